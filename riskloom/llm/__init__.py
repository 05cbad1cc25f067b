"""Training-data operators: scans, classifiers, near-duplicate and exact-repeat search, packing, nearest neighbours.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLE`` are what the driver entry adds when the package exists.
"""
