"""riskloom: transaction-risk analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; nothing
is collected except bounded control values (grids, cut points, offsets).
"""

__all__ = ["session"]
