"""Connected components of a table of links, by repeated contraction (no links on the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, component) for every end of a link (a, b); the component is the smallest id it can reach.

    Every node points to its smallest neighbour if that is smaller, pointers
    are followed twice, links are renamed to the nodes pointed at, and what
    still joins two different nodes goes round again.  A round at least halves
    the nodes that have a smaller neighbour, so rounds grow with the logarithm.
    Null ends make no link.  ``parts`` bounds the partitions where links are few.
    """
    narrow = (lambda df: df.coalesce(parts)) if parts else (lambda df: df)
    edges = links.where("a <> b").select("a", "b")
    edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(narrow(narrow(edges).distinct()))
    nodes = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        parent = narrow(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = narrow(parent.join(up, "p").select("a", F.col("pp").alias("p")))
        parent = cut_lineage(parent)
        nodes = narrow(nodes.join(parent.withColumnRenamed("a", "component"), "component", "left")
                       .select("id", F.coalesce("p", "component").alias("component")))
        ends = [parent.select(F.col("a").alias(e), F.col("p").alias(f"{e}p")) for e in ("a", "b")]
        edges = narrow(edges.join(ends[0], "a")).join(ends[1], "b").where("ap <> bp")
        edges = cut_lineage(narrow(narrow(edges.select(F.col("ap").alias("a"), F.col("bp").alias("b"))).distinct()))
    return cut_lineage(nodes)
