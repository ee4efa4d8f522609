"""Connected components of a link table, for graphs of any size and degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm._common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a long, b long); the root
    is the smallest node of the component.

    Alternates large-star and small-star steps until every node points at its
    root. A step takes each node's smallest neighbour by a map-side combined
    aggregate and joins it back, so the links of a node of any degree stay
    spread over tasks (skewed joins are split at run time). Every round is
    written to the shared checkpoint folder. Self links and repeated rows are
    harmless; rows with a null end are ignored; an empty table gives no rows.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = materialise(edges, "links")
    mark = _fingerprint(edges)
    while mark[0]:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        new = _fingerprint(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
