"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's larger (or smaller) neighbours move to its least neighbour."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.hint("merge").join(least.hint("merge"), "u")
    out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    )
    return out.filter("u <> v").distinct()


def components(links: DataFrame, work: Workspace, name: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of links (columns a, b: long).

    component is the least id that links reach. Nodes without links are not
    listed. Rows with a null end and self links are ignored. Each round is
    written to the shared folder; the number of rounds grows with the logarithm
    of the longest path.
    """
    edges = work.written(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    before = None
    for k in range(1, max_rounds + 1):
        edges = work.written(_star(_star(edges, True), False), f"{name}-{k}")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        work.drop(f"{name}-{k - 1}")
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
