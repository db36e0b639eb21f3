"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _checksum(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node reachable.

    Large-star and small-star steps alternate until the edge set is stable; each step is one
    aggregate and one join on a node, so no neighbourhood is collected into one row. Every
    step is written to the shared folder, which keeps the lineage short. Null ends are dropped,
    loops and repeated edges are allowed; an empty table gives an empty result.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _checksum(e)
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        new = _checksum(nxt)
        discard(e) if state[0] else None
        e, done, state = nxt, new == state, new
        if done:
            break
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(e.select("b", "b").distinct())
