"""Order statistics of all differences of two lists, without forming them.

Both lists are cut into blocks of ascending values with counts. For a block of thresholds and a
block of b's, the blocks of a fall into three: those below in full, which count by their prefix
sums, those above, and a narrow band of blocks where single values decide. Only the band's
values meet, by a join on block numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.store import Scope

#: Distinct values of a block, about.
BLOCK = 4096


def value_blocks(values: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """(b, lo, hi, n, vs, ks): distinct values of a column in blocks by value, with how often each occurs and how many there are."""
    per = values.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    # Sorted ranges are numbered one by one: blocks come from places in the order, not from values.
    sorted_ = per.repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id())
    own = F.floor((F.row_number().over(Window.partitionBy("p").orderBy("v")) - 1) / block)
    rows = sorted_.withColumn("own", own).groupBy("p", "own").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("v", "k"))).alias("x"))
    return rows.select(F.struct("p", "own").alias("b"), "lo", "hi", "n", F.col("x.v").alias("vs"), F.col("x.k").alias("ks"))


def _bounds(blocks: DataFrame) -> DataFrame:
    """Blocks' numbers in ascending order with the count of all values before each: few rows, of blocks."""
    order = Window.orderBy("lo")
    return blocks.select("b", "lo", "hi", "n", (F.row_number().over(order) - 1).alias("at"), (F.sum("n").over(order) - F.col("n")).alias("before"))


def differences_below(a: DataFrame, b: DataFrame, thresholds: DataFrame, scope: Scope, block: int = BLOCK) -> DataFrame:
    """(x, below): for each distinct threshold, how many pairs of a(v) and b(v) have a - b < x.

    Differences are taken in double precision before they are compared, which rounding keeps in
    order; so a threshold that is itself a difference never lies below itself.
    """
    xs = scope.stored(value_blocks(thresholds, "x", block).select(F.col("b").alias("xb"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("vs").alias("xs")), "thresholds")
    bs = scope.stored(value_blocks(b, "v", block).select(F.col("b").alias("bb"), F.col("lo").alias("b0"), F.col("hi").alias("b1"), F.col("n").alias("bn"), F.col("vs").alias("bv"), F.col("ks").alias("bk")), "subtrahends")
    held = scope.stored(value_blocks(a, "v", block), "minuends")
    edges = scope.stored(_bounds(held), "edges")
    # A pair of blocks for every two blocks' values: the thresholds stand against all b's, block by block.
    pairs = xs.select("xb", "x0", "x1").crossJoin(bs.select("bb", "b0", "b1", "bn"))
    full = F.col("hi") - F.col("b0") < F.col("x0")
    none = F.col("lo") - F.col("b1") >= F.col("x1")
    # Blocks that are below in full are a prefix of the order, those above a suffix.
    both = pairs.crossJoin(F.broadcast(edges))  # one row for each BLOCK distinct values of a
    spans = both.groupBy("xb", "bb", "bn").agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("sure"), F.array_compact(F.collect_list(F.when(~full & ~none, F.col("b")))).alias("band"))
    spans = scope.stored(spans, "spans")
    sure = spans.groupBy("xb").agg(F.sum(F.col("sure") * F.col("bn")).alias("sure"))
    band = spans.select("xb", "bb", F.explode("band").alias("b")).join(bs.select("bb", "bv", "bk"), "bb").join(held.select("b", "vs", "ks"), "b").join(xs.select("xb", "xs"), "xb")

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("xb").slice(i, 1)
                x, bv, bk, av, ak = (batch.column(c)[i].values.to_numpy() for c in ("xs", "bv", "bk", "vs", "ks"))
                upto = np.concatenate([[0], np.cumsum(ak)])
                below = np.zeros(len(x), np.int64)
                for v, k in zip(bv, bk):
                    below += k * upto[np.searchsorted(av - v, x, "left")]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([key] * len(x)), pa.array(x), pa.array(below)], ["xb", "x", "below"])

    kind = dict(xs.dtypes)["xb"]
    some = band.select("xb", "xs", "bv", "bk", "vs", "ks").mapInArrow(count, f"xb {kind}, x double, below long").groupBy("x").agg(F.sum("below").alias("some"))
    every = xs.select("xb", F.explode("xs").alias("x"))
    d = every.join(sure, "xb").join(some, "x", "left")
    return d.select("x", (F.col("sure") + F.coalesce("some", F.lit(0))).alias("below"))
