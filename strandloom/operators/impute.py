"""Imputation of contacts between chromosomes whose one end has no allele."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contacts import bin_of

REGION, LEAST, RATIO = 10_000_000, 2, 0.9


def offsets(spark: SparkSession, res: int, region: int = REGION) -> DataFrame:
    """(di, dj): cells of the neighbourhood, relative to the contact: those within sqrt(L) of (1, 1), L = region // res."""
    side = region // res
    reach = math.sqrt(side)
    cells = [(i - side, j - side) for i in range(2 * side + 1) for j in range(2 * side + 1) if math.hypot(i - side - 1, j - side - 1) < reach]
    return spark.createDataFrame(cells, "di long, dj long")


def impute_inter(hap_pairs: DataFrame, unimputed: DataFrame, bins: DataFrame, res: int, region: int = REGION, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """(bin1, bin2, n) on global haplotype bin ids: contacts between chromosomes with one known end, placed on a copy.

    unimputed(bin1, bin2, n) is symmetric, on the ids of bins(chrom, bin, bin_id), chrom with the
    haplotype's letter. The contacts around the two possible targets vote: a copy with `least`
    of them and more than `ratio` of both wins. Contacts at the matrix's border are left out.
    """
    spark = hap_pairs.sparkSession
    side = region // res
    d = hap_pairs.where("chrom1 <> chrom2 and hap_class in ('M_M', 'P_P') and resolved in ('R1', 'R2')")
    first = F.col("resolved") == "R1"
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    d = d.select(F.concat(F.substring("hap_class", 1, 1), pick("chrom1", "chrom2")).alias("c_a"), bin_of(pick("frag1", "frag2"), res).alias("b_a"), pick("chrom2", "chrom1").alias("c_t"), bin_of(pick("frag2", "frag1"), res).alias("b_t"))
    d = d.groupBy("c_a", "b_a", "c_t", "b_t").agg(F.count(F.lit(1)).alias("n"))
    ids = lambda name: bins.select(F.col("chrom").alias("c_" + name), F.col("bin").alias("b_" + name), F.col("bin_id").alias(name))
    d = d.join(ids("a"), ["c_a", "b_a"])
    for h in "MP":
        t = ids("t").withColumnRenamed("t", h).where(F.substring("c_t", 1, 1) == h).withColumn("c_t", F.expr("substr(c_t, 2)"))
        d = d.join(t, ["c_t", "b_t"])
    size = bins.agg((F.max("bin_id") + 1).alias("size"))
    inner = lambda c: (F.col(c) >= side) & (F.col(c) + side + 1 <= F.col("size"))
    d = d.crossJoin(F.broadcast(size)).where(inner("a") & inner("M") & inner("P")).select("a", "M", "P", "n")
    near = d.select("a", "M", "P").distinct().crossJoin(F.broadcast(offsets(spark, res, region)))
    near = near.select("a", "M", "P", (F.col("a") + F.col("di")).alias("bin1"), F.explode(F.array(F.struct(F.lit("M").alias("h"), (F.col("M") + F.col("dj")).alias("t")), F.struct(F.lit("P").alias("h"), (F.col("P") + F.col("dj")).alias("t")))).alias("x"))
    near = near.select("a", "M", "P", "bin1", "x.h", F.col("x.t").alias("bin2")).join(unimputed.select("bin1", "bin2", F.col("n").alias("v")), ["bin1", "bin2"])
    sums = near.groupBy("a", "M", "P").agg(F.sum(F.when(F.col("h") == "M", F.col("v")).otherwise(0)).alias("sm"), F.sum(F.when(F.col("h") == "P", F.col("v")).otherwise(0)).alias("sp"))
    both = F.col("sm") + F.col("sp")
    target = F.when((F.col("sm") >= least) & (F.col("sm") / both > ratio), F.col("M")).when((F.col("sp") >= least) & (F.col("sp") / both > ratio), F.col("P"))
    won = d.join(sums, ["a", "M", "P"]).select(F.col("a").alias("bin1"), target.alias("bin2"), "n").where("bin2 is not null")
    return won.groupBy("bin1", "bin2").agg(F.sum("n").cast("long").alias("n"))
