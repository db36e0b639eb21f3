"""Allele specificity of loops, boundaries and compartments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.stats import bh_adjust, normal_two_sided, one_proportion_z, t_two_sided
from strandloom.sources.store import Scope, stored

from .orderstats import BLOCK, differences_below

OFFSET, ZERO_SHARE = 10, 0.85


def loop_specificity(loops: DataFrame, maternal: DataFrame, paternal: DataFrame, legacy: bool = False) -> DataFrame:
    """loops(chrom, m1, m2, p1, p2) in bins -> M and P values, share test (z), log2 fold change, rank of the mean.

    Tested are loops with a value of either parent whose mean is not above the 95th percentile of
    the non-zero (floored) means of all loops; the expected share is theirs. With legacy, that
    percentile is taken over the numbers 0, 1, ... of those means instead of over them. rank_ratio
    is the share of all non-zero means that are smaller; it and log2fc are null where z is.
    """
    look = lambda d, m, s: d.join(m.select("chrom", F.col("bin1").alias(s + "1"), F.col("bin2").alias(s + "2"), F.col("value").alias(s)), ["chrom", s + "1", s + "2"], "left")
    d = look(look(loops, maternal, "m"), paternal, "p").na.fill(0.0, ["m", "p"])
    d = d.withColumn("mean", F.floor((F.col("m") + F.col("p")) / 2))
    # The share of non-zero means that are smaller: few rows, ranked in one window.
    some = F.col("mean") > 0
    d = d.withColumn("rank_ratio", F.when(some, (F.rank().over(Window.partitionBy(some).orderBy("mean")) - 1) / F.count(F.lit(1)).over(Window.partitionBy(some))).otherwise(0.0))
    most = F.lit(0.95) * (F.count_if(some) - 1) if legacy else F.percentile(F.when(some, F.col("mean")), F.lit(0.95))
    d = d.crossJoin(F.broadcast(d.agg(most.alias("most")))).where((F.col("m") != 0) & (F.col("p") != 0) & ((F.col("m") + F.col("p")) / 2 <= F.col("most"))).drop("most")
    ratio = d.agg((F.sum("m") / F.sum(F.col("m") + F.col("p"))).alias("p0"))
    d = d.crossJoin(F.broadcast(ratio)).withColumn("z", one_proportion_z(F.col("m"), F.col("m") + F.col("p"), F.col("p0")))
    tested = F.col("z").isNotNull()
    return d.withColumn("log2fc", F.when(tested, F.log2(F.col("m") / F.col("p")))).withColumn("rank_ratio", F.when(tested, F.col("rank_ratio")))


def loop_specificity_tested(loops: DataFrame, maternal: DataFrame, paternal: DataFrame) -> DataFrame:
    d = loop_specificity(loops, maternal, paternal)
    return bh_adjust(d.withColumn("pvalue", F.when(F.col("z").isNotNull(), normal_two_sided("z"))), "pvalue", "qvalue")


def boundary_samples(boundaries: DataFrame, m: DataFrame, offset: int = OFFSET) -> DataFrame:
    """(chrom, b, i, j, x): lower triangle of the block across each boundary b of a full matrix, over the mean of the non-zero cells of the three blocks around it.

    Rows i are [b - offset, b), columns j are [b, b + offset); zeros of the block are rows too.
    """
    b = boundaries.select("chrom", F.col("bin").alias("b")).distinct()
    side = lambda lo, hi: F.explode(F.sequence(F.col("b") + lo, F.col("b") + hi - 1))
    block = b.withColumn("i", side(-offset, 0)).withColumn("j", side(0, offset))
    values = m.select("chrom", F.col("bin1").alias("i"), F.col("bin2").alias("j"), "value")
    whole = b.withColumn("i", side(-offset, offset)).withColumn("j", side(-offset, offset)).where("not (i >= b and j < b)")
    mean = whole.join(values, ["chrom", "i", "j"]).where("value <> 0").groupBy("chrom", "b").agg(F.avg("value").alias("mean"))
    x = block.where((F.col("i") - (F.col("b") - offset)) >= (F.col("j") - F.col("b"))).join(values, ["chrom", "i", "j"], "left").join(mean, ["chrom", "b"], "left")
    return x.select("chrom", "b", "i", "j", F.coalesce(F.col("value") / F.col("mean"), F.lit(0.0)).alias("x"))


def paired_t(m: DataFrame, p: DataFrame) -> DataFrame:
    """(chrom, b, n, m_mean, p_mean, t) of two sample tables, over the cells where both are non-zero; null t without spread.

    A boundary of which either sample is zeros to 85 % or more is left out.
    """
    thin = lambda s: s.groupBy("chrom", "b").agg(F.avg((F.col("x") == 0).cast("double")).alias("z")).where(F.col("z") < ZERO_SHARE).select("chrom", "b")
    d = m.withColumnRenamed("x", "xm").join(p.withColumnRenamed("x", "xp"), ["chrom", "b", "i", "j"]).join(thin(m), ["chrom", "b"], "left_semi").join(thin(p), ["chrom", "b"], "left_semi")
    d = d.where("xm <> 0 and xp <> 0").withColumn("diff", F.col("xm") - F.col("xp"))
    d = d.groupBy("chrom", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("xm").alias("m_mean"), F.avg("xp").alias("p_mean"), F.avg("diff").alias("a"), F.stddev_samp("diff").alias("s"))
    return d.select("chrom", "b", "n", "m_mean", "p_mean", F.when((F.col("n") > 1) & (F.col("s") > 1e-12), F.col("a") / (F.col("s") / F.sqrt("n"))).alias("t"))


def boundary_specificity(candidates: DataFrame, maternal: DataFrame, paternal: DataFrame, offset: int = OFFSET) -> DataFrame:
    """candidates(chrom, m_bin, p_bin): the paired test at the shared boundary, or at the better of two, with p and BH q."""
    at = candidates.select("chrom", F.explode(F.array("m_bin", "p_bin")).alias("bin")).distinct()
    t = paired_t(boundary_samples(at, maternal, offset), boundary_samples(at, paternal, offset))
    t = t.withColumn("pvalue", F.when(F.col("t").isNotNull(), t_two_sided("t", (F.col("n") - 1).cast("double"))))
    both = candidates.select("chrom", "m_bin", "p_bin", F.explode(F.array_distinct(F.array("m_bin", "p_bin"))).alias("b")).join(t, ["chrom", "b"])
    best = both.where("pvalue is not null").groupBy("chrom", "m_bin", "p_bin").agg(F.min(F.struct("pvalue", "b", "m_mean", "p_mean", "t", "n")).alias("x")).select("chrom", "m_bin", "p_bin", "x.*")
    return bh_adjust(best, "pvalue", "qvalue")


def compartment_specificity(maternal: DataFrame, paternal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chrom, bin, m, p, diff, pvalue, qvalue): bins (chrom, bin, pc) of opposite sign, against all differences m - p of such bins; q by Benjamini-Hochberg.

    A maternal chromosome that correlates negatively is flipped. A bin's rank is the number of
    (a, b) with m_a - p_b below its own difference; the smaller of it and its complement, over
    all pairs, is the p-value.
    """
    d = maternal.select("chrom", "bin", F.col("pc").alias("m")).join(paternal.select("chrom", "bin", F.col("pc").alias("p")), ["chrom", "bin"])
    r = d.groupBy("chrom").agg(F.corr("m", "p").alias("r"))
    d = d.join(r, "chrom").select("chrom", "bin", F.when(F.col("r") < 0, -F.col("m")).otherwise(F.col("m")).alias("m"), "p").where("m * p < 0")
    with Scope(d.sparkSession) as scope:
        diff = scope.stored(d.withColumn("diff", F.col("m") - F.col("p")), "candidates")
        below = differences_below(diff.select(F.col("m").alias("v")), diff.select(F.col("p").alias("v")), diff.select(F.col("diff").alias("x")), scope, block)
        n = F.col("n") * F.col("n")
        all_ = diff.agg(F.count(F.lit(1)).alias("n"))
        ranked = diff.join(below, F.col("diff") == F.col("x")).crossJoin(F.broadcast(all_))  # one row
        ranked = ranked.select("chrom", "bin", "m", "p", "diff", (F.least(F.col("below"), n - F.col("below")) / n).alias("pvalue"))
        return stored(bh_adjust(ranked, "pvalue", "qvalue"), "compartment-specificity")
