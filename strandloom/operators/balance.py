"""Matrix correction: gaps, SNP density, symmetry, vanilla coverage, iterative balancing.

Matrices are full pixel tables (chrom, bin1, bin2, value) without zeros; sizes(chrom, n) has a
chromosome's number of bins. Averages and percentiles count implicit zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.store import Scope, stored

VC_POWER = 2 / 3


def grid(sizes: DataFrame) -> DataFrame:
    """(chrom, bin) of every bin."""
    return sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))


def row_sums(m: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, bin, row_sum, coverage), empty rows included."""
    s = m.where("value <> 0").groupBy("chrom", F.col("bin1").alias("bin")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    return grid(sizes).join(s, ["chrom", "bin"], "left").join(sizes, "chrom").select("chrom", "bin", F.coalesce("s", F.lit(0.0)).alias("row_sum"), (F.coalesce("c", F.lit(0)) / F.col("n")).alias("coverage"))


def local_gaps(m: DataFrame, sizes: DataFrame, most: float = 0.2) -> DataFrame:
    """(chrom, bin) with a coverage below 0.2 and below the first quartile of the chromosome's non-zero coverages."""
    r = row_sums(m, sizes)
    q = r.where("coverage > 0").groupBy("chrom").agg(F.percentile("coverage", F.lit(0.25)).alias("q"))
    return r.join(q, "chrom", "left").where(F.col("coverage") < F.least(F.lit(most), F.coalesce("q", F.lit(most)))).select("chrom", "bin")


def low_resolution_gaps(m: DataFrame, sizes: DataFrame, most: float = 0.1) -> DataFrame:
    return row_sums(m, sizes).where(F.col("coverage") < most).select("chrom", "bin")


def snp_factor(t: DataFrame, m: DataFrame, p: DataFrame, sizes: DataFrame, gaps_m: DataFrame, gaps_p: DataFrame) -> DataFrame:
    """(chrom, bin, alpha): phased share of a bin's contacts, over the largest of the non-gap bins.

    Zero counts as 1; values are raised to the 20th percentile of the non-gap bins. A bin is a
    gap here if it is one of both parents.
    """
    rt, rm, rp = (row_sums(x, sizes).select("chrom", "bin", F.col("row_sum").alias(c)) for x, c in ((t, "t"), (m, "m"), (p, "p")))
    both = gaps_m.join(gaps_p, ["chrom", "bin"], "left_semi").withColumn("gap", F.lit(True))
    a = rt.join(rm, ["chrom", "bin"]).join(rp, ["chrom", "bin"]).join(both, ["chrom", "bin"], "left")
    a = a.select("chrom", "bin", ((F.col("m") + F.col("p")) / (F.col("t") + 1)).alias("a"), F.col("gap").isNull().alias("used"))
    return _shares(a).select("chrom", "bin", "alpha")


def _shares(a: DataFrame) -> DataFrame:
    """a(chrom, .., used, a) with alpha: a over the largest used one, 1 for 0, and not below the used ones' 20th percentile."""
    top = a.groupBy("chrom").agg(F.max(F.when(F.col("used"), F.col("a"))).alias("top"))
    a = a.join(top, "chrom").withColumn("a", F.col("a") / F.col("top")).drop("top")
    a = a.withColumn("a", F.when(F.col("a") == 0, 1.0).otherwise(F.col("a")))
    low = a.where("used").groupBy("chrom").agg(F.percentile("a", F.lit(0.2)).alias("low"))
    return a.join(low, "chrom").withColumn("alpha", F.greatest("a", "low")).drop("low")


def scale_rows(m: DataFrame, factor: DataFrame) -> DataFrame:
    f = factor.select("chrom", F.col("bin").alias("bin1"), "alpha")
    return m.join(f, ["chrom", "bin1"]).select("chrom", "bin1", "bin2", (F.col("value") / F.col("alpha")).alias("value"))


def symmetrise_sum(m: DataFrame) -> DataFrame:
    """The sum of a cell and its mirror; the diagonal stays."""
    mirror = m.where("bin1 <> bin2").select("chrom", F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "value")
    return m.select("chrom", "bin1", "bin2", "value").unionByName(mirror).groupBy("chrom", "bin1", "bin2").agg(F.sum("value").alias("value"))


def symmetrise_mean(m: DataFrame, gaps: DataFrame) -> DataFrame:
    """The mean of a cell and its mirror, a missing one counting as zero; between two gaps the larger one; the diagonal stays."""
    mirror = m.where("bin1 <> bin2").select("chrom", F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "value")
    both = m.select("chrom", "bin1", "bin2", "value").unionByName(mirror).groupBy("chrom", "bin1", "bin2").agg(F.sum("value").alias("s"), F.max("value").alias("top"))
    for k in ("1", "2"):
        g = gaps.select("chrom", F.col("bin").alias("bin" + k)).distinct().withColumn("gap" + k, F.lit(True))
        both = both.join(g, ["chrom", "bin" + k], "left")
    v = F.when(F.col("bin1") == F.col("bin2"), F.col("s")).when(F.col("gap1") & F.col("gap2"), F.col("top")).otherwise(F.col("s") / 2)
    return both.select("chrom", "bin1", "bin2", v.alias("value"))


def vc_correct(m: DataFrame, power: float = VC_POWER) -> DataFrame:
    """Cells over the powers of both their rows' sums."""
    s = m.groupBy("chrom", "bin1").agg(F.sum("value").alias("s"))
    s = s.select("chrom", F.col("bin1").alias("bin"), F.when(F.col("s") == 0, 1.0).otherwise(F.pow("s", F.lit(power))).alias("w"))
    for k in ("1", "2"):
        m = m.join(s.select("chrom", F.col("bin").alias("bin" + k), F.col("w").alias("w" + k)), ["chrom", "bin" + k])
    return m.select("chrom", "bin1", "bin2", (F.col("value") / (F.col("w1") * F.col("w2"))).alias("value"))


def keep_mean(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """after, scaled to the mean of before: over the same cells, the ratio of their sums."""
    by = ["chrom"] if by is None else by
    x = before.groupBy(*by).agg(F.sum("value").alias("x"))
    y = after.groupBy(*by).agg(F.sum("value").alias("y"))
    r = x.join(y, by) if by else x.crossJoin(y)
    d = after.join(r, by) if by else after.crossJoin(F.broadcast(r))
    return d.select("chrom", "bin1", "bin2", (F.col("value") * F.col("x") / F.col("y")).alias("value"))


def two_step_local(t: DataFrame, m: DataFrame, p: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected maternal and paternal matrices of chromosomes: SNP density, symmetry, coverage, mean."""
    # Per-bin tables, small beside the pixels, are computed once.
    gm, gp = stored(local_gaps(m, sizes), "gaps"), stored(local_gaps(p, sizes), "gaps")
    f = stored(snp_factor(t, m, p, sizes, gm, gp), "factor")
    fix = lambda x, g: keep_mean(x, vc_correct(symmetrise_mean(scale_rows(x, f), g)))
    return fix(m, gm), fix(p, gp)


def two_step_global(h: DataFrame, factor: DataFrame) -> DataFrame:
    """The corrected matrix of all haplotype chromosomes at once: h on global bins under one chrom label, factor by global bin."""
    return keep_mean(h, vc_correct(symmetrise_sum(scale_rows(h, factor))), [])


def global_factor(t: DataFrame, h: DataFrame, sizes: DataFrame, most_gap: float = 0.1) -> DataFrame:
    """(chrom, bin, alpha) of the genome's bins, from the unphased chromosomes' full matrices t(chrom, bin1, bin2, value) and the phased directed pixels h.

    h is (chrom1, bin1, chrom2, bin2, value) with M or P before the genome's names. Gaps are the
    unphased chromosomes' bins that cover under most_gap of them.
    """
    own = lambda x: h.where((F.col("chrom1") == F.col("chrom2")) & F.col("chrom1").startswith(x)).select(F.expr("substr(chrom1, 2)").alias("chrom"), "bin1", "bin2", "value")
    gaps = low_resolution_gaps(t, sizes, most_gap)
    return snp_factor(t, own("M"), own("P"), sizes, gaps, gaps)


def correct_global(t: DataFrame, h: DataFrame, sizes: DataFrame, bins: DataFrame, most_gap: float = 0.1) -> DataFrame:
    """(chrom1, bin1, chrom2, bin2, value): the corrected matrix of all phased chromosomes, its factor built from t and h (see global_factor).

    bins(chrom, bin, gbin) numbers the phased genome's bins.
    """
    one = F.lit("all").alias("chrom")
    f = stored(global_factor(t, h, sizes, most_gap), "global-factor")
    for k in "12":
        h = h.join(bins.select(F.col("chrom").alias("chrom" + k), F.col("bin").alias("bin" + k), F.col("gbin").alias("g" + k)), ["chrom" + k, "bin" + k])
    whole = bins.withColumn("place", F.expr("substr(chrom, 2)")).join(f.select(F.col("chrom").alias("place"), "bin", "alpha"), ["place", "bin"])
    d = two_step_global(h.select(one, F.col("g1").alias("bin1"), F.col("g2").alias("bin2"), "value"), whole.select(one, F.col("gbin").alias("bin"), "alpha"))
    for k in "12":
        d = d.join(bins.select(F.col("gbin").alias("bin" + k), F.col("chrom").alias("chrom" + k), F.col("bin").alias("b" + k)), "bin" + k)
    return d.select("chrom1", F.col("b1").alias("bin1"), "chrom2", F.col("b2").alias("bin2"), "value")


def ice_weights(m: DataFrame, iterations: int = 200, tolerance: float = 1e-5, ignore_diagonals: int = 1, with_spread: bool = False) -> DataFrame | tuple[DataFrame, float]:
    """(chrom, bin, bias): iterative correction of a symmetric full matrix within chromosomes; corrected value = value / (bias1 * bias2).

    Each round divides the biases by the rows' sums over their mean. Rounds stop when the
    variance of the relative sums is below the tolerance. Biases are scaled so that the
    corrected rows of a chromosome sum to 1 on average. A round is written out and the one before
    deleted: lost executors cost one round, and the disk used does not grow with rounds. With
    with_spread the last variance, of the chromosome where it is largest, comes too.
    """
    with Scope(m.sparkSession) as scope:
        m = scope.stored(m.where(F.abs(F.col("bin1") - F.col("bin2")) >= ignore_diagonals).where("value <> 0").select("chrom", "bin1", "bin2", "value"), "pixels")
        held = scope.stored(m.groupBy("chrom", F.col("bin1").alias("bin")).agg(F.lit(1.0).alias("bias")), "bias")

        def sums(b: DataFrame) -> DataFrame:
            b1, b2 = (b.select("chrom", F.col("bin").alias("bin" + k), F.col("bias").alias("b" + k)) for k in "12")
            v = m.join(b1, ["chrom", "bin1"]).join(b2, ["chrom", "bin2"])
            return v.groupBy("chrom", F.col("bin1").alias("bin")).agg(F.sum(F.col("value") / (F.col("b1") * F.col("b2"))).alias("s"))

        worst = None
        for _ in range(iterations):
            s = sums(held)
            mean = s.groupBy("chrom").agg(F.mean("s").alias("mean"))
            new = scope.stored(held.select("chrom", "bin", "bias").join(s, ["chrom", "bin"]).join(mean, "chrom").select("chrom", "bin", (F.col("bias") * F.col("s") / F.col("mean")).alias("bias"), (F.col("s") / F.col("mean")).alias("rel")), "bias")
            scope.drop(held)
            held = new
            if tolerance > 0 or with_spread:
                worst = new.groupBy("chrom").agg(F.var_pop("rel").alias("v")).agg(F.max("v")).first()[0]
                if worst is None or worst < tolerance:
                    break
        mean = sums(held).groupBy("chrom").agg(F.mean("s").alias("mean"))
        out = stored(held.join(mean, "chrom").select("chrom", "bin", (F.col("bias") * F.sqrt("mean")).alias("bias")), "ice-bias")
    return (out, worst or 0.0) if with_spread else out


def apply_bias(m: DataFrame, bias: DataFrame) -> DataFrame:
    for k in "12":
        m = m.join(bias.select("chrom", F.col("bin").alias("bin" + k), F.col("bias").alias("b" + k)), ["chrom", "bin" + k])
    return m.select("chrom", "bin1", "bin2", (F.col("value") / (F.col("b1") * F.col("b2"))).alias("value"))
