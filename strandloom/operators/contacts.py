"""Contact counting: bins, pixels at many resolutions, replicates, marginals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTIONS = (10_000_000, 5_000_000, 1_000_000, 500_000, 100_000, 40_000)


def in_labels(chrom: Column, labels: list[str] | None = None) -> Column:
    """Whether a chromosome is asked for: '#' stands for all numbers, no labels for everything."""
    if not labels:
        return F.lit(True)
    named = chrom.isin([x for x in labels if x != "#"])
    return named | chrom.rlike("^[0-9]+$") if "#" in labels else named


def bare_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def natural_order(chroms: DataFrame) -> DataFrame:
    """chroms(chrom, ..) with rank: numbers by value, then names."""
    number = F.when(F.col("chrom").rlike("^[0-9]{1,18}$"), F.col("chrom")).cast("long")
    return chroms.withColumn("rank", F.row_number().over(Window.orderBy(number.asc_nulls_last(), "chrom")).cast("long"))


def bins_table(genome_size: DataFrame, res: int) -> DataFrame:
    """(chrom, bin, bin_id, start, end) of genome_size(chrom, length): floor(length / res) + 1 bins a chromosome, ids in natural order."""
    g = natural_order(genome_size).withColumn("n", F.floor(F.col("length") / res) + 1)
    g = g.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = g.select("chrom", "length", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))
    return d.select("chrom", "bin", (F.col("first") + F.col("bin")).cast("long").alias("bin_id"), (F.col("bin") * res).cast("long").alias("start"), F.least(F.col("length"), (F.col("bin") + 1) * res).cast("long").alias("end"))


def bin_of(pos: Column, res: Column | int) -> Column:
    return F.floor(pos / res).cast("long")


def count_contacts(pairs: DataFrame, resolutions: list[int], at1: str = "frag1", at2: str = "frag2", keep: list[str] | None = None) -> DataFrame:
    """Pixels (res, chrom1, bin1, chrom2, bin2, n), upper triangle, of all resolutions in one pass.

    The lesser (chromosome, bin) end comes first. Contacts are counted at the finest resolution
    that divides the others before they are spread over those, so the shuffle carries pixels.
    """
    keep = keep or []
    res = sorted(set(resolutions))
    base = res[0] if all(r % res[0] == 0 for r in res) else None
    d = pairs.select(*keep, "chrom1", F.col(at1).alias("a"), "chrom2", F.col(at2).alias("b"))
    if base:
        d = d.select(*keep, "chrom1", bin_of(F.col("a"), base).alias("a"), "chrom2", bin_of(F.col("b"), base).alias("b")).groupBy(*keep, "chrom1", "a", "chrom2", "b").agg(F.count(F.lit(1)).alias("n"))
    else:
        d = d.withColumn("n", F.lit(1))
    d = d.withColumn("res", F.explode(F.array(*[F.lit(r) for r in res])))
    step = F.col("res") / base if base else F.col("res")
    x, y = F.struct(F.col("chrom1").alias("c"), bin_of(F.col("a"), step).alias("b")), F.struct(F.col("chrom2").alias("c"), bin_of(F.col("b"), step).alias("b"))
    d = d.select(*keep, "res", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "n")
    return d.groupBy(*keep, "res", F.col("x.c").alias("chrom1"), F.col("x.b").alias("bin1"), F.col("y.c").alias("chrom2"), F.col("y.b").alias("bin2")).agg(F.sum("n").cast("long").alias("n"))


def haplotype_pairs_unimputed(hap_pairs: DataFrame) -> DataFrame:
    """Pairs whose two ends have an allele, with haplotype-prefixed chromosomes."""
    k = F.col("hap_class")
    d = hap_pairs.where((k.isin("M_M", "P_P") & (F.col("resolved") == "Both")) | k.isin("M_P", "P_M"))
    return d.withColumns({"chrom1": F.concat(F.substring("hap_class", 1, 1), "chrom1"), "chrom2": F.concat(F.substring("hap_class", 3, 1), "chrom2")})


def haplotype_contacts(hap_pairs: DataFrame, resolutions: list[int]) -> DataFrame:
    """Unimputed haplotype pixels."""
    return count_contacts(haplotype_pairs_unimputed(hap_pairs), resolutions)


def imputed_intra_contacts(hap_pairs: DataFrame, resolutions: list[int]) -> DataFrame:
    """Directed pixels (res, chrom, bin1, bin2, n) of pairs within a chromosome with one known end.

    The row is the end with the allele. Ends known to be of one parent on one chromosome are
    taken to meet the same copy.
    """
    d = hap_pairs.where("chrom1 = chrom2 and hap_class in ('M_M', 'P_P') and resolved in ('R1', 'R2')")
    first = F.col("resolved") == "R1"
    d = d.select(F.concat(F.substring("hap_class", 1, 1), "chrom1").alias("chrom"), F.when(first, F.col("frag1")).otherwise(F.col("frag2")).alias("a"), F.when(first, F.col("frag2")).otherwise(F.col("frag1")).alias("b"))
    d = d.withColumn("res", F.explode(F.array(*[F.lit(r) for r in resolutions])))
    return d.groupBy("res", "chrom", bin_of(F.col("a"), F.col("res")).alias("bin1"), bin_of(F.col("b"), F.col("res")).alias("bin2")).agg(F.count(F.lit(1)).alias("n"))


def merge_replicates(*pixels: DataFrame) -> DataFrame:
    """The sum of pixel tables with the same columns, the last of which is the value."""
    d = pixels[0]
    for p in pixels[1:]:
        d = d.unionByName(p)
    *keys, value = d.columns
    return d.groupBy(*keys).agg(F.sum(value).alias(value))


def symmetric(pixels: DataFrame) -> DataFrame:
    """Both triangles of (chrom, bin1, bin2, value)."""
    swapped = pixels.where("bin1 <> bin2").select("chrom", F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "value")
    return pixels.select("chrom", "bin1", "bin2", "value").unionByName(swapped)


def marginals(pixels: DataFrame, n_bins: int) -> DataFrame:
    """(chrom, bin, row_sum, coverage) of every row with a non-zero cell of a full matrix; coverage counts implicit zeros."""
    return pixels.where("value <> 0").groupBy("chrom", F.col("bin1").alias("bin")).agg(F.sum("value").alias("row_sum"), (F.count(F.lit(1)) / n_bins).alias("coverage"))
