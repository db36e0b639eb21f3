"""Interaction pairs: duplicates, ligation artefacts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

LIBRARY_SIZE = 500
PAIR_KEY = ["chrom1", "flag1", "pos1", "chrom2", "flag2", "pos2"]


def drop_duplicates(pairs: DataFrame) -> DataFrame:
    """The pair with the smallest name of each (chrom, strand, position) of both mates.

    A partial aggregate before the shuffle keeps one row a key and task; mates are not swapped.
    """
    rest = [c for c in pairs.columns if c not in PAIR_KEY]
    first = F.min(F.struct("name", *[c for c in rest if c != "name"])).alias("p")
    return pairs.groupBy(*PAIR_KEY).agg(first).select(*PAIR_KEY, "p.*").select(*pairs.columns)


def mark_duplicates(pairs: DataFrame) -> DataFrame:
    """pairs with dup_rank: 1 for the survivor, higher for its duplicates."""
    return pairs.withColumn("dup_rank", F.row_number().over(Window.partitionBy(*PAIR_KEY).orderBy("name")).cast("long"))


def artefact_class(library_size: int = LIBRARY_SIZE) -> Column:
    """SC (self-circle), DE (dangling end), UM (unknown), ED (extra dangling end) or VALID, of columns with frag1, frag2."""
    c = F.col
    forward = c("pos1") < c("pos2")
    inward, outward = (c("flag1") == 0) & (c("flag2") == 16), (c("flag1") == 16) & (c("flag2") == 0)
    inside = F.when(forward, F.when(inward, "DE").when(outward, "SC").otherwise("UM")).otherwise(F.when(inward, "SC").when(outward, "DE").otherwise("UM"))
    near = (F.abs(c("pos1") - c("pos2")) <= library_size) & ((forward & inward) | ((c("pos1") > c("pos2")) & outward))
    return F.when(c("chrom1") != c("chrom2"), "VALID").when(c("frag1") == c("frag2"), inside).when(near, "ED").otherwise("VALID")


def with_fragments(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """pairs with frag1 and frag2, the midpoints of their mates' fragments; mates outside all fragments drop the pair."""
    from .rangejoin import point_in_interval, width_for

    f = fragments.select("chrom", "start", "end", "mid")
    width = width_for(f)
    for k in ("1", "2"):
        pairs = point_in_interval(pairs, f, "chrom" + k, "pos" + k, width).withColumnRenamed("mid", "frag" + k).drop("start", "end")
    return pairs


def classify(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Pairs without duplicates, with fragments and their artefact class."""
    return with_fragments(drop_duplicates(pairs), fragments).withColumn("class", artefact_class())


def valid_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    return classify(pairs, fragments).where("class = 'VALID'").drop("class")


def filtering_stats(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row: total_pairs (before duplicates go), duplicates, and the count of each class."""
    total = pairs.agg(F.count(F.lit(1)).alias("total_pairs"))
    unique = drop_duplicates(pairs).agg(F.count(F.lit(1)).alias("u"))
    kinds = classify(pairs, fragments).agg(*[F.count_if(F.col("class") == k).alias("n_" + k.lower()) for k in ("SC", "DE", "UM", "ED", "VALID")])
    return total.crossJoin(unique).crossJoin(kinds).withColumn("duplicates", F.col("total_pairs") - F.col("u")).drop("u")


CLASSES = ("SC", "DE", "UM", "ED", "VALID")


def write_valid_pairs(pairs: DataFrame, fragments: DataFrame, path: str) -> dict[str, int]:
    """Write valid_pairs under path and return filtering_stats' counts, taken while the rows pass: one reading of the pairs.

    Pairs are counted before duplicates go, survivors after, classes where they are told.
    """
    before, after, kinds = Observation(), Observation(), Observation()
    seen = pairs.observe(before, F.count(F.lit(1)).alias("total_pairs"))
    unique = drop_duplicates(seen).observe(after, F.count(F.lit(1)).alias("unique"))
    told = with_fragments(unique, fragments).withColumn("class", artefact_class())
    told = told.observe(kinds, *[F.count_if(F.col("class") == k).alias("n_" + k.lower()) for k in CLASSES])
    told.where("class = 'VALID'").drop("class").write.mode("overwrite").parquet(path)
    total = before.get["total_pairs"]
    return {"total_pairs": total, **kinds.get, "duplicates": total - after.get["unique"]}


def merged_stats(parts: list[dict[str, int]]) -> dict[str, int]:
    """The counts of chunks, added up."""
    return {k: sum(p[k] for p in parts) for k in (parts[0] if parts else {})}
