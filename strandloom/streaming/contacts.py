"""Contact counting over arriving pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.contacts import bin_of


def stream_pairs(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def count_stream(pairs: DataFrame, res: int, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Running pixels (chrom1, bin1, chrom2, bin2, n) of a stream of pairs(name, chrom1, frag1, chrom2, frag2, ..).

    With a time column, a pair that comes again within the delay counts once; its state is kept
    for that long only.
    """
    if time is not None:
        pairs = pairs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["name"])
    x = F.struct(F.col("chrom1").alias("c"), bin_of(F.col("frag1"), res).alias("b"))
    y = F.struct(F.col("chrom2").alias("c"), bin_of(F.col("frag2"), res).alias("b"))
    d = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    return d.groupBy(F.col("x.c").alias("chrom1"), F.col("x.b").alias("bin1"), F.col("y.c").alias("chrom2"), F.col("y.b").alias("bin2")).agg(F.count(F.lit(1)).alias("n"))
