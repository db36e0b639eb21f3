"""Range joins as equi-joins on coarse buckets of the coordinate.

A bare range predicate would plan as a nested loop over one broadcast side; with a bucket key
both sides are hashed or sorted, and a long chromosome spreads over its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def buckets_of(start: Column, end: Column, width: int) -> Column:
    """Each bucket that [start, end] touches, to explode."""
    return F.sequence(bucket_of(start, width), bucket_of(end, width))


def width_for(intervals: DataFrame) -> int:
    """A bucket width near the mean length of intervals(start, end), a power of two: as many buckets as intervals.

    Apart intervals with whole ends then put about two of them into a bucket, and never more than
    the width, whatever their number.
    """
    mean = intervals.agg(F.avg(F.col("end") - F.col("start")).alias("mean")).first()["mean"]
    return 1 << max(4, math.ceil(math.log2(max(1.0, mean or 1.0))))


def point_in_interval(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, width: int | None = None, how: str = "inner") -> DataFrame:
    """points with the interval (start, pos] of intervals(chrom, start, end, ..) that they lie in.

    Intervals are left-open and right-closed; position 1 belongs to the interval that starts
    there. Points outside all intervals are dropped by an inner join, and null by a left one.
    Without a width, width_for reads the intervals for one.
    """
    width = width or width_for(intervals)
    i = intervals.withColumnsRenamed({"chrom": "__chrom"}).withColumn("__bucket", F.explode(buckets_of(F.col("start"), F.col("end"), width)))
    p = F.col(pos)
    inside = (F.col(chrom) == F.col("__chrom")) & (bucket_of(p, width) == F.col("__bucket")) & (p <= F.col("end")) & ((p > F.col("start")) | ((p == 1) & (F.col("start") == 1) & (F.col("end") >= 1)))
    return points.join(i, inside, how).drop("__chrom", "__bucket")


def points_in_spans(spans: DataFrame, points: DataFrame, chrom: str, start: str, length: str, width: int = 5_000) -> DataFrame:
    """Rows of spans with every row of points(chrom, pos, ..) in [start, start + length), inner."""
    first, last = F.col(start), F.col(start) + F.col(length) - 1
    s = spans.withColumn("__bucket", F.explode(buckets_of(first, last, width)))
    p = points.withColumnsRenamed({"chrom": "__chrom", "pos": "__pos"}).withColumn("__at", bucket_of(F.col("__pos"), width))
    hit = (F.col(chrom) == F.col("__chrom")) & (F.col("__bucket") == F.col("__at")) & F.col("__pos").between(first, last)
    return s.join(p, hit).withColumnRenamed("__pos", "snp_pos").drop("__chrom", "__bucket", "__at")
