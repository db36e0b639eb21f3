"""Mixing sources to target weights, by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated when its target is above
its size. A queued document's virtual finish time is the source's words up to its end, over the
source's target; served in the order of finish times, all sources reach their targets together
at time 1. The global order is a prefix sum over finish times, and the mix is what lies within
the total budget; the document that straddles its source's end is cut there.

All sums over ordered rows are taken in two levels (buckets of a bounded number of rows, then
the buckets' totals), so a source with any share of the rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, old_names, own_names

_BUCKET_ROWS = 8000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> with weight, target.

    Sources in code point order, null last, get the weights in turn and share the total size by
    weight. A target stops at cap times the source's size; the excess is shared by weight among
    the others until none is above. One row per source, so its windows see sources, not rows.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # Sources fill up in the order of most / weight; the common level is the highest over the number that are full.
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    s = s.withColumn("level", (total - full) / left)
    level = F.max("level").over(everything)
    return s.withColumn("target", F.least(F.col("most"), level * F.col("weight"))).select("source", "source_size", "weight", "target")


def _prefix(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """df with `out`, the sum of `value` over the earlier rows of its group, by (bucket, order)."""
    by = df.groupBy(*group, bucket).agg(F.sum(value).alias("__v"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(*[F.col(g).alias("__" + g) for g in group], F.col(bucket).alias("__b"), F.coalesce(F.sum("__v").over(over), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order)
    df = df.withColumn("__i", F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("__n", F.row_number().over(inner))
    same = F.col(bucket) == F.col("__b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("__" + g))
    return df.join(by, same).withColumn(out, F.col("__o") + F.col("__i")).drop("__o", "__i", "__b", *["__" + g for g in group])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of docs(doc_id, text, source) and its plays in the mix.

    doc_id, content (xxhash64 of the text), source, size (words; null text: 0), source_size,
    target, taken (words that the mix takes, repeats counted) and plays: (position, virtual
    finish time, words) of each time it is taken, where position counts the mix's words before.

    A document is taken at most cap times. Documents without words are never taken. Null sources
    form one source, served as the last; rows that repeat are separate rows; other columns are
    ignored; an empty table gives an empty result. The same rows give the same mix.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    d = materialize(d, "sizes")
    stats = d.agg(F.count(F.lit(1)).alias("n")).first()
    buckets = stats["n"] // _BUCKET_ROWS + 1
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    targets = materialize(targets, "targets")
    t = targets.select(F.col("source").alias("__s"), "source_size", "target")
    h = F.xxhash64(F.lit(seed), "doc_id", "content")
    d = d.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    d = _prefix(d, ["source"], "bucket", ["h", "doc_id", "content", "size"], "size", "start").withColumnRenamed("__n", "nth")
    d = d.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    d = materialize(d, "queued")
    rounds = F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(F.lit(cap), F.ceil((F.col("target") - F.col("start")) / F.col("source_size"))).cast("int")).otherwise(0)
    q = d.where(rounds > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), rounds)))
    at = F.col("start") + (F.col("epoch") - 1) * F.col("source_size")
    # A millionth of a word keeps targets that are whole but for rounding.
    q = q.withColumn("words", F.least(F.col("size"), F.floor(F.col("target") - at + 1e-6))).where("words > 0")
    q = q.withColumn("finish", F.least(F.lit(1.0), (at + F.col("words")) / F.col("target")))
    q = q.withColumn("slot", F.floor(F.col("finish") * (cap * buckets)))
    # Finish times crowd at 1, one for each source; those go to buckets of their own hash.
    q = q.withColumn("slot", F.when(F.col("slot") >= cap * buckets, cap * buckets + F.pmod(F.col("h"), F.lit(buckets))).otherwise(F.col("slot")))
    q = _prefix(q.drop("nth"), [], "slot", ["finish", "h", "epoch", "doc_id"], "words", "position").drop("__n")
    budget = targets.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) + 1e-6)).first()[0] or 0
    q = q.where(F.col("position") < budget).withColumn("words", F.least("words", budget - F.col("position")))
    key = ["source", "bucket", "start", "doc_id", "content"]
    plays = q.select(*[F.col(k).alias("__" + k) for k in key], "position", "finish", "words").groupBy(*["__" + k for k in key]).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("position", "finish", "words"))).alias("plays"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col("__" + k))
    # Rows with words have starts of their own, so no row finds another's plays.
    out = d.join(plays, same & (F.col("size") > 0), "left")
    return out.select("doc_id", "content", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "plays")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs, in its order: each document as often as it is taken.

    Documents are whole here: a play of half a document or more counts as one, a shorter one
    as none. Rows without words, null texts among them, are not taken; null sources are one
    source; of repeated rows each has its plays; other columns, whatever their names, are kept;
    an empty table stays empty.
    """
    m = mix(docs, **how).where("taken > 0").select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"), F.col("source").alias("__s"), F.filter("plays", lambda p: 2 * p["words"] >= F.col("size"))["position"].alias("__p"))
    # Equal rows share their plays, so that the join below neither drops nor multiplies them.
    m = m.where(F.size("__p") > 0).groupBy("__d", "__c", "__s").agg(F.flatten(F.collect_list("__p")).alias("__p"), F.count(F.lit(1)).alias("__k"))
    own, names = own_names(docs)
    doc_id, source = F.col(names["doc_id"]).cast("long"), F.col(names["source"]).cast("string")
    d = own.withColumn("__content", F.xxhash64(names["text"]))
    j = d.join(m, doc_id.eqNullSafe(F.col("__d")) & (F.col("__content") == F.col("__c")) & source.eqNullSafe(F.col("__s")))
    lone = j.where("__k = 1").withColumn("__at", F.explode("__p"))
    some = j.where("__k > 1").dropDuplicates([names["doc_id"], "__content", names["source"]]).withColumn("__at", F.explode("__p"))
    return old_names(lone.unionByName(some).repartitionByRange("__at").sortWithinPartitions("__at"), names)
