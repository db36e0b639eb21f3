"""Quality scores from preference pairs, by the Bradley-Terry model.

A labelled good text is preferred to a labelled bad one. The model gives each text a worth
w . f(text); the chance that a text is preferred to another is the logistic of the difference of
their worths. Weights minimise the logistic loss of feature differences over pairs, with a ridge
penalty, by Newton's method. The worth's threshold is the quantile, among the labelled rows'
worths, at the share of bad rows; a score is the logistic of the worth's distance from it, set so
that the threshold's score is 0.7.

Features are shares of character classes and of neighbouring classes, repetition of words and
lines, and lengths, all of the whole text, taken in Arrow batches where the text lies. All
labelled rows teach: they are dealt to groups of some of either label, whose pairs are all taken,
and Newton's sums, means, spreads and the quantile come from Spark. A partial sum for each task
comes to the driver.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prefer_small_batches, slices_by_bytes, trimmed

#: Preference pairs of rows in memory, each of a good and a bad row.
PAIRS = 40_000
#: Rows of the more frequent label in a group, and of the other at least (all, if fewer).
_GROUP, _OTHERS = 256, 32
#: Rows of a bucket in which rows are numbered; rows that a quantile's last step looks at.
_BUCKET, _FEW = 4096, 1000
THRESHOLD = 0.7
_RIDGE, _ROUNDS, _CLIP, _LEAST_SPREAD = 3.0, 25, 6.0, 1e-3
_SLICE = 1 << 20

_PUNCTUATION = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
_LOWER, _UPPER, _DIGIT, _LINE, _SPACE, _OTHER = range(len(_PUNCTUATION), len(_PUNCTUATION) + 6)
N_CLASSES = _OTHER + 1
#: Coarser classes for neighbours: sentence marks and other punctuation apart.
_SENTENCE = ".,;:?'\"()-"
_COARSE = 8
_LENGTHS = 11
N_FEATURES = N_CLASSES + _COARSE * _COARSE + _LENGTHS


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and coarse class of each class."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        name = unicodedata.category(chr(c))
        if name == "Lu" or name == "Lt":
            kind[c] = _UPPER
        elif name[0] in "LM":
            kind[c] = _LOWER
        elif name[0] == "N":
            kind[c] = _DIGIT
        elif name[0] == "Z":
            kind[c] = _SPACE
    kind[[ord(c) for c in _PUNCTUATION]] = np.arange(len(_PUNCTUATION))
    kind[[9, 11, 12, 32]], kind[[10, 13]] = _SPACE, _LINE
    coarse = np.array([5 if c in _SENTENCE else 6 for c in _PUNCTUATION] + [0, 1, 2, 3, 4, 7], np.uint8)
    return kind, coarse


def features(texts: list[str]) -> np.ndarray:
    """(texts, N_FEATURES): square roots of class shares and of neighbours' shares, then repetition and lengths."""
    kind, coarse = _classes()
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts):
        if not text:
            row[-1] = 1.0
            continue
        k = kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        row[:N_CLASSES] = np.bincount(k, minlength=N_CLASSES) / len(k)
        g = coarse[k]
        if len(g) > 1:
            row[N_CLASSES : N_CLASSES + _COARSE * _COARSE] = np.bincount(g[:-1] * np.uint8(_COARSE) + g[1:], minlength=_COARSE * _COARSE) / (len(g) - 1)
        words, lines = text.split(), [x for x in text.split("\n") if x]
        n = len(words)
        if not n:
            row[-1] = 1.0
            continue
        seen = Counter(words)
        top = max(seen.values())
        row[-_LENGTHS:] = (
            np.log1p(n), np.log(len(seen) + 1) / np.log(n + 1), len(seen) / n, top / n, np.sqrt(max(0, top - 1) / n),
            np.sqrt(sum(map(operator.eq, words, words[1:])) / n), (len(text) - n) / n / 10, max(map(len, seen)) / 100, np.sqrt(1 - len(set(lines)) / max(1, len(lines))), np.log1p(n / max(1, len(lines))), 0.0,
        )
    shares = out[:, : N_CLASSES + _COARSE * _COARSE]
    np.sqrt(shares, out=shares)
    return out


@dataclass
class Model:
    """worth = weight . clipped((features - centre) / spread); without any pair all worths are equal."""

    centre: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    threshold: float
    learned: bool

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -_CLIP, _CLIP)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(x), 0.5)
        z = np.clip(self.worth(x) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)
        return 1 / (1 + np.exp(-z))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Weights of least logistic loss with a ridge penalty; sums(w) are pair_sums over all pairs."""
    w = np.zeros(n)
    for _ in range(_ROUNDS):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + _RIDGE * np.eye(n), slope - _RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the loss at w over pairs with feature differences d."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the chance that the bad row were preferred
    return d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def product_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pair_sums at w over all pairs of a good and a bad row: (g - b)(g - b)' is gg' + bb' - gb' - bg', so each row's own product is taken once."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -500, 500)))
    q = p * (1 - p)
    cross = good.T @ (q @ bad)
    curve = (good * q.sum(1)[:, None]).T @ good + (bad * q.sum(0)[:, None]).T @ bad - cross - cross.T
    return good.T @ p.sum(1) - bad.T @ p.sum(0), curve


def train(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Fit on features of good and bad rows in memory; share_bad is the bad rows' share of all labelled ones."""
    none = np.zeros(good.shape[1])
    if not len(good) or not len(bad):
        return Model(none, none + 1, none, 0.0, False)
    both = np.concatenate([good, bad])
    weight_of = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    model = Model(both.mean(0), np.maximum(both.std(0), _LEAST_SPREAD), none, 0.0, True)
    rnd = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    # Every row is in a pair before any is in a second one.
    pick = lambda m: np.concatenate([rnd.permutation(m) for _ in range(-(-n // m))])[:n]
    d = model.scaled(good)[pick(len(good))] - model.scaled(bad)[pick(len(bad))]
    model.weight = newton(lambda w: pair_sums(d, w), len(none))
    worth = model.worth(both)
    order = np.argsort(worth, kind="stable")
    below = np.cumsum(weight_of[order])
    at = int(np.searchsorted(below, share_bad - 1e-12))
    # Between the quantile's row and the next one, so that neither lies on the line.
    model.threshold = float((worth[order[at]] + worth[order[min(at + 1, len(order) - 1)]]) / 2)
    return model


def _rest(doc_id):
    return F.crc32(F.col(doc_id).cast("long").cast("string")) % 4


def _in_batches(docs: DataFrame, make, schema: str) -> DataFrame:
    """docs(.., text): all columns but text, and what make gives for each list of texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for a, b in slices_by_bytes(sizes, _SLICE):
                made = make(texts[a:b])
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], *made], [*rest.schema.names[:-1], *[f"m{i}" for i in range(len(made))]])

    prefer_small_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), schema)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, h, f) of each row of docs(doc_id, text), stored: h is a hash of the text, f its features."""

    def make(part: list[str]):
        import pyarrow as pa

        x = features(part).astype(np.float32)
        return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))]

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_rest("doc_id") == 2, F.lit(False)).alias("held_out"), F.xxhash64(text).alias("h"), text.alias("text"))
    return materialize(_in_batches(d, make, "doc_id long, held_out boolean, h long, m0 array<float>").withColumnRenamed("m0", "f"), "features")


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, id, h, f) of all labelled rows, stored.

    Labels are those of rows whose crc32(doc_id) mod 4 is not 2, with an id and a quality of 0
    or 1; an id that has both teaches nothing. Of documents with one id all that differ in text
    are taken.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(_rest("doc_id") != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other")).where("label = other").drop("other")
    found = rows.where("doc_id is not null and not held_out").withColumnRenamed("doc_id", "id").join(known, "id")
    return materialize(found.groupBy("label", "id", "h").agg(F.first("f").alias("f")), "training")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_FEATURES)


def _summed(d: DataFrame, make, columns: int) -> np.ndarray:
    """The sum of make(batch), an array of so many numbers, over a table, in one job: a row for each task comes to the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(columns)
        for batch in batches:
            total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return sum((np.frombuffer(r["part"]) for r in d.mapInArrow(trimmed(run), "part binary").collect()), np.zeros(columns))


def _numbered(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows with i, from 0, within each label: numbers inside buckets of a hash, and the sizes of the buckets before."""
    buckets = max(1, sum(counts.values()) // _BUCKET)
    d = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)))
    sizes = d.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "bucket").collect()
    first, at = [], {}
    for r in sizes:
        first.append((r["label"], r["bucket"], at.get(r["label"], 0)))
        at[r["label"]] = at.get(r["label"], 0) + r["n"]
    offsets = rows.sparkSession.createDataFrame(first, "label int, bucket long, first long")
    within = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("id", "h")) - 1
    return d.withColumn("at", within).join(F.broadcast(offsets), ["label", "bucket"]).select("label", (F.col("first") + F.col("at")).alias("i"), "f")


def groups(rows: DataFrame, counts: dict[int, int], model: Model) -> DataFrame:
    """(good, bad): scaled features of groups of training rows, as bytes, stored.

    The more frequent label's rows are in one group each. Those of the other take turns, so that
    each group has _OTHERS of them, or all, and each is in a group.
    """
    many, few = (1, 0) if counts[1] >= counts[0] else (0, 1)
    n = -(-counts[many] // _GROUP)
    each = max(min(_OTHERS, counts[few]), -(-counts[few] // n))
    d = _numbered(rows, counts)
    turns = F.sequence(F.col("i"), F.lit(each * n - 1), F.lit(counts[few]).cast("long"))
    dealt = d.where(F.col("label") == many).select("label", "f", (F.col("i") % n).alias("group"))
    dealt = dealt.unionByName(d.where(F.col("label") == few).select("label", "f", F.explode(turns).alias("turn")).select("label", "f", F.floor(F.col("turn") / each).alias("group")))

    def pack(table):
        import pyarrow as pa

        label = table.column("label").to_numpy()
        z = model.scaled(np.concatenate([_matrix(c) for c in table.column("f").chunks]))
        return pa.table({"good": pa.array([z[label == 1].astype(np.float32).tobytes()], pa.binary()), "bad": pa.array([z[label == 0].astype(np.float32).tobytes()], pa.binary())})

    return materialize(dealt.groupBy("group").applyInArrow(pack, "good binary, bad binary"), "groups")


def _group_sums(w: np.ndarray):
    """pair_sums at w over all pairs of each group of a batch, in one array."""

    def make(batch) -> np.ndarray:
        out = np.zeros(len(w) * (len(w) + 1))
        for good, bad in zip(*(batch.column(c).to_pylist() for c in range(2))):
            good, bad = (np.frombuffer(x, np.float32).reshape(-1, len(w)).astype(float) for x in (good, bad))
            slope, curve = product_sums(good, bad, w)
            out[: len(w)] += slope
            out[len(w) :] += curve.ravel()
        return out

    return make


def order_statistics(d: DataFrame, k: int) -> tuple[float, float]:
    """The k-th smallest (from 1) of d's only column x, and the one after it, or itself at the end: by counts in ever narrower bins."""
    lo, hi, below = *d.agg(F.min("x"), F.max("x")).first(), 0
    while lo < hi:
        bins = F.floor((F.col("x") - lo) / (hi - lo) * 1024)
        inside = d.where(F.col("x").between(lo, hi))
        for r in inside.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect():
            if below + r["n"] >= k:
                break
            below += r["n"]
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= _FEW:
            lo = hi = sorted(x[0] for x in d.where(F.col("x").between(lo, hi)).collect())[k - below - 1]
    reached, after = d.agg(F.count_if(F.col("x") <= lo), F.min(F.when(F.col("x") > lo, F.col("x")))).first()
    return lo, lo if reached > k or after is None else after


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """A model of all labelled rows of featured(docs) and labels(doc_id, quality)."""
    none = np.zeros(N_FEATURES)
    taught = training_rows(rows, labels)
    counts = {0: 0, 1: 0} | {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(counts.values()):
        return Model(none, none + 1, none, 0.0, False)
    n = sum(counts.values())
    centre = _summed(taught.select("f"), lambda batch: _matrix(batch.column(0)).sum(0), N_FEATURES) / n
    square = _summed(taught.select("f"), lambda batch: ((_matrix(batch.column(0)) - centre) ** 2).sum(0), N_FEATURES) / n
    model = Model(centre, np.maximum(np.sqrt(square), _LEAST_SPREAD), none, 0.0, True)
    dealt = groups(taught, counts, model)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = _summed(dealt, _group_sums(w), N_FEATURES * (N_FEATURES + 1))
        return s[:N_FEATURES], s[N_FEATURES:].reshape(N_FEATURES, N_FEATURES)

    model.weight = newton(sums, N_FEATURES)

    def worths(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.worth(_matrix(batch.column(0))))], ["x"])

    # Between the quantile's row and the next one, so that neither lies on the line.
    model.threshold = sum(order_statistics(materialize(taught.select("f").mapInArrow(worths, "x double"), "worths"), counts[0])) / 2
    return model


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.7 on) of each row of docs(doc_id, text).

    held_out is whether crc32(doc_id) mod 4 is 2; a row without an id is neither held out nor
    learned from. Null texts count as empty ones, which have a score like any other; equal texts
    have equal scores, repeated rows stay apart; other columns, whatever their names, are
    ignored; an empty table stays empty. Without labels of both kinds every score is 0.5.
    """
    rows = featured(docs)
    held = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))  # three vectors of N_FEATURES numbers

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(held.value.score(_matrix(batch.column(2))))], ["doc_id", "held_out", "score"])

    scored = rows.select("doc_id", "held_out", "f").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
