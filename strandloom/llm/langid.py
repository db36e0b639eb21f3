"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased code points, where anything but a letter counts
as one and the same boundary character, hashed to a fixed number of buckets. A feature's value
is its share of the text's n-grams times its inverse document frequency. Weights are trained by
follow-the-regularised-leader (proximal) with L1 and L2 penalties on a bounded sample of
labelled rows; a temperature fitted on a held-back part of that sample calibrates the scores.
Prediction reads whole texts, in Arrow batches, and needs nothing but the weight table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, old_names, own_names, prefer_small_batches, slices_by_bytes, trimmed

UNDETERMINED = "und"
#: Labelled rows learned from: at most so many of each language, none longer than so many code points.
SAMPLE_PER_LANGUAGE, SAMPLE_CODE_POINTS = 1000, 20000
_BITS = 17
_NONE = 1 << _BITS
_SLICE = 1 << 19
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of shape (3, code points), row offsets, whether each row has a letter); _NONE where there is no n-gram."""
    low = [t.lower() for t in texts]
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=offsets[1:])
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(0)).astype(np.uint32)
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(len(c))
    out = np.full((3, len(c)), _NONE, np.int32)
    h, any_letter = np.zeros(len(c), np.uint32), np.zeros(len(c), bool)
    for n in range(1, 4):
        m = len(c) - n + 1
        if m <= 0:
            break
        h[:m] = (h[:m] ^ c[n - 1 :]) * _MIX[n - 1]
        h[:m] ^= h[:m] >> np.uint32(15)
        any_letter[:m] |= letter[n - 1 :]
        ok = any_letter[:m] & (place[:m] + n <= end[:m])
        out[n - 1, :m][ok] = ((h[:m] * np.uint32(2654435769)) >> np.uint32(32 - _BITS)).astype(np.int32)[ok]
    seen = np.concatenate([[0], np.cumsum(letter)])
    return out, offsets, seen[offsets[1:]] > seen[offsets[:-1]]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets + 1, languages): weight times inverse document frequency; the last row is 0
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, offsets, has = features(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            begin = offsets[some]
            for g in grams:
                count[some] += np.add.reduceat(g != _NONE, begin, dtype=np.int64)
                for k in range(len(self.languages)):
                    total[some, k] += np.add.reduceat(self.table[:, k][g], begin, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        z, has = self.logits([t or "" for t in texts])
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        names = [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has)]
        return names, np.where(has, p[np.arange(len(best)), best], 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5, seed: int = 5) -> Model:
    """Fit on texts and labels; every fifth example only calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((_NONE + 1, 0)), np.zeros(0), 1.0)
    target = np.array([languages.index(x) for x in labels])
    rows = []
    for t in texts:
        g = features([t])[0].ravel()
        idx, c = np.unique(g[g != _NONE], return_counts=True)
        rows.append((idx.astype(np.int32), c.astype(np.int32)))
    df = np.zeros(_NONE + 1)
    for idx, _ in rows:
        df[idx] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 1
    rows = [(idx, (c / max(1, c.sum()) * idf[idx]).astype(np.float32)) for idx, c in rows]
    k = len(languages)
    z, n = np.zeros((_NONE + 2, k)), np.zeros((_NONE + 2, k))  # the last row is the bias

    def weights(i):
        zi = z[i]
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(n[i])) / alpha + l2)

    learn = [i for i in range(len(rows)) if i % 5 or len(rows) < 10]
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rnd.permutation(learn):
            idx = np.append(rows[r][0], _NONE + 1)
            x = np.append(rows[r][1].astype(np.float64), 0.1)
            w = weights(idx)
            p = _softmax(x @ w)
            p[target[r]] -= 1
            g = np.outer(x, p)
            old = n[idx]
            new = old + g * g
            z[idx] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[idx] = new
    w = weights(slice(None))
    table = (w[: _NONE + 1] * idf[:, None]).astype(np.float32)
    table[_NONE] = 0
    model = Model(languages, table, w[_NONE + 1] * 0.1, 1.0)
    held = [i for i in range(len(rows)) if i % 5 == 0 or len(rows) < 10]
    sizes = np.concatenate([[0], np.cumsum([len(texts[i]) for i in held])])
    logits = np.concatenate([model.logits([texts[i] for i in held[a:b]])[0] for a, b in slices_by_bytes(sizes, _SLICE // 2)] or [np.zeros((0, k))])

    def loss(t):
        p = _softmax(logits / t)[np.arange(len(held)), target[held]]
        return -np.log(np.maximum(p, 1e-12)).mean()

    # A perfectly separated sample would drive the temperature to 0: it stops at the grid's end.
    model.temperature = float(min(np.geomspace(0.05, 20, 200), key=loss))
    return model


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, code_points: int = SAMPLE_CODE_POINTS) -> DataFrame:
    """(text, lang) of at most per_language rows of each language: the first ones by a hash of id and text.

    Only rows with an id, a label and a text, no longer than code_points, whose crc32(doc_id) mod 4 is not 2.
    """
    ok = docs.where("doc_id is not null and lang is not null and text is not null and crc32(cast(cast(doc_id as long) as string)) % 4 <> 2")
    ok = ok.where(F.char_length("text") <= code_points)
    key = ok.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.col("lang").alias("l"))
    first = Window.partitionBy("l").orderBy(F.xxhash64("d", "h"), "d", "h")
    key = key.distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_language).drop("rn")
    found = ok.select("doc_id", "text", "lang").join(F.broadcast(key), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h")) & (F.col("lang") == F.col("l")))
    return found.groupBy("d", "h", "l").agg(F.first("text").alias("text")).select("d", "h", "text", F.col("l").alias("lang"))


def fit(docs: DataFrame, **sample: int) -> Model:
    """A model learned from a bounded sample of docs(doc_id, text, lang); the driver holds that sample only."""
    rows = training_sample(docs, **sample).toArrow().sort_by([("lang", "ascending"), ("d", "ascending"), ("h", "ascending")])
    order = np.random.default_rng(1).permutation(len(rows))
    texts, labels = rows.column("text").to_pylist(), rows.column("lang").to_pylist()
    model = train([texts[i] for i in order], [labels[i] for i in order])
    del rows, texts, labels
    give_back()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; columns of these names are replaced.

    Null texts and texts without a letter are `und` with score 0, and so are all texts if the
    model has learned no language. Rows that repeat stay apart; an empty table stays empty.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # of a fixed number of buckets
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at)
            sizes = np.concatenate([[0], np.cumsum([len(t or "") for t in texts.to_pylist()])])
            for a, b in slices_by_bytes(sizes, _SLICE):
                names, scores = held.value.predict(texts[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    prefer_small_batches(spark)
    return docs.mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs(doc_id, text, lang); see fit and predict.

    held_out is whether crc32(doc_id) mod 4 is 2; a row without an id is neither held out nor learned from.
    """
    model = fit(docs, **sample)
    rest = F.crc32(F.col("doc_id").cast("long").cast("string")) % 4
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, **sample: int) -> DataFrame:
    """Rows of docs whose language is determined with a score of `least` or more, with lang set to it.

    Null texts and texts without a letter go; rows that repeat stay or go together; a score on
    the line stays; other columns, whatever their names, are kept; an empty table stays empty.
    """
    own, names = own_names(docs)
    own = own.withColumnRenamed(names["text"], "text")
    kept = predict(own, fit(docs, **sample)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return old_names(kept, names | {"text": "text"} | ({"lang": "lang_pred"} if "lang" in names else {}))
