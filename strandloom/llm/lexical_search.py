"""Ranked lexical search over an index whose documents are reordered by recursive graph bisection.

Bisection splits documents into halves and swaps those whose terms fit the other half better, by
the estimated cost of the gaps in posting lists; then each half alike. It is learned on a bounded
sample; the halves' document frequencies then place every document, by the same cost, down the
tree. Leaves, cut where they hold too much, are shards: documents that share terms stand together.

The index has all terms of all documents: postings (shard, term, places, occurrences and the
largest score factor of them) and members (shard, the doc_id and length at each place). A search
bounds an item's score in each shard, visits shards by descending bound, a few at first and then
more, and stops an item when no shard left could hold a document that its list would take. Places
are mapped back to doc_ids, by which equal scores are ordered. So results are exact, whatever the
sample taught.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialize, prefer_small_batches, slices_by_bytes, trimmed

#: Documents that bisection is learned on, none of more code points; the most frequent of their terms.
SAMPLE, SAMPLE_CODE_POINTS, VOCABULARY = 2048, 20_000, 16_384
#: Levels of halves at most, and rounds of swaps each.
DEPTH, SWAPS = 8, 10
#: Documents and postings of a shard, about.
SHARD, SHARD_POSTINGS = 4096, 1 << 21
#: Shards that an item visits first, how many times more it visits each time, items of a block.
FIRST, GROWTH, BLOCK = 4, 8, 1000
_SLICE = 1 << 20
#: Score factors, as in score = w * (10**9 * tf div (1000 * tf + 12 * m)): fixed values.
_SCALE, _TF, _M = 1_000_000_000, 1000, 12

#: Letters A-Z to lower case, other ASCII but digits and letters to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of anything but ASCII that is neither letter nor digit, only A-Z lower-cased."""
    return text.encode().translate(_TABLE).split()


def _cost(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Estimated bits of the gaps of terms with x and y documents among nx and ny."""
    return x * np.log2(nx / (x + 1.0)) + y * np.log2(ny / (y + 1.0))


def _halves(doc: np.ndarray, term: np.ndarray, n: int, vocabulary: int, swaps: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of n documents is in the left half, each term's gain of standing left) of edges (doc, term)."""
    left = np.arange(n) < (n + 1) // 2
    nl, nr = int(left.sum()), n - int(left.sum())
    for _ in range(swaps):
        at = left[doc]
        dl, dr = (np.bincount(term[x], minlength=vocabulary).astype(float) for x in (at, ~at))
        now = _cost(dl, dr, nl, nr)
        leave, enter = now - _cost(np.maximum(dl - 1, 0), dr + 1, nl, nr), now - _cost(dl + 1, np.maximum(dr - 1, 0), nl, nr)
        gain = np.bincount(doc, np.where(at, leave[term], enter[term]), n)
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
        k = min(len(l), len(r))
        swap = int((gain[l[:k]] + gain[r[:k]] > 1e-9).sum())  # the sums descend
        if not swap:
            break
        left[l[:swap]], left[r[:swap]] = False, True
    at = left[doc]
    dl, dr = (np.bincount(term[x], minlength=vocabulary).astype(float) for x in (at, ~at))
    return left, _cost(dl, dr + 1, nl, nr) - _cost(dl + 1, dr, nl, nr)


@dataclass
class Tree:
    """gain[node, term] of standing in the left half; node k's halves are the nodes 2 k + 1 and 2 k + 2."""

    terms: list[bytes]
    gain: np.ndarray
    depth: int

    @classmethod
    def learn(cls, docs: list[set[bytes]], depth: int, vocabulary: int = VOCABULARY, swaps: int = SWAPS) -> "Tree":
        df = Counter(t for d in docs for t in d)
        terms = sorted((t for t, n in df.items() if n > 1), key=lambda t: (-df[t], t))[:vocabulary]
        of = {t: i for i, t in enumerate(terms)}
        edges = [(i, of[t]) for i, d in enumerate(docs) for t in d if t in of]
        doc, term = np.array(edges, np.int64).reshape(-1, 2).T
        gain = np.zeros((2**depth - 1, len(terms)), np.float32)
        node = np.zeros(len(docs), np.int64)
        for k in range(2**depth - 1):
            members = np.flatnonzero(node == k)
            if len(members) < 2:
                node[members] = 2 * k + 1
                continue
            mine = np.flatnonzero(node[doc] == k)
            left, gain[k] = _halves(np.searchsorted(members, doc[mine]), term[mine], len(members), len(terms), swaps)
            node[members] = 2 * k + 2 - left
        return cls(terms, gain, depth)

    def leaves(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n documents, numbered from the left, by its edges (doc, term)."""
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            right = np.bincount(doc, self.gain[node[doc], term], n) < 0
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def learn_tree(docs: DataFrame, depth: int, rows: int, sample: int = SAMPLE) -> Tree:
    """A tree of a random sample of docs(text); the driver holds the sample only."""
    if depth == 0:
        return Tree([], np.zeros((0, 0), np.float32), 0)
    ok = docs.select("text").where(F.char_length("text").between(1, SAMPLE_CODE_POINTS))
    texts = ok.sample(fraction=min(1.0, 1.3 * sample / max(1, rows)), seed=3).limit(sample).toArrow().column(0).to_pylist()
    return Tree.learn([set(terms_of(t)) for t in texts], depth)


_FORWARD = "row long, doc_id long, n int, leaf int, terms binary, tf binary"


def _forward(tree):
    """(row, doc_id, text) -> lengths, leaves and terms with their occurrences; documents without a term are left out."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(tree.value.terms, pa.binary())
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for a, b in slices_by_bytes(ends, _SLICE):
                counts, n = [], []
                for t in texts[a:b]:
                    words = terms_of(t)
                    n.append(len(words))
                    counts.append(Counter(words))
                some = np.flatnonzero(n)
                leaf = np.zeros(len(n), np.int64)
                if tree.value.depth:
                    flat = pa.array([t for c in counts for t in c], pa.binary())
                    doc = np.repeat(np.arange(len(n)), [len(c) for c in counts])
                    at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
                    leaf = tree.value.leaves(doc[at >= 0], at[at >= 0], len(n))
                rows = batch.slice(a, b - a).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([
                    *rows.columns[:2], pa.array(np.array(n, np.int32)[some]), pa.array(leaf[some].astype(np.int32)),
                    pa.array([b" ".join(counts[i]) for i in some], pa.binary()), pa.array([np.fromiter(counts[i].values(), "<i4", len(counts[i])).tobytes() for i in some], pa.binary()),
                ], ["row", "doc_id", "n", "leaf", "terms", "tf"])

    return run


def factor(tf, m):
    """A posting's share of a score, besides the term's weight."""
    return _SCALE * tf // (_TF * tf + _M * m)


_INDEX = "shard long, term string, at array<int>, tf array<int>, bound int, ids array<long>, m array<long>"


def _invert(n_docs: int, n_terms: int):
    """The documents of a shard -> its postings, and one row without a term for its members, by ascending doc_id."""

    def run(key, table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("row", "ascending")])
        m = 75 + 25 * table.column("n").to_numpy().astype(np.int64) * n_docs // n_terms
        words, tfs = [], []
        for t, x in zip(table.column("terms").to_pylist(), table.column("tf").to_pylist()):
            words.append(t.split())
            tfs.append(np.frombuffer(x, "<i4"))
        at = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
        code, tf = coded.indices.to_numpy(), np.concatenate(tfs)
        order = np.argsort(code, kind="stable")
        code, at, tf = code[order], at[order], tf[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        ends = pa.array(np.append(begin, len(code)).astype(np.int32))
        bound = np.maximum.reduceat(factor(tf.astype(np.int64), m[at]), begin).astype(np.int32)
        n, none = len(begin), lambda kind: pa.nulls(1, kind)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        shard = key[0].as_py()
        postings = pa.RecordBatch.from_arrays([
            pa.array(np.full(n, shard)), coded.dictionary.cast(pa.string()), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(tf)), pa.array(bound), pa.nulls(n, longs), pa.nulls(n, longs),
        ], names := [x.split()[0] for x in _INDEX.split(", ")])
        members = pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), none(pa.string()), none(ints), none(ints), none(pa.int32()), pa.array([table.column("doc_id").to_pylist()], longs), pa.array([m.tolist()], longs)], names)
        return pa.Table.from_batches([postings, members])

    return run


@dataclass
class Index:
    """table: postings and members of shards; n_docs with a term and n_terms of them."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> Index:
    """An index of all terms of all docs(doc_id, text), in the shared folder."""
    spark = docs.sparkSession
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = d.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, rows) / shard)))))
    tree = spark.sparkContext.broadcast(learn_tree(d, depth, rows, sample))  # of VOCABULARY terms and 2 ** DEPTH nodes at most
    prefer_small_batches(spark, 500)
    forward = materialize(d.mapInArrow(trimmed(_forward(tree)), _FORWARD), "forward")
    per = forward.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum(F.octet_length("tf") / 4).alias("postings")).collect()  # a row for each of the tree's leaves
    n_docs, n_terms = sum(r["docs"] for r in per), sum(r["n"] for r in per)
    if not n_terms:
        return Index(spark.createDataFrame([], _INDEX), 0, 0)
    pieces = {r["leaf"]: int(max(-(-r["docs"] // shard), -(-r["postings"] // SHARD_POSTINGS))) for r in per}
    first = dict(zip(sorted(pieces), np.cumsum([0, *[pieces[k] for k in sorted(pieces)]]).tolist()))
    of = spark.createDataFrame([(k, first[k], pieces[k]) for k in pieces], "leaf int, first long, pieces long")
    # A leaf that holds too much, as of copies, is cut by chance; its shards have like bounds.
    cut = forward.join(F.broadcast(of), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), "pieces")).drop("leaf", "first", "pieces")
    table = materialize(cut.groupBy("shard").applyInArrow(_invert(n_docs, n_terms), _INDEX), "index")
    discard(forward)
    return Index(table, n_docs, n_terms)


def query_terms(queries: DataFrame) -> DataFrame:
    """(q, item_id, term, k): the terms of each row of queries(item_id, text) with how often each occurs in it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(i, j, t.decode(), k) for i, j, text in zip(*(c.to_pylist() for c in batch.columns)) for t, k in Counter(terms_of(text or "")).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["q", "item_id", "term", "k"])

    d = queries.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "q long, item_id long, term string, k long")


_FOUND = "q long, doc_id long, score long"


def _score(most: int):
    """Postings and members of a shard, and the weighted terms of the items that visit it -> each item's best documents there."""

    def run(key, postings, wanted):
        import pyarrow as pa

        held, ids, m, out = {}, np.zeros(0), np.zeros(0, np.int64), []
        for batch in postings.to_batches():
            at, tf = batch.column("at"), batch.column("tf")
            for i, t in enumerate(batch.column("term").to_pylist()):
                if t is None:
                    ids, m = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "m"))
                else:
                    held[t] = at[i].values.to_numpy(), tf[i].values.to_numpy().astype(np.int64)
        held = {t: (at, factor(tf, m[at])) for t, (at, tf) in held.items()}
        order = wanted.sort_by("q")
        q, terms, weight = order.column("q").to_numpy(), order.column("term").to_pylist(), order.column("weight").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q))
        for a, b in zip(edges, edges[1:]):
            score = np.zeros(len(m), np.int64)
            for t, w in zip(terms[a:b], weight[a:b]):
                if t in held:
                    at, f = held[t]
                    score[at] += w * f
            some = np.flatnonzero(score > 0)
            if len(some) > most:
                least = np.partition(score[some], -most)[-most]
                some = some[score[some] >= least]
            # Places are in the order of doc_ids, so a stable sort keeps it among equal scores.
            for i in some[np.argsort(-score[some], kind="stable")][:most]:
                out.append((int(q[a]), None if ids[i] != ids[i] else int(ids[i]), int(score[i])))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["q", "doc_id", "score"])

    return run


def _first(df: DataFrame, most: int) -> DataFrame:
    """The most first rows of each item by score and doc_id, with their rank."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(index: Index, queries: DataFrame, most: int = 20, first: int = FIRST, growth: int = GROWTH, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents with a score above 0 of each row of queries(item_id, text).

    Terms repeat as they do in the item. Equal scores go by ascending doc_id, null ids last.
    Null and empty items, and those without a known term, have no rows; repeated items have
    each their rows; other columns are ignored.
    """
    spark: SparkSession = queries.sparkSession
    empty = "item_id long, rank int, doc_id long, score long"
    if not index.n_docs:
        return spark.createDataFrame([], empty)
    terms = materialize(query_terms(queries), "query-terms")
    items = terms.select("q").distinct().count()
    if not items:
        return spark.createDataFrame([], empty)
    known = index.table.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    hits = materialize(known.select("shard", "term", "at", "tf", "bound"), "hits")
    df = hits.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(index.n_docs)) + 2) / (2 * F.col("df") + 1)))
    weighted = materialize(terms.join(df, "term").select("q", "item_id", "term", (F.col("k") * weight).cast("long").alias("weight")).where("weight > 0"), "weighted")
    bounds = hits.select("shard", "term", "bound").join(weighted, "term").groupBy("q", "shard").agg(F.sum(F.col("weight") * F.col("bound")).alias("bound"))
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "shard")
    left = materialize(bounds.withColumn("turn", F.row_number().over(order)), "bounds")
    members = index.table.where("term is null").select("shard", F.lit(None).cast("string").alias("term"), "at", "tf", "ids", "m")
    postings = hits.select("shard", "term", "at", "tf", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("m")).unionByName(members)
    blocks = -(-items // block)
    of = F.pmod(F.xxhash64("q"), F.lit(blocks))
    best, done, upto = spark.createDataFrame([], _FOUND + ", rank int"), 0, first
    while True:
        # An item goes on while a shard left could reach its list's last score; on a tie its doc_id may be smaller.
        last = best.where(F.col("rank") == most).select("q", F.col("score").alias("least"))
        ahead = left.where(F.col("turn") > done).join(last, "q", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0)))
        visits = materialize(ahead.where(F.col("turn") <= upto).select("q", "shard"), "visits")
        if visits.isEmpty():
            if done and ahead.isEmpty():
                break
        else:
            wanted = visits.join(weighted, "q").select("shard", of.alias("part"), "q", "term", "weight")
            at = visits.select(F.col("shard").alias("s"), of.alias("p")).distinct()
            seen = postings.join(at, F.col("shard") == F.col("s")).withColumn("part", F.col("p") + 0).drop("s", "p")
            with arrow_batches(spark, 2000):
                found = seen.groupBy("shard", "part").cogroup(wanted.groupBy("shard", "part")).applyInArrow(_score(most), _FOUND)
                best = materialize(_first(best.select("q", "doc_id", "score").unionByName(found), most), "best")
        discard(visits)
        done, upto = upto, upto * growth
    return best.join(terms.select("q", "item_id").distinct(), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """search over an index of docs(doc_id, text).

    Null and empty texts, and texts without a term, are never found and count for nothing;
    repeated rows are documents of their own; null doc_ids come last among equal scores; very
    long texts are indexed whole, in one task each; other columns, whatever their names, are
    ignored; empty tables give an empty result.
    """
    return search(build_index(docs), queries, most)
