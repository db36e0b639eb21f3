"""N-gram Jaccard self-join of texts, by rare-first prefix filtering.

1. One pass over the texts makes each text's set of word n-grams as 64-bit hashes (numpy, on
   Arrow batches) and deals packed (hash, text) entries by hash range.
2. Each range counts in how many texts a hash occurs. A hash of one text can match nothing, so
   only entries of repeated hashes go on; for prefix, filters and overlap the rest is a number.
3. A text's hashes in rare-first order give its prefix: any two linked texts share a hash there.
   Texts that have as many unrepeated hashes as the prefix is long have no partner.
4. Candidate pairs share a prefix hash and pass the length, positional and suffix filters. Each
   pair is verified once, by exact overlap. Texts with equal sets are one class from the start.
   Pairs inside one already linked component cannot change the result, so the first rounds
   verify stars around the most typical text of each posting list, and only pairs between
   different components are verified after that. No posting list is expanded into all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, mix64, old_names, own_names, returned, slices_by_bytes, text_buffers, trimmed
from .components import connected_components

_BATCH_BYTES = 1 << 18
_BATCH_ROWS = 500
#: Entries packed at a time, at least; with many hash ranges enough for 32 entries a range.
_FLUSH = 1 << 19
#: Hash ranges hold about this many entries.
_RANGE_ENTRIES = 500_000
_LOW_BITS = 40
#: Parts of the hash space in the suffix filter; rows of a posting list that one task compares at a time.
_PARTS = 512
_BLOCK_ROWS = 2000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = _BYTE[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    p = _POWERS.get("p")
    if p is None or len(p) < n:
        m = max(n, _BATCH_BYTES * 2)
        p = np.full(m, _BASE, np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        _POWERS["p"] = p
    return p


def _inverse_powers(n: int) -> np.ndarray:
    p = _POWERS.get("i")
    if p is None or len(p) < n:
        m = max(n, _BATCH_BYTES * 2)
        p = np.full(m, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        _POWERS["i"] = p
    return p


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row of a UTF-8 buffer.

    A-Z count as a-z; a row with fewer than n words gives one hash of all its words, a row
    without words gives none.
    """
    rows = len(offsets) - 1
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * rows
    word = ~_SEP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return [empty] * rows
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data))[: len(data)], out=total[1:])
    w = mix64((total[end] - total[start]) * _inverse_powers(len(data))[start] + (end - start).astype(np.uint64) * _BYTE[7])
    at = np.searchsorted(start, offsets)
    count = np.diff(at)
    grams = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n if len(grams) else 0):
        grams += w[k : k + len(grams)] * _SLOT[k]
    grams = mix64(grams)
    out = []
    for a, c in zip(at[:-1].tolist(), count.tolist()):
        if c >= n:
            h = np.sort(grams[a : a + c - n + 1])
            keep = np.empty(len(h), bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        elif c:
            out.append(mix64((w[a : a + c] * _SLOT[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c) * _SLOT[63]))
        else:
            out.append(empty)
    return out


_DEALT = "r int, flush long, node long, doc_id long, content long, n long, sig binary, entries binary"


def _deal(n: int, bits: int):
    """Arrow batches (doc_id, content, text) -> one row per text, and packed entries by hash range."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("r", pa.int32()), ("flush", pa.int64()), ("node", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("entries", pa.binary())])
        most = max(_FLUSH, 32 << bits)
        ctx = TaskContext.get()
        uid = (ctx.partitionId() if ctx else 0) << 20
        sets, own, held, idx, seen = [], [], 0, 0, set()

        def flush():
            h = np.concatenate(sets) >> np.uint64(64 - _LOW_BITS - bits)
            o = np.repeat(np.array(own, np.uint16), [len(s) for s in sets])
            r = (h >> np.uint64(_LOW_BITS)).astype(np.uint16)
            order = np.argsort(r, kind="stable")
            packed = np.empty((len(h), 7), np.uint8)
            packed[:, :5] = h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            packed[:, 5:] = o[order].astype("<u2").view(np.uint8).reshape(-1, 2)
            cut = np.searchsorted(r[order], np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut))
            blobs = [packed[cut[k] : cut[k + 1]].tobytes() for k in some.tolist()]
            none = lambda t: pa.nulls(len(some), t)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), uid), pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(blobs, pa.binary())], schema=schema)

        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            ids, content = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices_by_bytes(offsets, _BATCH_BYTES):
                nodes, sizes, sigs = [], [], []
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n):
                    if idx == 65535 or held > most:
                        if held:
                            yield flush()
                        sets, own, held, idx, uid = [], [], 0, 0, uid + 1
                    sig = xxhash.xxh3_128(s.tobytes()).digest() if len(s) else None
                    nodes.append(uid << 16 | idx)
                    sizes.append(len(s))
                    sigs.append(sig)
                    if sig is not None and sig not in seen:
                        seen.add(sig)
                        sets.append(s)
                        own.append(idx)
                        held += len(s)
                    idx += 1
                m = b - a
                r = [(x >> 3) % (1 << bits) for x in nodes]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.nulls(m, pa.int64()), pa.array(nodes, pa.int64()), pa.array(ids[a:b], pa.int64()), pa.array(content[a:b], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)
        if held:
            yield flush()

    return run


_COUNTED = "node long, doc_id long, content long, n long, sig binary, bucket int, entries binary"


def _count(bits: int):
    """A hash range -> its text rows, and packed (text, order key) entries of its repeated hashes by bucket of texts.

    An order key is the document frequency (8 bits, an eighth of a binary power each) above the
    hash: ascending keys are rare first, and equal hashes have equal keys.
    """

    def run(key, table):
        import pyarrow as pa

        schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bucket", pa.int32()), ("entries", pa.binary())])
        is_entry = np.array(table.column("flush").is_valid())
        texts = table.filter(pa.array(~is_entry))
        parts = [texts.select(["node", "doc_id", "content", "n", "sig"]).append_column("bucket", pa.nulls(len(texts), pa.int32())).append_column("entries", pa.nulls(len(texts), pa.binary()))]
        blobs = table.filter(pa.array(is_entry))
        if len(blobs):
            low, node = [], []
            for f, b in zip(blobs.column("flush").to_pylist(), blobs.column("entries")):
                e = np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, 7)
                h = np.zeros((len(e), 8), np.uint8)
                h[:, :5] = e[:, :5]
                low.append(h.view("<u8")[:, 0])
                node.append((np.int64(f) << 16) + np.ascontiguousarray(e[:, 5:]).view("<u2")[:, 0])
            low, node = np.concatenate(low), np.concatenate(node)
            order = np.argsort(low, kind="stable")
            low, node = low[order], node[order]
            del order
            begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            df = np.diff(np.append(begin, len(low)))
            rank = np.minimum(127, np.round(4 * np.log2(df))).astype(np.uint64)
            many = np.repeat(df > 1, df)
            keys = (np.repeat(rank, df) << np.uint64(56) | np.uint64(key[0].as_py()) << np.uint64(_LOW_BITS) | low)[many].astype(np.int64)
            node = node[many]
            bucket = (mix64(node.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            packed = np.stack([node[order], keys[order]], axis=1)
            cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut))
            packs = [packed[cut[k] : cut[k + 1]].astype("<i8").tobytes() for k in some.tolist()]
            m = len(some)
            parts.append(pa.table([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(some, pa.int32()), pa.array(packs, pa.binary())], schema=schema))
        return pa.concat_tables([p.cast(schema) for p in parts])

    return run


def _gather(table):
    """A bucket's entries -> each text's order keys, rare first."""
    import pyarrow as pa

    e = np.concatenate([np.frombuffer(b.as_buffer(), "<i8").reshape(-1, 2) for b in table.column("entries")])
    order = np.lexsort((e[:, 1], e[:, 0]))
    node, keys = e[order, 0], e[order, 1]
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(keys)), pa.int32()), pa.array(keys))
    return pa.table([pa.array(node[begin]), lists], ["node", "keys"])


_PAIRING = "a long, bs array<long>"


def _pairing(t: int):
    """Rows of posting lists, sorted by (key, left, right) -> candidate pairs as (a, its partners b > a).

    A pair needs one row of the left and one of the right side, of different labels, and passes
    the length, positional and suffix filters. The suffix filter bounds the overlap by the
    hashes of one text that fall into parts of the hash space where the other has any.
    """

    def pairs(g):
        left, right = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        for at in range(0, len(left), 512):
            x = left[at : at + 512]
            na, nb = g["n"][x][:, None], g["n"][right][None]
            need = -(-t * (na + nb) // (100 + t))
            ok = (g["label"][x][:, None] != g["label"][right][None]) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * t)
            ia, ib = g["i"][x][:, None], g["i"][right][None]
            ok &= np.minimum(ia, ib) + 1 + np.minimum(na - g["u"][x][:, None] - ia - 1, nb - g["u"][right][None] - ib - 1) >= need
            if not ok.any():
                continue
            ca, cb = (np.frombuffer(b"".join(g["parts"][k] for k in side), np.uint8).reshape(len(side), -1).astype(np.float32) for side in (x, right))
            full = (ca == 255).any(1)[:, None] | (cb == 255).any(1)[None]  # counts that may be larger bound nothing
            ok &= full | (ca @ (cb > 0).T.astype(np.float32) >= need) & ((ca > 0).astype(np.float32) @ cb.T >= need)
            p, q = np.nonzero(ok)
            p, q = g["node"][x][p], g["node"][right][q]
            yield np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1)

    def grouped(found):
        import pyarrow as pa

        e = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        begin = np.flatnonzero(np.concatenate([[True], e[1:, 0] != e[:-1, 0]])) if len(e) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(e)), pa.int32()), pa.array(e[:, 1]))
        return pa.RecordBatch.from_arrays([pa.array(e[begin, 0]), lists], ["a", "bs"])

    def run(batches):
        import pyarrow as pa

        rest, found = None, []
        for batch in _and_end(batches):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None])
            if not len(table):
                continue
            table = table.combine_chunks()
            g = {c: np.array(table.column(c)) for c in ("key", "left", "right", "side", "node", "label", "n", "u", "i")}
            g["parts"] = table.column("parts").to_pylist()
            new = (g["key"][1:] != g["key"][:-1]) | (g["left"][1:] != g["left"][:-1]) | (g["right"][1:] != g["right"][:-1])
            begin = np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])
            if batch is not None:  # the last group may go on
                rest = table.slice(begin[-2]).to_batches()[0]
                begin = begin[:-1]
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                found += pairs({c: v[a:b] for c, v in g.items()})
            yield grouped(found)
            found = []

    return run


def _and_end(batches):
    yield from batches
    yield None


def _parts(width: int):
    """Counts of an Arrow batch's keys by part of the hash space, as bytes; 255 stands for any larger count."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("keys"))
            flat, n = np.array(lists.flatten()), np.array(lists.value_lengths())
            row = np.repeat(np.arange(len(n)), n)
            counts = np.zeros((len(n), width), np.int64)
            np.add.at(counts, (row, (flat % width).astype(np.int64)), 1)
            counts = np.minimum(counts, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in counts], pa.binary())], [*batch.schema.names, "parts"])

    return run


def _needed(na, nb, t: int):
    """Least overlap of a link: 100 * overlap >= t * union."""
    return F.ceil(F.lit(t) * (na + nb) / F.lit(100 + t))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, star_rounds: int = 2) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, content (xxhash64 of the text), n_shingles, component_id, links_to.

    Two texts link when 100 * |A and B| >= percent * |A or B| over their sets of word n-grams;
    component_id is the smallest doc_id reachable by links, the row's own included.

    Null or empty texts, and texts without words, have an empty set and link with nothing (not
    even with each other). Rows that repeat, in part or whole, are separate rows of one
    component. A null doc_id is smallest only where its whole component has null ids. Other
    columns are ignored. An empty table gives an empty result. docs must be a deterministic
    plan, such as a scan: rows get their identity from their place in it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.col("text").cast("string").alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(16, max(3, int(size / 6 / _RANGE_ENTRIES).bit_length()))
    dealt = src.mapInArrow(trimmed(_deal(n, bits)), _DEALT)
    with arrow_batches(docs.sparkSession, _BATCH_ROWS):
        table = materialize(dealt.groupBy("r").applyInArrow(lambda key, table: returned(_count(bits))(key, table), _COUNTED), "grams")
    rows = table.where("entries is null").drop("bucket", "entries")

    # Equal sets are one class, represented by its first row.
    reps = rows.where("sig is not null").groupBy("sig").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"))
    reps = materialize(reps, "reps")
    prefix_len = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1
    keys = table.where("entries is not null").groupBy("bucket").applyInArrow(lambda table: returned(_gather)(table), "node long, keys array<long>")
    cand = (
        keys.join(reps.select("node", "n"), "node").withColumn("u", F.col("n") - F.size("keys"))
        .withColumn("p", (prefix_len - F.col("u")).cast("int")).where("p > 0").select("node", "n", "u", "p", "keys")
    )
    cand = cand.mapInArrow(trimmed(_parts(_PARTS)), "node long, n long, u long, p int, keys array<long>, parts binary")
    cand = materialize(cand, "cand")
    # The lower `far`, the more of the text's hashes occur elsewhere, and the better a centre it is.
    post = cand.select("node", "n", "u", (F.col("u") / F.col("n")).alias("far"), F.posexplode(F.slice("keys", F.lit(1), F.col("p"))).alias("i", "key"))
    post = materialize(post, "post")
    shared = post.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    post = materialize(post.join(shared, "key"), "post")

    t = percent
    facts, sets = cand.select("node", "n"), cand.select("node", "keys")

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> those of them that link."""
        fa, fb = (facts.select([F.col(c).alias(c + x) for c in facts.columns]) for x in "ab")
        sa, sb = (sets.select([F.col(c).alias(c + x) for c in sets.columns]) for x in "ab")
        p = pairs.join(fa, F.col("a") == F.col("nodea")).join(fb, F.col("b") == F.col("nodeb"))
        p = p.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * t)).select("a", "b", "na", "nb")
        p = p.join(sa, F.col("a") == F.col("nodea")).join(sb, F.col("b") == F.col("nodeb"))
        inter = F.size(F.array_intersect("keysa", "keysb"))
        return p.where(100 * inter >= t * (F.col("na") + F.col("nb") - inter)).select("a", "b")

    def unlinked(pairs: DataFrame, done: list[DataFrame]) -> DataFrame:
        for d in done:
            pairs = pairs.join(d, ["a", "b"], "left_anti")
        return pairs

    def near(x: str, y: str):
        """Length and positional filters on one shared prefix hash at i (after u unshared ones)."""
        nx, ny, ix, iy = (F.col(f"{a}.{c}") for c in ("n", "i") for a in (x, y))
        ux, uy = F.col(f"{x}.u"), F.col(f"{y}.u")
        best = F.least(ix, iy) + 1 + F.least(nx - ux - ix - 1, ny - uy - iy - 1)
        return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * t) & (best >= _needed(nx, ny, t))

    def labelled(links: list[DataFrame]) -> DataFrame:
        if not links:
            return post.withColumn("label", F.col("node"))
        every = links[0]
        for x in links[1:]:
            every = every.union(x)
        label = connected_components(every)
        return post.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))

    tried: list[DataFrame] = []
    links: list[DataFrame] = []
    fact = F.struct("far", "node", "n", "u", "i")
    for _ in range(star_rounds):
        heads = labelled(links).groupBy("key", "label").agg(F.min(fact).alias("y"))
        heads = materialize(heads, "heads")
        centre = heads.groupBy("key").agg(F.min("y").alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
        star = heads.join(centre, "key").where((F.col("x.node") != F.col("y.node")) & near("x", "y"))
        star = star.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        star = materialize(unlinked(star, tried), "star")
        tried.append(star)
        links.append(materialize(verify(star), "links"))
    # All that is left: pairs between components, in posting lists that hold more than one.
    lab = materialize(labelled(links).select("key", "label", fact.alias("y")), "lab")
    by = lab.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = by.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("m"), F.ceil(F.sum("k") / F.lit(_BLOCK_ROWS)).alias("s")).where("m > 1").select("key", "main", "s")
    # Rows outside a list's main label meet all rows, in blocks of a bounded number of rows.
    minor = F.col("label") != F.col("main")
    lab = lab.join(mixed, "key").join(cand.select("node", "parts"), F.col("y.node") == F.col("node"))
    lab = lab.select("key", "label", "main", "s", "node", "y.n", "y.u", "y.i", "parts", F.pmod(F.xxhash64("node"), "s").alias("own"))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))
    lefts = lab.where(minor).withColumn("other", every_block).select("*", F.col("own").alias("left"), F.col("other").alias("right"), F.lit(0).alias("side"))
    rights = lab.withColumn("other", every_block).select("*", F.col("other").alias("left"), F.col("own").alias("right"), F.lit(1).alias("side"))
    blocks = lefts.unionByName(rights).select("key", "left", "right", "side", "node", "label", "n", "u", "i", "parts")
    blocks = blocks.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    cross = blocks.mapInArrow(trimmed(_pairing(t)), _PAIRING).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
    cross = cross.select("a", F.explode("bs").alias("b"))
    cross = materialize(unlinked(cross, tried), "cross")
    links.append(materialize(verify(cross), "links"))

    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    label = connected_components(every)
    classes = reps.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).select("sig", "label", "least_id")
    least = classes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(least, "label").select("sig", "component_id")
    out = rows.select("doc_id", "content", F.col("n").alias("n_shingles"), "sig").join(classes, "sig", "left")
    return out.select("doc_id", "content", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one row of each component: the row of the smallest doc_id, then of the smallest content hash.

    Rows whose set is empty all stay, null texts too; of rows that are equal in doc_id and text
    one stays. A null doc_id counts as the largest. Other columns, whatever their names, are kept;
    an empty table stays empty.
    """
    c = ngram_components(docs, **how)
    c = materialize(c, "components")
    worded = c.where("n_shingles > 0")
    kept = worded.groupBy("component_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("doc_id").alias("doc_id"), "content")).alias("k"))
    drop = worded.select("doc_id", "content").distinct().join(kept.select(F.col("k.doc_id").alias("d"), F.col("k.content").alias("c")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left_anti")
    again = worded.groupBy("doc_id", "content").count().where("count > 1").select("doc_id", "content")
    own, names = own_names(docs)
    doc_id = F.col(names["doc_id"])
    d = own.withColumn("__content", F.xxhash64(names["text"]))
    drop = drop.select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"))
    same = doc_id.cast("long").eqNullSafe(F.col("__d")) & (F.col("__content") == F.col("__c"))
    out = d.join(drop, same, "left_anti")
    once = again.select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"))
    if once.isEmpty():
        return old_names(out, names)
    one, rest = out.join(once, same, "left_semi"), out.join(once, same, "left_anti")
    return old_names(rest.unionByName(one.dropDuplicates([names["doc_id"], "__content"])), names)
