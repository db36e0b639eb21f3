"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode a space and the text, so that their tokens cover the same bytes. B's
tokens are a static interval index: starts and ends in ascending order. Each A token is a stabbing
query that two bisections answer with the list of B tokens it overlaps. A gap between A tokens
that no B token spans ends a group; within a group all A and B tokens are linked.

Corpus-wide, a pair of ids counts the documents that hold it linked. Documents keep their distinct
pairs packed, pairs are counted over all documents, and the counts go back to the packed pairs: by
broadcast if the pairs are few, else by a join of packed blocks over ranges of A ids.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialize, prefer_small_batches, slices_by_bytes, trimmed
from .sentencepiece_codec import encoder, model_bytes

DEFAULT_A = "/opt/tokenizers/byte_bpe_50k.json"
#: Up to so many distinct pairs, of 16 bytes each, are broadcast; beyond, ranges of A ids are joined.
BROADCAST_PAIRS = 2_000_000
RANGES = 256
#: Groups of more links are taken by distinct ids; so many distinct pairs at a time.
_WIDE, _BLOCK = 4096, 1 << 20
_SLICE = 1 << 18
_COUNTED = 1 << 21
_LOADED: dict[int, "ByteLevel"] = {}

#: The split of text before merges that byte-level models of this kind use. A fixed value.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte of each character of byte-level entries: printable bytes stand for themselves, others for 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE model of a tokenizer file: ids of texts without special tokens, and the bytes of ids."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model, of = j["model"], _byte_of()
        raw = {i: bytes(map(of.__getitem__, t)) for t, i in model["vocab"].items()}
        self.raw = [raw.get(i, b"") for i in range(max(raw) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and sorted(raw) == list(range(256 + len(merges)))
        usual = j.get("normalizer") is None and j["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if ranked and usual and not model.get("ignore_merges"):
            import tiktoken

            e = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})
            self.encode_all = lambda texts: [e.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(spec.decode())
            t.encode_special_tokens = True
            self.encode_all = lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def byte_level(spec: bytes) -> ByteLevel:
    k = hash(spec)
    if k not in _LOADED:
        _LOADED.clear()
        _LOADED[k] = ByteLevel(spec)
    return _LOADED[k]


class Intervals:
    """A static index over consecutive intervals: which of them a query overlaps."""

    def __init__(self, ends: np.ndarray):
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]])

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) of the intervals that overlap each [start, end)."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): where each group begins among A's and among B's tokens, with the numbers of tokens as last entries.

    Both lists cover the same bytes; a document's last token ends a group, as no token spans two.
    """
    if not len(a_ends):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    index = Intervals(b_ends)
    first, last = index.stab(np.concatenate([[0], a_ends[:-1]]), a_ends)
    cut = np.flatnonzero(last[:-1] <= first[1:]) + 1
    return np.concatenate([[0], cut, [len(a_ends)]]), np.concatenate([[0], first[cut], [len(b_ends)]])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. count[i] of them, for all i in turn."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - count - first, count)


def _links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, width: int) -> np.ndarray:
    """Codes a * width + b of every linked pair of occurrences."""
    na, nb = np.diff(ga), np.diff(gb)
    per = np.repeat(nb, na)  # partners of each A token of these groups
    at = _ranges(np.repeat(gb[:-1], na), per)
    return np.repeat(a.astype(np.int64), per) * width + b[at]


def pair_blocks(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, width: int):
    """(codes, links) of one document's distinct linked pairs, in blocks of disjoint codes, each ascending.

    Groups of many links are taken by their distinct ids and how often these occur, for a range
    of A ids at a time, so that memory does not grow with the square of a group.
    """
    na, nb = np.diff(ga), np.diff(gb)
    wide = np.flatnonzero(na * nb > _WIDE)
    if not len(wide):
        yield np.unique(_links(a, b, ga, gb, width), return_counts=True)
        return
    kinds = [(np.unique(a[ga[g] : ga[g + 1]], return_counts=True), np.unique(b[gb[g] : gb[g + 1]], return_counts=True)) for g in wide]
    slim = np.flatnonzero(na * nb <= _WIDE)
    keep = lambda ends, x: (x[_ranges(ends[slim], np.diff(ends)[slim])], np.concatenate([[0], np.cumsum(np.diff(ends)[slim])]))
    (sa, sga), (sb, sgb) = keep(ga, a), keep(gb, b)
    codes, links = np.unique(_links(sa, sb, sga, sgb, width), return_counts=True)
    # A ids in ascending order, cut where the pairs of wide groups fill a block.
    ids, load = np.concatenate([u for (u, _), _ in kinds]), np.concatenate([np.full(len(u), len(v)) for (u, _), (v, _) in kinds])
    order = np.argsort(ids, kind="stable")
    ids, block = ids[order], np.cumsum(load[order]) // _BLOCK
    edges = [0, *np.unique(ids[np.flatnonzero(np.diff(block)) + 1]).tolist(), 1 << 40]
    for lo, hi in zip(edges, edges[1:]):
        c, n = [codes[(codes >= lo * width) & (codes < hi * width)]], [links[(codes >= lo * width) & (codes < hi * width)]]
        for (u, un), (v, vn) in kinds:
            x = (u >= lo) & (u < hi)
            c.append((u[x].astype(np.int64)[:, None] * width + v).ravel())
            n.append((un[x][:, None] * vn).ravel())
        c, n = np.concatenate(c), np.concatenate(n)
        found, back = np.unique(c, return_inverse=True)
        if len(found):
            yield found, np.bincount(back, n, len(found)).astype(np.int64)


_DIGITS: list[tuple[np.ndarray, np.ndarray]] = []


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal forms of 0 .. most as rows of bytes with room for a separator, and their lengths."""
    if not _DIGITS or len(_DIGITS[0][1]) <= most:
        texts = [str(i).encode() for i in range(max(most + 1, 1 << 16))]
        width = len(texts[-1]) + 1
        _DIGITS[:] = [(np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(-1, width), np.array(list(map(len, texts))))]
    return _DIGITS[0]


def group_text(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3: the groups' ids in order."""
    if not len(a):
        return b""
    na, nb = np.diff(ga), np.diff(gb)
    # A group's A tokens come after all tokens of earlier groups, its B tokens after its A tokens.
    place_a, place_b = np.arange(len(a)) + np.repeat(gb[:-1], na), np.arange(len(b)) + np.repeat(ga[1:], nb)
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[ga[1:] - 1]], mark[place_b[gb[1:] - 1]] = ord("|"), ord(";")
    table, length = _digits(int(ids.max()))
    rows, n = table[ids].copy(), length[ids]
    rows[np.arange(len(ids)), n] = mark
    return rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()[:-1]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 by byte planes, compressed."""
    import pyarrow as pa

    raw = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:4], "little")
    raw = pa.Codec("zstd").decompress(data[4:], 4 * n, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


_ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, links binary"


def _align(spec: bytes, model: bytes):
    """Documents (doc_id, row, text) -> figures, and packed pairs in one or, for very wide groups, more rows of the same document."""

    def run(batches):
        import pyarrow as pa

        a_of, b_of = byte_level(spec), encoder(model)
        a_len, b_len = (np.array(list(map(len, x.raw)), np.int64) for x in (a_of, b_of))
        width = len(b_len)
        if len(a_len) * width >= 1 << 32:
            raise NotImplementedError("pairs of ids must fit 32 bits")
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column(2).to_pylist()]
                sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                for lo, hi in slices_by_bytes(sizes, _SLICE):
                    part = texts[lo:hi]
                    out = {n.split()[0]: [] for n in _ALIGNED.split(", ")}
                    ids_a = a_of.encode_all([f" {t}" for t in part])
                    ids_b = [np.frombuffer(x, "<i4") for x in b_of.encode_all(part)]
                    for k, (t, xa, b) in enumerate(zip(part, ids_a, ids_b)):
                        want = b" " + t.encode()
                        if not t or b"".join(map(a_of.raw.__getitem__, xa)) != want or b"".join(map(b_of.raw.__getitem__, b.tolist())) != want:
                            rows, figures = [(b"", b"")], (0, 0, 0, 0, "")
                        else:
                            a = np.array(xa, np.int64)
                            ga, gb = groups_of(np.cumsum(a_len[a]), np.cumsum(b_len[b]))
                            figures = len(a), len(b), len(ga) - 1, int((np.diff(ga) * np.diff(gb)).sum()), hashlib.sha256(group_text(a, b, ga, gb)).hexdigest()
                            rows = [(_pack(np.diff(c, prepend=0)), _pack(n)) for c, n in pair_blocks(a, b, ga, gb, width)]
                        for i, (c, n) in enumerate(rows):
                            values = (*(batch.column(x)[lo + k].as_py() for x in (0, 1)), *(figures if i == 0 else (None,) * 5), c, n)
                            for column, v in zip(out.values(), values):
                                column.append(v)
                    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(out.values(), kinds)], list(out))
        finally:
            b_of.forget()

    return run


def _codes(column) -> tuple[np.ndarray, np.ndarray]:
    """All codes of packed rows, one after the other, and how many each row has."""
    parts = [np.cumsum(_unpack(x)) if x else np.zeros(0, np.int64) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array(list(map(len, parts)), np.int64)


def _count(batches):
    """Packed pairs -> (code, n): in how many of a task's documents each occurs, added up before they leave the task as far as memory is bounded."""
    import pyarrow as pa

    def added(parts):
        c, n = (np.concatenate(x) for x in zip(*parts))
        found, back = np.unique(c, return_inverse=True)
        return found, np.bincount(back, n, len(found)).astype(np.int64)

    def out(c, n):
        for at in range(0, len(c), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["code", "n"])

    held, fresh, some = [], [], 0
    for batch in batches:
        c = _codes(batch.column(0))[0]
        fresh.append(c)
        some += len(c)
        if some >= _COUNTED:
            held = [added([*held, (x := np.concatenate(fresh), np.ones(len(x)))])]
            fresh, some = [], 0
            if len(held[0][0]) > 2 * _COUNTED:
                yield from out(*held[0])
                held = []
    if fresh or held:
        x = np.concatenate([np.zeros(0, np.int64), *fresh])
        yield from out(*added([*held, (x, np.ones(len(x)))]))


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(code, n, best) of packed pairs: in how many documents each is linked, and whether its A id has none of more."""
    counts = aligned.select("codes").mapInArrow(trimmed(_count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pair-counts")
    a = F.floor(F.col("code") / width)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, a == F.col("a")).select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def _weighed(codes: np.ndarray, links: np.ndarray, per: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """(links with the best count, sum of counts over links) of each row, by a table of ascending codes."""
    known, n, best = table
    at = np.searchsorted(known, codes)
    row = np.repeat(np.arange(len(per)), per)
    ends = np.concatenate([[0], np.cumsum(per)])
    total = lambda x: (y := np.concatenate([[0], np.cumsum(x)]))[ends[1:]] - y[ends[:-1]] if len(row) else np.zeros(len(per), np.int64)
    return total(np.where(best[at], links, 0)), total(n[at] * links)


def _by_broadcast(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    spark = packed.sparkSession
    t = pairs.toArrow().sort_by("code")
    held = spark.sparkContext.broadcast((t.column("code").to_numpy(), t.column("n").to_numpy(), t.column("best").to_numpy()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                codes, per = _codes(rows.column(1))
                links = np.concatenate([np.zeros(0, np.int64), *[_unpack(x) for x in rows.column(2).to_pylist() if x]])
                best, total = _weighed(codes, links, per, held.value) if len(codes) else (np.zeros(len(per), np.int64),) * 2
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(best), pa.array(total)], ["row", "n_best", "count_sum"])

    return packed.mapInArrow(trimmed(run), "row long, n_best long, count_sum long")


def _by_ranges(pairs: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """The same by a join of blocks: pairs of A ids that are equal modulo RANGES are one table, of a size that the vocabularies bound."""

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            codes, per = _codes(batch.column(1))
            links = np.concatenate([np.zeros(0, np.int64), *[_unpack(x) for x in batch.column(2).to_pylist() if x]])
            row = np.repeat(batch.column(0).to_numpy(), per)
            order = np.lexsort([codes, codes // width % RANGES])
            codes, links, row = codes[order], links[order], row[order]
            edges = np.searchsorted(codes // width % RANGES, np.arange(RANGES + 1))
            for r in np.flatnonzero(np.diff(edges)):
                x = slice(edges[r], edges[r + 1])
                yield pa.RecordBatch.from_arrays([pa.array([int(r)], pa.int32()), *[pa.array([v[x].astype("<i8").tobytes()]) for v in (codes, links, row)]], ["r", "codes", "links", "rows"])

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                codes, links, row = (np.frombuffer(batch.column(k)[i].as_py(), "<i8") for k in range(3))
                t = batch.column(3)[i].values
                known, n, best = (t.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                which, back = np.unique(row, return_inverse=True)
                by = np.argsort(back, kind="stable")
                out = _weighed(codes[by], links[by], np.bincount(back), (known, n, best))
                yield pa.RecordBatch.from_arrays([pa.array(which), *map(pa.array, out)], ["row", "n_best", "count_sum"])

    tables = pairs.groupBy((F.floor(F.col("code") / width) % RANGES).cast("int").alias("r")).agg(F.array_sort(F.collect_list(F.struct("code", "n", "best"))).alias("t"))
    blocks = packed.mapInArrow(trimmed(split), "r int, codes binary, links binary, rows binary")
    both = blocks.join(tables.hint("merge"), "r").select("codes", "links", "rows", "t")
    return both.mapInArrow(trimmed(look), "row long, n_best long, count_sum long")


def align(docs: DataFrame, a: bytes | None = None, b: bytes | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of docs(doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a is a byte-level tokenizer file's contents, b a SentencePiece model's. Strings of special
    tokens are plain text. Null and empty texts, and texts whose tokens' bytes are not a space
    and the text (as with U+2581, which B takes for a space), have no tokens: zeros and ''.
    Ties for an A id's highest count are all best. Repeated rows stay apart and count as one
    document each; null doc_ids stay; other columns, whatever their names, are ignored; an empty
    table stays empty. A text is encoded in one task, with memory in proportion to its length.
    """
    spec = model_bytes(DEFAULT_A) if a is None else a
    model = model_bytes() if b is None else b
    spark = docs.sparkSession
    width = len(encoder(model).raw)
    prefer_small_batches(spark, 200)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    aligned = materialize(d.mapInArrow(trimmed(_align(spec, model)), _ALIGNED), "aligned")
    with arrow_batches(spark, 200):
        pairs = materialize(pair_counts(aligned, width), "pairs")
        packed = aligned.select("row", "codes", "links")
        few = pairs.count() <= broadcast_pairs
        found = _by_broadcast(pairs, packed) if few else _by_ranges(pairs, packed, width)
        found = materialize(found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "weighed")
    discard(pairs)
    rest = aligned.where("groups_sha256 is not null").join(found, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return rest.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
