"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes cuts a text where its top bits are zero: by a harder mask
before the normal chunk size and an easier one after it, between a least and a largest size.
Boundaries move with the content, so an edit changes only the chunks around it. A fingerprint
is the set of a text's chunk digests with their lengths; the containment of one text in another
is the share of its chunks' length whose digests the other has too.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prefer_small_batches, slices_by_bytes, text_buffers, trimmed
from .ngram_join import _inverse_powers, _powers

_RNG = np.random.default_rng(977)
_GEAR = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
_DIGEST = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_WINDOW = 32
_SLICE_BYTES = 4 << 20
#: Blocks of consecutive ids hold about this many bytes of text on average.
_BLOCK_BYTES = 4 << 20


def _gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of gear[b] << distance over the row's last 32 bytes."""
    rows = len(offsets) - 1
    gap = np.repeat(np.arange(rows, dtype=np.int64) * _WINDOW, np.diff(offsets))
    at = np.arange(len(data), dtype=np.int64) + gap
    h = np.zeros(len(data) + rows * _WINDOW, np.uint32)  # zeros between rows: nothing leaks into the next row
    h[at] = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h[at]


def chunk_ends(data: np.ndarray, offsets: np.ndarray, least: int = 12, normal: int = 32, most: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Row and end (exclusive, in the buffer) of every chunk, by row and place.

    All rows advance by one chunk at a time together.
    """
    bits = normal.bit_length() - 1
    h = _gear(data, offsets)
    easy = np.flatnonzero(h >> np.uint32(32 - bits + 1) == 0) + 1
    hard = easy[h[easy - 1] >> np.uint32(32 - bits - 1) == 0]
    far = np.int64(len(data) + most + 1)
    easy, hard = np.append(easy, far), np.append(hard, far)
    row = np.flatnonzero(np.diff(offsets))
    start, stop = offsets[row], offsets[row + 1]
    rows, ends = [], []
    while len(row):
        a = hard[np.searchsorted(hard, start + least)]
        b = easy[np.searchsorted(easy, start + normal)]
        end = np.where(a < start + normal, a, b)
        end = np.minimum(np.minimum(end, start + most), stop)
        rows.append(row)
        ends.append(end)
        more = end < stop
        row, start, stop = row[more], end[more], stop[more]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, ends = np.concatenate(rows), np.concatenate(ends)
    order = np.argsort(ends, kind="stable")
    return rows[order], ends[order]


def chunk_sets(data: np.ndarray, offsets: np.ndarray, **sizes: int) -> list[np.ndarray]:
    """For each row its distinct chunks, sorted, as digest (40 bits) << 16 | length in bytes."""
    rows = len(offsets) - 1
    row, end = chunk_ends(data, offsets, **sizes)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_DIGEST[data] * _powers(len(data))[: len(data)], out=total[1:])
    n = (end - start).astype(np.uint64)
    d = mix64((total[end] - total[start]) * _inverse_powers(len(data) + 1)[start] + n * _DIGEST[3])
    packed = (d >> np.uint64(24)) << np.uint64(16) | n
    cut = np.searchsorted(row, np.arange(rows + 1)).tolist()
    out = []
    for a, b in zip(cut, cut[1:]):
        s = np.sort(packed[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def text_of(chunks: np.ndarray) -> str:
    """The fingerprint as a string: base64 of 7 bytes for each chunk (5 of digest, 2 of length)."""
    return base64.b64encode(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()).decode()


def chunks_of(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 7)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 1:] = raw
    return full.view(">u8")[:, 0].astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's weight that b has too; of two empty sets 1, of an empty and another 0."""
    if not len(a):
        return float(not len(b))
    if not len(b):
        return 0.0
    w = a & np.uint64(0xFFFF)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return float(w[b[at] == a].sum() / w.sum())


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def fingerprints(docs: DataFrame, **sizes: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, fingerprint: the operator on texts alone.

    A null text counts as empty; an empty text has the empty fingerprint. Equal texts have equal
    fingerprints; rows that repeat stay apart; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices_by_bytes(offsets, _SLICE_BYTES):
                part = data[offsets[a] : offsets[b]]
                prints = [text_of(c) for c in chunk_sets(part, offsets[a : b + 1] - offsets[a], **sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(sizes: dict):
    """Sorted (block, guest, doc_id, text) rows -> the comparison of each row with the one after it in its block.

    The last row of a block is a guest, the first of the next block; it gets no result.
    """

    def run(batches):
        import pyarrow as pa

        def results(rows):
            """rows: (block, guest, doc_id, text); the last is only looked at."""
            texts = [r[3] for r in rows]
            two = [edited(x, y) for x, y in zip(texts, texts[1:])]
            own = chunk_sets(*_buffer(texts), **sizes)
            new = chunk_sets(*_buffer(two), **sizes)
            keep = [i for i in range(len(rows) - 1) if not rows[i][1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in keep], pa.int64()),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(two[i].encode()).hexdigest() for i in keep], pa.string()),
                    pa.array([text_of(own[i]) for i in keep], pa.string()),
                    pa.array([text_of(new[i]) for i in keep], pa.string()),
                    pa.array([containment(own[i], new[i]) for i in keep], pa.float64()),
                    pa.array([containment(own[i], own[i + 1]) for i in keep], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held.append(row)
                size += len(row[3])
                if size >= _SLICE_BYTES:
                    yield results(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield results(held)

    return run


def compare_with_next(docs: DataFrame, **sizes: int) -> DataFrame:
    """Each row of docs(doc_id, text) against its edited text and the next document, by ascending doc_id.

    The next of the last document is the first; equal ids follow in the order of their texts, a
    null doc_id comes last. Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (containment of the document in the other). Null
    texts count as empty. Of a lone row the next is the row itself. An empty table gives an
    empty result; other columns are ignored.

    Rows are dealt to blocks of consecutive ids, and each block also gets the first row of the
    block after it, so that no task needs more than its block.
    """
    prefer_small_batches(docs.sparkSession, 500)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size // _BLOCK_BYTES) + 1
    cuts = []
    if blocks > 1:
        marks = d.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], max(10000, 20 * blocks))).first()[0]
        cuts = sorted(set(marks or []))
    # The block is the number of cuts at or below doc_id, by binary search in one expression: steps
    # that are columns of each other grow the optimiser's plans by a factor each.
    block = F.lit(0)
    if cuts:
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        table = F.lit(cuts)
        below = lambda at: (at <= len(cuts)) & (F.get(table, at - 1) <= F.col("doc_id"))
        block = F.aggregate(steps, F.lit(0), lambda b, step: F.when(below(b + step), b + step).otherwise(b))
    d = d.withColumn("block", block)
    d = d.withColumn("block", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.col("block")))
    d = d.withColumn("at", F.coalesce("doc_id", F.lit(2**63 - 1)))
    # The first id of each block: a row per block, bounded by the number of blocks.
    firsts = d.groupBy("block").agg(F.min("at").alias("at")).orderBy("block").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], _OUT)
    goes = [(r["block"], r["at"], firsts[i - 1]["block"]) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(goes, "block int, at long, goes int")
    head = d.join(F.broadcast(heads), ["block", "at"])
    head = head.groupBy("goes").agg(F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text"))
    head = head.select("doc_id", "text", F.col("goes").alias("block"), F.lit(True).alias("guest"))
    every = d.select("doc_id", "text", "block", F.lit(False).alias("guest")).unionByName(head)
    return (
        every.repartition(len(firsts), "block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_last(), "text")
        .select("block", "guest", "doc_id", "text").mapInArrow(trimmed(_compare(sizes)), _OUT)
    )
