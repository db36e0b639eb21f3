import hashlib
import random

import numpy as np
import pytest
from strandloom.llm import fingerprint as fp


def brute_chunks(raw, least=12, normal=32, most=128):
    """The chunks of one text, byte by byte."""
    out, start, window = [], 0, []
    bits = normal.bit_length() - 1
    for i, b in enumerate(raw):
        window = [int(fp._GEAR[b]), *window[:31]]
        h = sum(g << k for k, g in enumerate(window)) % 2**32
        n = i + 1 - start
        cut = (n >= least and n < normal and h >> (32 - bits - 1) == 0) or (n >= normal and h >> (32 - bits + 1) == 0) or n == most
        if cut:
            out.append(raw[start : i + 1])
            start = i + 1
    return out + [raw[start:]] * (start < len(raw))


def texts():
    rnd = random.Random(5)
    words = ["alpha", "bête", "gamma", "δέλτα", "x", "漢字"]
    t = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 40, 400]))) for _ in range(40)]
    return t + ["", "a" * 1000, "😀" * 77, t[3], t[5]]


def test_chunks():
    raw = [t.encode() for t in texts()]
    data, offsets = fp._buffer(texts())
    row, end = fp.chunk_ends(data, offsets)
    start = np.concatenate([[0], end[:-1]])
    got = [[] for _ in raw]
    for r, a, b in zip(row, start, end):
        got[r].append(data[a:b].tobytes())
    assert got == [brute_chunks(r) for r in raw]
    sets = fp.chunk_sets(data, offsets)
    assert [len(s) for s in sets] == [len(set(g)) for g in got]
    assert all((fp.chunks_of(fp.text_of(s)) == s).all() for s in sets)
    for i in range(0, len(raw), 3):
        for j in range(0, len(raw), 5):
            a, b = set(got[i]), set(got[j])
            want = sum(len(c) for c in a & b) / sum(len(c) for c in a) if a else float(not b)
            assert fp.containment(sets[i], sets[j]) == pytest.approx(want)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        e = fp.edited(t, nxt)
        a, b, c = (fp.chunk_sets(*fp._buffer([x]))[0] for x in (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.text_of(a), fp.text_of(b), fp.containment(a, b), fp.containment(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_compare(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(fp, "_BLOCK_BYTES", block_bytes)
    rows = [(i * 13 % 47, t) for i, t in enumerate(texts())] + [(None, "null id"), (None, None), (7, "again"), (7, "again"), (9, None)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted([tuple(r) for r in fp.compare_with_next(df).collect()], key=str)
    assert got == brute(rows)


def test_few_rows(spark):
    for rows in ([], [(1, None)], [(1, "abcd")], [(2, "abcdef"), (1, "xy")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted([tuple(r) for r in fp.compare_with_next(df).collect()], key=str) == brute(rows)
        assert fp.fingerprints(df).count() == len(rows)


def test_half_edit_scores():
    rnd = random.Random(2)
    a, b = (" ".join(str(rnd.random()) for _ in range(200)) for _ in range(2))
    x, y, z = fp.chunk_sets(*fp._buffer([a, fp.edited(a, b), b]))
    assert 0.4 < fp.containment(x, y) < 0.6 and fp.containment(x, z) < 0.05


def test_the_plan_holds_the_cuts_a_few_times_only(spark, monkeypatch):
    """Blocks of a few bytes: a plan of a few times its cuts, and the results of one block."""
    docs = spark.createDataFrame([(3 * i + 10**9, f"text number {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    want = sorted(map(tuple, fp.compare_with_next(docs).collect()))
    monkeypatch.setattr(fp, "_BLOCK_BYTES", 100)
    got = fp.compare_with_next(docs)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    assert sorted(map(tuple, got.collect())) == want
