import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from strandloom.llm import sentencepiece_codec as sp

MODEL = sp.model_bytes()
PIECES = sp.load(MODEL)


def library():
    """The library, made to search the best path over the same pieces and scores."""
    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    m.trainer_spec.model_type = 1
    for p in m.pieces:  # lone marks score -1e9, which single precision cannot add to the others
        p.score = max(p.score, -8e6)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def score(ids):
    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    return sum(m.pieces[i].score for i in ids)


def exhaustive(text):
    """The best score over all segmentations."""
    best = {0: 0.0}
    for i in range(len(text)):
        for j, v in PIECES.steps(text, i, len(text)):
            best[j] = max(best.get(j, best[i] + v), best[i] + v)
    return best[len(text)]


def texts():
    rnd = random.Random(9)
    words = ["the", "Élan", "straße", "token", "aaa", "aaaa", "ning", "año", ",", "漢", "\n", "  ", "▁", "😀", "12345", "x" * 30]
    t = ["", None, " ", "   ", "a", " a", "a ", "▁▁", "naïve café", "aaaaaaaaaaaaaaa" * 5]
    return t + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 80))) for _ in range(40)] + ["".join(rnd.choice("abcdeéß漢") for _ in range(500))]


def test_words_are_best_and_decode():
    lib = library()
    for t in texts():
        ids = np.frombuffer(PIECES.encode_all([t or ""])[0], "<i4").tolist()
        assert ids == PIECES.best(sp.normalized(t or ""))
        assert PIECES.decode(ids) == (t or "").replace(sp.MARK, " ") == lib.decode(ids)
        n = sp.normalized(t or "")
        if len(n) < 60 and all(PIECES.found.get(c) for c in n):
            assert score(ids) == exhaustive(n)


def test_library_agrees_on_words():
    lib = library()
    rnd = random.Random(3)
    words = ["the", "token", "naming", "statement", "people", "Sparkling", "größe"] + ["".join(rnd.choice("aeinrstéß.,") for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    for w in words:
        assert PIECES.best(sp.normalized(w)) == lib.encode(w)


@pytest.mark.parametrize("chunk", [16, 17, 64])
def test_chunks_give_the_best_path(chunk):
    for t in texts():
        n = sp.normalized(t or "")
        if len(n) <= chunk:
            continue
        ends = sp.cut_points(n, chunk)
        begins = [0, *ends[:-1]]
        reach = PIECES.longest - 1
        parts = [(n[a : b + reach], b - a, b == len(n)) for a, b in zip(begins, ends)]
        full = [PIECES.matrix(*p, False) for p in parts]
        ms = [PIECES.matrix(*p, sp.word_begins(n, a)) for p, a in zip(parts, begins)]
        assert sp.prefixes(full)[-1][0, 0] == sp.prefixes(ms)[-1][0, 0]
        st = sp.boundary_states(ms)
        ids = [x for (a, b), (i, o) in zip(zip(begins, ends), st) for x in PIECES.best(n[a : b + reach], i, b - a + o)]
        total = sp.prefixes(ms)[-1]
        assert total[0, 0] == exhaustive(n)
        assert PIECES.decode(ids) == t.replace(sp.MARK, " ")
        if all(b - a < chunk or b == len(n) for a, b in zip(begins, ends)):
            assert ids == PIECES.best(n)


def test_scan_is_associative():
    rnd = np.random.default_rng(0)
    ms = [rnd.integers(-9, 0, (4, 4)).astype(float) for _ in range(7)]
    want = [ms[0]]
    for m in ms[1:]:
        want.append(sp.max_plus(want[-1], m))
    assert all((a == b).all() for a, b in zip(sp.prefixes(ms), want))


def test_frames(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts())] + [(3, "again"), (3, "again"), (None, "no id")][0:0]
    rows += [(3, "again", "c"), (3, "again", "c"), (None, "no id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    whole = sorted([(str(r["doc_id"]), r["ids"]) for r in sp.encode(df, MODEL).collect()])
    parts = sorted([(str(r["doc_id"]), r["ids"]) for r in sp.encode(df, MODEL, giant=100, chunk=128).collect()])
    assert whole == parts and len(whole) == len(rows)
    back = sorted((str(r["doc_id"]), r["text"]) for r in sp.decode(sp.encode(df, MODEL, giant=100, chunk=20), MODEL).collect())
    assert back == sorted((str(d), (t or "").replace(sp.MARK, " ")) for d, t, _ in rows)
    assert sp.decode(sp.encode(df.limit(0), MODEL), MODEL).count() == 0


def test_ids_are_the_models_own(spark):
    """The unchanged model in the library, on whole texts; giant ones too, with words longer than a chunk."""
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rnd = random.Random(6)
    odd = ["The token over the international", "\x00\x01 a\tb\r\n c", "a" * 300 + " " + "漢字" * 200 + " the  end", "▁▁ x ▁", "x" + " " * 200 + "y"]
    odd.append(" ".join("".join(rnd.choice("aeinrstéß.,漢") for _ in range(rnd.randrange(1, 12))) for _ in range(400)))
    rows = [(i, t) for i, t in enumerate([*texts(), *odd])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, lib.encode(t or "")) for i, t in rows]
    for how in ({}, {"giant": 40, "chunk": 20}, {"giant": 100, "chunk": 64}):
        assert sorted((r["doc_id"], r["ids"]) for r in sp.encode(df, MODEL, **how).collect()) == want


def test_transfers_of_a_merging_model():
    """Chunks cut anywhere, also inside words: matrices, scan and traces give the library's own ids."""
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    merges = sp.encoder(MODEL)
    rnd = random.Random(11)
    odd = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30, 300))) for alphabet in ("ab", "aein", "theringsou", "漢字学生中国", "0123456789abcdef", "xé\U0001f600 ", "  a", "=-_") for _ in range(6)]
    crossing = 0
    for t in [*odd, *(t for t in texts() if t)]:
        n = sp.normalized(t)
        for chunk in (16, 23):
            rows = [r[1:] for r in sp.chunks_of(n, chunk, merges.longest)]
            states = sp.boundary_pieces([merges.transfer(*r) for r in rows])
            assert [x for r, s in zip(rows, states) for x in merges.trace(*r, *s)] == lib.encode(t)
            crossing += sum(leave[1] > 0 for _, leave in states)
    assert crossing > 100


def test_sparse_products_are_dense_ones():
    rnd = np.random.default_rng(2)
    dense = [np.where(rnd.random((4, 4)) < 0.5, rnd.integers(-9, 0, (4, 4)).astype(float), -np.inf) for _ in range(6)]
    sparse = [{(i, j): m[i, j] for i in range(4) for j in range(4) if m[i, j] > -np.inf} for m in dense]
    for d, s in zip(sp.prefixes(dense), sp.prefixes(sparse, sp.max_plus_sparse)):
        assert s == {(i, j): d[i, j] for i in range(4) for j in range(4) if d[i, j] > -np.inf}


def test_words_are_forgotten_by_bytes(monkeypatch):
    monkeypatch.setattr(sp, "_MEMORY", 5000)
    merges = sp.encoder(MODEL)
    merges.forget()
    for i in range(50):
        merges.encode_all([f"word{i}x and{i} some{i}"])
    assert len(merges.words) < 60


def test_encoding_back_is_decoding(spark):
    rows = list(enumerate([t for t in texts()]))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: (r["ids"], r["text"]) for r in sp.decode(sp.encode(d, MODEL), MODEL).collect()}
    for giant, chunk in ((sp.GIANT, sp.CHUNK), (60, 20)):
        assert {r["doc_id"]: (r["ids"], r["text"]) for r in sp.encode(d, MODEL, giant, chunk, back=True).collect()} == want
