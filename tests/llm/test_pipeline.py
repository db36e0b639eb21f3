import random
from collections import Counter, defaultdict

import numpy as np
import corpus_pipeline
from strandloom.llm import langid, sentencepiece_codec
from test_langid import WORDS
from test_mixing import brute_targets
from test_ngram_join import brute as components
from test_pii import brute as personal


def corpus():
    rnd = random.Random(6)
    rows = []
    for i in range(160):
        lang = rnd.choice(list(WORDS))
        words = [rnd.choice(WORDS[lang]) + rnd.choice(["", "", "er", "en", "a"]) for _ in range(rnd.randrange(8, 50))]
        text = " ".join(words)
        if i % 9 == 0:
            text += f" me{i}@mail.example"
        rows.append((i, text, lang, rnd.choice(["a", "a", "b", None]), len(text)))
    rows += [(200 + i, t, x, s, n) for i, (_, t, x, s, n) in enumerate(rows[:20])]
    return rows + [(300, None, "en", "a", 0), (301, "", None, "b", 0), (302, "12 34", "en", "a", 5), (303, rows[0][1], "en", "a", 3)]


def test_stages_against_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(corpus(), schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows = [tuple(r) for r in docs.collect()]
        seen[name] = rows
        if name != "token_ids":
            assert docs.columns == before.columns
        was = [tuple(r) for r in before.collect()]
        if name == "language":
            model = langid.fit(before)
            names, scores = model.predict([r[1] for r in was])
            want = [(r[0], r[1], n, *r[3:]) for r, n, s in zip(was, names, scores) if n != "und" and s >= 0.5]
            assert sorted(rows, key=str) == sorted(want, key=str) and len(want) >= 175
        if name == "near_duplicates":
            groups = defaultdict(list)
            for r, (_, _, c) in zip(was, components([x[:2] for x in was])):
                groups[c].append(r)
            assert sorted(r[0] for r in rows) == sorted(min(x[0] for x in g) for g in groups.values())
        if name == "personal_data":
            assert {r[0] for r in rows} == {r[0] for r in was} and all(sum(personal(r[1])[:4]) == 0 for r in rows)
            assert sum("[EMAIL]" in r[1] for r in rows) == sum(personal(r[1])[0] for r in was) > 0
        if name == "source_mix":
            size = {r[0]: len(r[1].split()) for r in was}
            sources = defaultdict(int)
            for r in was:
                sources[r[3]] += size[r[0]]
            got = Counter()
            for r in rows:
                got[r[3]] += size[r[0]]
            want = brute_targets(sources)
            assert all(abs(got[s] - want[s]) <= max(size.values()) for s in want) and max(Counter(rows).values()) <= 3
        if name == "token_ids":
            pieces = sentencepiece_codec.encoder(sentencepiece_codec.model_bytes())
            want = Counter((r[0], tuple(np.frombuffer(pieces.encode_all([r[1]])[0], "<i4").tolist())) for r in was)
            assert Counter((d, tuple(ids)) for d, n, ids in rows) == want and all(n == len(ids) for _, n, ids in rows)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == sorted(map(str, seen["token_ids"]))


def test_stages_keep_other_columns_and_odd_rows(spark):
    """Extra columns of names that operators use, null ids, repeats and a very long text, through every stage."""
    rnd = random.Random(3)
    prose = lambda n: " ".join(rnd.choice(WORDS["en"]) + rnd.choice("abcdefgh") for _ in range(n))
    rows = [(i, prose(40), "en", "a", 0) for i in range(30)] + [(None, prose(40), "en", None, 0), (None, "", "en", "a", 0), (50, prose(30000), "en", "b", 0)]
    rows += [rows[3], rows[3], (60, None, None, None, None)]
    names = ["score", "lang_pred", "__content", "content", "__d", "__c", "__s", "__p", "__at", "__m", "base", "added", "component_id", "size", "h"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} double" for x in names)
    docs = spark.createDataFrame([(*r, *[7.5] * len(names)) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.schema.names
        got = out.collect()
        assert all(r[x] == 7.5 for r in got for x in names) and {r["doc_id"] for r in got} >= {*range(30), None, 50}, name
        docs = spark.createDataFrame(got, docs.schema)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(ids) == docs.count() and max(r["n_ids"] for r in ids) > 30000


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
