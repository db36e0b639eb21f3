import random
import zlib

import numpy as np
from strandloom.llm import langid

WORDS = {"en": ["the", "of", "and", "shore", "thing", "which"], "de": ["der", "und", "schön", "nicht", "Straße", "ein"], "fr": ["le", "été", "que", "dans", "où", "leçon"]}


def rows(n=240, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "de", "fr"])
        out.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(2, 60))), lang))
    return out


def brute_logits(model, text):
    """Features one by one, from a plain walk over the text's n-grams."""
    low = text.lower()
    total, count = np.zeros(len(model.languages)), 0
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if any(c.isalpha() for c in g):
                f = langid.features([g])[0][n - 1, 0]
                total += model.table[f]
                count += 1
    return total / max(count, 1) + model.bias


def test_logits_match_a_plain_walk():
    data = rows(60)
    model = langid.train([t for _, t, _ in data], [x for _, _, x in data])
    texts = ["the été Straße", "a", "", "1 2 3", "Ünd? le 漢字! " * 30]
    got, has = model.logits(texts)
    assert has.tolist() == [True, True, False, False, True]
    assert np.allclose(got, [brute_logits(model, t) for t in texts], atol=1e-4)


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, x, "clash") for i, t, x in data], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(data)
    right = []
    for i, _, x in data:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i]["held_out"] == held and 0 <= got[i]["score"] <= 1
        if held:
            right.append(got[i]["lang_pred"] == x)
    assert len(right) > 30 and np.mean(right) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    data = rows(120)
    lie = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in data]
    schema = "doc_id long, text string, lang string"
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(d, schema)).collect())) for d in (data, lie))
    assert a == b


def test_odd_rows(spark):
    data = [*rows(60), (None, "the thing", "en"), (100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "der und " * 20000, "de"), (103, "der und " * 20000, "de")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = [r for r in langid.identify(df).collect() if r["doc_id"] is None or r["doc_id"] >= 100]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == [("100", "und"), ("101", "und"), ("102", "und"), ("103", "de"), ("103", "de"), ("None", "en")]
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.where("doc_id in (100, 101, 102)").count() == 0 and kept.where("doc_id = 103 or doc_id is null").count() == 3


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(df).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "the", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one).collect()} == {("en", 1.0)}
