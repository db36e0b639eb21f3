import random
import re
from collections import Counter

import pytest
from strandloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, again = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            again |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def texts():
    rnd = random.Random(12)
    vocab = ["the", "of", "é", "漢字😀", "word", "x", "##", "*a*", "END."] + [f"w{i}" for i in range(30)]
    t = ["", None, " \n\t", "a", "a a", "a a a", "a a a a", "a b c a b c", "x\n\nx\nx ", "a\n" * 300, "spam " * 20000, "A" * 5000]
    for _ in range(80):
        t.append("".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", "\n", "\x0b"]) for _ in range(rnd.randrange(150))))
    return t


def test_counts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "a b", ""), (4, "a a", ""), (4, "a a", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    got = sorted(str((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))) for r in quality.judge(df).collect())
    assert got == sorted(str((d, brute(t))) for d, t, _ in rows)


def test_kept(spark):
    rnd = random.Random(1)
    prose = lambda: "\n".join(" ".join(rnd.choice(["shore", "of", "light", "with", "some", "river", "under", "people"]) + str(rnd.randrange(40)) * 0 + rnd.choice("abcdefgh") for _ in range(40)) + "." for _ in range(4))
    junk = lambda: " ".join(rnd.choice(["SALE", "BUY", "NOW", "WIN"]) + str(rnd.random()) + "$$$###" for _ in range(120))
    rows = [(i, prose()) for i in range(80)] + [(1000 + i, junk()) for i in range(30)] + [(2000, None), (2001, "short")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["kept"] for i in range(80)) and not any(got[i]["kept"] for i in got if i >= 1000)
    assert all(0 <= r["quality"] <= 1 for r in got.values())


def test_posteriors_match_bayes_and_recover_accuracies():
    rnd = random.Random(3)
    truth, n = [(0.9, 0.8), (0.7, 0.95), (0.85, 0.85), (0.95, 0.7)], Counter()
    for _ in range(40000):
        y = rnd.random() < 0.75
        votes = []
        for g, b in truth:
            if rnd.random() < 0.2:
                votes.append(None)
            else:
                votes.append(int(rnd.random() < g) if y else int(rnd.random() >= b))
        n[tuple(votes)] += 1
    prior, acc = quality.fit(sorted(n.items(), key=str))
    assert abs(prior - 0.75) < 0.03 and all(abs(a - x) < 0.04 and abs(b - y) < 0.06 for (a, b), (x, y) in zip(acc, truth))
    p = quality.posterior((1, None, 0, 1), 0.6, truth)
    good, bad = 0.6 * 0.9 * 0.15 * 0.95, 0.4 * 0.2 * 0.85 * 0.3
    assert p == pytest.approx(good / (good + bad))


def brute_em(votes):
    """Posteriors by expectation-maximisation over single texts, with the query's priors."""
    (ga, gn), (ba, bn), (sa, sn) = quality.GOOD_PRIOR, quality.BAD_PRIOR, quality.SHARE_PRIOR
    share, good, bad = 0.8, [0.95] * len(votes[0]), [0.4] * len(votes[0])
    for _ in range(301):
        p = []
        for v in votes:
            a, b = share, 1 - share
            for j, x in enumerate(v):
                if x is not None:
                    a *= good[j] if x else 1 - good[j]
                    b *= 1 - bad[j] if x else bad[j]
            p.append(a / (a + b))
        voted = lambda j, want: [(q, v[j] == want) for q, v in zip(p, votes) if v[j] is not None]  # noqa: E731, B023
        last = p
        share = (sum(p) + sa * sn) / (len(p) + sn)
        good = [(sum(q for q, y in voted(j, 1) if y) + ga * gn) / (sum(q for q, _ in voted(j, 1)) + gn) for j in range(len(votes[0]))]
        bad = [(sum(1 - q for q, y in voted(j, 0) if y) + ba * bn) / (sum(1 - q for q, _ in voted(j, 0)) + bn) for j in range(len(votes[0]))]
    return last


def test_kept_against_brute_force(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{path}') order by doc_id").fetchall()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = list(quality.rules())
    from pyspark.sql import functions as F

    votes = {r["doc_id"]: tuple(r[x] for x in names) for r in quality.counts(df).select("doc_id", *[F.when(b, 0).when(g, 1).alias(x) for x, (g, b) in quality.rules().items()]).collect()}
    ids = sorted(votes)
    want = dict(zip(ids, brute_em([votes[i] for i in ids])))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[i]["quality"] == pytest.approx(want[i], abs=1e-6) and got[i]["kept"] == (not brute(dict(docs)[i])[5] and want[i] >= 0.5) for i in ids)


def test_estimates_are_no_vote_count():
    """On the given rows estimates lie inside 0 to 1, differ between rules, and agree with the labels."""
    n = Counter({(1, 1, 1): 900, (1, 0, 1): 80, (1, 1, None): 40, (0, 0, 0): 50, (0, 1, 0): 40, (None, 0, 0): 30})
    prior, acc = quality.fit(sorted(n.items(), key=str))
    assert 0 < prior < 1 and all(0 < x < 1 for pair in acc for x in pair) and len({round(g, 3) for g, _ in acc}) == 3
    # One bad vote of the second rule weighs less than one of the third.
    assert quality.posterior((1, 0, 1), prior, acc) > 0.5 > quality.posterior((None, 1, 0), prior, acc)


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
