import random
import re

import pytest
from strandloom.llm.ngram_join import keep_one, ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows):
    """(doc_id, text) rows -> [(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]


def key(t):
    return tuple((x is None, x) for x in t)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", __import__("pyspark").sql.functions.lit("clash"))
    return sorted([tuple(r) for r in ngram_components(df).select("doc_id", "n_shingles", "component_id").collect()], key=key)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 8, 30, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
        sep = rnd.choice([" ", "\n", "  ", "\t"])
        text = sep.join(x.upper() if rnd.random() < 0.1 else x for x in w)
        rows.append((i * 7 % 101, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed, 90)
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "one"), (1, "ONE "), (None, "one"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d E f"), (9, long), (10, long + " y"), (11, "é é b"), (None, "only null here")]
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, None), (6, "q"), (6, "q"), (None, "q")]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    got = sorted([tuple(r) for r in keep_one(df).collect()], key=key)
    assert got == sorted([(1, "a b c d e f", "en"), (3, None, "en"), (4, None, "en"), (6, "q", "en")], key=key)
