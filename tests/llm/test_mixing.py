import random
import re
from collections import defaultdict

import pytest
from strandloom.llm.mixing import mix, mixed_documents, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Share by weight, cap, reshare the excess by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target, full = {}, set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in names}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3}, {"b": 5, None: 100, "": 7, "é": 0}, {"x": 4}, {"a": 0}, {f"s{i}": i * i for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * (1 + want[k]) for k in want)


def rows(seed=3, n=300):
    rnd = random.Random(seed)
    out = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["big"] * 6 + ["a", "b", "zz", None])) for i in range(n)]
    return out + [(1000, None, "a"), (1001, "", "b"), (1002, "x y z", "tiny"), (1002, "x y z", "tiny"), (None, "q w", None)]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix(df.withColumn("taken", df.doc_id)).collect()
    assert len(got) == len(data)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(d), str(s), len(WORD.findall(t or ""))) for d, t, s in data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * sum(sizes.values())
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["plays"] or [])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    plays = sorted(p for r in got for p in r["plays"] or [])
    assert [p["position"] for p in plays] == [sum(x["words"] for x in plays[:i]) for i in range(len(plays))]
    assert all(a["finish"] <= b["finish"] for a, b in zip(plays, plays[1:]))
    again = mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mix(df).collect()))


def test_mixed_documents(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    got = mixed_documents(df)
    assert got.columns == df.columns
    n = defaultdict(int)
    for r in got.collect():
        n[r] += 1
    assert max(n.values()) <= 6 and None not in [r["text"] for r in n]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and mixed_documents(df).count() == 0
