import math
import random
import re
from collections import Counter

import numpy as np
from strandloom.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, most):
    """The stated scores of every document for every item."""
    terms = [(i, Counter(words(t))) for i, t in docs]
    some = [(i, c, sum(c.values())) for i, c in terms if c]
    n, total = len(some), sum(k for _, _, k in some)
    df = Counter(t for _, c, _ in some for t in c)
    out = []
    for item, text in queries:
        asked = Counter(words(text))
        found = []
        for doc, c, k in some:
            m = 100 - 25 + 25 * k * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:most])]
    return out


def made(n, seed=4):
    """Documents of several topics, one of which a third of them share."""
    rnd = random.Random(seed)
    topics = [[f"{chr(97 + t)}w{i}" for i in range(30)] for t in range(6)]
    text = lambda t: " ".join(rnd.choice(topics[t]) if rnd.random() < 0.8 else rnd.choice(["the", "of", "Straße", "漢字"]) for _ in range(rnd.randrange(3, 60)))
    return [(i, text(0 if i % 3 == 0 else rnd.randrange(6))) for i in range(n)], [(q, text(rnd.randrange(6))) for q in range(25)]


def test_ranks_are_those_of_all_documents(spark):
    docs, queries = made(400)
    docs += [(400 + i, "aw1 aw2 aw3 the") for i in range(60)]  # copies: ties by doc_id
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    index = ls.build_index(d, shard=32, sample=200)
    assert index.table.select("shard").distinct().count() > 10
    for first, growth, block in ((1, 2, 7), (4, 8, 1000)):
        got = ls.search(index, q, 20, first, growth, block).collect()
        assert sorted(map(tuple, got)) == sorted(brute(docs, queries, 20))


def test_visits_stop_before_all_shards(spark):
    docs, queries = made(400)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    index = ls.build_index(d, shard=32, sample=300)
    seen = []
    kept = ls.materialize
    try:
        ls.materialize = lambda df, name: (seen.append((name, x := kept(df, name), x.count())), x)[1]  # noqa: F841
        ls.search(index, q, 3, 1, 2).collect()
    finally:
        ls.materialize = kept
    visits, pairs = sum(n for name, _, n in seen if name == "visits"), next(n for name, _, n in seen if name == "bounds")
    assert 0 < visits < 0.8 * pairs


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "-- !?"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha beta"), (5, "ALPHA " * 5000), (6, "äpfel ÄPFEL beta_gamma x" + "\x00" + "y")]
    queries = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "ÄPFEL gamma gamma x"), (6, "beta alpha alpha")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as shard", "3 as term", "4 as score")
    q = spark.createDataFrame(queries, "item_id long, text string").selectExpr("item_id", "text", "'x' as q", "0 as rank")
    got = ls.rank_documents(d, q, 20).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, queries, 20), key=key)
    assert ls.rank_documents(d.limit(0), q).count() == 0
    assert ls.rank_documents(d, q.limit(0)).count() == 0
    assert ls.rank_documents(d.where("doc_id < 3"), q).count() == 0


def test_bisection_parts_topics():
    rnd = random.Random(2)
    docs = [{f"{'ab'[i % 2]}{rnd.randrange(20)}".encode() for _ in range(8)} | {b"the"} for i in range(120)]
    tree = ls.Tree.learn(docs, 1)
    at = {t: i for i, t in enumerate(tree.terms)}
    doc, term = np.array([(i, at[t]) for i, d in enumerate(docs) for t in d if t in at]).T
    leaf = tree.leaves(doc, term, len(docs))
    assert len(set(leaf[::2])) == 1 and len(set(leaf[1::2])) == 1 and leaf[0] != leaf[1]


def test_bisection_lowers_the_cost_of_gaps():
    rnd = random.Random(3)
    docs = [{f"{rnd.randrange(4) if i % 5 else 9}-{rnd.randrange(15)}".encode() for _ in range(10)} for i in range(200)]
    terms = sorted({t for d in docs for t in d})
    at = {t: i for i, t in enumerate(terms)}
    doc, term = np.array([(i, at[t]) for i, d in enumerate(docs) for t in d]).T

    def cost(left):
        l = np.bincount(term[left[doc]], minlength=len(terms)).astype(float)  # noqa: E741
        r = np.bincount(term[~left[doc]], minlength=len(terms)).astype(float)
        return ls._cost(l, r, int(left.sum()), int((~left).sum())).sum()

    left = ls._halves(doc, term, len(docs), len(terms), 10)[0]
    assert left.sum() == 100 and cost(left) < cost(np.arange(200) < 100)
