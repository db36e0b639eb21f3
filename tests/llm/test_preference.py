import random
import zlib

import numpy as np
from strandloom.llm import preference as pf

DATA = "/root/testdata/sf0.01"


def test_held_out_labels_are_told(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in pf.judge_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(x["quality"], got[x["doc_id"]]["predicted"]) for x in labels.collect() if got[x["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(q == p for q, p in held) >= 0.97 * len(held)


def test_weights_are_the_least_pairwise_loss():
    rnd = np.random.default_rng(3)
    good, bad = rnd.normal(0.4, 1, (40, 3)), rnd.normal(-0.4, 1, (30, 3))
    model = pf.train(good, bad, 0.4, pairs=1200, seed=1)
    z = lambda x: np.clip((x - model.centre) / model.spread, -pf._CLIP, pf._CLIP)
    # All pairs are taken as often, whatever their order, when there are as many as wanted.
    d = (z(good)[:, None] - z(bad)[None]).reshape(-1, 3)

    def loss(w):
        return np.log1p(np.exp(-d @ w)).sum() + pf._RIDGE / 2 * w @ w

    full = model.weight.copy()
    for _ in range(200):  # plain gradient descent over all pairs
        full -= 2e-3 * (-(d / (1 + np.exp(d @ full))[:, None]).sum(0) + pf._RIDGE * full)
    assert loss(model.weight) < loss(np.zeros(3)) and abs(loss(model.weight) / loss(full) - 1) < 0.02


def test_threshold_is_the_quantile_of_the_bad_share():
    rnd = np.random.default_rng(5)
    good, bad = rnd.normal(1, 1, (80, 2)), rnd.normal(-1, 1, (20, 2))
    model = pf.train(good, bad, 0.2)
    worth = model.worth(np.concatenate([good, bad]))
    assert (worth < model.threshold).sum() == 20
    assert np.isclose(model.score(good), 1 / (1 + np.exp(-(model.worth(good) - model.threshold + np.log(7 / 3))))).all()


def test_only_learning_rows_teach(spark):
    rnd = random.Random(1)
    text = lambda ok: " ".join(rnd.choice(["one", "two", "three", "four"]) + ("" if ok else "###") for _ in range(20))
    rows = [(i, text(i % 2), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, _, q in rows]  # held-out labels say the opposite
    got = {r["doc_id"]: r["predicted"] for r in pf.judge_quality(docs, spark.createDataFrame(flip, "doc_id long, quality int")).collect()}
    assert got == {i: q for i, _, q in rows}


def test_edges(spark):
    schema = "doc_id long, text string"
    good, bad = "A plain sentence of words.", "x### y$$$ ###"
    rows = [(1, good), (2, bad), (3, None), (4, ""), (None, good), (1, good), (5, " \n "), (6, good * 5000), (7, "漢字かな" * 50)]
    docs = spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "1 as label", "2 as id", "3 as m0", "4 as score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(1, 1), (None, 0), (3, None), (8, 1), (8, 0)], "doc_id long, quality int")
    got = pf.judge_quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert {r["score"] for r in pf.judge_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert pf.judge_quality(docs.limit(0), labels).count() == 0


def test_every_labelled_row_is_in_a_group(spark):
    """Groups hold each row of the more frequent label once and each of the other at least once, some of both in every group."""
    rnd = np.random.default_rng(2)
    for n_good, n_bad in ((9000, 5), (300, 9000), (700, 600), (1, 1)):
        x = rnd.normal(0, 1, (n_good + n_bad, pf.N_FEATURES)).round(3)
        rows = spark.createDataFrame([(int(i < n_good), i, i, f) for i, f in enumerate(x.tolist())], "label int, id long, h long, f array<float>")
        model = pf.Model(np.zeros(pf.N_FEATURES), np.ones(pf.N_FEATURES), np.zeros(pf.N_FEATURES), 0.0, True)
        packed = pf.groups(rows, {1: n_good, 0: n_bad}, model).collect()
        unpack = lambda b: np.frombuffer(b, np.float32).reshape(-1, pf.N_FEATURES)
        for column, n in (("good", n_good), ("bad", n_bad)):
            parts = [unpack(r[column]) for r in packed]
            assert min(map(len, parts)) >= 1 and max(map(len, parts)) <= pf._GROUP
            every = np.concatenate(parts)
            assert len(np.unique(every, axis=0)) == n and (len(every) == n or n < max(n_good, n_bad))


def test_order_statistics(spark):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(0, 1, 5000), np.full(3000, 0.25), [1e9]])
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    s = np.sort(x)
    for k in (1, 40, 4000, 5500, 8000, 8001):
        assert pf.order_statistics(d, k) == (s[k - 1], s[min(k, len(s) - 1)])


def test_the_whole_training_set_teaches(spark):
    """A mark that few bad rows have, and that a sample of the first rows by hash lacked, counts."""
    rows = [(i, "A plain text of words." if i % 2 else ("A plain text of words ~." if i % 40 == 0 else "x### y$$$"), i % 2) for i in range(12_000)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    taught = pf.training_rows(pf.featured(docs), labels)
    assert taught.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(12_000)) > 8000


def test_products_sum_all_pairs():
    rnd = np.random.default_rng(6)
    for n_good, n_bad in ((1, 1), (40, 3), (7, 30)):
        good, bad, w = rnd.normal(1, 2, (n_good, 5)), rnd.normal(-1, 2, (n_bad, 5)), rnd.normal(0, 1, 5)
        want = pf.pair_sums((good[:, None] - bad[None]).reshape(-1, 5), w)
        assert all(np.allclose(a, b, rtol=1e-11, atol=1e-11) for a, b in zip(pf.product_sums(good, bad, w), want))


def test_sums_of_a_table_are_one_job(spark):
    """Partitions are summed side by side: a job for each of them would do one after another."""
    context = spark.sparkContext
    context.setJobGroup("sums", "")
    try:
        got = pf._summed(spark.range(0, 1000, 1, 6), lambda batch: np.array([batch.num_rows, sum(batch.column(0).to_pylist())], float), 2)
        assert got.tolist() == [1000, 499500]
        assert len(context.statusTracker().getJobIdsForGroup("sums")) == 1
    finally:
        context._jsc.sc().clearJobGroup()
