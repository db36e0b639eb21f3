import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.operators import balance
from strandloom.sources.pixelstore import PixelStore, balance_store
from strandloom.sources.store import Scope, exists, session_scope

PX = "res long, chrom1 string, bin1 long, chrom2 string, bin2 long, n long"


def chunk(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice([10, 20]), rnd.choice(["M1", "P1", "M2"]), rnd.randrange(9000), rnd.choice(["M1", "P1", "M2"]), rnd.randrange(9000), rnd.randrange(1, 5)) for _ in range(n)]


def one_pass(rows, res):
    out = {}
    for r, c1, b1, c2, b2, n in rows:
        if r == res:
            k = (c1, b1, c2, b2) if (c1, b1) <= (c2, b2) else (c2, b2, c1, b1)
            out[k] = out.get(k, 0) + n
    return out


def held(d):
    return {(r["chrom1"], r["bin1"], r["chrom2"], r["bin2"]): r["n"] for r in d.collect()}


def test_chunks_in_any_order(spark, tmp_path):
    """Appended twice and read is as appended at once; compaction changes files only."""
    store = PixelStore(spark, str(tmp_path / "s"))
    assert store.read(10).count() == 0 and store.runs() == []
    a, b = chunk(1), chunk(2)
    b += a[:50]  # pixels that both chunks have
    for rows in (b, a):
        store.append(spark.createDataFrame(rows, PX))
    for _ in range(2):
        for res in (10, 20):
            assert held(store.read(res)) == one_pass(a + b, res)
        want = one_pass(a + b, 10)
        assert held(store.read(10, "M1")) == {k: n for k, n in want.items() if k[0] == k[2] == "M1"}
        assert held(store.read(10, haplotype="Paternal")) == {k: n for k, n in want.items() if k[0] == k[2] == "P1"}
        assert held(store.read(10, start=4000, end=4100)) == {k: n for k, n in want.items() if 4000 <= k[1] < 4100}
        assert store.chromosomes(10) == ["M1", "P1", "M2"] and store.chromosomes(10, "Maternal") == ["M1", "M2"]
        store.compact()
        assert len(store.runs()) == 1
    with pytest.raises(ValueError):
        store.read(10, haplotype="M")
    with pytest.raises(ValueError):
        store.chromosomes(10, "Other")


def test_reads_prune_resolutions_and_ranges(spark, tmp_path):
    store = PixelStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame(chunk(3), PX))
    plan = store.read(10, start=5000, end=5010)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(store.read(10, start=5000, end=5010).inputFiles()) > 0
    scan = plan[plan.index("PartitionFilters") :]
    assert "res" in scan.split("]")[0] and "range" in scan.split("]")[0]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    store = PixelStore(spark, str(tmp_path / "s"))
    rows = chunk(4, 30)
    first = store._latest
    other = PixelStore(spark, str(tmp_path / "s"))
    calls = []

    def late():
        k = first()
        if not calls:
            calls.append(k)
            other.append(spark.createDataFrame(rows, PX))  # another writer's manifest comes in between
        return k

    store._latest = late
    store.append(spark.createDataFrame(rows, PX))
    store._latest = first
    assert len(store.runs()) == 2 and held(store.read(10)) == one_pass(rows + rows, 10)


def test_stored_weights_balance(spark, tmp_path):
    rng = np.random.default_rng(2)
    w = rng.uniform(0.3, 3, 20)
    a = np.round(40 * np.outer(w, w) * rng.uniform(0.9, 1.1, (20, 20)))
    a[7] = a[:, 7] = 0  # a bin without contacts
    a[11, :] = a[:, 11] = 0
    a[11, 12] = a[12, 11] = 3  # and one with a single pixel
    rows = [(10, "1", i, "1", j, int(a[i, j])) for i in range(20) for j in range(i, 20) if a[i, j]]
    store = PixelStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame(rows, PX))
    with pytest.raises(ValueError):
        store.weights(10)
    sizes = spark.createDataFrame([("1", 20)], "chrom string, n long")
    before = session_scope(spark).path
    assert balance_store(store, 10, sizes, 100, 1e-8, least_pixels=3) < 1e-8
    weights = {r["bin"]: r["weight"] for r in store.weights(10, "1").collect()}
    assert sorted(weights) == list(range(20)) and [b for b, x in weights.items() if x is None] == [7, 11]
    out = np.zeros((20, 20))
    for r in store.balanced(10, "1").collect():
        out[r["bin1"], r["bin2"]] = out[r["bin2"], r["bin1"]] = r["value"]
    np.fill_diagonal(out, 0)
    live = [i for i in range(20) if i not in (7, 11)]
    assert np.allclose(out[live].sum(1), 1, atol=1e-3) and not out[[7, 11]].any()
    assert session_scope(spark).path == before
    store.put_gaps(10, spark.createDataFrame([("1", 7), ("1", 7), ("2", 1)], "chrom string, bin long"))
    assert [tuple(r) for r in store.gaps(10, "1").collect()] == [("1", 7)]


def folder_size(spark, path):
    """Files below a folder."""
    fs, p = balance.stored.__globals__["_fs"](spark, path)
    return fs.getContentSummary(p).getFileCount() if fs.exists(p) else 0


def test_rounds_leave_one_table(spark):
    """A balance of many rounds leaves its result only, however many rounds it took."""
    rng = np.random.default_rng(3)
    a = rng.poisson(20, (12, 12)).astype(float)
    a = a + a.T
    d = spark.createDataFrame([("1", i, j, float(a[i, j])) for i in range(12) for j in range(12)], "chrom string, bin1 long, bin2 long, value double")
    root = session_scope(spark).path.rsplit("/", 1)[0]
    left = []
    for rounds in (2, 9):
        before = folder_size(spark, root)
        balance.ice_weights(d, rounds, 0)
        left.append(folder_size(spark, root) - before)
    assert left[0] == left[1] > 0


def test_scopes_keep_on_failure_and_resume(spark):
    d = spark.range(5)
    with pytest.raises(RuntimeError):
        with Scope(spark, "resumed") as scope:
            scope.stored(d, "one")
            raise RuntimeError
    assert exists(spark, f"{scope.path}/one/_SUCCESS")
    with Scope(spark, "resumed") as scope:
        assert scope.stored(d.select(F.raise_error(F.lit("computed again")).cast("long").alias("id")), "one").count() == 5
        assert scope.stored(d, "two").count() == 5
    assert not exists(spark, scope.path)
