"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from strandloom.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_called_domains_are_the_planted_blocks(spark):
    """The query's ground has blocks of 20 bins; those away from the chromosomes' ends are called, on every chromosome."""
    got = sorted((r["chrom"], r["start"], r["end"]) for r in registry.QUERIES["domains_called"](spark, DATA).collect())
    assert got == [(str(c), 20 * k, 20 * (k + 1)) for c in range(1, 6) for k in range(1, 9)]
