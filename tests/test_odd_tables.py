"""Queries on tables that reach further than the given small ones."""

import math

import duckdb
import pytest
from strandloom.plans import registry

from test_queries import rows


@pytest.fixture
def made(spark, tmp_path):
    """A function that writes tables given as SQL, and one that runs a query's SQL on them."""
    con = duckdb.connect()

    def write(**tables):
        for name, body in tables.items():
            con.execute(f"copy ({body}) to '{tmp_path}/{name}.parquet' (format parquet)")
            con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
        return str(tmp_path)

    return write, con


def same_as_sql(spark, con, folder, name):
    got = registry.QUERIES[name](spark, folder)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    want = want.fetchall()
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want)
    return want


EVENT = "'view' as event_type"


def test_domains_of_boundaries_beyond_the_first_regions(spark, made):
    write, con = made
    folder = write(events=f"select i as event_id, i % 50 as user_id, {EVENT}, (i * 7919 % 9000) / 10.0 as value from range(4000) t(i)")
    assert max(r[1] for r in same_as_sql(spark, con, folder, "domains")) >= 500


@pytest.mark.parametrize("order", [(7.22, 7.21, 7.65, 7.91, 7.89, 7.12), (7.22, 7.65, 7.91, 7.21, 7.89, 7.12)])
def test_directionality_does_not_depend_on_the_order_of_sums(spark, made, order):
    """The values' sum is 45; added as doubles in the first order it is less, and the rest after division by 3 is nearly 3."""
    from strandloom.plans.structure_queries import _signal_di

    values = " union all ".join(f"select {i} as event_id, 0 as user_id, {EVENT}, cast({x} as double) as value" for i, x in enumerate(order))
    folder = made[0](events=f"select * from ({values}) order by event_id")
    di = _signal_di(spark, folder).where("chrom = '1' and bin = 7").first()["di"]
    assert di == pytest.approx(5 * math.sin(7 * 0.21))


def test_adjusted_specificity_is_never_below_its_p_value(spark):
    """q-values of the query are Benjamini-Hochberg's of all its p-values, on tables where loops are tested."""
    got = registry.QUERIES["loop_specificity"](spark, "/root/testdata/sf0.1").where("pvalue is not null").select("pvalue", "qvalue").collect()
    p = sorted(r["pvalue"] for r in got)
    low, want = 1.0, {}
    for k in range(len(p), 0, -1):
        low = min(low, p[k - 1] * len(p) / k)
        want.setdefault(p[k - 1], low)
    assert len(p) == 4000 and all(r["qvalue"] == pytest.approx(want[r["pvalue"]], abs=1e-2) and r["qvalue"] >= r["pvalue"] - 1e-6 for r in got)
