import hashlib
import random

import pytest
from strandloom.llm import warc


def brute(rows):
    last = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in last and i != last[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(1)
    bodies = ["é" * 499 + "x", "é" * 500, "a" * 999, "b" * 1000, "<p>\r\n\r\nWARC/1.1</p>" * 80, "", None] + [str(rnd.random()) * 100 for _ in range(20)]
    out = [(i, rnd.choice(["http://www.a.example/x", "https://b.example:80/q?r#s", "//c.example", None, "", "no host", "http://u@a.example/\n"]), rnd.choice(bodies)) for i in range(120)]
    return out + [(None, None, "b" * 1000), (500, "http://z.example/", "lone" * 300), (501, "u", "twin" * 300), (501, "v", "twin" * 300), (500, "w", "😀" * 50000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.archive_and_read(df).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows())
    # Histories by sorting each URL's captures.
    by = {}
    for i, url, _ in sorted(rows(), key=lambda r: (warc.url_key(warc.written(r[1])), warc.capture_time(r[0]), -1 if r[0] is None else r[0])):
        by.setdefault(warc.url_key(warc.written(url)), []).append(i)
    want = [(i, k + 1, ids[k - 1] if k else None) for ids in by.values() for k, i in enumerate(ids)]
    assert sorted([(r["page_id"], r["capture"], r["last_page_id"]) for r in got], key=str) == sorted(want, key=str)


def test_runs_that_are_not_merged_have_other_histories(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc, "_ROLL_BYTES", 2000)
    df = spark.createDataFrame([(i, f"http://h.example/{i % 3}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").repartition(3)
    index = warc.materialize(warc.write_archives(df), "runs")
    unmerged = index.withColumn("index_part", F.lit(0)).withColumn("index_pos", F.shiftright(F.xxhash64("run"), 20) * 1000 + F.col("run_pos"))
    history = lambda d: sorted(str((r["page_id"], r["capture"], r["last_page_id"])) for r in warc.read_archives(warc.histories(d)).collect())
    assert history(warc.merge_index(index, 2)) != history(unmerged)


def test_merged_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "_ROLL_BYTES", 2000)
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(df)
    runs = index.select("run").distinct().count()
    assert runs > 3
    merged = warc.merge_index(index, 3).collect()
    merged.sort(key=lambda r: (r["index_part"], r["index_pos"]))
    order = [(r["url_key"].encode(), r["ts"], -1 if r["page_id"] is None else r["page_id"]) for r in merged]
    assert order == sorted(order) and len(order) == len(rows())
    r = next(x for x in merged if x["record_type"] == "response" and x["payload_bytes"] > 0)
    with warc._open(r["file"], "r") as f:
        f.read(r["offset"])
        one = next(warc.read_records(f))
    assert hashlib.sha1(one[2]).hexdigest() == r["digest"] and one[0]["WARC-Type"] == "response"


def test_reads_what_the_index_names(spark, monkeypatch):
    monkeypatch.setattr(warc, "_READ_BYTES", 4000)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(3)
    merged = warc.materialize(warc.merge_index(warc.write_archives(df), 4), "merged")
    assert warc.read_archives(merged).rdd.getNumPartitions() > 1
    # Half of the index reads half of the records, in any order of its rows.
    half = merged.where("page_id % 2 = 0").orderBy(F.rand(3))
    assert sorted([tuple(r)[:5] for r in warc.read_archives(half).collect()], key=str) == [r for r in brute(rows()) if r[0] is not None and r[0] % 2 == 0]
    first = merged.agg(F.min("offset")).first()[0]
    swapped = merged.withColumn("page_id", F.col("page_id") + 1)
    for wrong in (merged.withColumn("offset", F.col("offset") + 1), merged.withColumn("length", F.col("length") - 9), swapped, merged.withColumn("offset", F.lit(first))):
        with pytest.raises(Exception, match="record|inflat|decompress|header|Error"):
            warc.read_archives(wrong).collect()


def test_histories(spark):
    df = spark.createDataFrame([(i, f"http://h.example/{i % 3 if i % 4 else 0}", f"page {i}") for i in range(200)] + [(7, "http://h.example/1", "x")], "page_id long, url string, html string").repartition(5)
    got = warc.histories(warc.merge_index(warc.write_archives(df), 7)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["index_part"], r["index_pos"])):
        by.setdefault(r["url_key"], []).append(r)
    assert sum(map(len, by.values())) == 201
    for rs in by.values():
        assert [r["capture"] for r in rs] == list(range(1, len(rs) + 1))
        assert [r["page_id"] for r in rs] == sorted(r["page_id"] for r in rs)
        assert [r["last_page_id"] for r in rs] == [None] + [r["page_id"] for r in rs[:-1]]


def test_loser_tree():
    rnd = random.Random(7)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rnd.randrange(20) for _ in range(rnd.randrange(9))) for _ in range(k)]
        got = [x for _, x in warc.LoserTree(runs)]
        assert got == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("url, key", [("http://www.A.example/p?q#f", "example,a)/p?q"), ("https://a.b.example:8080", "example,b,a:8080)/"), (None, ""), ("x y", "x y")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
