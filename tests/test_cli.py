"""The steps of the command line, from files to files."""

import random

from strandloom import __main__ as cli
from strandloom.sources import bam
from strandloom.sources.pixelstore import PixelStore

BAM = "name string, flag int, ref string, pos long, mapq int, cigar string, seq string, qual string, as_score int, xs_score int"


def run(spark, *argv):
    cli.main([*map(str, argv)])


def test_genome(spark, tmp_path):
    g = "".join(random.Random(1).choice("ACGT") for _ in range(500)) + "GATC" + "A" * 300
    (tmp_path / "g.fa").write_text(f">chr1\n{g[:300]}\n{g[300:]}\n")
    (tmp_path / "snps").write_text("chr1 5 A T G\nchr1 800 A C C\n")
    run(spark, "genome", tmp_path / "g.fa", tmp_path / "out", "--snps", tmp_path / "snps", "--enzyme", "MboI")
    for letter, base in (("M", "T"), ("P", "G")):
        files = sorted((tmp_path / f"out/{letter}/chrom={letter}1").glob("part-*"))
        lines = "".join(f.read_text() for f in files).split("\n")
        want = list(g)
        want[4], want[799] = base, "C"
        assert lines[0] == f">{letter}1" and "".join(lines[1:]) == "".join(want) and len(lines[1]) == 60
    f = spark.read.parquet(str(tmp_path / "out/fragments")).orderBy("start").collect()
    assert f[0]["start"] == 1 and f[-1]["end"] == len(g) and all(a["end"] == b["start"] for a, b in zip(f, f[1:]))


def test_pairs_filter_and_matrix(spark, tmp_path):
    rnd = random.Random(2)
    rows = {k: [(f"r{i}_{k}", 4 if i % 10 == 9 and k == "2" else 0, "1", rnd.randrange(1, 9000), 30, "50M", "ACGTA" * 10, None, -1, -5 if i % 7 == 3 else None) for i in range(40)] for k in "12"}
    for k in "12":
        bam.write_bam(spark.createDataFrame(rows[k], BAM), str(tmp_path / f"bam{k}"), [("1", 10000)])
    (tmp_path / "frags").write_text("".join(f"1\t{x}\t{x + 500}\n" for x in range(0, 10000, 500)))
    (tmp_path / "snps").write_text("".join(f"1 {x} A C G\n" for x in range(1, 9000, 3)))
    for level in (1, 2):
        run(spark, "pairs", f"{tmp_path}/bam1,{tmp_path}/bam2", tmp_path / f"p{level}", "--fragments", tmp_path / "frags", "--snps", tmp_path / "snps", "--level", level)
        log = {r["_c0"]: int(r["_c1"]) for r in spark.read.csv(str(tmp_path / f"p{level}/log"), sep="\t").where("_c1 <> 'n'").collect()}
        multi = sum(i % 7 == 3 and i % 10 != 9 for i in range(40)) if level == 1 else 0  # the second hit is worse
        assert log == {"pair": 36 - multi, "unmapped": 4} | ({"multiple": multi} if multi else {})
    seen = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "p2/groups")).where("outcome = 'pair'").collect()}
    for i in (0, 1, 2):
        pos, seq = rows["1"][i][3], "ACGTA" * 10
        assert seen[f"r{i}"]["r1"]["snp_n"] == sum(x % 3 == 1 and seq[x - pos] == "C" for x in range(pos, min(pos + 50, 9000)))
    run(spark, "filter", tmp_path / "p2/pairs", tmp_path / "valid", "--fragments", tmp_path / "frags")
    valid = spark.read.parquet(str(tmp_path / "valid"))
    assert 0 < valid.count() <= 36
    run(spark, "matrix", tmp_path / "valid", tmp_path / "px", "--resolutions", "1000")
    assert spark.read.parquet(str(tmp_path / "px")).groupBy().sum("n").first()[0] == valid.count()
    (tmp_path / "sizes").write_text("chr1\t9999\n")
    run(spark, "balance", tmp_path / "px", tmp_path / "store", "--resolutions", "1000", "--sizes", tmp_path / "sizes")
    assert PixelStore(spark, str(tmp_path / "store")).weights(1000).count() == 10


def test_cluster(spark, tmp_path):
    (tmp_path / "loops").write_text("chr s e a b c d f g q\n" + "".join(f"1 {x} {x + 500000} 0 0 0 0 0 0 0.0{k}\n" for k, x in enumerate((0, 10000, 900000), 1)))
    run(spark, "cluster", tmp_path / "loops", tmp_path / "out", "--resolutions", "10000")
    got = sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, inferSchema=True).collect())
    assert [(r[1], r[4]) for r in got] == [(0, 2), (900000, 1)]
