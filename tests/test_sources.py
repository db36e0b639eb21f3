import gzip
import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import genome
from strandloom.sources import bam, blocks, text


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, as a large file has of its size."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def records(n, seed=3):
    """Reads whose qualities often begin with @ or +."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.randrange(1, 60)
        out.append((f"r{i}", "".join(rnd.choice("ACGTN") for _ in range(k)), rnd.choice("@+I#") + "".join(rnd.choice("@+I#5") for _ in range(k - 1))))
    return out


def test_fastq_by_blocks(spark, tmp_path, small_blocks):
    reads = records(200)
    body = "".join(f"@{n} x y\n{s}\n+\n{q}\n" for n, s, q in reads)
    (tmp_path / "a_chunk1.fastq").write_text(body)
    (tmp_path / "b_chunk2.fastq").write_text(body[: body.index("@r9 ")] + "@cut\nAC\n")  # an unfinished record at the end
    with gzip.open(tmp_path / "c_chunk3.fastq.gz", "wt") as f:
        f.write(body)
    paths = [str(tmp_path / n) for n in ("a_chunk1.fastq", "b_chunk2.fastq", "c_chunk3.fastq.gz")]
    assert blocks.lines(spark, paths[0]).select("block").distinct().count() > 20
    got = sorted(tuple(r) for r in text.read_fastq(spark, paths, 2).collect())
    want = [(f"{n}_2", 2, s, q, c) for c, part in ((1, reads), (2, reads[:9]), (3, reads)) for n, s, q in part]
    assert got == sorted(want)


def test_fastq_records_longer_than_blocks(spark, tmp_path, small_blocks):
    reads = [(f"r{i}", "ACGT" * (150 + i), "@I+5" * (150 + i)) for i in range(9)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads))
    got = sorted(tuple(r)[:4] for r in text.read_fastq(spark, str(tmp_path / "a.fastq"), 1).collect())
    assert got == sorted((f"{n}_1", 1, s, q) for n, s, q in reads)


def test_fastq_round_trip(spark, tmp_path):
    reads = records(120)
    d = spark.createDataFrame([(n, s, q) for n, s, q in reads], "name string, seq string, qual string")
    text.write_fastq(d, str(tmp_path / "out"), per_file=25)
    got = text.read_fastq(spark, str(tmp_path / "out"), 1)
    assert sorted((r["name"], r["seq"], r["qual"]) for r in got.collect()) == sorted((f"{n}_1", s, q) for n, s, q in reads)


def genome_of(seed, lengths):
    rnd = random.Random(seed)
    return {f"{i + 1}": "".join(rnd.choice("ACGTgatc") for _ in range(n)) for i, n in enumerate(lengths)}


def test_fasta_tiles_over_blocks(spark, tmp_path, small_blocks):
    """Sequences over many blocks, several headers in one block, empty sequences, and lines before the first header."""
    g = genome_of(5, [3000, 10, 0, 7, 1500, 299])
    for width in (60, 61, 1000):
        path = tmp_path / f"g{width}.fa"
        path.write_text("junk\n" + "".join(f">chr{c} text\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for c, s in g.items()))
        tiles = blocks.fasta_tiles(spark, str(path), 64).collect()
        for c, s in g.items():
            mine = sorted((t["offset"], t["seq"]) for t in tiles if t["chrom"] == c)
            assert mine == [(i, s[i : i + 64].upper()) for i in range(0, len(s), 64)]


def test_digest_over_tile_seams(spark, tmp_path):
    g = {**genome_of(6, [900, 333]), "9": "GATC" * 40, "x": "A" * 50}
    whole = spark.createDataFrame([(c, s.upper()) for c, s in g.items()], "chrom string, seq string")
    tiled = spark.createDataFrame([(c, i, s.upper()[i : i + 7]) for c, s in g.items() for i in range(0, len(s), 7)], "chrom string, offset long, seq string")
    for enzyme in ("MboI", "HindIII", "A-A", "AA-A"):  # the last ones overlap themselves
        assert sorted(map(tuple, genome.digest_tiles(tiled, enzyme).collect())) == sorted(map(tuple, genome.digest(whole, "chrom", enzyme).collect()))


def test_tiles_take_variants(spark, tmp_path):
    g = genome_of(7, [400])["1"].upper()
    tiled = spark.createDataFrame([("1", i, g[i : i + 60]) for i in range(0, len(g), 60)], "chrom string, offset long, seq string")
    s = spark.createDataFrame([("1", p, "N") for p in (1, 60, 61, 400)], "chrom string, pos long, m_alt string")
    got = "".join(r["seq"] for r in genome.haplotype_tiles(tiled, s, "m_alt", 60).orderBy("tile").collect())
    want = list(g)
    for p in (1, 60, 61, 400):
        want[p - 1] = "N"
    assert got == "".join(want)


def alignments(n, seed=8):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k, lost = rnd.randrange(0, 90), rnd.random() < 0.2
        seq = "".join(rnd.choice("ACGTN") for _ in range(k))
        qual = "".join(chr(33 + rnd.randrange(42)) for _ in range(k)) if rnd.random() < 0.9 else None
        out.append((f"r{i // 3}_{i % 3 + 1}", 4 if lost else rnd.choice([0, 16]), "*" if lost else rnd.choice(["chr1", "chrX"]), 0 if lost else rnd.randrange(1, 5000), rnd.randrange(60), f"{k}M" if k and not lost else "*", seq or "*", qual if k else None, None if lost else -rnd.randrange(40), -rnd.randrange(40) if rnd.random() < 0.3 else None))
    return out


BAM = "name string, flag int, ref string, pos long, mapq int, cigar string, seq string, qual string, as_score int, xs_score int"


def test_bam_round_trip_in_small_ranges(spark, tmp_path, monkeypatch):
    """What BAM gives is what SAM text of the same records gives, however small the byte ranges and blocks are."""
    rows = alignments(900)
    path = str(tmp_path / "bam")
    bam.write_bam(spark.createDataFrame(rows, BAM).coalesce(1), path, [("chr1", 9000), ("chrX", 8000)])
    sam = tmp_path / "a.sam"
    tags = lambda a, x: "".join(f"\t{t}:i:{v}" for t, v in (("AS", a), ("XS", x)) if v is not None)
    sam.write_text("@HD\n" + "".join(f"{n}\t{f}\t{r}\t{p}\t{q}\t{c}\t*\t0\t0\t{s}\t{z or '*'}{tags(a, x)}\n" for n, f, r, p, q, c, s, z, a, x in rows))
    want = sorted(map(str, text.read_sam(spark, str(sam)).collect()))
    for split in (1 << 20, 20_000, 7_000):
        d = bam.read_bam(spark, path, split=split)
        assert sorted(map(str, d.collect())) == want
    assert d.rdd.getNumPartitions() > 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = bam.read_bam(spark, path, split=7_000).where("unmapped = 1")
        assert sorted(map(str, got.collect())) == [x for x in want if x.endswith("unmapped=1)")]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    for lost in (0, 1):
        got = bam.read_bam(spark, path, bool(lost), 7_000)
        assert sorted(map(str, got.collect())) == [x for x in want if x.endswith(f"unmapped={lost})")]


def test_bam_ranges_share_no_record(spark, tmp_path, monkeypatch):
    """Every cut of a file of tiny blocks, where records run over many blocks' ends."""
    monkeypatch.setattr(bam, "_BLOCK", 700)
    rows = alignments(300, 9)
    w = bam._Writer({"path": str(tmp_path), "refs": "chr1:9000,chrX:8000"}, [], False)
    names = [x.split()[0] for x in BAM.split(", ")]
    file = w.write(iter([dict(zip(names, r)) for r in rows])).path
    size = bam._files(file)[0][1]
    for split in (97, 501, 1000, 4096, size):
        r = bam._Reader({"path": file, "split": str(split)})
        got = [x for p in r.partitions() for b in r.read(p) for x in b.column("name").to_pylist()]
        assert got == [x[0] for x in rows], split


def test_bam_filters_are_pushed(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    r = bam._FilteringReader({"path": "x"})
    rest = list(r.pushFilters([EqualTo(("unmapped",), 1), GreaterThan(("pos",), 5)]))
    assert r.unmapped == 1 and rest == [GreaterThan(("pos",), 5)]
