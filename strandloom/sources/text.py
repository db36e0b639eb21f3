"""Readers and writers of the field's text formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import fasta_tiles, numbered_lines, read_fastq  # noqa: F401

PAIR_FIELDS = ["ref", "strand", "pos", "len", "as_score", "frag", "snp_n"]


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, at, line): lines of text files in file order; at is unique and ascending within a file."""
    d = spark.read.text(path)
    return d.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(chrom, seq) of short sequences, each in one row; blocks.fasta_tiles is for those of any length."""
    t = fasta_tiles(spark, path)
    parts = t.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("offset", "seq"))).alias("p"))
    return parts.select("chrom", F.array_join(F.col("p.seq"), "").alias("seq"))


def write_fasta(lines: DataFrame, path: str) -> None:
    """lines(chrom, line_no, line) as one folder a chromosome, in order."""
    first = lines.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit(">"), "chrom").alias("line"))
    d = first.unionByName(lines.select("chrom", "line_no", "line")).repartitionByRange("chrom", "line_no").sortWithinPartitions("chrom", "line_no")
    d.select("chrom", "line").write.mode("overwrite").partitionBy("chrom").text(path)


def write_fastq(reads: DataFrame, path: str, per_file: int = 4_000_000, compression: str = "gzip") -> None:
    """reads(name, seq, qual) in files of at most per_file records."""
    d = reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))
    d.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def read_snps(spark: SparkSession, path) -> DataFrame:
    """(chrom, pos, ref, m_alt, p_alt) of five white-space separated columns."""
    f = F.split(F.trim("line"), r"\s+")
    d = _lines(spark, path).where(F.size(f) >= 5)
    d = d.select(F.regexp_replace(f[0], "^chr", "").alias("chrom"), f[1].try_cast("long").alias("pos"), *[F.upper(f[i]).alias(c) for i, c in ((2, "ref"), (3, "m_alt"), (4, "p_alt"))])
    return d.where("pos is not null")


def read_fragments(spark: SparkSession, path) -> DataFrame:
    """(chrom, start, end, mid) of numbered, X and Y chromosomes."""
    d = spark.read.csv(path, sep="\t", schema="chrom string, start long, end long")
    d = d.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).where(F.col("chrom").rlike("^([0-9]+|X|Y)$"))
    return d.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))


def read_genome_size(spark: SparkSession, path, labels: list[str] | None = None) -> DataFrame:
    from strandloom.operators.contacts import in_labels

    d = spark.read.csv(path, sep="\t", schema="chrom string, length long").withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return d.where(in_labels(F.col("chrom"), labels))


def haplotype_sizes(sizes: DataFrame) -> DataFrame:
    """Each chromosome twice, with the letters M and P."""
    return sizes.select(F.explode(F.array(F.lit("M"), F.lit("P"))).alias("h"), "chrom", "length").select(F.concat("h", "chrom").alias("chrom"), "length")


def _rows(spark: SparkSession, path, names: list[str], at: list[int], kinds: list[str]) -> DataFrame:
    """White-space separated columns by their place; lines whose numbers are none, as headers, are left out."""
    f = F.split(F.trim("line"), r"\s+")
    d = _lines(spark, path).select(*[(F.regexp_replace(F.get(f, k), "^chr", "") if kind == "string" else F.get(f, k).try_cast(kind)).alias(n) for n, k, kind in zip(names, at, kinds)])
    for n, kind in zip(names, kinds):
        d = d.where(F.col(n).isNotNull()) if kind != "string" else d
    return d


def read_loop_pairs(spark: SparkSession, path) -> DataFrame:
    """(chrom, start1, end1, start2, end2): loops of both parents, a maternal and a paternal pair of anchors."""
    return _rows(spark, path, ["chrom", "start1", "end1", "start2", "end2"], [0, 1, 2, 3, 4], ["string"] + ["long"] * 4)


def read_called_loops(spark: SparkSession, path) -> DataFrame:
    """(chrom, start, end, q) of a loop table, as cluster_loops takes it: columns 1 to 3 and 10."""
    return _rows(spark, path, ["chrom", "start", "end", "q"], [0, 1, 2, 9], ["string", "long", "long", "double"])


def read_boundary_pairs(spark: SparkSession, path) -> DataFrame:
    """(chrom, pos1, pos2): candidate boundaries of both parents."""
    return _rows(spark, path, ["chrom", "pos1", "pos2"], [0, 1, 2], ["string", "long", "long"])


def read_compartments(spark: SparkSession, path) -> DataFrame:
    """(chrom, bin, pc) of lines (chromosome, value): a chromosome's bins are its lines' places, from 0."""
    d = numbered_lines(spark, path)
    f = F.split(F.trim("line"), r"\s+")
    d = d.select("file", "block", "i", F.regexp_replace(f[0], "^chr", "").alias("chrom"), F.get(f, 1).try_cast("double").alias("pc")).where("pc is not null")
    # Lines of a chromosome in earlier blocks, then in this one.
    per = d.groupBy("chrom", "file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chrom").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(per.select("chrom", "file", "block", before.alias("before")), ["chrom", "file", "block"])
    own = F.row_number().over(Window.partitionBy("chrom", "file", "block").orderBy("i")) - 1
    return d.select("chrom", (F.col("before") + own).alias("bin"), "pc")


def write_compartments(pc: DataFrame, path: str) -> None:
    """pc(chrom, bin, pc) as lines (chromosome, value) in the order of bins; bins without a row are zero."""
    n = pc.groupBy("chrom").agg(F.max("bin").alias("n"))
    every = n.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("bin")).join(pc, ["chrom", "bin"], "left")
    d = every.repartitionByRange("chrom", "bin").sortWithinPartitions("chrom", "bin")
    d.select(F.concat_ws("\t", "chrom", F.coalesce("pc", F.lit(0.0)).cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_sam(spark: SparkSession, path) -> DataFrame:
    """(name, tag, ref, flag, pos, len, as_score, xs_score, seq, unmapped) of SAM text; pos is 1-based, names lose their role tag."""
    from strandloom.operators.reads import split_name

    d = _lines(spark, path).where(~F.col("line").startswith("@")).select(F.split("line", "\t").alias("f")).where(F.size("f") >= 11)
    pair, tag = split_name(F.col("f")[0])
    score = lambda t: F.regexp_extract(F.array_join(F.slice("f", 12, 100), "\t"), rf"(?:^|\t){t}:i:(-?\d+)", 1).try_cast("int")
    flag = F.col("f")[1].cast("int")
    return d.select(pair.alias("name"), tag.alias("tag"), F.regexp_replace(F.col("f")[2], "^chr", "").alias("ref"), flag.alias("flag"), F.col("f")[3].cast("long").alias("pos"), F.char_length(F.col("f")[9]).alias("len"), score("AS").alias("as_score"), score("XS").alias("xs_score"), F.col("f")[9].alias("seq"), flag.bitwiseAND(4).cast("boolean").cast("int").alias("unmapped"))


def read_pairs(spark: SparkSession, path) -> DataFrame:
    """Pair rows of 15 columns, or of 23 with a candidate mate: name, r1, r2, cand, cand_of."""
    f = F.split("line", "\t")
    d = _lines(spark, path).select(f.alias("f")).where(F.size("f") >= 15)

    def mate(at: int):
        kinds = ["string", "int", "long", "int", "int", "long", "long"]
        return F.struct(*[F.get("f", at + i).cast(k).alias(n) for i, (n, k) in enumerate(zip(PAIR_FIELDS, kinds))])

    has = F.size("f") >= 23
    return d.select(F.col("f")[0].alias("name"), mate(1).alias("r1"), mate(8).alias("r2"), F.when(has, mate(15)).alias("cand"), F.when(has, F.get("f", 22)).alias("cand_of"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    m = lambda s: [F.col(f"{s}.{c}").cast("string") for c in PAIR_FIELDS]
    row = F.concat_ws("\t", "name", *m("r1"), *m("r2"), *m("cand"), "cand_of")  # absent candidates add no columns
    pairs.select(row.alias("value")).write.mode("overwrite").text(path)


def write_table(d: DataFrame, path: str) -> None:
    """Results as tab-separated text with a header."""
    d.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """The multi-resolution store: Parquet by resolution, sorted by bins."""
    d = pixels.repartitionByRange("res", "chrom1", "bin1").sortWithinPartitions("res", "chrom1", "bin1", "chrom2", "bin2")
    d.write.mode("overwrite").partitionBy("res").parquet(path)


def read_pixels(spark: SparkSession, path: str, res: int, chrom: str | None = None, haplotype: str | None = None) -> DataFrame:
    """Pixels of one resolution, of one chromosome or of one parent's (M or P)."""
    d = spark.read.parquet(path).where(F.col("res") == res)
    if chrom is not None:
        d = d.where((F.col("chrom1") == chrom) & (F.col("chrom2") == chrom))
    return d.where(F.col("chrom1").startswith(haplotype) & F.col("chrom2").startswith(haplotype)) if haplotype else d
