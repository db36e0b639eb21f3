"""Domain-shaped inputs derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "concat('r',l_orderkey,'_',l_linenumber,'_',l_partkey,'_',l_suppkey,'_',cast(l_quantity as int)) as name"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw interaction pairs."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        NAME,
        "cast(1 + l_partkey % 5 as string) as chrom1",
        "if(l_linenumber % 2 = 0, 0, 16) as flag1",
        "1 + (l_partkey*7919 + l_suppkey*104729) % 2000000 as pos1",
        "cast(if(l_suppkey % 3 = 0, 1 + l_suppkey % 5, 1 + l_partkey % 5) as string) as chrom2",
        "if(l_suppkey % 2 = 0, 0, 16) as flag2",
        "if(l_quantity < 15, greatest(1, 1 + (l_partkey*7919 + l_suppkey*104729) % 2000000 + (l_suppkey % 7 - 3) * 151), 1 + (l_partkey*15485863 + l_suppkey*32452843) % 2000000) as pos2",
        "l_orderkey % 4 as snp1", "(l_orderkey + l_suppkey) % 3 as snp2", "-(l_partkey % 40) as as1", "-(l_suppkey % 40) as as2",
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction fragments (chrom, start, end, mid), left-open intervals but for the first of a chromosome."""
    from strandloom.operators.genome import fragments_of_sites

    sites = table(spark, sf_dir, "part").selectExpr("cast(1 + p_partkey % 5 as string) as chrom", "1 + (p_partkey*611953) % 2000000 as site").distinct()
    return fragments_of_sites(sites)


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(1 + c_custkey % 5 as string) as chrom", "1 + (c_custkey*104729) % 2000000 as pos",
        "substr('ACGT', cast(1 + c_custkey % 4 as int), 1) as m_alt", "substr('ACGT', cast(1 + (c_custkey + 1 + c_nationkey % 3) % 4 as int), 1) as p_alt",
    ).distinct()


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.translate("text", letters, bases), "[^ACGT]", "").alias("seq"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(1 + user_id % 5 as string) as chrom", "cast(floor(value) as bigint) as bin", "event_type as kind", "value as v")


def maternal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").selectExpr(
        NAME, "cast(1 + l_partkey % 5 as string) as chrom1", "100 + (l_partkey*7919 + l_suppkey*104729) % 2000000 as pos1",
        "-(l_partkey % 40) as as1", "l_orderkey % 4 as snp1", "l_suppkey % 3 as snp2",
    )


def paternal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 0").selectExpr(
        NAME, "cast(1 + l_partkey % 5 as string) as chrom1", "100 + (l_partkey*7919 + l_suppkey*104729) % 2000000 + (l_orderkey % 4) * 4 as pos1",
        "-(l_suppkey % 40) as as1", "cast(l_linenumber % 4 as bigint) as snp1", "l_partkey % 3 as snp2",
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read groups of two to six alignments."""
    roles = [(0, ["1", "2"], ""), (1, ["1", "11", "12", "2"], ""), (2, ["1", "2", "21", "22"], ""), (3, ["1", "1", "2", "2"], "1010"), (4, ["1", "11", "12", "2", "2"], "10010"), (5, ["1", "2", "11", "12", "21", "22"], "110000"), (6, ["1", "1", "2"], "000")]
    rows = [(c, k + 1, tag, int(len(long) > k and long[k] == "1")) for c, tags, long in roles for k, tag in enumerate(tags)]
    t = spark.createDataFrame(rows, "c long, k long, tag string, len150 int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 7).alias("c"))
    return o.join(F.broadcast(t), "c").selectExpr(
        "concat('o', o_orderkey) as name", "tag", "cast(1 + (o_custkey + k) % 5 as string) as ref",
        "1 + (o_custkey*7919 + k*((o_orderkey % 3)*800)) % 2000000 as pos", "if((o_orderkey + k) % 11 = 0, 1, 0) as unmapped",
        "-(o_custkey % 20) as as_score", "if((o_orderkey + k*3) % 13 = 0, -(o_custkey % 20), null) as xs_score", "if(len150 = 1, 150, 60) as len",
    )


def matrix_pixels(spark: SparkSession, sf_dir: str, res: int = 40_000) -> DataFrame:
    """(chrom, bin1, bin2, value): a symmetric within-chromosome contact matrix, upper triangle, from the pairs."""
    from strandloom.operators.contacts import count_contacts

    p = pairs(spark, sf_dir).where("chrom1 = chrom2")
    c = count_contacts(p, [res], "pos1", "pos2")
    return c.select(F.col("chrom1").alias("chrom"), "bin1", "bin2", F.col("n").cast("double").alias("value"))


def n_bins(res: int = 40_000, length: int = 2_000_000) -> int:
    return length // res + 1




def directed_pixels(spark: SparkSession, sf_dir: str, where: str = "true", res: int = 40_000) -> DataFrame:
    """(chrom, bin1, bin2, value): within-chromosome contacts from the first to the second mate."""
    p = pairs(spark, sf_dir).where("chrom1 = chrom2").where(where)
    d = p.selectExpr("chrom1 as chrom", f"cast(floor(pos1 / {res}) as bigint) as bin1", f"cast(floor(pos2 / {res}) as bigint) as bin2")
    return d.groupBy("chrom", "bin1", "bin2").agg(F.count(F.lit(1)).cast("double").alias("value"))


def sizes(spark: SparkSession, res: int = 40_000) -> DataFrame:
    """(chrom, n): the bins of the five chromosomes."""
    return spark.range(1, 6).select(F.col("id").cast("string").alias("chrom"), F.lit(n_bins(res)).cast("long").alias("n"))


def _mapped(spark: SparkSession, sf_dir: str, where: str, exprs: list[str], cand: str, cand_snp: str, cand_frag: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where(where).selectExpr(NAME, "*")
    shift, s1, n1, s2, n2 = exprs
    d = d.selectExpr(
        "name", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "cast(1 + l_partkey % 5 as string) as c1", f"100 + (l_partkey*7919 + l_suppkey*104729) % 2000000 + {shift} as p1", f"{s1} as s1", f"{n1} as n1",
        "cast(if(l_suppkey % 3 = 0, 1 + l_suppkey % 5, 1 + l_partkey % 5) as string) as c2", "100 + (l_partkey*15485863 + l_suppkey*32452843) % 2000000 as p2", f"{s2} as s2", f"{n2} as n2",
    )
    d = d.withColumns({"f1": F.expr("p1 - p1 % 4000 + 2000"), "f2": F.expr("p2 - p2 % 4000 + 2000"), "of": F.expr(f"if({cand}, if(l_orderkey % 2 = 0, 'R1', 'R2'), null)")})
    read = lambda k: F.struct(F.col("c" + k).alias("chrom"), F.col("f" + k).alias("frag"), F.col("p" + k).alias("pos"), F.col("s" + k).alias("score"), F.col("n" + k).cast("long").alias("snp"))
    own = lambda c: F.when(F.col("of") == "R1", F.col(c + "1")).otherwise(F.col(c + "2"))
    c = F.struct(own("c").alias("chrom"), (own("f") + F.expr(cand_frag)).alias("frag"), (own("p") + 7).alias("pos"), own("s").alias("score"), F.expr(cand_snp).cast("long").alias("snp"))
    return d.select("name", read("1").alias("r1"), read("2").alias("r2"), F.when(F.col("of").isNotNull(), c).alias("cand"), F.col("of").alias("cand_of"))


def mapped_maternal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pairs of the maternal mapping, with structs of mates and candidates."""
    return _mapped(spark, sf_dir, "l_partkey % 5 <> 0", ["0", "-(l_partkey % 40)", "l_orderkey % 4", "-(l_suppkey % 40)", "l_suppkey % 3"], "l_linenumber % 3 = 0", "(l_orderkey + l_partkey) % 5", "if(l_linenumber % 2 = 0, 0, 4000)")


def mapped_paternal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, "l_suppkey % 7 <> 0", ["(l_orderkey % 4) * 4", "-(l_suppkey % 40)", "l_linenumber % 4", "-(l_partkey % 40)", "l_partkey % 3"], "l_linenumber % 3 = 0 or l_orderkey % 5 = 0", "(l_orderkey + l_suppkey) % 4", "0")


def haplotype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.operators.alleles import assign_haplotypes

    return assign_haplotypes(mapped_maternal(spark, sf_dir), mapped_paternal(spark, sf_dir))


def stored_haplotype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """haplotype_pairs, written by class and read again: what counts contacts reads only the classes it needs."""
    from strandloom.operators.alleles import write_by_class
    from strandloom.sources.store import shared_path

    path = shared_path(spark, "hap-pairs")
    d = haplotype_pairs(spark, sf_dir)
    write_by_class(d, path)
    return spark.read.schema(d.schema).parquet(path)
