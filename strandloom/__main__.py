"""python -m strandloom: the steps of the pipeline over Parquet and text files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _digest(spark, a):
    from strandloom.operators.genome import digest_tiles
    from strandloom.sources.blocks import fasta_tiles

    digest_tiles(fasta_tiles(spark, a.input), a.enzyme).write.mode("overwrite").parquet(a.output)


def _rescue(spark, a):
    from strandloom.operators.reads import rescue
    from strandloom.sources.text import read_fastq, write_fastq

    write_fastq(rescue(read_fastq(spark, a.input, a.mate), a.enzyme), a.output)


def _genome(spark, a):
    """Both parents' sequences of a genome, with the fragments of an enzyme beside them."""
    from strandloom.operators.genome import digest_tiles, haplotype_tiles, wrapped
    from strandloom.sources.blocks import fasta_tiles
    from strandloom.sources.text import read_snps, write_fasta

    tile = 60_000
    tiles = fasta_tiles(spark, a.input, tile)
    snps = read_snps(spark, a.snps)
    for letter, allele in (("M", "m_alt"), ("P", "p_alt")):
        lines = wrapped(haplotype_tiles(tiles, snps, allele, tile))
        write_fasta(lines.withColumn("chrom", F.concat(F.lit(letter), "chrom")), f"{a.output}/{letter}")
    digest_tiles(tiles, a.enzyme).write.mode("overwrite").parquet(f"{a.output}/fragments")


def _pairs(spark, a):
    """Interaction pairs of BAM files, several separated by commas, and the counts of their groups' outcomes."""
    from strandloom.operators.reads import integrate, placed
    from strandloom.sources.bam import read_bams
    from strandloom.sources.text import PAIR_FIELDS, read_fragments, read_snps, write_pairs, write_table

    snps = read_snps(spark, a.snps) if a.snps else None
    groups = integrate(placed(read_bams(spark, a.input.split(",")), read_fragments(spark, a.fragments), snps, a.allele), a.level)
    groups.write.mode("overwrite").parquet(f"{a.output}/groups")
    groups = spark.read.parquet(f"{a.output}/groups")
    mate = lambda s: F.when(F.col(s).isNotNull(), F.struct(*[(F.col(f"{s}.flag").bitwiseAND(16).cast("int") if c == "strand" else F.col(f"{s}.{c}")).alias(c) for c in PAIR_FIELDS])).alias(s)
    write_pairs(groups.where("outcome = 'pair'").select("name", mate("r1"), mate("r2"), mate("cand"), "cand_of"), f"{a.output}/pairs")
    write_table(groups.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).coalesce(1), f"{a.output}/log")


def _balance(spark, a):
    from strandloom.sources.pixelstore import PixelStore, balance_store
    from strandloom.sources.text import read_genome_size

    store = PixelStore(spark, a.output)
    store.append(spark.read.parquet(a.input))
    for res in a.resolutions:
        sizes = read_genome_size(spark, a.sizes).select("chrom", (F.floor(F.col("length") / res) + 1).cast("long").alias("n"))
        balance_store(store, res, sizes)


def _cluster(spark, a):
    from strandloom.operators.loops import cluster_loops
    from strandloom.sources.text import read_called_loops, write_table

    write_table(cluster_loops(read_called_loops(spark, a.input), a.resolutions[0]), a.output)


def _filter(spark, a):
    from strandloom.operators.pairs import write_valid_pairs
    from strandloom.sources.text import read_fragments, read_pairs

    p = read_pairs(spark, a.input).select("name", F.col("r1.ref").alias("chrom1"), F.col("r1.strand").alias("flag1"), F.col("r1.pos").alias("pos1"), F.col("r2.ref").alias("chrom2"), F.col("r2.strand").alias("flag2"), F.col("r2.pos").alias("pos2"))
    for k, n in write_valid_pairs(p, read_fragments(spark, a.fragments), a.output).items():
        print(f"{k}\t{n}")


def _allelic(spark, a):
    from strandloom.operators.alleles import assign_haplotypes, write_by_class

    write_by_class(assign_haplotypes(spark.read.parquet(a.input), spark.read.parquet(a.paternal)), a.output)


def _matrix(spark, a):
    from strandloom.operators.contacts import count_contacts
    from strandloom.sources.text import write_pixels

    write_pixels(count_contacts(spark.read.parquet(a.input), a.resolutions), a.output)


def _structures(spark, a, what):
    from strandloom.operators import balance, compartments, contacts, domains, loops
    from strandloom.sources.text import read_genome_size, read_pixels, write_table

    px = read_pixels(spark, a.input, a.resolutions[0]).where("chrom1 = chrom2").select(F.col("chrom1").alias("chrom"), "bin1", "bin2", F.col("n").cast("double").alias("value"))
    n = read_genome_size(spark, a.sizes).select("chrom", (F.floor(F.col("length") / a.resolutions[0]) + 1).cast("long").alias("n"))
    m = contacts.symmetric(px)
    if what == "compartments":
        d = compartments.call_compartments(m, n)
    elif what == "domains":
        d = domains.call_domains(m, n, a.resolutions[0])
    else:
        bias = balance.ice_weights(m)
        even = balance.apply_bias(px, bias)
        d = loops.call_loops(even, px, n, bias, a.resolutions[0])
    write_table(d, a.output)


COMMANDS = {
    "digest": _digest, "genome": _genome, "pairs": _pairs, "balance": _balance, "cluster": _cluster, "rescue": _rescue, "filter": _filter, "allelic": _allelic, "matrix": _matrix,
    **{k: (lambda s, a, k=k: _structures(s, a, k)) for k in ("compartments", "domains", "loops")},
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--enzyme", default="MboI", help="a name, or a site with its cut such as A-AGCTT")
    p.add_argument("--mate", type=int, default=1)
    p.add_argument("--fragments", help="fragments file of pairs and filter")
    p.add_argument("--snps", help="SNP file of genome and pairs")
    p.add_argument("--allele", default="m_alt", choices=["m_alt", "p_alt"], help="the parent whose alleles pairs counts")
    p.add_argument("--level", type=int, default=1, choices=[1, 2], help="2 takes reads with a worse second hit")
    p.add_argument("--paternal", help="paternal pairs of allelic; input has the maternal ones")
    p.add_argument("--sizes", help="genome sizes of balance, compartments, domains and loops")
    p.add_argument("--resolutions", type=int, nargs="+", default=[40_000])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    COMMANDS[a.command](spark, a)


if __name__ == "__main__":
    main()
