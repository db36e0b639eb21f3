"""Genome preparation: enzymes, digestion, haplotype sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Recognition sites without ambiguous bases, the cut marked by '-'.
ENZYMES = {
    "AatII": "GACGT-C", "Acc65I": "G-GTACC", "AclI": "AA-CGTT", "AfeI": "AGC-GCT", "AflII": "C-TTAAG", "AgeI": "A-CCGGT", "AluI": "AG-CT", "ApaI": "GGGCC-C", "ApaLI": "G-TGCAC", "AscI": "GG-CGCGCC", "AseI": "AT-TAAT", "AsiSI": "GCGAT-CGC",
    "AvrII": "C-CTAGG", "BamHI": "G-GATCC", "BclI": "T-GATCA", "BfaI": "C-TAG", "BfuCI": "-GATC", "BglII": "A-GATCT", "BsiWI": "C-GTACG", "BspEI": "T-CCGGA", "BspHI": "T-CATGA", "BsrGI": "T-GTACA", "BssHII": "G-CGCGC", "BstBI": "TT-CGAA",
    "BstUI": "CG-CG", "ClaI": "AT-CGAT", "Csp6I": "G-TAC", "CviAII": "C-ATG", "CviQI": "G-TAC", "DpnI": "GA-TC", "DpnII": "-GATC", "DraI": "TTT-AAA", "EagI": "C-GGCCG", "EcoRI": "G-AATTC", "EcoRV": "GAT-ATC", "FatI": "-CATG",
    "FseI": "GGCCGG-CC", "FspI": "TGC-GCA", "HaeIII": "GG-CC", "HhaI": "GCG-C", "HinP1I": "G-CGC", "HindIII": "A-AGCTT", "HpaI": "GTT-AAC", "HpaII": "C-CGG", "HpyCH4IV": "A-CGT", "HpyCH4V": "TG-CA", "KasI": "G-GCGCC", "KpnI": "GGTAC-C",
    "MboI": "-GATC", "MfeI": "C-AATTG", "MluCI": "-AATT", "MluI": "A-CGCGT", "MscI": "TGG-CCA", "MseI": "T-TAA", "MspI": "C-CGG", "NaeI": "GCC-GGC", "NarI": "GG-CGCC", "NcoI": "C-CATGG", "NdeI": "CA-TATG", "NheI": "G-CTAGC",
    "NlaIII": "CATG-", "NotI": "GC-GGCCGC", "NruI": "TCG-CGA", "NsiI": "ATGCA-T", "PacI": "TTAAT-TAA", "PciI": "A-CATGT", "PmeI": "GTTT-AAAC", "PmlI": "CAC-GTG", "PstI": "CTGCA-G", "PvuI": "CGAT-CG", "PvuII": "CAG-CTG", "RsaI": "GT-AC",
    "SacI": "GAGCT-C", "SacII": "CCGC-GG", "SalI": "G-TCGAC", "Sau3AI": "-GATC", "SbfI": "CCTGCA-GG", "ScaI": "AGT-ACT", "SmaI": "CCC-GGG", "SnaBI": "TAC-GTA", "SpeI": "A-CTAGT", "SphI": "GCATG-C", "SspI": "AAT-ATT", "StuI": "AGG-CCT",
    "SwaI": "ATTT-AAAT", "TaqI": "T-CGA", "XbaI": "T-CTAGA", "XhoI": "C-TCGAG", "XmaI": "C-CCGGG",
}


def resolve_enzyme(enzyme: str) -> tuple[str, int]:
    """(site, cut offset) of a known enzyme's name or of a custom pattern such as A-AGCTT."""
    pattern = ENZYMES.get(enzyme, enzyme).upper()
    if not pattern or set(pattern) - set("ACGT-") or pattern.count("-") != 1 or len(pattern) < 2:
        raise ValueError(f"neither an enzyme nor a site of A, C, G, T with one '-': {enzyme!r}")
    return pattern.replace("-", ""), pattern.index("-")


def junctions(spark: SparkSession, enzymes: list[str] | None = None) -> DataFrame:
    """enzyme, site, cut, plus, minus, palindromic: what two filled-in and ligated ends read as."""
    rows = [(e, *resolve_enzyme(e)) for e in (enzymes or sorted(ENZYMES))]
    d = spark.createDataFrame(rows, "enzyme string, site string, cut int")
    d = d.withColumn("plus", F.expr("concat(substr(site, 1, length(site) - cut), substr(site, cut + 1))"))
    d = d.withColumn("minus", F.reverse(F.translate("plus", "ACGT", "TGCA")))
    return d.withColumn("palindromic", F.col("plus") == F.col("minus"))


def cut_sites(sequences: DataFrame, key: str, site: str, cut: int) -> DataFrame:
    """(key, boundary, length): 1 + match + cut for each non-overlapping match, without the ends."""
    parts = sequences.select(key, F.char_length("seq").alias("length"), F.posexplode(F.split(F.upper("seq"), site, -1)).alias("i", "part"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.sum(F.char_length("part") + len(site)).over(before))
    return parts.where("i > 0").select(key, (F.col("at") - len(site) + 1 + cut).cast("long").alias("boundary"), F.col("length").cast("long"))


def digest(sequences: DataFrame, key: str, enzyme: str) -> DataFrame:
    """(key, start, end) fragments of each sequence: [1, b1], [b1, b2], ..., [bn, length]."""
    site, cut = resolve_enzyme(enzyme)
    cuts = cut_sites(sequences, key, site, cut).select(key, F.col("boundary").alias("start"))
    whole = sequences.select(key, F.lit(1).cast("long").alias("start"), F.char_length("seq").cast("long").alias("length")).where("length > 0")
    starts = whole.unionByName(cuts, allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("start")
    total = F.max("length").over(Window.partitionBy(key))
    d = starts.withColumn("end", F.coalesce(F.lead("start").over(by), total))
    # A cut at the first or past the last base leaves an empty fragment.
    return d.where(F.col("end") > F.col("start")).select(key, (F.row_number().over(by) - 1).cast("long").alias("frag_idx"), "start", "end")


def _apart(site: str):
    """Of matches (chrom, run, at) that may overlap, those that a search from the left would find, run by run."""

    def run(key, t):
        out, free = [], -1
        for at in sorted(t["at"].to_pylist()):
            if at >= free:
                out.append(at)
                free = at + len(site)
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(out, pa.int64())], ["chrom", "at"])

    return run


def digest_tiles(tiles: DataFrame, enzyme: str) -> DataFrame:
    """(chrom, frag_idx, start, end) fragments of sequences in tiles (chrom, offset, seq), as digest gives them.

    A tile is searched with the first bases of the next one, so that a site over a seam is found
    once. What is gathered by chromosome are positions of cuts.
    """
    site, cut = resolve_enzyme(enzyme)
    more = len(site) - 1
    d = tiles.withColumn("next", F.col("offset") + F.char_length("seq"))
    head = tiles.select("chrom", F.col("offset").alias("next"), F.substring("seq", 1, more).alias("more"))
    d = d.join(head, ["chrom", "next"], "left").select("chrom", "offset", F.concat("seq", F.coalesce("more", F.lit(""))).alias("seq"))

    def find(batches):
        for batch in batches:
            out = []
            for chrom, offset, seq in zip(*(c.to_pylist() for c in batch.columns)):
                at = seq.find(site)
                while at >= 0:
                    out.append((chrom, offset + at))
                    at = seq.find(site, at + 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64()))], ["chrom", "at"])

    found = d.mapInArrow(find, "chrom string, at long")
    by = Window.partitionBy("chrom").orderBy("at")
    if any(site.startswith(site[k:]) for k in range(1, len(site))):  # a site that can overlap itself
        far = F.coalesce(F.col("at") - F.lag("at").over(by) >= len(site), F.lit(True)).cast("int")
        runs = found.withColumn("far", far).withColumn("run", F.sum("far").over(by))
        found = runs.groupBy("chrom", "run").applyInArrow(_apart(site), "chrom string, at long")
    length = tiles.groupBy("chrom").agg(F.max(F.col("offset") + F.char_length("seq")).cast("long").alias("length")).where("length > 0")
    starts = found.select("chrom", (F.col("at") + 1 + cut).alias("start")).unionByName(length.select("chrom", F.lit(1).cast("long").alias("start")))
    by = Window.partitionBy("chrom").orderBy("start")
    d = starts.withColumn("end", F.lead("start").over(by)).join(length, "chrom").withColumn("end", F.coalesce("end", "length"))
    return d.where("end > start").select("chrom", (F.row_number().over(by) - 1).cast("long").alias("frag_idx"), "start", "end")


def fragments_of_sites(sites: DataFrame) -> DataFrame:
    """sites(chrom, site) -> (chrom, start, end, mid) fragments that end at each site."""
    by = Window.partitionBy("chrom").orderBy("site")
    d = sites.select("chrom", F.coalesce(F.lag("site").over(by), F.lit(1)).cast("long").alias("start"), F.col("site").cast("long").alias("end"))
    return d.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))


def haplotype_tiles(genome: DataFrame, snps: DataFrame, allele: str, tile: int = 100_000) -> DataFrame:
    """genome(chrom, seq) with the allele column of snps(chrom, pos, ..) written in, as (chrom, tile, seq).

    Each tile is rebuilt from the stretches between its SNPs, so no task holds a chromosome's
    edits. A genome in tiles (chrom, offset, seq) of `tile` bases is taken as it is.
    """
    if "offset" in genome.columns:
        return _edited(genome.select("chrom", F.floor(F.col("offset") / tile).cast("int").alias("tile"), "seq"), snps, allele, tile)
    tiles = genome.select("chrom", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("seq") - 1) / tile).cast("int"))).alias("tile"), "seq")
    tiles = tiles.select("chrom", "tile", F.expr(f"substr(seq, tile * {tile} + 1, {tile})").alias("seq"))
    return _edited(tiles, snps, allele, tile)


def _edited(tiles: DataFrame, snps: DataFrame, allele: str, tile: int) -> DataFrame:
    s = snps.select("chrom", F.floor((F.col("pos") - 1) / tile).cast("int").alias("tile"), ((F.col("pos") - 1) % tile).cast("int").alias("at"), F.col(allele).alias("base"))
    s = s.groupBy("chrom", "tile", "at").agg(F.min("base").alias("base"))
    s = s.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list(F.struct("at", "base"))).alias("edits"))
    d = tiles.join(s, ["chrom", "tile"], "left")
    edits = F.filter("edits", lambda e: e["at"] < F.char_length("seq"))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(edits, i - 1)["at"] + 1)
    pieces = F.transform(edits, lambda e, i: F.concat(F.substring("seq", before(i) + 1, e["at"] - before(i)), e["base"]))
    rest = F.substring("seq", F.element_at(edits, -1)["at"] + 2, F.lit(tile))
    return d.select("chrom", "tile", F.when(F.coalesce(F.size(edits), F.lit(0)) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("seq")).alias("seq"))


def wrapped(tiles: DataFrame, width: int = 60) -> DataFrame:
    """(chrom, line_no, line) of tiles(chrom, tile, seq) for a FASTA file; tiles must hold a multiple of width."""
    lines = tiles.select("chrom", "tile", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{width}}}"), F.lit(0))).alias("k", "line"))
    per = tiles.groupBy().agg(F.ceil(F.max(F.char_length("seq")) / width).alias("per"))
    return lines.join(F.broadcast(per)).select("chrom", (F.col("tile") * F.col("per") + F.col("k") + 1).cast("long").alias("line_no"), "line")
