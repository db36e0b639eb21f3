"""Queries that write derived inputs in the field's formats and read them back, and stores over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import balance, contacts, genome, pairs, reads
from strandloom.sources import bam, blocks, text
from strandloom.sources import fixtures as fx
from strandloom.sources.pixelstore import PixelStore, balance_store
from strandloom.sources.store import shared_path

from .contact_queries import _integrate_sql
from .inputs import RES, sql

#: Bases of the tiles of the FASTA queries, and records of a FASTQ file.
TILE, PER_FILE = 1000, 2000

#: Read groups in SQL: roles of the fixture's alignments by o_orderkey % 7.
_ROLES = [(0, ["1", "2"], ""), (1, ["1", "11", "12", "2"], ""), (2, ["1", "2", "21", "22"], ""), (3, ["1", "1", "2", "2"], "1010"), (4, ["1", "11", "12", "2", "2"], "10010"), (5, ["1", "2", "11", "12", "21", "22"], "110000"), (6, ["1", "1", "2"], "000")]
_VALUES = ", ".join(f"({c}, {k + 1}, '{tag}', {int(len(long) > k and long[k] == '1')})" for c, tags, long in _ROLES for k, tag in enumerate(tags))
_ALIGNED_SQL = f"""with t(c, k, tag, len150) as (values {_VALUES}), al as (select concat('o', o_orderkey) as name, tag, case when (o_orderkey + k) % 11 = 0 then 4 else 0 end as flag, cast(1 + (o_custkey + k) % 5 as varchar) as ref,
    1 + (o_custkey*7919 + k*((o_orderkey % 3)*800)) % 2000000 as pos, -(o_custkey % 20) as as_score, case when (o_orderkey + k*3) % 13 = 0 then -(o_custkey % 20) end as xs_score, case when len150 = 1 then 150 else 60 end as len from orders join t on o_orderkey % 7 = c)"""


def _fastq(spark, d):
    """Sequences as reads of plain FASTQ files."""
    path = shared_path(spark, "fastq")
    reads = fx.sequences(spark, d).where("seq <> ''").selectExpr("concat('d', doc_id) as name", "seq", "translate(seq, 'ACGT', '@I+5') as qual")
    text.write_fastq(reads, path, PER_FILE, "none")
    return text.read_fastq(spark, path, 1).select("name", "mate", F.char_length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def _tiles(spark, d):
    """Sequences as a FASTA file of wrapped lines, read back in tiles."""
    path = shared_path(spark, "fasta")
    body = F.concat(F.lit(">chr"), F.col("doc_id").cast("string"), F.lit(" made\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n"))
    fx.sequences(spark, d).where("seq <> ''").select(body.alias("value")).write.mode("overwrite").text(path)
    return blocks.fasta_tiles(spark, path, TILE)


_REFS = [(str(i), 2_100_000) for i in range(1, 6)]


def _records(spark, d):
    """Alignments as records."""
    return fx.alignments(spark, d).select(
        F.concat_ws("_", "name", "tag").alias("name"), (4 * F.col("unmapped")).cast("int").alias("flag"), "ref", "pos", F.lit(30).alias("mapq"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"),
        F.expr("repeat('ACGTN', cast(len / 5 as int))").alias("seq"), F.lit(None).cast("string").alias("qual"), F.col("as_score").cast("int").alias("as_score"), F.col("xs_score").cast("int").alias("xs_score"),
    )


def _bam(spark, d, unmapped=None):
    """Alignments as BAM files, read back by byte ranges."""
    path = shared_path(spark, "bam")
    bam.write_bam(_records(spark, d).repartition("name").sortWithinPartitions("name"), path, _REFS)
    r = bam.read_bam(spark, path, unmapped, split=1 << 20)
    # A read group may hold several alignments of one tag, so rows are counted.
    keys = ["name", "tag", "flag", "ref", "pos", "len", "as_score", "xs_score"]
    return r.withColumn("flag", F.col("flag").cast("long")).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))


def _bam_pairs(spark, d):
    """Both mates' alignments in BAM files of their own, read together and integrated."""
    from .contact_queries import _flat

    paths = [shared_path(spark, f"bam{k}") for k in "12"]
    for k, path in zip("12", paths):
        bam.write_bam(_records(spark, d).where(F.col("name").rlike(f"_{k}[12]?$")), path, _REFS)
    a = bam.read_bams(spark, paths).withColumns({"frag": F.expr("pos - pos % 4000 + 2000"), "snp_n": F.lit(0)})
    return _flat(reads.integrate(a))


def _store(spark, d):
    """A pixel store filled in three chunks: by parity of the read name's hash, and a few pairs again."""
    store = PixelStore(spark, shared_path(spark, "pixels"))
    p = fx.pairs(spark, d)
    for k in (0, 1):
        store.append(contacts.count_contacts(p.where(f"snp1 % 2 = {k}"), [RES, 5 * RES], "pos1", "pos2"))
    store.append(contacts.count_contacts(p.where("snp2 = 2"), [RES], "pos1", "pos2"))
    return store


def _stored_pixels(spark, d):
    store = _store(spark, d)
    store.compact()
    store.append(contacts.count_contacts(fx.pairs(spark, d).where("snp2 = 1"), [RES], "pos1", "pos2"))
    return store.read(RES)


def _weights(spark, d):
    store = PixelStore(spark, shared_path(spark, "pixels"))
    store.append(contacts.count_contacts(fx.pairs(spark, d).where("chrom1 = chrom2"), [RES], "pos1", "pos2"))
    balance_store(store, RES, fx.sizes(spark), 400, 1e-12)
    v = store.balanced(RES).where("bin1 <> bin2")
    ends = v.select(F.col("chrom1").alias("chrom"), F.explode(F.array("bin1", "bin2")).alias("bin"), "value")
    s = ends.groupBy("chrom", "bin").agg(F.sum("value").alias("s"))
    w = store.weights(RES).select("chrom", "bin", F.col("weight").isNull().alias("masked"))
    return w.join(s, ["chrom", "bin"], "left").select("chrom", "bin", "masked", F.round("s", 4).alias("row_sum"))


def _directed(spark, d):
    p = fx.pairs(spark, d).where("snp1 <> snp2").withColumn("h", F.when(F.col("snp1") > F.col("snp2"), "M").otherwise("P"))
    p = p.select(F.concat("h", "chrom1").alias("chrom1"), contacts.bin_of(F.col("pos1"), RES).alias("bin1"), F.concat("h", "chrom2").alias("chrom2"), contacts.bin_of(F.col("pos2"), RES).alias("bin2"))
    return p.groupBy("chrom1", "bin1", "chrom2", "bin2").agg(F.count(F.lit(1)).cast("double").alias("value"))


def _global(spark, d):
    size = spark.createDataFrame([(h + str(i), 2_000_000) for h in "MP" for i in range(1, 6)], "chrom string, length long")
    bins = contacts.bins_table(size, RES).select("chrom", "bin", F.col("bin_id").alias("gbin"))
    m = contacts.symmetric(fx.matrix_pixels(spark, d))
    return balance.correct_global(m, _directed(spark, d), fx.sizes(spark), bins).withColumn("value", F.round("value", 6))


_GLOBAL_SQL = f""", h as (select concat(case when snp1 > snp2 then 'M' else 'P' end, chrom1) as c1, pos1 // {RES} as b1, concat(case when snp1 > snp2 then 'M' else 'P' end, chrom2) as c2, pos2 // {RES} as b2, cast(count(*) as double) as v from fx_pairs where snp1 <> snp2 group by all),
    own as (select substr(c1, 2) as chrom, b1 as bin, sum(v) as s from h where c1 = c2 group by 1, 2),
    a0 as (select t.chrom, t.bin, coalesce(o.s, 0) / (t.row_sum + 1) as a, t.coverage >= 0.1 as used from rows_t t left join own o using (chrom, bin)),
    a1 as (select chrom, bin, used, case when a = 0 then 1.0 else a / top end as a from a0 join (select chrom, max(a) filter (used) as top from a0 group by 1) using (chrom)),
    al as (select chrom, bin, greatest(a, low) as alpha from a1 join (select chrom, quantile_cont(a, 0.2) as low from a1 where used group by 1) using (chrom)),
    s as (select c1, b1, c2, b2, v / alpha as v from h join al on al.chrom = substr(c1, 2) and al.bin = b1),
    y as (select c1, b1, c2, b2, sum(v) as v from (select * from s union all select c2, b2, c1, b1, v from s where c1 <> c2 or b1 <> b2) group by all),
    r as (select c1 as c, b1 as b, sum(v) as s from y group by 1, 2), x as (select y.*, v / (pow(p.s, 2.0/3) * pow(q.s, 2.0/3)) as w from y join r p on p.c = c1 and p.b = b1 join r q on q.c = c2 and q.b = b2)
    select c1 as chrom1, b1 as bin1, c2 as chrom2, b2 as bin2, round(w * (select sum(v) from h) / (select sum(w) from x), 6) as value from x"""


def _counted(spark, d):
    path = shared_path(spark, "valid")
    p = fx.pairs(spark, d)
    parts = [pairs.write_valid_pairs(p.where(f"chrom1 {w} '3'"), fx.fragments(spark, d), f"{path}/{k}") for k, w in (("a", "<"), ("b", ">="))]
    row = pairs.merged_stats(parts)
    written = spark.read.parquet(f"{path}/a", f"{path}/b").agg(F.count(F.lit(1)).alias("n_written"))
    return written.select(*[F.lit(v).cast("long").alias(k) for k, v in row.items()], "n_written")


def _compartment_lines(spark, d):
    """Mean score differences as compartment lines, written and read by places."""
    from .structure_queries import _pc

    path = shared_path(spark, "compartments")
    text.write_compartments(_pc(spark, d, "m"), path)
    return text.read_compartments(spark, path)


def _loop_tables(spark, d):
    """Frequent pixels as a loop table and as pairs of anchors, read again."""
    px = fx.matrix_pixels(spark, d).where("value >= 2").selectExpr("chrom", f"bin1 * {RES} as a", f"bin2 * {RES} as b", "cast(1 / (1 + value) as double) as q")
    path = shared_path(spark, "loops")
    text.write_table(px.selectExpr("chrom", "a", "b", "0 as c3", "0 as c4", "0 as c5", "0 as c6", "0 as c7", "0 as c8", "q"), f"{path}/called")
    text.write_table(px.selectExpr("concat('chr', chrom) as chrom", "a", "b", "a as a2", "b as b2"), f"{path}/pairs")
    called = text.read_called_loops(spark, f"{path}/called").groupBy("chrom").agg(F.count(F.lit(1)).alias("n_called"), F.sum("start").alias("starts"), F.round(F.sum("q"), 6).alias("q"))
    both = text.read_loop_pairs(spark, f"{path}/pairs").groupBy("chrom").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("end1") + F.col("start2")).alias("anchors"))
    marks = text.read_boundary_pairs(spark, f"{path}/pairs").groupBy("chrom").agg(F.sum(F.col("pos2") - F.col("pos1")).alias("apart"))
    return called.join(both, "chrom").join(marks, "chrom")


_FRAG = "{p} - {p} % 4000 + 2000"


def _pair_lines(spark, d):
    """Pairs as lines of 15 columns, or of 23 where there is a candidate, read again."""
    path = shared_path(spark, "pair-lines")
    mate = lambda k: F.struct(F.col("chrom" + k).alias("ref"), F.col("flag" + k).alias("strand"), F.col("pos" + k).alias("pos"), F.lit(60).alias("len"), F.col("as" + k).alias("as_score"), F.expr(_FRAG.format(p="pos" + k)).alias("frag"), F.col("snp" + k).alias("snp_n"))
    has = F.col("snp1") == 3
    p = fx.pairs(spark, d).select("name", mate("1").alias("r1"), mate("2").alias("r2"), F.when(has, mate("2")).alias("cand"), F.when(has, "R1").alias("cand_of"))
    text.write_pairs(p, path)
    r = text.read_pairs(spark, path)
    flat = lambda s: [F.col(f"{s}.{c}").cast("string" if c == "ref" else "long").alias(f"{s}_{c}") for c in text.PAIR_FIELDS]
    return r.select("name", *flat("r1"), *flat("r2"), *flat("cand"), "cand_of")


def _pair_lines_sql() -> str:
    side = lambda s, k, no: [f"{'case when snp1 = 3 then ' if no else ''}{v}{' end' if no else ''} as {s}_{c}" for c, v in (("ref", f"chrom{k}"), ("strand", f"flag{k}"), ("pos", f"pos{k}"), ("len", "60"), ("as_score", f"as{k}"), ("frag", _FRAG.format(p=f"pos{k}")), ("snp_n", f"snp{k}"))]
    return sql("fx_pairs", f"select name, {', '.join([*side('r1', '1', False), *side('r2', '2', False), *side('cand', '2', True)])}, case when snp1 = 3 then 'R1' end as cand_of from fx_pairs")


def _tables(spark, d):
    """Fragments, variants and sizes as text files, read again and counted by chromosome."""
    path = shared_path(spark, "tables")
    marked = lambda x: x.withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    marked(fx.fragments(spark, d)).select("chrom", "start", "end").write.csv(f"{path}/fragments", sep="\t")
    marked(fx.snps(spark, d)).select("chrom", "pos", F.lit("N"), F.lower("m_alt"), "p_alt").write.csv(f"{path}/snps", sep=" ")
    p = fx.pairs(spark, d).groupBy(F.col("chrom1").alias("chrom")).agg(F.max("pos1").alias("length"))
    marked(p.unionByName(p.selectExpr("concat('Un', chrom) as chrom", "length"))).write.csv(f"{path}/sizes", sep="\t")
    f = text.read_fragments(spark, f"{path}/fragments").groupBy("chrom").agg(F.count(F.lit(1)).alias("fragments"), F.sum("mid").alias("mids"))
    v = text.read_snps(spark, f"{path}/snps").groupBy("chrom").agg(F.count(F.lit(1)).alias("snps"), F.sum("pos").alias("places"), F.count_if(F.col("m_alt") == "A").alias("m_a"), F.count_if(F.col("p_alt") == "A").alias("p_a"))
    return text.read_genome_size(spark, f"{path}/sizes", ["#", "X"]).join(f, "chrom").join(v, "chrom")


def _sam(spark, d):
    """Alignments as SAM text, read again and counted."""
    path = shared_path(spark, "sam")
    tag = lambda t, c: F.concat(F.lit(f"{t}:i:"), F.col(c).cast("string"))
    head = F.concat_ws("\t", "name", "flag", F.concat(F.lit("chr"), "ref"), "pos", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), tag("AS", "as_score"), tag("XS", "xs_score"))
    _records(spark, d).select(head.alias("value")).write.text(path)
    keys = ["name", "tag", "flag", "ref", "pos", "len", "as_score", "xs_score"]
    return text.read_sam(spark, path).withColumn("flag", F.col("flag").cast("long")).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))


def _resolutions(spark, d):
    """The multi-resolution store of one file tree, one parent's chromosomes read from it."""
    path = shared_path(spark, "resolutions")
    p = fx.pairs(spark, d).where("snp1 <> snp2").withColumn("h", F.when(F.col("snp1") > F.col("snp2"), "M").otherwise("P"))
    p = p.withColumns({"chrom1": F.concat("h", "chrom1"), "chrom2": F.concat("h", "chrom2")})
    text.write_pixels(contacts.count_contacts(p, [RES, 5 * RES], "pos1", "pos2"), path)
    return text.read_pixels(spark, path, 5 * RES, haplotype="P").select("chrom1", "bin1", "chrom2", "bin2", "n")


def register(add) -> None:
    add("pair_lines", _pair_lines, _pair_lines_sql())
    add(
        "annotation_tables", _tables,
        sql(["fx_pairs", "fx_frags", "fx_snps"], """, z as (select chrom1 as chrom, max(pos1) as length from fx_pairs group by 1), f as (select chrom, count(*) as fragments, cast(sum((s + e) // 2) as bigint) as mids from fx_frags group by 1),
        v as (select chrom, count(*) as snps, cast(sum(pos) as bigint) as places, count(*) filter (m_alt = 'A') as m_a, count(*) filter (p_alt = 'A') as p_a from fx_snps group by 1) select * from z join f using (chrom) join v using (chrom)"""),
    )
    add("sam_records", _sam, f"{_ALIGNED_SQL} select name, tag, cast(flag as bigint) as flag, ref, pos, len, as_score, xs_score, count(*) as k from al group by all")
    h = "(select concat('P', chrom1) as c1, pos1 // 200000 as b1, concat('P', chrom2) as c2, pos2 // 200000 as b2 from fx_pairs where snp1 < snp2)"
    add(
        "pixels_of_one_parent", _resolutions,
        sql("fx_pairs", f"select case when (c1, b1) <= (c2, b2) then c1 else c2 end as chrom1, case when (c1, b1) <= (c2, b2) then b1 else b2 end as bin1, case when (c1, b1) <= (c2, b2) then c2 else c1 end as chrom2, case when (c1, b1) <= (c2, b2) then b2 else b1 end as bin2, count(*) as n from {h} group by all"),
    )
    add("compartment_lines", _compartment_lines, sql("fx_pairs", f""", p as (select chrom1 as chrom, pos1 // {RES} as bin, avg(as1 - as2) as pc from fx_pairs group by 1, 2), n as (select chrom, max(bin) as n from p group by 1),
        g as (select chrom, unnest(range(n + 1)) as bin from n) select g.chrom, g.bin, coalesce(pc, 0) as pc from g left join p using (chrom, bin)"""))
    add(
        "loop_tables", _loop_tables,
        sql("mx", f"select chrom, count(*) as n_called, cast(sum(bin1 * {RES}) as bigint) as starts, round(sum(1 / (1 + value)), 6) as q, count(*) as n_pairs, cast(sum((bin1 + bin2) * {RES}) as bigint) as anchors, cast(sum((bin2 - bin1) * {RES}) as bigint) as apart from px where value >= 2 group by 1"),
    )
    add("fastq_records", _fastq, sql("fx_seqs", "select concat('d', doc_id, '_1') as name, 1 as mate, length(seq) as n, md5(seq) as seq_md5, md5(translate(seq, 'ACGT', '@I+5')) as qual_md5 from fx_seqs where seq <> ''"))
    add(
        "fasta_tiles", lambda s, d: _tiles(s, d).select("chrom", "offset", F.char_length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5")),
        sql("fx_seqs", f""", t as (select cast(doc_id as varchar) as chrom, unnest(range(0, length(seq), {TILE})) as "offset", seq from fx_seqs where seq <> ''), u as (select chrom, "offset", substr(seq, "offset" + 1, {TILE}) as part from t)
        select chrom, "offset", length(part) as n, md5(part) as seq_md5 from u"""),
    )
    add(
        "digest_tiles", lambda s, d: genome.digest_tiles(_tiles(s, d), "MboI"),
        sql("fx_seqs", """, m as (select doc_id, length(seq) as n, string_split(seq, 'GATC') as p from fx_seqs where seq <> ''), c as (select doc_id, n, unnest(range(1, len(p))) as i, p from m),
        b as (select doc_id, list_sum(list_transform(p[1:i], lambda x: length(x) + 4)) - 3 as start from c union all select doc_id, 1 from m),
        f as (select b.doc_id, start, coalesce(lead(start) over (partition by b.doc_id order by start), n) as e from b join m using (doc_id))
        select cast(doc_id as varchar) as chrom, row_number() over (partition by doc_id order by start) - 1 as frag_idx, cast(start as bigint) as start, cast(e as bigint) as "end" from f where e > start"""),
    )
    keys = "name, tag, cast(flag as bigint) as flag, ref, pos, len, as_score, xs_score, count(*) as k"
    add("bam_records", _bam, f"{_ALIGNED_SQL} select {keys} from al group by all")
    add("bam_unmapped", lambda s, d: _bam(s, d, True), f"{_ALIGNED_SQL} select {keys} from al where flag = 4 group by all")
    add("bam_pairs", _bam_pairs, _integrate_sql())
    level = lambda s, d: fx.alignments(s, d).withColumn("xs_score", F.expr("xs_score + (pos % 3 - 1)")).groupBy("ref").agg(*[F.count_if(reads.is_unique(x)).alias(f"level{x}") for x in (1, 2)], F.count(F.lit(1)).alias("n"))
    add(
        "unique_reads", lambda s, d: level(s, d),
        f"""{_ALIGNED_SQL}, x as (select *, xs_score + (pos % 3 - 1) as xs from al) select ref, count(*) filter (flag = 0 and xs is null) as level1, count(*) filter (flag = 0 and (xs is null or as_score > xs)) as level2, count(*) as n from x group by 1""",
    )
    side = f"""case when (chrom1, pos1 // {RES}) <= (chrom2, pos2 // {RES}) then {{a}} else {{b}} end"""
    c = lambda a, b: side.format(a=a, b=b)
    add(
        "pixel_store", _stored_pixels,
        sql("fx_pairs", f"""select {c('chrom1', 'chrom2')} as chrom1, {c(f'pos1 // {RES}', f'pos2 // {RES}')} as bin1, {c('chrom2', 'chrom1')} as chrom2, {c(f'pos2 // {RES}', f'pos1 // {RES}')} as bin2,
        cast(sum(1 + cast(snp2 in (1, 2) as int)) as bigint) as n from fx_pairs group by 1, 2, 3, 4"""),
    )
    add("stored_weights", _weights, sql("mx", f", o as (select distinct chrom, bin1 as bin from mx where bin1 <> bin2) select g.chrom, g.bin, o.bin is null as masked, case when o.bin is not null then cast(1 as double) end as row_sum from grid g left join o using (chrom, bin)"))
    add("global_correction", _global, sql(["mx", "rows_t"], _GLOBAL_SQL))
    add(
        "counted_pairs", _counted,
        sql("pairs", """select (select count(*) from fx_pairs) as total_pairs, count(*) filter (class = 'SC') as n_sc, count(*) filter (class = 'DE') as n_de, count(*) filter (class = 'UM') as n_um,
        count(*) filter (class = 'ED') as n_ed, count(*) filter (class = 'VALID') as n_valid, (select count(*) from fx_pairs) - (select count(*) from dedup) as duplicates, count(*) filter (class = 'VALID') as n_written from classed"""),
    )
