"""Queries on sequences, reads, pairs, alleles and contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import alleles, contacts, genome, impute, pairs, reads
from strandloom.sources import fixtures as fx
from strandloom.sources.text import haplotype_sizes

from .inputs import NAME, RES, mark, sql

#: Resolutions of the multi-resolution query.
MULTI = [40_000, 200_000, 1_000_000]
#: Neighbourhood of the imputation query: bins of 100 kb, region of 1 Mb.
INTER_RES, INTER_REGION = 100_000, 1_000_000


def _seqs(spark, d):
    return fx.sequences(spark, d)


def _doc_snps(spark, d):
    """An allele at every 97th base of each sequence."""
    n = _seqs(spark, d).where("length(seq) between 1 and 3000").selectExpr("doc_id", "explode(sequence(0, length(seq) - 1)) as i").where("i % 97 = 13")
    return n.selectExpr("cast(doc_id as string) as chrom", "cast(i + 1 as bigint) as pos", "substr('ACGT', cast((doc_id + i) % 4 + 1 as int), 1) as m_alt")


def _align(spark, d):
    return fx.alignments(spark, d).withColumns({"flag": F.lit(0), "frag": F.expr("pos - pos % 4000 + 2000"), "snp_n": F.lit(0)})


def _flat(x):
    r = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("ref", "pos", "frag")]
    return x.select("name", "outcome", *r("r1"), *r("r2"), *r("cand"), "cand_of")


#: Chromosome labels of a supplier's number, numbers and names mixed.
_LABEL = "case l_suppkey % 27 when 0 then 'X' when 1 then 'Y' when 2 then 'MT' when 3 then '2L' else cast(l_suppkey % 27 as {text}) end"


def _sizes_df(spark, d):
    """(chrom, length): labels with the largest position that any of their pairs has."""
    return fx.table(spark, d, "lineitem").selectExpr(_LABEL.format(text="string") + " as chrom", "1 + (l_partkey*7919 + l_suppkey*104729) % 2000000 as pos").groupBy("chrom").agg(F.max("pos").cast("long").alias("length"))


_SIZES_SQL = f"(select {_LABEL.format(text='varchar')} as chrom, max(1 + (l_partkey*7919 + l_suppkey*104729) % 2000000) as length from lineitem group by 1)"
_RANKED = f"select chrom, length, row_number() over (order by try_cast(chrom as int) nulls last, chrom) as rank from {_SIZES_SQL}"
#: Enzymes of the junction query, with their sites' cuts in SQL.
_ENZYMES = ["MboI", "HindIII", "NcoI", "CC-GATGG"]


def _junctions(spark, d):
    """Each enzyme's ligation junction, and how often the sequences hold it."""
    j = F.broadcast(genome.junctions(spark, _ENZYMES).withColumn("cut", F.col("cut").cast("long")))  # a row an enzyme
    hits = F.size(F.split("seq", F.col("plus"), -1)) - 1
    per = _seqs(spark, d).crossJoin(j).groupBy("enzyme", "site", "cut", "plus", "minus", "palindromic")
    return per.agg(F.count_if(hits > 0).alias("n_sequences"), F.sum(hits).cast("long").alias("n_hits"))


def _around(spark, d):
    """Contacts in the imputation's neighbourhood of each frequent pixel."""
    px = fx.matrix_pixels(spark, d)
    at = px.where("value >= 2").select("chrom", F.col("bin1").alias("x"), F.col("bin2").alias("y")).crossJoin(F.broadcast(impute.offsets(spark, 500_000)))  # some sixty cells
    near = at.withColumns({"bin1": F.col("x") + F.col("di"), "bin2": F.col("y") + F.col("dj")}).join(px, ["chrom", "bin1", "bin2"])
    return near.groupBy("chrom", F.col("x").alias("bin1"), F.col("y").alias("bin2")).agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("value"))


def _stats_sql() -> str:
    n = lambda c: f"count(*) filter (where {c})"
    cols = {"total": "count(*)", "bi_allelic": n("hap_class = 'Bi_Allelic'"), "m_p": n("hap_class = 'M_P'"), "p_m": n("hap_class = 'P_M'")}
    for c in ("M_M", "P_P"):
        cols[c.lower()] = n(f"hap_class = '{c}'")
        for x in ("Both", "R1", "R2"):
            cols[f"{c.lower()}_{x.lower()}"] = n(f"hap_class = '{c}' and resolved = '{x}'")
    cols |= {"intra_allelic": n("chrom1 = chrom2 and hap_class <> 'Bi_Allelic'"), "inter_allelic": n("chrom1 <> chrom2 and hap_class <> 'Bi_Allelic'")}
    cols["allelic_ratio"] = "round(1 - count(*) filter (where hap_class = 'Bi_Allelic') / count(*), 6)"
    return sql("hap", "select " + ", ".join(f"{v} as {k}" for k, v in cols.items()) + " from hap")


def _pixels_sql(res: int) -> str:
    a, b = f"(chrom1, frag1 // {res})", f"(chrom2, frag2 // {res})"
    return f"""select {res} as res, case when {a} <= {b} then chrom1 else chrom2 end as chrom1, case when {a} <= {b} then frag1 // {res} else frag2 // {res} end as bin1,
      case when {a} <= {b} then chrom2 else chrom1 end as chrom2, case when {a} <= {b} then frag2 // {res} else frag1 // {res} end as bin2, count(*) as n from valid group by all"""


def _hap_bins(spark):
    size = haplotype_sizes(spark.createDataFrame([(str(i), 2_000_000) for i in range(1, 6)], "chrom string, length long"))
    # Haplotype letters keep names from being numbers: order by letter, then number.
    return contacts.bins_table(size, INTER_RES)


def _inter(spark, d):
    hap, bins = fx.stored_haplotype_pairs(spark, d), _hap_bins(spark)
    un = contacts.haplotype_contacts(hap, [INTER_RES])
    ids = lambda k: bins.select(F.col("chrom").alias("chrom" + k), F.col("bin").alias("bin" + k), F.col("bin_id").alias("i" + k))
    un = un.join(ids("1"), ["chrom1", "bin1"]).join(ids("2"), ["chrom2", "bin2"]).select(F.col("i1").alias("bin1"), F.col("i2").alias("bin2"), "n")
    full = un.unionByName(un.where("bin1 <> bin2").select(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), "n"))
    return impute.impute_inter(hap, full, bins, INTER_RES, INTER_REGION)


def _inter_sql() -> str:
    n = 2_000_000 // INTER_RES + 1
    side = INTER_REGION // INTER_RES
    gid = lambda c, f: f"(case substr({c}, 1, 1) when 'M' then 0 else 5 end + cast(substr({c}, 2) as bigint) - 1) * {n} + {f} // {INTER_RES}"
    body = f"""
    , un as (select {gid("c1", "f1")} as x, {gid("c2", "f2")} as y from hap_un),
    cell as (select x as bin1, y as bin2, count(*) as v from (select least(x, y) as x, greatest(x, y) as y from un union all select greatest(x, y), least(x, y) from un where x <> y) group by all),
    one as (select substr(hap_class, 1, 1) as h, case resolved when 'R1' then chrom1 else chrom2 end as ca, case resolved when 'R1' then frag1 else frag2 end as fa,
      case resolved when 'R1' then chrom2 else chrom1 end as ct, case resolved when 'R1' then frag2 else frag1 end as ft from hap where chrom1 <> chrom2 and hap_class in ('M_M', 'P_P') and resolved in ('R1', 'R2')),
    pos as (select {gid("h || ca", "fa")} as a, {gid("'M' || ct", "ft")} as m, {gid("'P' || ct", "ft")} as p, count(*) as n from one group by all),
    use as (select * from pos where a >= {side} and m >= {side} and p >= {side} and a + {side} + 1 <= {10 * n} and m + {side} + 1 <= {10 * n} and p + {side} + 1 <= {10 * n}),
    off as (select i - {side} as di, j - {side} as dj from range({2 * side + 1}) a(i), range({2 * side + 1}) b(j) where sqrt(pow(i - {side + 1}, 2) + pow(j - {side + 1}, 2)) < sqrt({side})),
    votes as (select a, m, p, n, coalesce(sum((select v from cell where bin1 = a + di and bin2 = m + dj)), 0) as sm, coalesce(sum((select v from cell where bin1 = a + di and bin2 = p + dj)), 0) as sp from use, off group by all)
    select a as bin1, t as bin2, cast(sum(n) as bigint) as n from (select a, n, case when sm >= 2 and sm / (sm + sp) > 0.9 then m when sp >= 2 and sp / (sm + sp) > 0.9 then p end as t from votes) where t is not null group by all"""
    return sql("hap_un", "select 1").rsplit("\n", 1)[0] + body


def _integrate_sql() -> str:
    """Read groups to pairs, as one CASE over the roles; results are lists of (r1, r2, candidate, its mate)."""
    pair = lambda a, b, c="null", of="null": f"{{'a': {a}, 'b': {b}, 'c': {c}, 'f': {of}}}"
    one = lambda *x: f"{{'o': 'pair', 'p': [{', '.join(x)}]}}"
    none = lambda o: f"{{'o': '{o}', 'p': [null]}}"
    U, M, BAD = none("unmapped"), none("multiple"), none("malformed")
    same = lambda x, y: f"({x}.frag = {y}.frag and {x}.ref = {y}.ref)"
    ok, lost = (lambda x: f"{x}.bad = 0"), (lambda x: f"{x}.bad = 2")

    def merged(p: tuple, q: tuple) -> str:
        return f"case when {same(p[0], q[0])} and {same(p[1], q[1])} then {one(pair(*p))} else {one(pair(*p), pair(*q))} end"

    def r1_cut(x, y, z):
        return f"""case when ({lost(x)} and {lost(y)}) or {lost(z)} then {U} when (not {ok(x)} and not {ok(y)}) or not {ok(z)} then {M}
          when not {ok(x)} then case when {same(y, z)} then {U} else {one(pair(y, z))} end when not {ok(y)} then {one(pair(x, z))}
          when {same(y, z)} then {one(pair(x, z, y, "'R2'"))} when {same(x, y)} then {one(pair(x, z, y, "'R1'"))} else {merged((x, y), (y, z))} end"""

    def r2_cut(z, x, y):
        return f"""case when ({lost(x)} and {lost(y)}) or {lost(z)} then {U} when (not {ok(x)} and not {ok(y)}) or not {ok(z)} then {M}
          when not {ok(x)} then case when {same(y, z)} then {U} else {one(pair(z, y))} end when not {ok(y)} then {one(pair(z, x))}
          when {same(x, y)} then {one(pair(z, x, y, "'R2'"))} when {same(y, z)} then {one(pair(z, x, y, "'R1'"))} else {merged((z, y), (y, x))} end"""

    a, b, c, d = "t11", "t12", "t21", "t22"
    R1, R2 = "'R1'", "'R2'"
    four = f"""case when {same(a, b)} and {same(c, d)} then {merged((a, c, d, R2), (b, c, d, R2))} when {same(a, b)} then {merged((a, d, b, R1), (b, c, b, R1))}
      when {same(c, d)} then {merged((a, c, d, R2), (b, c, d, R2))} when {same(b, d)} then {merged((a, d, b, R2), (b, c, d, R1))} else {merged((a, b), (d, c))} end"""
    six = f"""case when ({lost(a)} and {lost(b)}) or ({lost(c)} and {lost(d)}) then {U} when (not {ok(a)} and not {ok(b)}) or (not {ok(c)} and not {ok(d)}) then {M}
      when not ({ok(a)} and {ok(b)}) and not ({ok(c)} and {ok(d)}) then {one(pair("y1", "y2"))} when not ({ok(a)} and {ok(b)}) then {r2_cut("y1", c, d)} when not ({ok(c)} and {ok(d)}) then {r1_cut(a, b, "y2")} else {four} end"""
    role = lambda name, cond: f"arg_min(r, pos) filter (where {cond}) as {name}"
    return f"""with al as ({_ALIGN_SQL}), ra as (select name, tag, pos, ref, len, {{'ref': ref, 'pos': pos, 'frag': pos - pos % 4000 + 2000, 'bad': case when unmapped = 1 then 2 when xs_score is null then 0 else 1 end}} as r from al),
    g as (select name, count(*) as k, string_agg(tag, ',' order by tag) as tags, {", ".join(role("t" + t, f"tag = '{t}'") for t in ("1", "2", "11", "12", "21", "22"))}, {role("s1", "tag = '1' and len < 150")}, {role("s2", "tag = '2' and len < 150")},
      arg_max(r, (tag, pos, ref)) filter (where tag like '%1' and r.bad = 0) as l1, arg_max(r, (tag, pos, ref)) filter (where tag like '%2' and r.bad = 0) as l2, count(*) filter (where r.bad = 2) as nl, count(*) filter (where r.bad > 0) as nb,
      list(r order by tag, pos, ref) as every, list(r order by tag, pos, ref) filter (where len <> 150) as kept from ra group by name),
    h as (select *, case when t11.bad = 0 then t11 else t12 end as y1, case when t22.bad = 0 then t22 else t21 end as y2, case when k = 2 then every when tags = '1,1,2,2' then kept end as pl from g),
    o as (select name, case when pl is not null then case when len(pl) <> 2 then {BAD} when pl[1].bad = 2 or pl[2].bad = 2 then {U} when pl[1].bad = 1 or pl[2].bad = 1 then {M} else {one(pair("pl[1]", "pl[2]"))} end
      when k = 3 then case when nl >= 2 then {U} when nb >= 2 then {M} when l1 is not null and l2 is not null then {one(pair("l1", "l2"))} else {BAD} end
      when tags = '1,11,12,2' then {r1_cut(a, b, "t2")} when tags = '1,2,21,22' then {r2_cut("t1", c, d)} when tags = '1,11,12,2,2' then {r1_cut(a, b, "s2")} when tags = '1,1,2,21,22' then {r2_cut("s1", c, d)}
      when tags = '1,11,12,2,21,22' then {six} else {BAD} end as x from h),
    e as (select name, x.o as outcome, len(x.p) as k, unnest(range(len(x.p))) as i, unnest(x.p) as p from o)
    select case when k = 2 then concat(name, '_', i + 1) else name end as name, outcome, p.a.ref as r1_ref, p.a.pos as r1_pos, p.a.frag as r1_frag, p.b.ref as r2_ref, p.b.pos as r2_pos, p.b.frag as r2_frag, p.c.ref as cand_ref, p.c.pos as cand_pos, p.c.frag as cand_frag, p.f as cand_of from e"""


def register(add) -> None:
    # Sequences and reads.
    add(
        "digest_fragments", lambda s, d: genome.digest(_seqs(s, d), "doc_id", "MboI"),
        sql("fx_seqs", """, hit as (select doc_id, seq, unnest(range(1, length(seq) - 2)) as i from fx_seqs where length(seq) >= 4),
        b as (select doc_id, i as b from hit where substr(seq, i, 4) = 'GATC' union select doc_id, 1 from fx_seqs where length(seq) > 0),
        f as (select doc_id, b as start, coalesce(lead(b) over (partition by doc_id order by b), (select length(seq) from fx_seqs s where s.doc_id = b.doc_id)) as "end" from b)
        select doc_id, row_number() over (partition by doc_id order by start) - 1 as frag_idx, start, "end" from f where "end" > start"""),
    )
    add(
        "junction_sequence", _junctions,
        sql("fx_seqs", """, e as (select * from (values ('MboI', 'GATC', 0, 'GATCGATC', 'GATCGATC', true), ('HindIII', 'AAGCTT', 1, 'AAGCTAGCTT', 'AAGCTAGCTT', true),
        ('NcoI', 'CCATGG', 1, 'CCATGCATGG', 'CCATGCATGG', true), ('CC-GATGG', 'CCGATGG', 2, 'CCGATGATGG', 'CCATCATCGG', false)) as t(enzyme, site, cut, plus, minus, palindromic))
        select e.*, count(*) filter (contains(seq, plus)) as n_sequences, cast(sum((length(seq) - length(replace(seq, plus, ''))) / length(plus)) as bigint) as n_hits from e, fx_seqs group by all"""),
    )
    add(
        "rescue_reads", lambda s, d: reads.rescue(_seqs(s, d).selectExpr("concat('s', doc_id) as name", "seq", "translate(seq, 'ACGT', 'IHGF') as qual"), "A-CGT"),
        sql("fx_seqs", """, j as (select doc_id, seq, (length(seq) - length(replace(seq, 'ACGCGT', ''))) / 6 as n, instr(seq, 'ACGCGT') as pos from fx_seqs),
        p as (select doc_id, 1 as k, substr(seq, 1, pos - 1) as seq, pos - 1 as l, length(seq) - pos - 5 as r from j where n = 1 union all select doc_id, 2, substr(seq, pos + 6), pos - 1, length(seq) - pos - 5 from j where n = 1)
        select case when l >= 10 and r >= 10 then concat('s', doc_id, k) else concat('s', doc_id) end as name, seq, translate(seq, 'ACGT', 'IHGF') as qual from p
        where (l >= 10 and r >= 10) or (l < 10 and k = 2) or (l >= 10 and r < 10 and k = 1)"""),
    )
    add("pair_integrate", lambda s, d: _flat(reads.integrate(_align(s, d))), _integrate_sql())
    add(
        "pair_outcomes", lambda s, d: reads.integrate(_align(s, d)).select("name", "outcome").withColumn("name", F.regexp_extract("name", "^(o[0-9]+)", 1)).distinct().groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
        f"select outcome, count(*) as n from (select distinct regexp_extract(name, '^(o[0-9]+)', 1) as name, outcome from ({_integrate_sql()})) group by 1",
    )
    add(
        "simple_groups", lambda s, d: _flat(reads.integrate(_align(s, d).join(_align(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.max("len").alias("ml")).where("k = 2 or (k = 4 and ml = 150)").select("name"), "name"))).select("name", "outcome", "r1_pos", "r2_pos"),
        f"""with a as ({_ALIGN_SQL}), g as (select *, count(*) over (partition by name) as k, max(len) over (partition by name) as ml from a),
        u as (select name, tag, pos, unmapped, xs_score from g where k = 2 or (k = 4 and ml = 150 and len <> 150)),
        w as (select name, sum(unmapped) as lost, count(xs_score) filter (where unmapped = 0) as multi, min_by(pos, tag) as r1_pos, max_by(pos, tag) as r2_pos from u group by name)
        select name, case when lost > 0 then 'unmapped' when multi > 0 then 'multiple' else 'pair' end as outcome, case when lost = 0 and multi = 0 then r1_pos end as r1_pos, case when lost = 0 and multi = 0 then r2_pos end as r2_pos from w""",
    )
    tiles = lambda s, d: genome.haplotype_tiles(_seqs(s, d).where("length(seq) between 1 and 3000").selectExpr("cast(doc_id as string) as chrom", "seq"), _doc_snps(s, d), "m_alt", 600)
    add(
        "haplotype_sequence", tiles,
        sql("fx_seqs", """, s as (select doc_id, seq from fx_seqs where length(seq) between 1 and 3000), b as (select doc_id, unnest(range(length(seq))) as i, seq from s)
        select cast(doc_id as varchar) as chrom, cast(i // 600 as int) as tile, string_agg(case when i % 97 = 13 then substr('ACGT', cast((doc_id + i) % 4 + 1 as bigint), 1) else substr(seq, i + 1, 1) end, '' order by i) as seq from b group by 1, 2"""),
    )
    add(
        "fasta_lines", lambda s, d: genome.wrapped(tiles(s, d)).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"), F.sum(F.char_length("line")).alias("n_bases")),
        sql("fx_seqs", "select cast(doc_id as varchar) as chrom, cast(ceil(length(seq) / 60) as bigint) as n_lines, cast(ceil(length(seq) / 60) as bigint) as last_line, length(seq) as n_bases from fx_seqs where length(seq) between 1 and 3000"),
    )
    # Fragments, SNPs, pairs.
    add(
        "fragment_lookup", lambda s, d: pairs.with_fragments(fx.pairs(s, d), fx.fragments(s, d)).select("name", "frag1", "frag2"),
        sql(["fx_pairs", "fx_frags"], """select name, (a.s + a.e) // 2 as frag1, (b.s + b.e) // 2 as frag2 from fx_pairs d
        join fx_frags a on a.chrom = d.chrom1 and d.pos1 <= a.e and (d.pos1 > a.s or (d.pos1 = 1 and a.s = 1)) join fx_frags b on b.chrom = d.chrom2 and d.pos2 <= b.e and (d.pos2 > b.s or (d.pos2 = 1 and b.s = 1))"""),
    )
    read = "select doc_id, cast(1 + doc_id % 5 as varchar) as chrom, 1 + (doc_id * 7919) % 2000000 as pos, substr(seq, 1, 2000) as seq from fx_seqs where length(seq) > 0"
    add(
        "snp_match_count",
        lambda s, d: alleles.snp_matches(_seqs(s, d).where("length(seq) > 0").selectExpr("concat('d', doc_id) as name", "cast(1 + doc_id % 5 as string) as chrom", "1 + (doc_id * 7919) % 2000000 as pos", "substr(seq, 1, 2000) as seq"), fx.snps(s, d), "m_alt"),
        sql(["fx_seqs", "fx_snps"], f""", r as ({read}) select concat('d', doc_id) as name, count(s.pos) as snp_n from r left join fx_snps s on s.chrom = r.chrom and s.pos >= r.pos and s.pos < r.pos + length(seq) and substr(seq, cast(s.pos - r.pos + 1 as bigint), 1) = m_alt group by 1"""),
    )
    cols = "name, chrom1, flag1, pos1, chrom2, flag2, pos2"
    add("dedup_pairs", lambda s, d: pairs.drop_duplicates(fx.pairs(s, d)).selectExpr(*cols.split(", ")), sql(["fx_pairs", "dedup"], f"select {cols} from dedup"))
    add("duplicate_ranks", lambda s, d: pairs.mark_duplicates(fx.pairs(s, d)).where("dup_rank > 1").select("name", "dup_rank"), sql("fx_pairs", "select name, rn as dup_rank from (select name, row_number() over (partition by chrom1, flag1, pos1, chrom2, flag2, pos2 order by name) as rn from fx_pairs) where rn > 1"))
    add("artefact_classes", lambda s, d: pairs.classify(fx.pairs(s, d), fx.fragments(s, d)).groupBy("class").agg(F.count(F.lit(1)).alias("n")), sql("pairs", "select class, count(*) as n from classed group by 1"))
    add("valid_pairs", lambda s, d: pairs.valid_pairs(fx.pairs(s, d), fx.fragments(s, d)).selectExpr(*cols.split(", "), "frag1", "frag2"), sql("pairs", f"select {cols}, frag1, frag2 from valid"))
    add(
        "filtering_stats", lambda s, d: pairs.filtering_stats(fx.pairs(s, d), fx.fragments(s, d)),
        sql("pairs", """select (select count(*) from fx_pairs) as total_pairs, count(*) filter (class = 'SC') as n_sc, count(*) filter (class = 'DE') as n_de, count(*) filter (class = 'UM') as n_um,
        count(*) filter (class = 'ED') as n_ed, count(*) filter (class = 'VALID') as n_valid, (select count(*) from fx_pairs) - (select count(*) from dedup) as duplicates from classed"""),
    )
    # Alleles.
    add(
        "allele_mark", lambda s, d: fx.maternal(s, d).alias("m").join(fx.paternal(s, d).alias("p"), "name").select("name", _mark_of("1").alias("mark1")),
        f"""with m as (select {NAME} as name, 1 + l_partkey % 5 as c, 100 + (l_partkey*7919 + l_suppkey*104729) % 2000000 as p, -(l_partkey % 40) as s, l_orderkey % 4 as n from lineitem where l_partkey % 5 <> 0),
        p as (select {NAME} as name, 1 + l_partkey % 5 as c, 100 + (l_partkey*7919 + l_suppkey*104729) % 2000000 + (l_orderkey % 4) * 4 as p, -(l_suppkey % 40) as s, l_linenumber % 4 as n from lineitem where l_suppkey % 7 <> 0)
        select name, {mark(["m.c", "m.p", "m.s", "m.n"], ["p.c", "p.p", "p.s", "p.n"])} as mark1 from m join p using (name)""",
    )
    add(
        "candidate_available", lambda s, d: fx.mapped_maternal(s, d).select("name", F.struct("r1", "r2", "cand", "cand_of").alias("m")).select("name", alleles.candidate_available("m").alias("available")),
        sql("hm", "select name, coalesce((cof = 'R1' and cc = c1 and cf = f1) or (cof = 'R2' and cc = c2 and cf = f2), false) as available from hm"),
    )
    hap = "name, chrom1, frag1, chrom2, frag2, hap_class, resolved"
    side = lambda x, k: x.select("name", F.struct("r1", "r2", "cand", "cand_of").alias(k))
    add("hap_pairs_both", lambda s, d: alleles.pairs_on_both(side(fx.mapped_maternal(s, d), "m").join(side(fx.mapped_paternal(s, d), "p"), "name")), sql("hap", f"select {hap} from hap_both"))
    add("hap_pairs_single", lambda s, d: alleles.pairs_on_one(side(fx.mapped_maternal(s, d), "m").join(fx.mapped_paternal(s, d), "name", "left_anti"), "M"), sql("hap", f"select {hap} from hap_m"))
    add("hap_pairs", fx.haplotype_pairs, sql("hap", f"select {hap} from hap"))
    add("hap_pair_stats", lambda s, d: alleles.haplotype_stats(fx.haplotype_pairs(s, d)).withColumn("allelic_ratio", F.round("allelic_ratio", 6)), _stats_sql())
    # Bins and contacts.
    add("natural_chrom_order", lambda s, d: contacts.natural_order(_sizes_df(s, d)), _RANKED)
    add(
        "bins_table", lambda s, d: contacts.bins_table(_sizes_df(s, d), 200_000),
        f"""with g as (select *, length // 200000 + 1 as n from ({_RANKED})), f as (select *, coalesce(sum(n) over (order by rank rows between unbounded preceding and 1 preceding), 0) as first from g),
        b as (select *, unnest(range(n)) as bin from f) select chrom, bin, cast(first + bin as bigint) as bin_id, bin * 200000 as start, least(length, (bin + 1) * 200000) as "end" from b""",
    )
    valid = lambda s, d: pairs.valid_pairs(fx.pairs(s, d), fx.fragments(s, d))
    add("contact_pixels_40k", lambda s, d: contacts.count_contacts(valid(s, d), [RES]), sql("pairs", _pixels_sql(RES)))
    add("contact_pixels_multi", lambda s, d: contacts.count_contacts(valid(s, d), MULTI), sql("pairs", " union all ".join(_pixels_sql(r) for r in MULTI)))
    add("contact_pixels_intra", lambda s, d: contacts.count_contacts(valid(s, d).where(contacts.in_labels(F.col("chrom1"), ["#", "X"]) & (F.col("chrom1") == F.col("chrom2"))), [RES]), sql("pairs", f"select * from ({_pixels_sql(RES)}) where chrom1 = chrom2"))
    add(
        "hap_contacts_unimputed", lambda s, d: contacts.haplotype_contacts(fx.stored_haplotype_pairs(s, d), [RES]),
        sql("hap_un", f"""select {RES} as res, x[1] as chrom1, cast(x[2] as bigint) as bin1, y[1] as chrom2, cast(y[2] as bigint) as bin2, n from (
        select case when (c1, f1 // {RES}) <= (c2, f2 // {RES}) then [c1, cast(f1 // {RES} as varchar)] else [c2, cast(f2 // {RES} as varchar)] end as x, case when (c1, f1 // {RES}) <= (c2, f2 // {RES}) then [c2, cast(f2 // {RES} as varchar)] else [c1, cast(f1 // {RES} as varchar)] end as y, count(*) as n from hap_un group by all)"""),
    )
    add(
        "hap_contacts_intra_imputed", lambda s, d: contacts.imputed_intra_contacts(fx.stored_haplotype_pairs(s, d), [RES]),
        sql("hap", f"""select {RES} as res, substr(hap_class, 1, 1) || chrom1 as chrom, case resolved when 'R1' then frag1 else frag2 end // {RES} as bin1, case resolved when 'R1' then frag2 else frag1 end // {RES} as bin2, count(*) as n
        from hap where chrom1 = chrom2 and hap_class in ('M_M', 'P_P') and resolved in ('R1', 'R2') group by all"""),
    )
    add(
        "neighbourhood_offsets", _around,
        sql("mx", """, o as (select i - 20 as di, j - 20 as dj from range(41) a(i), range(41) b(j) where sqrt(pow(i - 21, 2) + pow(j - 21, 2)) < sqrt(20))
        select p.chrom, p.bin1, p.bin2, count(*) as cells, sum(q.value) as value from px p, o join px q on q.chrom = p.chrom and q.bin1 = p.bin1 + di and q.bin2 = p.bin2 + dj where p.value >= 2 group by 1, 2, 3"""),
    )
    add("hap_contacts_inter_imputed", _inter, _inter_sql())
    half = lambda s, d, k: fx.directed_pixels(s, d, f"snp2 = {k}").withColumn("value", F.col("value").cast("long"))
    add("replicate_merge", lambda s, d: contacts.merge_replicates(half(s, d, 0), half(s, d, 1), half(s, d, 1)), sql("fx_pairs", f"select chrom1 as chrom, pos1 // {RES} as bin1, pos2 // {RES} as bin2, cast(sum(case snp2 when 0 then 1 else 2 end) as bigint) as value from fx_pairs where chrom1 = chrom2 and snp2 < 2 group by all"))
    add("marginals_coverage", lambda s, d: contacts.marginals(contacts.symmetric(fx.matrix_pixels(s, d)), fx.n_bins()).withColumn("coverage", F.round("coverage", 6)), sql("mx", f"select chrom, bin1 as bin, sum(value) as row_sum, round(count(*) / {2_000_000 // RES + 1}, 6) as coverage from mx group by all"))


def _mark_of(k: str):
    c = lambda s: {"chrom": F.col(f"{s}.chrom{k}"), "pos": F.col(f"{s}.pos{k}"), "score": F.col(f"{s}.as{k}"), "snp": F.col(f"{s}.snp{k}")}
    return alleles.allele_mark(c("m"), c("p"))


_ALIGN_SQL = """select concat('o', o_orderkey) as name, t.tag, cast(1 + (o_custkey + t.k) % 5 as varchar) as ref, 1 + (o_custkey*7919 + t.k*((o_orderkey % 3)*800)) % 2000000 as pos, case when (o_orderkey + t.k) % 11 = 0 then 1 else 0 end as unmapped,
    case when (o_orderkey + t.k*3) % 13 = 0 then -(o_custkey % 20) end as xs_score, case when t.long = 1 then 150 else 60 end as len from orders join (values (0,1,'1',0),(0,2,'2',0),
    (1,1,'1',0),(1,2,'11',0),(1,3,'12',0),(1,4,'2',0),(2,1,'1',0),(2,2,'2',0),(2,3,'21',0),(2,4,'22',0),(3,1,'1',1),(3,2,'1',0),(3,3,'2',1),(3,4,'2',0),
    (4,1,'1',1),(4,2,'11',0),(4,3,'12',0),(4,4,'2',1),(4,5,'2',0),(5,1,'1',1),(5,2,'2',1),(5,3,'11',0),(5,4,'12',0),(5,5,'21',0),(5,6,'22',0),(6,1,'1',0),(6,2,'1',0),(6,3,'2',0)) as t(c,k,tag,long) on o_orderkey % 7 = t.c"""
