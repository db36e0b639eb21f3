"""Reads and alignments: rescue of chimeric reads, and read groups to interaction pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .genome import resolve_enzyme

MIN_PART = 10
LONG_READ = 150


def rescue(reads: DataFrame, enzyme: str, min_part: int = MIN_PART) -> DataFrame:
    """reads(name, seq, qual) cut at their one ligation junction -> (name, seq, qual) parts.

    Reads without a junction, or with several, are dropped. A part under min_part bases is
    dropped; two left parts get the name suffixes 1 and 2. The minus-strand junction counts only
    where the plus-strand one is absent.
    """
    site, cut = resolve_enzyme(enzyme)
    plus = site[: len(site) - cut] + site[cut:]
    minus = plus.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    hits = lambda j: F.size(F.split("seq", j, -1)) - 1
    r = reads.withColumn("at", F.when(hits(plus) == 1, F.instr("seq", plus)).when((hits(plus) == 0) & (hits(minus) == 1), F.instr("seq", minus)))
    n = len(plus)
    r = r.where("at is not null").withColumns({"left": F.expr("at - 1"), "right": F.char_length("seq") - F.col("at") - n + 1})
    part = lambda name, a, k: F.struct(name.alias("name"), F.substring("seq", a, k).alias("seq"), F.substring("qual", a, k).alias("qual"))
    one, two = (F.lit(1), F.col("left")), (F.col("at") + n, F.col("right"))
    parts = (
        F.when(F.col("left") < min_part, F.array(part(F.col("name"), *two)))
        .when(F.col("right") < min_part, F.array(part(F.col("name"), *one)))
        .otherwise(F.array(part(F.concat("name", F.lit("1")), *one), part(F.concat("name", F.lit("2")), *two)))
    )
    return r.select(F.explode(parts).alias("p")).select("p.*")


def main_chromosome(ref: Column) -> Column:
    return ref.rlike("^([0-9]+|X|Y)$")


def is_unique(level: int = 1) -> Column:
    """Mapped and unambiguous: without a second hit, or (level 2) with a worse one."""
    ok = (F.col("unmapped") == 0) & F.col("as_score").isNotNull() & main_chromosome(F.col("ref"))
    clear = F.col("xs_score").isNull()
    return F.coalesce(ok & (clear if level == 1 else clear | (F.col("as_score") > F.col("xs_score"))), F.lit(False))


def split_name(name: Column) -> tuple[Column, Column]:
    """(pair name, role tag) of an alignment's query name."""
    return F.regexp_extract(name, "^(.*)_([^_]+)$", 1), F.regexp_extract(name, "^(.*)_([^_]+)$", 2)


def mark_mate(name: Column, mate: int) -> Column:
    return F.concat(name, F.lit(f"_{mate}"))


_FIELDS = ["ref", "flag", "pos", "len", "as_score", "frag", "snp_n"]


def integrate(alignments: DataFrame, level: int = 1) -> DataFrame:
    """Read groups to interaction pairs, by the number and roles of their alignments.

    alignments(name, tag, ref, flag, pos, len, as_score, xs_score, unmapped, frag, snp_n) with
    frag the fragment midpoint. Returns name, outcome (pair, unmapped, multiple or malformed)
    and, for pairs, r1, r2, cand (structs) and cand_of; a group of two interactions gives two
    rows with the name suffixes _1 and _2. One shuffle, on the name.
    """
    gone = (F.col("unmapped") == 1) | ~F.coalesce(main_chromosome(F.col("ref")), F.lit(False))
    a = alignments.withColumn("bad", F.when(gone, 2).when(is_unique(level), 0).otherwise(1))
    read = F.struct("tag", "pos", "ref", "flag", "len", "as_score", "frag", "snp_n", "bad")
    g = a.groupBy("name").agg(F.array_sort(F.collect_list(read)).alias("all"))
    one = lambda tag: F.get(F.filter("all", lambda x: x["tag"] == tag), 0)
    short = lambda tag: F.get(F.filter("all", lambda x: (x["tag"] == tag) & (x["len"] < LONG_READ)), 0)
    tags = F.array_join(F.transform("all", lambda x: x["tag"]), ",")
    g = g.select("name", "all", tags.alias("tags"), *[one(t).alias("t" + t) for t in ("1", "2", "11", "12", "21", "22")], short("1").alias("s1"), short("2").alias("s2"))
    n = F.size("all")
    kept = F.filter("all", lambda x: x["len"] != LONG_READ)
    g = g.withColumn("plain", F.when(n == 2, F.col("all")).when(F.col("tags") == "1,1,2,2", kept).when(n == 3, _mates()))

    null_read, null_of = F.lit(None).cast(g.schema["all"].dataType.elementType), F.lit(None).cast("string")
    pair = lambda r1, r2, cand=null_read, of=null_of: F.struct(r1.alias("r1"), r2.alias("r2"), cand.alias("cand"), of.alias("cand_of"))
    result = lambda kind, *ps: F.struct(F.lit(kind).alias("outcome"), F.array(*ps).cast(pairs_type).alias("pairs"))
    pairs_type = g.select(F.array(pair(F.col("t1"), F.col("t2")))).schema[0].dataType
    U, M, BAD = result("unmapped"), result("multiple"), result("malformed")
    same = lambda x, y: (x["frag"] == y["frag"]) & (x["ref"] == y["ref"])
    ok, lost = lambda x: x["bad"] == 0, lambda x: x["bad"] == 2

    def merged(p: Column, q: Column) -> Column:
        equal = (p["r1"]["ref"] == q["r1"]["ref"]) & (p["r2"]["ref"] == q["r2"]["ref"]) & (p["r1"]["frag"] == q["r1"]["frag"]) & (p["r2"]["frag"] == q["r2"]["frag"])
        return F.when(equal, result("pair", p)).otherwise(result("pair", p, q))

    def r1_cut(x11: Column, x12: Column, x2: Column) -> Column:
        """The first mate is cut into 11 and 12; x2 is the other one."""
        core = F.when(same(x12, x2), result("pair", pair(x11, x2, x12, F.lit("R2")))).when(same(x11, x12), result("pair", pair(x11, x2, x12, F.lit("R1")))).otherwise(merged(pair(x11, x12), pair(x12, x2)))
        both_lost, both_bad = lost(x11) & lost(x12), ~ok(x11) & ~ok(x12)
        return (
            F.when(both_lost | lost(x2), U).when(both_bad | ~ok(x2), M)
            .when(~ok(x11), F.when(same(x12, x2), U).otherwise(result("pair", pair(x12, x2))))
            .when(~ok(x12), result("pair", pair(x11, x2))).otherwise(core)
        )

    def r2_cut(x1: Column, x21: Column, x22: Column) -> Column:
        core = F.when(same(x21, x22), result("pair", pair(x1, x21, x22, F.lit("R2")))).when(same(x22, x1), result("pair", pair(x1, x21, x22, F.lit("R1")))).otherwise(merged(pair(x1, x22), pair(x22, x21)))
        return (
            F.when((lost(x21) & lost(x22)) | lost(x1), U).when((~ok(x21) & ~ok(x22)) | ~ok(x1), M)
            .when(~ok(x21), F.when(same(x22, x1), U).otherwise(result("pair", pair(x1, x22))))
            .when(~ok(x22), result("pair", pair(x1, x21))).otherwise(core)
        )

    t1, t2, t11, t12, t21, t22 = (F.col("t" + x) for x in ("1", "2", "11", "12", "21", "22"))
    p = F.col("plain")
    lost_n = F.size(F.filter(p, lost))
    bad_n = F.size(F.filter(p, lambda x: ~ok(x)))
    two = F.when(F.size(p) != 2, BAD).when(lost_n > 0, U).when(bad_n > 0, M).otherwise(result("pair", pair(F.get(p, 0), F.get(p, 1))))
    four = (
        F.when(same(t11, t12) & same(t21, t22), merged(pair(t11, t21, t22, F.lit("R2")), pair(t12, t21, t22, F.lit("R2"))))
        .when(same(t11, t12), merged(pair(t11, t22, t12, F.lit("R1")), pair(t12, t21, t12, F.lit("R1"))))
        .when(same(t21, t22), merged(pair(t11, t21, t22, F.lit("R2")), pair(t12, t21, t22, F.lit("R2"))))
        .when(same(t12, t22), merged(pair(t11, t22, t12, F.lit("R2")), pair(t12, t21, t22, F.lit("R1"))))
        .otherwise(merged(pair(t11, t12), pair(t22, t21)))
    )
    x1, x2 = F.when(ok(t11), t11).otherwise(t12), F.when(ok(t22), t22).otherwise(t21)
    six = (
        F.when((lost(t11) & lost(t12)) | (lost(t21) & lost(t22)), U).when((~ok(t11) & ~ok(t12)) | (~ok(t21) & ~ok(t22)), M)
        .when((~ok(t11) | ~ok(t12)) & (~ok(t21) | ~ok(t22)), result("pair", pair(x1, x2)))
        .when(~ok(t11) | ~ok(t12), r2_cut(x1, t21, t22)).when(~ok(t21) | ~ok(t22), r1_cut(t11, t12, x2)).otherwise(four)
    )
    has = lambda *names: F.col("tags").isin(list(names))
    outcome = (
        F.when(F.col("plain").isNotNull(), two)
        .when(has("1,11,12,2"), r1_cut(t11, t12, t2)).when(has("1,2,21,22"), r2_cut(t1, t21, t22))
        .when(has("1,11,12,2,2"), r1_cut(t11, t12, F.col("s2"))).when(has("1,1,2,21,22"), r2_cut(F.col("s1"), t21, t22))
        .when(has("1,11,12,2,21,22"), six).otherwise(BAD)
    )
    g = g.select("name", F.coalesce(outcome, BAD).alias("o")).select("name", "o.outcome", "o.pairs")
    g = g.select("name", "outcome", F.size("pairs").alias("k"), F.posexplode_outer("pairs").alias("i", "p"))
    slim = lambda x: F.when(x.isNotNull(), F.struct(*[x[f].alias(f) for f in _FIELDS]))
    name = F.when(F.col("k") == 2, F.concat("name", F.lit("_"), (F.col("i") + 1).cast("string"))).otherwise(F.col("name"))
    return g.select(name.alias("name"), "outcome", slim(F.col("p.r1")).alias("r1"), slim(F.col("p.r2")).alias("r2"), slim(F.col("p.cand")).alias("cand"), F.col("p.cand_of").alias("cand_of"))


def _mates() -> Column:
    """Of three reads: with one lost or ambiguous at most, the last of either side; else what makes the group fail."""
    side = lambda end: F.filter("all", lambda x: x["tag"].endswith(end) & (x["bad"] == 0))
    many = lambda f: F.size(F.filter("all", f)) >= 2
    lost, bad = (lambda x: x["bad"] == 2), (lambda x: x["bad"] != 0)
    last = F.array(F.element_at(side("1"), -1), F.element_at(side("2"), -1))
    whole = (F.size(side("1")) > 0) & (F.size(side("2")) > 0)
    return F.when(many(lost), F.slice(F.filter("all", lost), F.lit(1), F.lit(2))).when(many(bad), F.array_repeat(F.get(F.filter("all", lambda x: x["bad"] == 1), 0), 2)).when(whole, last).otherwise(F.array())


def placed(alignments: DataFrame, fragments: DataFrame, snps: DataFrame | None = None, allele: str = "m_alt") -> DataFrame:
    """alignments(name, tag, ref, pos, len, seq, ..) with frag, the midpoint of their fragment, and snp_n, the SNPs whose allele they show; what integrate asks for.

    Unmapped alignments and those outside all fragments have no frag. SNPs are counted by the
    read's place; without snps they are 0.
    """
    from .alleles import snp_matches
    from .rangejoin import point_in_interval

    f = fragments.select(F.col("chrom"), "start", "end", F.col("mid").alias("frag"))
    a = point_in_interval(alignments, f, "ref", "pos", how="left").drop("start", "end")
    if snps is None:
        return a.withColumn("snp_n", F.lit(0).cast("long"))
    own = F.struct("name", "tag", "ref", "pos", "seq").alias("name")
    n = snp_matches(a.select(own, F.col("ref").alias("chrom"), "pos", "seq").distinct(), snps, allele)
    n = n.select("name.*", "snp_n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("name", "tag", "ref", "pos", "seq")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return a.alias("a").join(n.alias("n"), cond, "left").select("a.*", F.coalesce("n.snp_n", F.lit(0)).alias("snp_n"))
