"""Haplotype assignment: SNP matches per mate, allele marks, and pairs of both or one genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rangejoin import points_in_spans

POSITION_TOLERANCE, SCORE_GAP = 5, 18


def snp_matches(reads: DataFrame, snps: DataFrame, allele: str) -> DataFrame:
    """(name, snp_n) for every row of reads(name, chrom, pos, seq): SNPs in it whose allele the read shows.

    The base at a SNP is the one its distance from the read's start gives; gaps are not followed.
    """
    r = reads.withColumn("len", F.char_length("seq").cast("long"))
    hit = points_in_spans(r, snps.select("chrom", "pos", F.col(allele).alias("allele")), "chrom", "pos", "len")
    hit = hit.where(F.expr("substr(seq, cast(snp_pos - pos + 1 as int), 1)") == F.col("allele"))
    n = hit.groupBy("name").agg(F.count(F.lit(1)).alias("snp_n"))
    return reads.select("name").join(n, "name", "left").select("name", F.coalesce("snp_n", F.lit(0)).cast("long").alias("snp_n"))


def allele_mark(m: dict[str, Column], p: dict[str, Column]) -> Column:
    """M, P or N of a mate with chrom, pos, score and snp in the maternal (m) and paternal (p) mapping."""
    here = (m["chrom"] == p["chrom"]) & (F.abs(m["pos"] - p["pos"]) <= POSITION_TOLERANCE)
    by_snp = F.when(m["snp"] > 2 * p["snp"], "M").when(2 * m["snp"] < p["snp"], "P").otherwise("N")
    gap = m["score"] - p["score"]
    by_score = F.when((gap >= SCORE_GAP) & (m["snp"] >= 2 * p["snp"]), "M").when((gap <= -SCORE_GAP) & (p["snp"] >= 2 * m["snp"]), "P").otherwise("N")
    return F.when(here, by_snp).otherwise(by_score)


def mate(prefix: str, k: str) -> dict[str, Column]:
    """Columns of a mate struct <prefix>.r<k>."""
    r = F.col(f"{prefix}.{k}")
    return {"chrom": r["chrom"], "frag": r["frag"], "pos": r["pos"], "score": r["score"], "snp": r["snp"]}


def candidate_available(side: str) -> Column:
    """Whether the candidate of `side` lies in the fragment of the mate that it belongs to."""
    c, of = F.col(f"{side}.cand"), F.col(f"{side}.cand_of")
    own = F.when(of == "R1", F.col(f"{side}.r1")).otherwise(F.col(f"{side}.r2"))
    return F.coalesce(c.isNotNull() & (c["chrom"] == own["chrom"]) & (c["frag"] == own["frag"]), F.lit(False))


_ROUTES = {"NN": ("Bi_Allelic", None), "NM": ("M_M", "R2"), "MN": ("M_M", "R1"), "MM": ("M_M", "Both"), "NP": ("P_P", "R2"), "PN": ("P_P", "R1"), "PP": ("P_P", "Both"), "MP": ("M_P", None), "PM": ("P_M", None)}


def _pick(mark: Column, m: dict[str, Column], p: dict[str, Column], c: str) -> Column:
    return F.when(mark == "P", p[c]).otherwise(m[c])


def pairs_on_both(both: DataFrame) -> DataFrame:
    """Pairs mapped to both genomes -> (name, chrom1, frag1, chrom2, frag2, hap_class, resolved).

    both(name, m, p): structs of r1, r2, cand (each chrom, frag, pos, score, snp; cand null where
    there is none) and cand_of. A mate without a mark is judged again with its available
    candidate in place of the mate, on the genomes that have one; a mark found so also gives the
    coordinate. The maternal label decides where both genomes have candidates.
    """
    d = both.withColumn("of", F.coalesce("m.cand_of", "p.cand_of"))
    d = d.withColumns({"m_ok": candidate_available("m"), "p_ok": candidate_available("p")})
    sides: dict[str, tuple[dict, dict, dict, dict]] = {}
    steps: list[dict[str, Column]] = [{}, {}, {}]
    for k in ("1", "2"):
        m, p = mate("m", "r" + k), mate("p", "r" + k)
        use = {s: F.coalesce(F.col(s + "_ok") & (F.col(f"{s}.cand_of") == "R" + k), F.lit(False)) for s in ("m", "p")}
        new = lambda s, x, k=k: {c: F.when(F.col(f"{s}_use{k}"), F.col(f"{s}.cand")[c]).otherwise(x[c]) for c in x}
        sides[k] = (m, p, new("m", m), new("p", p))
        steps[0] |= {f"{s}_use{k}": use[s] for s in use}
        steps[1] |= {f"first{k}": allele_mark(m, p), f"second{k}": allele_mark(sides[k][2], sides[k][3])}
        may = (F.col("of") == "R" + k) & (F.col(f"m_use{k}") | F.col(f"p_use{k}"))
        steps[2][f"change{k}"] = F.coalesce(may, F.lit(False)) & (F.col(f"first{k}") == "N") & (F.col(f"second{k}") != "N")
    for step in steps:  # one projection each: later ones refer to columns, not to copies of expressions
        d = d.withColumns(step)
    out = {}
    for k, (m, p, m2, p2) in sides.items():
        change, first, second = (F.col(x + k) for x in ("change", "first", "second"))
        out["mark" + k] = F.when(change, second).otherwise(first)
        for c in ("chrom", "frag"):
            out[c + k] = F.when(change, _pick(second, m2, p2, c)).otherwise(_pick(first, m, p, c))
    d = d.select("name", *[v.alias(k) for k, v in out.items()])
    return _routed(d)


def _routed(d: DataFrame) -> DataFrame:
    marks = F.concat("mark1", "mark2")
    literal = lambda i: F.create_map(*[F.lit(x) for m, r in _ROUTES.items() if r[i] for x in (m, r[i])])
    kind, resolved = (F.try_element_at(literal(i), marks) for i in (0, 1))
    return d.select("name", "chrom1", "frag1", "chrom2", "frag2", kind.alias("hap_class"), resolved.alias("resolved"))


def pairs_on_one(one: DataFrame, genome: str, side: str = "m") -> DataFrame:
    """Pairs mapped to one genome only -> the same columns; genome is M or P, side the struct column."""
    s1, s2 = F.col(f"{side}.r1")["snp"], F.col(f"{side}.r2")["snp"]
    c, of = F.col(f"{side}.cand"), F.col(f"{side}.cand_of")
    ok = candidate_available(side) & (F.coalesce(c["snp"], F.lit(0)) != 0)
    to2, to1 = ok & (of == "R2"), ok & (of == "R1")
    mark = (
        F.when((s1 != 0) & (s2 != 0), "Both").when(s1 != 0, F.when(to2, "Both").otherwise("R1"))
        .when(s2 != 0, F.when(to1, "Both").otherwise("R2")).otherwise(F.when(ok, of).otherwise("N"))
    )
    swap1 = F.coalesce((s1 == 0) & to1, F.lit(False))
    swap2 = F.coalesce((s2 == 0) & to2, F.lit(False))
    r1, r2 = F.col(f"{side}.r1"), F.col(f"{side}.r2")
    at = lambda swap, r, f: F.when(swap, c[f]).otherwise(r[f])
    kind = F.when(mark == "N", "Bi_Allelic").otherwise(f"{genome}_{genome}")
    return one.select("name", at(swap1, r1, "chrom").alias("chrom1"), at(swap1, r1, "frag").alias("frag1"), at(swap2, r2, "chrom").alias("chrom2"), at(swap2, r2, "frag").alias("frag2"), kind.alias("hap_class"), F.when(mark != "N", mark).alias("resolved"))


def assign_haplotypes(maternal: DataFrame, paternal: DataFrame) -> DataFrame:
    """Valid pairs of the two mappings (name, r1, r2, cand, cand_of) to haplotype classes.

    One full outer join on the name replaces sorting and merging; which sides are present
    decides the rule.
    """
    side = lambda d, s: d.select("name", F.struct("r1", "r2", "cand", "cand_of").alias(s))
    d = side(maternal, "m").join(side(paternal, "p"), "name", "full_outer")
    both = pairs_on_both(d.where("m is not null and p is not null"))
    m = pairs_on_one(d.where("p is null"), "M", "m")
    p = pairs_on_one(d.where("m is null"), "P", "p")
    return both.unionByName(m).unionByName(p)


def haplotype_stats(hap_pairs: DataFrame) -> DataFrame:
    """One row: pairs by class and resolution, and the share of pairs with any allele."""
    n = lambda cond: F.count_if(cond)
    k, r = F.col("hap_class"), F.col("resolved")
    counts = {"total": F.count(F.lit(1)), "bi_allelic": n(k == "Bi_Allelic"), "m_p": n(k == "M_P"), "p_m": n(k == "P_M")}
    for c in ("M_M", "P_P"):
        counts[c.lower()] = n(k == c)
        for x in ("Both", "R1", "R2"):
            counts[f"{c.lower()}_{x.lower()}"] = n((k == c) & (r == x))
    intra = F.col("chrom1") == F.col("chrom2")
    counts |= {"intra_allelic": n(intra & (k != "Bi_Allelic")), "inter_allelic": n(~intra & (k != "Bi_Allelic"))}
    d = hap_pairs.agg(*[v.alias(x) for x, v in counts.items()])
    return d.withColumn("allelic_ratio", 1 - F.col("bi_allelic") / F.col("total"))


def write_by_class(hap_pairs: DataFrame, path: str) -> None:
    """One folder a class."""
    hap_pairs.write.mode("overwrite").partitionBy("hap_class").parquet(path)
