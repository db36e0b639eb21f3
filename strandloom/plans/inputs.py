"""The derived inputs in SQL, for the oracles: named common table expressions."""

from __future__ import annotations

NAME = "concat('r',l_orderkey,'_',l_linenumber,'_',l_partkey,'_',l_suppkey,'_',cast(l_quantity as int))"
RES = 40_000

CTE: dict[str, str] = {
    "fx_pairs": f"""select {NAME} as name, cast(1 + l_partkey % 5 as varchar) as chrom1, case when l_linenumber % 2 = 0 then 0 else 16 end as flag1,
      cast(1 + (l_partkey*7919 + l_suppkey*104729) % 2000000 as bigint) as pos1,
      cast(case when l_suppkey % 3 = 0 then 1 + l_suppkey % 5 else 1 + l_partkey % 5 end as varchar) as chrom2,
      case when l_suppkey % 2 = 0 then 0 else 16 end as flag2,
      cast(case when l_quantity < 15 then greatest(1, 1 + (l_partkey*7919 + l_suppkey*104729) % 2000000 + (l_suppkey % 7 - 3) * 151)
        else 1 + (l_partkey*15485863 + l_suppkey*32452843) % 2000000 end as bigint) as pos2,
      cast(l_orderkey % 4 as bigint) as snp1, cast((l_orderkey + l_suppkey) % 3 as bigint) as snp2,
      cast(-(l_partkey % 40) as bigint) as as1, cast(-(l_suppkey % 40) as bigint) as as2 from lineitem""",
    "fx_frags": """select chrom, coalesce(lag(site) over (partition by chrom order by site), 1) as s, site as e
      from (select distinct cast(1 + p_partkey % 5 as varchar) as chrom, cast(1 + (p_partkey*611953) % 2000000 as bigint) as site from part)""",
    "fx_snps": """select distinct cast(1 + c_custkey % 5 as varchar) as chrom, cast(1 + (c_custkey*104729) % 2000000 as bigint) as pos,
      substr('ACGT', cast(1 + c_custkey % 4 as int), 1) as m_alt, substr('ACGT', cast(1 + (c_custkey + 1 + c_nationkey % 3) % 4 as int), 1) as p_alt from customer""",
    "fx_seqs": """select doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') as seq from documents""",
    "fx_signal": "select cast(1 + user_id % 5 as varchar) as chrom, cast(floor(value) as bigint) as bin, event_type as kind, value as v from events",
    "dedup": "select * exclude (rn) from (select *, row_number() over (partition by chrom1, flag1, pos1, chrom2, flag2, pos2 order by name) as rn from fx_pairs) where rn = 1",
    "placed": """select d.*, (a.s + a.e) // 2 as frag1, (b.s + b.e) // 2 as frag2 from dedup d
      join fx_frags a on a.chrom = d.chrom1 and d.pos1 <= a.e and (d.pos1 > a.s or (d.pos1 = 1 and a.s = 1))
      join fx_frags b on b.chrom = d.chrom2 and d.pos2 <= b.e and (d.pos2 > b.s or (d.pos2 = 1 and b.s = 1))""",
    "classed": """select *, case when chrom1 <> chrom2 then 'VALID'
      when frag1 = frag2 and pos1 < pos2 then case when flag1 = 0 and flag2 = 16 then 'DE' when flag1 = 16 and flag2 = 0 then 'SC' else 'UM' end
      when frag1 = frag2 then case when flag1 = 0 and flag2 = 16 then 'SC' when flag1 = 16 and flag2 = 0 then 'DE' else 'UM' end
      when abs(pos1 - pos2) <= 500 and ((pos1 < pos2 and flag1 = 0 and flag2 = 16) or (pos1 > pos2 and flag1 = 16 and flag2 = 0)) then 'ED'
      else 'VALID' end as class from placed""",
    "valid": "select * from classed where class = 'VALID'",
    "sizes": f"select cast(i as varchar) as chrom, cast({2_000_000 // RES + 1} as bigint) as n from range(1, 6) t(i)",
    "grid": "select chrom, n, unnest(range(n)) as bin from sizes",
    "px": f"""select chrom1 as chrom, least(pos1 // {RES}, pos2 // {RES}) as bin1, greatest(pos1 // {RES}, pos2 // {RES}) as bin2, cast(count(*) as double) as value
      from fx_pairs where chrom1 = chrom2 group by all""",
    "mx": "select chrom, bin1, bin2, value from px union all select chrom, bin2, bin1, value from px where bin1 <> bin2",
    "dm": f"select chrom1 as chrom, pos1 // {RES} as bin1, pos2 // {RES} as bin2, cast(count(*) as double) as value from fx_pairs where chrom1 = chrom2 and snp1 > snp2 group by all",
    "dp": f"select chrom1 as chrom, pos1 // {RES} as bin1, pos2 // {RES} as bin2, cast(count(*) as double) as value from fx_pairs where chrom1 = chrom2 and snp1 < snp2 group by all",
    "rows_t": "select g.chrom, g.bin, g.n, coalesce(sum(value), 0) as row_sum, count(value) / g.n as coverage from grid g left join mx m on m.chrom = g.chrom and m.bin1 = g.bin group by 1, 2, 3",
    "rows_m": "select g.chrom, g.bin, g.n, coalesce(sum(value), 0) as row_sum, count(value) / g.n as coverage from grid g left join dm m on m.chrom = g.chrom and m.bin1 = g.bin group by 1, 2, 3",
    "rows_p": "select g.chrom, g.bin, g.n, coalesce(sum(value), 0) as row_sum, count(value) / g.n as coverage from grid g left join dp m on m.chrom = g.chrom and m.bin1 = g.bin group by 1, 2, 3",
    "gap_m": "select chrom, bin from rows_m join (select chrom, quantile_cont(coverage, 0.25) as q from rows_m where coverage > 0 group by 1) using (chrom) where coverage < least(0.2, q)",
    "gap_p": "select chrom, bin from rows_p join (select chrom, quantile_cont(coverage, 0.25) as q from rows_p where coverage > 0 group by 1) using (chrom) where coverage < least(0.2, q)",
    "alpha0": """select t.chrom, t.bin, (m.row_sum + p.row_sum) / (t.row_sum + 1) as a, not ((t.chrom, t.bin) in (select (chrom, bin) from gap_m) and (t.chrom, t.bin) in (select (chrom, bin) from gap_p)) as used
      from rows_t t join rows_m m using (chrom, bin) join rows_p p using (chrom, bin)""",
    "alpha1": """select chrom, bin, used, case when a = 0 then 1.0 else a / top end as a from alpha0 join (select chrom, max(a) filter (used) as top from alpha0 group by 1) using (chrom)""",
    "alpha": "select chrom, bin, greatest(a, low) as alpha from alpha1 join (select chrom, quantile_cont(a, 0.2) as low from alpha1 where used group by 1) using (chrom)",
    "sm": "select m.chrom, bin1, bin2, value / alpha as value from dm m join alpha a on a.chrom = m.chrom and a.bin = m.bin1",
    "sp": "select m.chrom, bin1, bin2, value / alpha as value from dp m join alpha a on a.chrom = m.chrom and a.bin = m.bin1",
}


def _sym(src: str, gap: str) -> str:
    return f"""select u.chrom, bin1, bin2, case when bin1 = bin2 then sum(value) when max(a.bin) is not null and max(b.bin) is not null then max(value) else sum(value) / 2 end as value
      from (select chrom, bin1, bin2, value from {src} union all select chrom, bin2, bin1, value from {src} where bin1 <> bin2) u
      left join {gap} a on a.chrom = u.chrom and a.bin = bin1 left join {gap} b on b.chrom = u.chrom and b.bin = bin2 group by 1, 2, 3"""


def _vc(src: str) -> str:
    return f"""select m.chrom, m.bin1, m.bin2, value / (pow(a.s, 2.0/3) * pow(b.s, 2.0/3)) as value from {src} m
      join (select chrom, bin1 as bin, sum(value) as s from {src} group by 1, 2) a on a.chrom = m.chrom and a.bin = m.bin1
      join (select chrom, bin1 as bin, sum(value) as s from {src} group by 1, 2) b on b.chrom = m.chrom and b.bin = m.bin2"""


def _mean(src: str, before: str) -> str:
    return f"""select chrom, bin1, bin2, value * x / y as value from {src} join (select chrom, sum(value) as x from {before} group by 1) using (chrom)
      join (select chrom, sum(value) as y from {src} group by 1) using (chrom)"""


for h in "mp":
    CTE[f"sym_{h}"] = _sym(f"s{h}", f"gap_{h}")
    CTE[f"vc_{h}"] = _vc(f"sym_{h}")
    CTE[f"cor_{h}"] = _mean(f"vc_{h}", f"d{h}")
CTE["sums_m"] = "select chrom, bin1, bin2, sum(value) as value from (select chrom, bin1, bin2, value from sm union all select chrom, bin2, bin1, value from sm where bin1 <> bin2) group by all"
CTE["cgap"] = "select chrom, bin from rows_t where coverage <= 0.05"
CTE["dist"] = "select chrom, n, unnest(range(n)) as d from sizes"
CTE["decay"] = """select chrom, d, case when cells > 0 then s / cells else s end as expected from (
    select x.chrom, x.d, coalesce((select sum(value) from mx m where m.chrom = x.chrom and abs(m.bin1 - m.bin2) = x.d and not exists (select 1 from cgap g where g.chrom = m.chrom and g.bin = m.bin2)), 0) as s,
      case when d = 0 then n else 2 * (n - d) end - coalesce((select sum(case when x.d = 0 then 1 else cast(bin <= x.n - 1 - x.d as int) + cast(bin >= x.d as int) end) from cgap g where g.chrom = x.chrom), 0) as cells
    from dist x)"""
CTE["oe"] = """select m.chrom, bin1, bin2, value / case when expected = 0 then low else expected end as value from mx m
    join decay e on e.chrom = m.chrom and e.d = abs(bin1 - bin2) join (select chrom, min(expected) as low from decay where expected > 0 group by 1) l on l.chrom = m.chrom"""
CTE["tgap"] = """select g.chrom, g.bin from grid g left join (select chrom, bin2 as bin, count(*) as k from mx where bin1 >= bin2 - 5 and bin1 < bin2 + 5 group by 1, 2) k using (chrom, bin)
    where coalesce(k, 0) < 8 or g.bin < 5 or g.bin > n - 1 - 5"""
CTE["di0"] = """select g.chrom, g.bin, g.n, coalesce(sum(case when bin2 < bin1 then value end), 0) as u, coalesce(sum(case when bin2 < bin1 then value * value end), 0) as uu,
      coalesce(sum(case when bin2 > bin1 then value end), 0) as d, coalesce(sum(case when bin2 > bin1 then value * value end), 0) as dd
    from grid g left join mx m on m.chrom = g.chrom and m.bin1 = g.bin and abs(bin2 - bin1) between 1 and 15 group by 1, 2, 3"""

# Mapped pairs of both genomes, flat.
_READS = """1 + l_partkey % 5 as c1, 100 + (l_partkey*7919 + l_suppkey*104729) % 2000000 + {shift} as p1, {s1} as s1, {n1} as n1,
    case when l_suppkey % 3 = 0 then 1 + l_suppkey % 5 else 1 + l_partkey % 5 end as c2, 100 + (l_partkey*15485863 + l_suppkey*32452843) % 2000000 as p2, {s2} as s2, {n2} as n2"""
_OWN = """select name, c1, f1, p1, s1, n1, c2, f2, p2, s2, n2, cof, case cof when 'R1' then c1 when 'R2' then c2 end as cc, case cof when 'R1' then f1 when 'R2' then f2 end + off as cf,
    case cof when 'R1' then p1 when 'R2' then p2 end + 7 as cp, case cof when 'R1' then s1 when 'R2' then s2 end as cs, case when cof is not null then cn end as cn
    from (select *, p1 - p1 % 4000 + 2000 as f1, p2 - p2 % 4000 + 2000 as f2 from (select {name} as name, {reads}, case when {cand} then case when l_orderkey % 2 = 0 then 'R1' else 'R2' end end as cof, {cn} as cn, {off} as off
    from lineitem where {where}))"""
CTE["hm"] = _OWN.format(name=NAME, reads=_READS.format(shift="0", s1="-(l_partkey % 40)", n1="l_orderkey % 4", s2="-(l_suppkey % 40)", n2="l_suppkey % 3"), cand="l_linenumber % 3 = 0", cn="(l_orderkey + l_partkey) % 5", off="case when l_linenumber % 2 = 0 then 0 else 4000 end", where="l_partkey % 5 <> 0")
CTE["hp"] = _OWN.format(name=NAME, reads=_READS.format(shift="(l_orderkey % 4) * 4", s1="-(l_suppkey % 40)", n1="l_linenumber % 4", s2="-(l_partkey % 40)", n2="l_partkey % 3"), cand="l_linenumber % 3 = 0 or l_orderkey % 5 = 0", cn="(l_orderkey + l_suppkey) % 4", off="0", where="l_suppkey % 7 <> 0")


def mark(m: list[str], p: list[str]) -> str:
    """M, P or N of (chrom, pos, score, snp) in both genomes."""
    (mc, mp, ms, mn), (pc, pp, ps, pn) = m, p
    return f"""case when {mc} = {pc} and abs({mp} - {pp}) <= 5 then case when {mn} > 2 * {pn} then 'M' when 2 * {mn} < {pn} then 'P' else 'N' end
      when {ms} - {ps} >= 18 and {mn} >= 2 * {pn} then 'M' when {ps} - {ms} >= 18 and {pn} >= 2 * {mn} then 'P' else 'N' end"""


def _side(k: str) -> str:
    own = lambda h: [f"{h}.{c}{k}" for c in "cpsn"]
    again = lambda h: [f"case when {h}use{k} then {h}.c{c} else {h}.{c}{k} end" for c in "cpsn"]
    return mark(own("m"), own("p")), mark(again("m"), again("p"))


_USE = ", ".join(f"coalesce({h}.cof = 'R{k}' and {h}.cc = {h}.c{k} and {h}.cf = {h}.f{k}, false) as {h}use{k}" for h in "mp" for k in "12")
CTE["hboth0"] = f"select m.name, {_USE}, coalesce(m.cof, p.cof) as cof, m, p from hm m join hp p on p.name = m.name"
(_a1, _b1), (_a2, _b2) = _side("1"), _side("2")
CTE["hboth1"] = f"select *, {_a1} as x1, {_b1} as y1, {_a2} as x2, {_b2} as y2 from hboth0"
CTE["hboth2"] = "select *, " + ", ".join(f"(coalesce(cof, '') = 'R{k}' and (muse{k} or puse{k}) and x{k} = 'N' and y{k} <> 'N') as ch{k}" for k in "12") + " from hboth1"
CTE["hboth3"] = "select *, case when ch1 then y1 else x1 end || case when ch2 then y2 else x2 end as marks from hboth2"


def _at(k: str, c: str) -> str:
    return f"case when ch{k} then case when y{k} = 'P' then case when puse{k} then p.c{c} else p.{c}{k} end else case when muse{k} then m.c{c} else m.{c}{k} end end when x{k} = 'P' then p.{c}{k} else m.{c}{k} end"


CTE["hap_both"] = f"""select name, cast({_at("1", "c")} as varchar) as chrom1, {_at("1", "f")} as frag1, cast({_at("2", "c")} as varchar) as chrom2, {_at("2", "f")} as frag2,
    case marks when 'NN' then 'Bi_Allelic' when 'MP' then 'M_P' when 'PM' then 'P_M' when 'NM' then 'M_M' when 'MN' then 'M_M' when 'MM' then 'M_M' else 'P_P' end as hap_class,
    case marks when 'NM' then 'R2' when 'NP' then 'R2' when 'MN' then 'R1' when 'PN' then 'R1' when 'MM' then 'Both' when 'PP' then 'Both' end as resolved from hboth3"""


def _one(src: str, other: str, g: str) -> str:
    return f"""select name, cast(case when mk0 and k1 then cc else c1 end as varchar) as chrom1, case when mk0 and k1 then cf else f1 end as frag1, cast(case when mk1 and k2 then cc else c2 end as varchar) as chrom2, case when mk1 and k2 then cf else f2 end as frag2,
      case when r = 'N' then 'Bi_Allelic' else '{g}_{g}' end as hap_class, nullif(r, 'N') as resolved from (select *, n1 = 0 as mk0, n2 = 0 as mk1,
      case when n1 <> 0 and n2 <> 0 then 'Both' when n1 <> 0 then case when k2 then 'Both' else 'R1' end when n2 <> 0 then case when k1 then 'Both' else 'R2' end when k1 then 'R1' when k2 then 'R2' else 'N' end as r
      from (select *, coalesce(cof = 'R1' and cc = c1 and cf = f1 and cn <> 0, false) as k1, coalesce(cof = 'R2' and cc = c2 and cf = f2 and cn <> 0, false) as k2 from {src} where name not in (select name from {other})))"""


CTE["hap_m"] = _one("hm", "hp", "M")
CTE["hap_p"] = _one("hp", "hm", "P")
CTE["hap"] = "select * from hap_both union all select * from hap_m union all select * from hap_p"
CTE["hap_un"] = """select substr(hap_class, 1, 1) || chrom1 as c1, frag1 as f1, substr(hap_class, 3, 1) || chrom2 as c2, frag2 as f2 from hap
    where (hap_class in ('M_M', 'P_P') and resolved = 'Both') or hap_class in ('M_P', 'P_M')"""

_PAIRS = ["fx_pairs", "fx_frags", "dedup", "placed", "classed", "valid"]
_HAP = ["hm", "hp", "hboth0", "hboth1", "hboth2", "hboth3", "hap_both", "hap_m", "hap_p", "hap"]
_CORR = ["fx_pairs", "sizes", "grid", "px", "mx", "dm", "dp", "rows_t", "rows_m", "rows_p", "gap_m", "gap_p", "alpha0", "alpha1", "alpha", "sm", "sp"]
_MX = ["fx_pairs", "sizes", "grid", "px", "mx"]
CHAINS = {
    "pairs": _PAIRS, "hap": _HAP, "hap_un": [*_HAP, "hap_un"], "corr": _CORR, "mx": _MX,
    "sym": [*_CORR, "sym_m", "sym_p"], "local": [*_CORR, "sym_m", "sym_p", "vc_m", "vc_p", "cor_m", "cor_p"],
    "decay": [*_MX, "rows_t", "cgap", "dist", "decay", "oe"], "tad": [*_MX, "tgap", "di0"],
}


def sql(chain: str | list[str], body: str) -> str:
    """body after the common table expressions of a chain."""
    names = CHAINS[chain] if isinstance(chain, str) and chain in CHAINS else [chain] if isinstance(chain, str) else chain
    flat: list[str] = []
    for n in names:
        for x in CHAINS.get(n, [n]):
            if x not in flat:
                flat.append(x)
    return "with " + ",\n".join(f"{n} as ({CTE[n]})" for n in flat) + "\n" + body
