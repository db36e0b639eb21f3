"""SQL of the structure queries whose operators iterate: other forms of the same results.

Isotonic fits by the min-max formula, tails by sums and by Simpson's rule, principal axes by power
iteration with deflation, neighbourhood sums cell by cell.
"""

from __future__ import annotations

from .inputs import CHAINS, CTE, RES, sql

N = 2_000_000 // RES + 1

CTE["dmean"] = "select x.chrom, x.d, coalesce((select sum(value) from px where px.chrom = x.chrom and bin2 - bin1 = x.d), 0) / (n - d) as mean from dist x where d <= 60"
CTE["isoc"] = """select chrom, d, y, up, sum(y) over (partition by chrom order by d) as s from (select m.chrom, d, case when up then mean else -mean end as y, up from dmean m
    join (select chrom, coalesce(case when isnan(c) then 1 else c end, 1) >= 0 as up from (select chrom, corr(d, r) as c from (select chrom, d, rank() over (partition by chrom order by mean) + (count(*) over (partition by chrom, mean) - 1) / 2 as r from dmean) group by 1)) using (chrom))"""
CTE["iso"] = """select chrom, b as d, greatest(case when any_value(up) then max(m) else -max(m) end, 0) + 0.0 as expected from (select chrom, a, b, up, min(m) over (partition by chrom, a order by b rows between current row and unbounded following) as m
    from (select x.chrom, x.d as a, y.d as b, x.up, (y.s - x.s + x.y) / (y.d - x.d + 1) as m from isoc x join isoc y on x.chrom = y.chrom and y.d >= x.d)) group by chrom, b"""
CTE["around"] = """select i - 20 as di, j - 20 as dj, greatest(abs(i - 20), abs(j - 20)) as r, i > 20 and j < 20 and not (i <= 21 and j >= 19) as low
    from range(41) a(i), range(41) b(j) where i <> 20 and j <> 20 and not (abs(i - 20) <= 1 and abs(j - 20) <= 1)"""
CTE["ring"] = f"""select p.chrom, p.bin1, p.bin2, p.value, r, sum(case when far then coalesce(m.value, 0) else 0 end) as s, sum(case when far then e.expected else 0 end) as e,
    sum(case when far and low then coalesce(m.value, 0) else 0 end) as ls, sum(case when far and low then e.expected else 0 end) as le, sum(case when low and y <> x then coalesce(m.value, 0) else 0 end) as lr
    from (select px.*, r, low, bin1 + di as x, bin2 + dj as y, bin2 + dj - bin1 - di >= 3 as far from px, around where bin2 - bin1 >= 3 and bin1 + di between 0 and {N - 1} and bin2 + dj between 0 and {N - 1}) p
    left join px m on m.chrom = p.chrom and m.bin1 = x and m.bin2 = y left join iso e on e.chrom = p.chrom and e.d = y - x group by 1, 2, 3, 4, 5"""
CTE["wide"] = "select chrom, bin1, bin2, value, w, sum(s) as s, sum(e) as e, sum(ls) as ls, sum(le) as le, sum(lr) as lr from ring join range(3, 21) t(w) on r <= w group by 1, 2, 3, 4, 5"
CTE["first_window"] = "select p.chrom, p.bin1, p.bin2, coalesce(min(w) filter (lr >= 16), 0) as w from px p left join wide using (chrom, bin1, bin2) where p.bin2 - p.bin1 >= 3 group by 1, 2, 3"
CTE["last_window"] = """select chrom, coalesce(min(w) filter (before > 0 and k < 0.1 * (total - before)), 20) as last from (select c.chrom, t.w, total, count(f.w) as k, coalesce(sum(count(f.w)) over (partition by c.chrom order by t.w rows between unbounded preceding and 1 preceding), 0) as before
    from (select chrom, count(*) as total from first_window group by 1) c cross join range(1, 21) t(w) left join first_window f on f.chrom = c.chrom and f.w = t.w group by 1, 2, 3) group by 1"""
CTE["ratios"] = "select chrom, bin1, bin2, value, w, s / nullif(e, 0) as k_ratio, ls / nullif(le, 0) as y_ratio from first_window f join wide using (chrom, bin1, bin2, w) join last_window using (chrom) where w <= last"
CHAINS["iso"] = ["fx_pairs", "sizes", "grid", "px", "mx", "dist", "dmean", "isoc", "iso"]
CHAINS["ratios"] = [*CHAINS["iso"], "around", "ring", "wide", "first_window", "last_window", "ratios"]


def _bh(src: str, p: str, q: str, by: str) -> str:
    return f"select *, least(1.0, min({p} * m / r) over (partition by {by} order by {p} range between current row and unbounded following)) as {q} from (select *, count(*) over (partition by {by}) as m, count(*) over (partition by {by} order by {p} range between unbounded preceding and current row) as r from {src})"


def poisson(src: str, lam: str, name: str) -> str:
    """src(chrom, .., obs, <lam>) with <name>_c, _p, _q and _fold."""
    chunk = f"select *, case when {lam} is null or isnan({lam}) or {lam} <= 0 then null when {lam} < 1 then 1 when abs(3 * log2({lam}) - round(3 * log2({lam}))) < 1e-12 then null else cast(floor(3 * log2({lam})) as int) + 2 end as {name}_c from {src}"
    tail = f"select *, case when {name}_c is null then 1.0::double else 1 - list_sum(list_transform(range(0, cast(obs as bigint) + 1), lambda k: exp(-pow(2.0, ({name}_c - 1) / 3) + k * ln(pow(2.0, ({name}_c - 1) / 3)) - lgamma(k + 1)))) end as {name}_p from ({chunk})"
    return f"select * exclude (m, r) replace (case when {name}_c is null then 1.0 else {name}_q end as {name}_q), obs / {lam} as {name}_fold from ({_bh(f'({tail})', f'{name}_p', f'{name}_q', f'chrom, {name}_c')})"


ISOTONIC = sql("iso", "select chrom, d, round(expected, 6) as expected from iso")
LOCAL = sql("ratios", "select chrom, bin1, bin2, value, cast(w as int) as \"window\", round(k_ratio, 6) as k_ratio, round(y_ratio, 6) as y_ratio from ratios")
CHUNK_POISSON = sql("mx", f", t as (select chrom, bin1, bin2, value as obs, (value + 0.7) * (1 + bin1 % 5) as lam from px) select chrom, bin1, bin2, obs, lam, round(d_p, 6) as d_p, round(d_q, 6) as d_q, round(d_fold, 6) as d_fold from ({poisson('t', 'lam', 'd')})")
_FOUND = [f"round({k}_{x}, 6) as {k}_{x}" for k in ("d", "ll") for x in ("fold", "p", "q")]
LOOPS = sql("ratios", f""", t as (select chrom, bin1, bin2, value as obs, expected * k_ratio as k, expected * y_ratio as y from ratios join (select chrom, d, expected from iso) i using (chrom) where i.d = bin2 - bin1),
    a as ({poisson('t', 'k', 'd')}), b as ({poisson('a', 'y', 'll')}), hit as (select chrom, bin1 as bin from px union select chrom, bin2 from px), gap as (select chrom, bin from grid where (chrom, bin) not in (select (chrom, bin) from hit))
    select chrom, bin1, bin2, obs, {', '.join(_FOUND)} from b where d_q <= 0.5 and ll_q <= 0.5
    and not exists (select 1 from gap g where g.chrom = b.chrom and (g.bin between bin1 - 5 and bin1 + 4 or g.bin between bin2 - 5 and bin2 + 4))""")


def two_sided(x: str, density: str, panels: int = 2000) -> str:
    """1 - 2 times the integral of a density of u from 0 to |x|, by Simpson's rule; beyond 40 it is 0."""
    h = f"(least(abs({x}), 40) / {panels})"
    weight = f"case when i = 0 or i = {panels} then 1 when i % 2 = 1 then 4 else 2 end"
    return f"greatest(0, 1 - 2 * {h} / 3 * list_sum(list_transform(range(0, {panels} + 1), lambda i: ({weight}) * {density.replace('$u', f'(i * {h})')})))"


NORMAL = "exp(-$u * $u / 2) / sqrt(2 * pi())"
STUDENT = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + $u * $u / df, -(df + 1) / 2)"

#: Loops with a z of the share test, as in loop_specificity_stat's SQL.
_Z = """, l as (select k.chrom, k.bin1 as m1, k.bin2 as m2, coalesce(a.value, 0) as m, coalesce(b.value, 0) as p from px k left join dm a using (chrom, bin1, bin2) left join dp b using (chrom, bin1, bin2) where k.bin2 - k.bin1 between 2 and 30 and k.value >= 2),
    n as (select floor((m + p) / 2) as mean from l where floor((m + p) / 2) > 0),
    g as (select * from l where m <> 0 and p <> 0 and (m + p) / 2 <= (select quantile_cont(mean, 0.95) from n)),
    e as (select *, (m + p) * p0 as e1, (m + p) * (1 - p0) as e2, sqrt((m + p) * p0 * (1 - p0)) as sd from (select *, (select sum(m) / sum(m + p) from g) as p0 from g)),
    t as (select *, case when least(e1, e2) >= 5 then case when e1 >= 30 and e2 >= 30 then (m - e1) / sd else (abs(m - e1) - 0.5) / sd end end as z from e)"""
LOOP_SPECIFICITY = sql(["mx", "dm", "dp"], f"""{_Z}, v as (select chrom, m1, m2, m, p, case when z is not null then {two_sided('z', NORMAL)} end as pvalue from t),
    w as (select *, q as qvalue from ({_bh('(select * from v where pvalue is not null)', 'pvalue', 'q', '1')}))
    select chrom, m1, m2, v.m, v.p, round(v.pvalue, 6) as pvalue, round(w.qvalue, 6) as qvalue from v left join w using (chrom, m1, m2)""")


def _sample(src: str) -> str:
    return f"""(select c.chrom, c.b, c.i, c.j, coalesce(v.value / (select avg(value) from {src} w where w.chrom = c.chrom and w.bin1 between c.b - 10 and c.b + 9 and w.bin2 between c.b - 10 and c.b + 9 and not (w.bin1 >= c.b and w.bin2 < c.b)), 0) as x
        from cells c left join {src} v on v.chrom = c.chrom and v.bin1 = c.i and v.bin2 = c.j)"""


BOUNDARY_SPECIFICITY = sql(["mx", "dm", "dp"], f""", cells as (select chrom, b, b - 10 + r as i, b + c as j from sizes, (values (14), (15), (25), (26), (36), (37)) t(b), range(10) x(r), range(10) y(c) where r >= c),
    a as {_sample("dm")}, e as {_sample("dp")}, u as (select chrom, b from a group by 1, 2 having avg(case when x = 0 then 1 else 0 end) < 0.85), w as (select chrom, b from e group by 1, 2 having avg(case when x = 0 then 1 else 0 end) < 0.85),
    s as (select a.chrom, a.b, a.x as xm, e.x as xp from a join e using (chrom, b, i, j) join u using (chrom, b) join w using (chrom, b) where a.x <> 0 and e.x <> 0),
    t as (select chrom, b, count(*) as n, avg(xm) as m_mean, avg(xp) as p_mean, case when count(*) > 1 and stddev_samp(xm - xp) > 1e-12 then avg(xm - xp) / (stddev_samp(xm - xp) / sqrt(count(*))) end as t, count(*) - 1 as df from s group by 1, 2),
    v as (select *, {two_sided('t', STUDENT)} as pvalue from t where t is not null and df > 0),
    o as (select v.chrom, k.m_bin, k.m_bin + 1 as p_bin, v.* exclude (chrom) from v join (values (14), (25), (36)) k(m_bin) on v.b in (k.m_bin, k.m_bin + 1)),
    best as (select * from (select *, row_number() over (partition by chrom, m_bin order by pvalue, b) as rank from o) where rank = 1)
    select chrom, m_bin, p_bin, round(pvalue, 6) as pvalue, cast(b as bigint) as b, round(m_mean, 6) as m_mean, round(p_mean, 6) as p_mean, round(t, 6) as t, n, round(q, 6) as qvalue from ({_bh('best', 'pvalue', 'q', '1').replace('as m,', 'as m_,').replace('* m /', '* m_ /')})""")

#: Steps of the power iteration for each axis.
STEPS = 1200


def _axis(k: int) -> str:
    """Axis k of C H C by power iteration, with the earlier axes taken out in every step."""
    w = "list_transform(m, lambda r: list_dot_product(r, y2))"
    for before in range(1, k):
        w = f"(select list_transform(list_zip(w, a), lambda z: z[1] - list_dot_product(w, a) * z[2]) from (select {w} as w, v{before} as a))"
    have = ", ".join(["chrom", "m", *[f"v{b}" for b in range(1, k)]])
    joined = "lists" + "".join(f" join axis{b} using (chrom)" for b in range(1, k))
    return f"""p{k}(chrom, k, v) as (select chrom, 0, list_transform(range(0, len(m)), lambda i: sin(i * 1.7 + {k}) + 0.1) from lists union all
      select chrom, k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) from (select chrom, k, {w} as w from (select {have}, k, list_transform(y, lambda x: x - list_avg(y)) as y2
        from (select {have}, k, list_transform(m, lambda r: list_dot_product(r, v)) as y from {joined} join p{k} using (chrom) where k < {STEPS})))),
    axis{k} as (select chrom, v as v{k} from p{k} where k = {STEPS})"""


COMPARTMENTS = "with recursive" + sql("decay", f""", u as (select chrom, bin from rows_t where coverage > 0.05), c as (select a.chrom, a.bin as row, b.bin as col, coalesce(value, 0) as v from u a join u b on a.chrom = b.chrom left join oe on oe.chrom = a.chrom and oe.bin1 = a.bin and oe.bin2 = b.bin),
    r as (select x.chrom, x.col as bin1, y.col as bin2, coalesce(case when var_pop(x.v) > 1e-15 and var_pop(y.v) > 1e-15 then corr(x.v, y.v) else 0 end, 0) as r from c x join c y on x.chrom = y.chrom and x.row = y.row group by 1, 2, 3),
    lists as (select chrom, list(row order by bin1) as m from (select chrom, bin1, list(r order by bin2) as row from r group by 1, 2) group by 1), bins as (select chrom, list(bin order by bin) as bins from u group by 1),
    {_axis(1)}, {_axis(2)}, {_axis(3)},
    flat as (select chrom, unnest(bins) as bin, 1 as k, unnest(v1) as v from bins join axis1 using (chrom) union all select chrom, unnest(bins), 2, unnest(v2) from bins join axis2 using (chrom) union all select chrom, unnest(bins), 3, unnest(v3) from bins join axis3 using (chrom)),
    ax as (select chrom, bin, k, v * (select sign(arg_max(f.v, abs(f.v))) from flat f where f.chrom = flat.chrom and f.k = flat.k) as v from flat),
    cell as (select r.chrom, a.k, r, sign(a.v) as s1, sign(b.v) as s2 from r join ax a on a.chrom = r.chrom and a.bin = bin1 join ax b on b.chrom = r.chrom and b.bin = bin2 and b.k = a.k),
    split as (select chrom, k, avg(r) filter (s1 = s2 and s1 <> 0 and r > -1 and r < 1 - 1e-5) - avg(r) filter (s1 > 0 and s2 < 0 and r > -1 and r < 1) as score from cell group by 1, 2),
    reach as (select chrom, k, max(bin) filter (v > 0) - min(bin) filter (v > 0) as up, max(bin) filter (v < 0) - min(bin) filter (v < 0) as down, max(bin) filter (v <> 0) - min(bin) filter (v <> 0) as whole from ax group by 1, 2),
    good as (select chrom, k, case when 2 * up > whole and 2 * down > whole and score > 0 then score else 0 end as score from split join reach using (chrom, k)),
    best as (select chrom, case when score > 0 then k else 1 end as k, score from (select *, row_number() over (partition by chrom order by coalesce(score, 0) desc, k) as n from good) where n = 1),
    pc as (select ax.chrom, bin, v, best.k, coalesce(best.score, 0) as score from ax join best on best.chrom = ax.chrom and best.k = ax.k),
    side as (select oe.chrom, avg(value) filter (a.v < 0) as b_mean, avg(value) filter (a.v > 0) as a_mean from oe join pc a on a.chrom = oe.chrom and a.bin = bin1 join pc b on b.chrom = oe.chrom and b.bin = bin2 where value <> 0 and sign(a.v) = sign(b.v) group by 1),
    each as (select chrom, bin, max(v) filter (k = 1) as pc1, max(v) filter (k = 2) as pc2, max(v) filter (k = 3) as pc3 from ax group by 1, 2)
    select chrom, bin, round(case when coalesce(b_mean, 0) > coalesce(a_mean, 0) then -v else v end, 5) as pc, cast(k as int) as component, round(score, 5) as score, round(pc1, 5) as pc1, round(pc2, 5) as pc2, round(pc3, 5) as pc3
    from pc join each using (chrom, bin) left join side using (chrom)""").removeprefix("with")

#: The three-state model's fixed values before training: start, moves, and the shift of its means; parts have the means 3 (k + shift) and the variance 3.
_START, _MOVE, _SHIFT = (0.4, 0.3, 0.3), ((0.85, 0.15, 0), (0.05, 0.80, 0.15), (0.19, 0.01, 0.80)), (1, -1, -2)
_LOG_START = "[" + ", ".join(f"ln({x})" for x in _START) + "]"
_LOG_MOVE = "[" + ", ".join("[" + ", ".join(f"ln({_MOVE[i][j]})" if _MOVE[i][j] else "'-inf'::double" for i in range(3)) + "]" for j in range(3)) + "]"
_EMIT = "[" + ", ".join("ln((" + " + ".join(f"exp(-(di - {3 * (k + shift)}) * (di - {3 * (k + shift)}) / 6)" for k in range(3)) + ") / (3 * sqrt(6 * pi())))" for shift in _SHIFT) + "]"
_FEW = """x as (select distinct chrom, bin from fx_signal where bin % 60 < 3 or bin % 97 = 5), g as (select chrom, bin, bin - row_number() over (partition by chrom order by bin) as g from x),
    i as (select chrom, min(bin) as a, max(bin) as b, count(*) as k from g group by chrom, g), kept as (select i.* from i join (select chrom, avg(k) as m from i group by 1) using (chrom) where k >= least(10, m)),
    l as (select chrom, unnest(range(a, b + 1)) as bin from kept union select chrom, unnest([0, 499]) from x), e as (select chrom, bin from x union select chrom, unnest([0, 499]) from x), n as (select chrom, bin, lead(bin) over (partition by chrom order by bin) as nxt from l),
    seg as (select chrom, bin + 1 as start, nxt as "end" from n where nxt - bin > 7 and (select count(*) from e where e.chrom = n.chrom and e.bin > n.bin and e.bin < nxt) / (nxt - bin - 1) <= (select count(*) from e where e.chrom = n.chrom) / 500 / 2)"""
#: Best paths, a bin a step, and back from each segment's end.
VITERBI = "with recursive" + sql("fx_signal", f""", {_FEW}, seen as (select chrom, bin, sum(v) as v from fx_signal group by 1, 2),
    d as (select seg.chrom, start, b.bin, 5 * sin(b.bin * 0.21) + coalesce(v, 0) % 3 as di from seg join range(500) b(bin) on b.bin >= start and b.bin < "end" left join seen on seen.chrom = seg.chrom and seen.bin = b.bin),
    em as (select chrom, start, bin, row_number() over (partition by chrom, start order by bin) as t, {_EMIT} as e from d),
    vit(chrom, start, t, v, b) as (select chrom, start, t, list_transform(list_zip({_LOG_START}, e), lambda z: z[1] + z[2]), []::bigint[][] from em where t = 1 union all
      select chrom, start, t, list_transform(list_zip(list_transform(into_, lambda c: list_max(c)), e), lambda z: z[1] + z[2]), list_append(b, list_transform(into_, lambda c: cast(list_position(c, list_max(c)) as bigint)))
      from (select em.chrom, em.start, em.t, em.e, b, list_transform({_LOG_MOVE}, lambda c: list_transform(list_zip(c, v), lambda z: z[1] + z[2])) as into_ from vit join em on em.chrom = vit.chrom and em.start = vit.start and em.t = vit.t + 1)),
    ends as (select vit.* from vit join (select chrom, start, max(t) as t from em group by 1, 2) using (chrom, start, t)),
    back(chrom, start, t, s, b) as (select chrom, start, t, cast(list_position(v, list_max(v)) as bigint), b from ends union all select chrom, start, t - 1, b[t - 1][s], b from back where t > 1)
    select chrom, start, bin, cast(s - 1 as int) as state from back join em using (chrom, start, t)""").removeprefix("with")

#: Clusters one by one: a fold over what is left grows one around its moving centre and passes on the rest; passes go on, twice as wide, until none merge.
_REACH = RES * 2**0.5 + 1000
_POINT = "struct(s double, e double, q double, n double)"
CLUSTERS = "with recursive" + sql("mx", f""", pts as (select chrom, list_sort(list({{'s': bin1 * {RES}::double, 'e': bin2 * {RES}::double, 'q': 1 / (1 + value * value * (1 + bin1 % 3))::double, 'n': 1::double}})) as todo from px where bin2 - bin1 >= 2 and value >= 3 group by 1),
    c(chrom, pass, n0, todo, made, done) as (select chrom, 1, len(todo), todo, []::{_POINT}[], false from pts union all
      select chrom, case when len(r.rest) = 0 then pass + 1 else pass end, case when len(r.rest) = 0 then len(now) else n0 end, case when len(r.rest) = 0 then list_sort(now) else r.rest end,
        case when len(r.rest) = 0 then []::{_POINT}[] else now end, len(r.rest) = 0 and pass > 1 and len(now) = n0
      from (select *, list_append(made, {{'s': r.best.s, 'e': r.best.e, 'q': r.best.q, 'n': r.total}}) as now from (select *, list_reduce(
          list_transform(todo, lambda p: {{'cs': p.s, 'ce': p.e, 'k': 1::double, 'total': p.n, 'best': {{'q': p.q, 's': p.s, 'e': p.e}}, 'rest': []::{_POINT}[]}}),
          lambda a, x: case when sqrt(pow(a.cs / a.k - x.cs, 2) + pow(a.ce / a.k - x.ce, 2)) <= case when pass > 1 then 2 else 1 end * {_REACH}
            then {{'cs': a.cs + x.cs, 'ce': a.ce + x.ce, 'k': a.k + 1, 'total': a.total + x.total, 'best': case when x.best < a.best then x.best else a.best end, 'rest': a.rest}}
            else {{'cs': a.cs, 'ce': a.ce, 'k': a.k, 'total': a.total, 'best': a.best, 'rest': list_append(a.rest, {{'s': x.cs, 'e': x.ce, 'q': x.best.q, 'n': x.total}})}} end) as r from c where not done)))
    select chrom, cast(p.s as bigint) as start, cast(p.e as bigint) as "end", round(p.q, 6) as q, cast(p.n as bigint) as n from (select chrom, unnest(todo) as p from c where done)""").removeprefix("with")

_LSE = "list_max({x}) + ln(list_sum(list_transform({x}, lambda y: exp(y - list_max({x})))))"
_LOG_FROM = "[" + ", ".join("[" + ", ".join(f"ln({_MOVE[i][j]})" if _MOVE[i][j] else "'-inf'::double" for j in range(3)) + "]" for i in range(3)) + "]"
_PARTS = "[" + ", ".join("[" + ", ".join(f"exp(-(di - {3 * (k + shift)}) * (di - {3 * (k + shift)}) / 6) / (3 * sqrt(6 * pi()))" for k in range(3)) + "]" for shift in _SHIFT) + "]"
#: One round of re-estimation: forward and backward sums, a bin a step, and the model of their expected counts.
TRAINED_ONCE = "with recursive" + sql("fx_signal", f""", {_FEW}, seen as (select chrom, bin, sum(v) as v from fx_signal group by 1, 2),
    d as (select seg.chrom, start, b.bin, 5 * sin(b.bin * 0.21) + coalesce(v, 0) % 3 as di from seg join range(500) b(bin) on b.bin >= start and b.bin < "end" left join seen on seen.chrom = seg.chrom and seen.bin = b.bin),
    em as (select chrom, start, di, row_number() over (partition by chrom, start order by bin) as t, count(*) over (partition by chrom, start) as n, {_EMIT} as e, {_PARTS} as parts from d),
    fw(chrom, start, t, f) as (select chrom, start, t, list_transform(list_zip({_LOG_START}, e), lambda z: z[1] + z[2]) from em where t = 1 union all
      select chrom, start, t, list_transform(list_zip(list_transform(into_, lambda c: {_LSE.format(x='c')}), e), lambda z: z[1] + z[2])
      from (select em.chrom, em.start, em.t, em.e, list_transform({_LOG_MOVE}, lambda c: list_transform(list_zip(c, f), lambda z: z[1] + z[2])) as into_ from fw join em on em.chrom = fw.chrom and em.start = fw.start and em.t = fw.t + 1)),
    bw(chrom, start, t, b, ahead) as (select chrom, start, t, [0.0::double, 0.0::double, 0.0::double], null::double[] from em where t = n union all
      select chrom, start, t, list_transform({_LOG_FROM}, lambda c: {_LSE.format(x='list_transform(list_zip(c, ahead), lambda z: z[1] + z[2])')}), ahead
      from (select bw.chrom, bw.start, bw.t - 1 as t, list_transform(list_zip(em.e, b), lambda z: z[1] + z[2]) as ahead from bw join em on em.chrom = bw.chrom and em.start = bw.start and em.t = bw.t where bw.t > 1)),
    tot as (select chrom, start, {_LSE.format(x='f')} as total from fw join (select distinct chrom, start, n as t from em) using (chrom, start, t)),
    al as (select em.*, f, b, ahead, total from em join fw using (chrom, start, t) join bw using (chrom, start, t) join tot using (chrom, start)),
    xi as (select i, j, sum(exp(f[i] + {_LOG_FROM}[i][j] + ahead[j] - total)) as c from al, range(1, 4) x(i), range(1, 4) y(j) where ahead is not null group by 1, 2),
    p as (select i, k, exp(f[i] + b[i] - total) * parts[i][k] / exp(e[i]) as g, di from al, range(1, 4) x(i), range(1, 4) y(k)), m as (select i, k, sum(g) as w, sum(g * di) / sum(g) as mean, sum(g * di * di) / sum(g) as sq from p group by 1, 2),
    u as (select 'move' as what, i, j as k, c / sum(c) over (partition by i) as value from xi union all select 'weight', i, k, w / sum(w) over (partition by i) from m union all select 'mean', i, k, mean from m union all select 'var', i, k, greatest(sq - mean * mean, 1e-3) from m)
    select what, cast(i as bigint) as state, cast(k as bigint) as k, round(value, 5) as value from u""").removeprefix("with")
