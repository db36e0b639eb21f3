"""Queries on correction, compartments, domains, loops and allele specificity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.stats import bh_adjust, two_proportion_z
from strandloom.operators import balance, compartments, contacts, domains, loops, specificity
from strandloom.sources import fixtures as fx
from strandloom.sources.store import stored

from . import structure_sql
from .inputs import CTE, RES, sql

N = fx.n_bins(RES)


def _m(s, d):
    return contacts.symmetric(fx.matrix_pixels(s, d))


def _t(s, d):
    return fx.matrix_pixels(s, d)


def _dm(s, d):
    return fx.directed_pixels(s, d, "snp1 > snp2")


def _dp(s, d):
    return fx.directed_pixels(s, d, "snp1 < snp2")


def _z(s):
    return fx.sizes(s)


def _round(d, *cols):
    return d.withColumns({c: F.round(c, 6) for c in cols or ["value"]})


def _factor(s, d):
    gm, gp = balance.local_gaps(_dm(s, d), _z(s)), balance.local_gaps(_dp(s, d), _z(s))
    return stored(balance.snp_factor(_m(s, d), _dm(s, d), _dp(s, d), _z(s), gm, gp), "factor")


def _decay(s, d):
    m, z = _m(s, d), _z(s)
    return compartments.distance_decay(m, z, compartments.compartment_gaps(m, z))


def _oe(s, d):
    return compartments.observed_over_expected(_m(s, d), _decay(s, d))


def _tgaps(s, d):
    return domains.tad_gaps(_m(s, d), _z(s), RES)


def _di(s, d, test):
    return _round(domains.directionality(_m(s, d), _z(s), _tgaps(s, d), RES, 600_000, test), "di")


def _islands_in(s, d):
    return fx.signal(s, d).where("bin % 7 <> 3 and bin % 11 < 8").select("chrom", "bin").distinct()


def _states(s, d, n=3):
    """Supplied state paths: a state per bin from the signal's kinds."""
    b = fx.signal(s, d).groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("k"), F.min("kind").alias("kind"))
    return b.select("chrom", F.floor(F.col("bin") / 50).alias("start"), "bin", ((F.col("k") + F.char_length("kind")) % n).cast("int").alias("state"))


_STATES = "st as (select chrom, bin // 50 as start, bin, (count(*) + length(min(kind))) % 3 as state from fx_signal group by 1, 2, 3)"


def _marks(s, d):
    """Supplied boundaries with marks."""
    return fx.signal(s, d).where("bin % 9 = 0").select("chrom", "bin").distinct().withColumn("mark", F.expr("case bin % 4 when 0 then 'start' when 1 then 'end' else 'both' end"))


def _mark_gaps(s, d):
    return fx.signal(s, d).where("bin % 13 < 4").select("chrom", "bin").distinct()


def _fake_di(s, d):
    return s.range(0, 500).selectExpr("explode(array('1','2','3','4','5')) as chrom", "id as bin", "cast(if((id * 7919 + 13) % 17 in (0, 3), 0, (id * 31) % 7 - 3) as double) as di")


def _signal_di(s, d):
    """Supplied directionality: waves along a chromosome, moved by the events of each bin.

    Values are summed as decimals: a sum of doubles depends on the order of its tasks, and what
    is left of it after division by 3 jumps where the sum is a multiple of 3.
    """
    seen = fx.signal(s, d).groupBy("chrom", "bin").agg(F.sum(F.col("v").cast("decimal(28,10)")).cast("double").alias("v"))
    b = s.range(0, 500).selectExpr("explode(array('1','2','3','4','5')) as chrom", "id as bin").join(seen, ["chrom", "bin"], "left")
    return b.select("chrom", "bin", (5 * F.sin(F.col("bin") * 0.21) + F.coalesce(F.col("v"), F.lit(0.0)) % 3).alias("di"))


def _regions(s, d):
    """The first 96 bins of every hundred that holds a supplied boundary, however far the signal reaches."""
    return _marks(s, d).select("chrom", (F.floor(F.col("bin") / 100) * 100).alias("start")).distinct().withColumn("end", F.col("start") + 95)


def _loops_in(s, d):
    """Supplied loops: frequent pixels some way off the diagonal."""
    return _t(s, d).where("bin2 - bin1 between 2 and 30 and value >= 2").select("chrom", "bin1", "bin2")


def _q_loops(s, d):
    return _t(s, d).where("bin2 - bin1 >= 2 and value >= 3").selectExpr("chrom", f"bin1 * {RES} as start", f"bin2 * {RES} as end", "cast(1 / (1 + value * value * (1 + bin1 % 3)) as double) as q")


def _pc(s, d, what):
    """Compartment signals of two parents: mean score differences of the pairs that begin, or end, in each bin."""
    k = "1" if what == "m" else "2"
    p = fx.pairs(s, d).select(F.col("chrom" + k).alias("chrom"), contacts.bin_of(F.col("pos" + k), RES).alias("bin"), (F.col("as1") - F.col("as2")).alias("x"))
    return p.groupBy("chrom", "bin").agg(F.avg("x").alias("pc"))


_PC = f"""pcm as (select chrom1 as chrom, pos1 // {RES} as bin, avg(as1 - as2) as m from fx_pairs group by 1, 2), pcp as (select chrom2 as chrom, pos2 // {RES} as bin, avg(as1 - as2) as p from fx_pairs group by 1, 2)"""


def _planted(s, d, res=10_000, n=201, block=20):
    """The given contacts at 10 kb on a ground of near cells that are fuller inside blocks of 200 kb."""
    ground = s.range(1, 6).select(F.col("id").cast("string").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bin1"))
    ground = ground.withColumn("bin2", F.explode(F.sequence(F.col("bin1"), F.least(F.col("bin1") + 30, F.lit(n - 1)))))
    m = ground.join(fx.matrix_pixels(s, d, res).withColumnRenamed("value", "seen"), ["chrom", "bin1", "bin2"], "left")
    same = F.floor(F.col("bin1") / block) == F.floor(F.col("bin2") / block)
    value = F.coalesce("seen", F.lit(0.0)) + 1 + F.when(same, 8.0 + (F.col("bin1") * 7 + F.col("bin2") * 3) % 5).otherwise(0.0)
    return contacts.symmetric(m.select("chrom", "bin1", "bin2", value.alias("value"))), s.range(1, 6).select(F.col("id").cast("string").alias("chrom"), F.lit(n).cast("long").alias("n"))


def _components(s, d):
    pc = compartments.call_compartments(_m(s, d), _z(s))
    return pc.withColumns({c: F.round(c, 5) for c in ("pc", "score", "pc1", "pc2", "pc3")})


def _ice_sql(rounds: int) -> str:
    m = "select chrom, bin1, bin2, value from mx where abs(bin1 - bin2) >= 1"
    out = [f"im as ({m})", "b0 as (select chrom, bin1 as bin, 1.0::double as b from im group by 1, 2)"]
    for k in range(rounds + 1):
        out.append(f"s{k} as (select x.chrom, x.bin, x.b, sum(value / (x.b * y.b)) as s from im join b{k} x on x.chrom = im.chrom and x.bin = bin1 join b{k} y on y.chrom = im.chrom and y.bin = bin2 group by 1, 2, 3)")
        if k < rounds:
            out.append(f"b{k + 1} as (select chrom, bin, b * s / avg(s) over (partition by chrom) as b from s{k})")
    return sql("mx", ", " + ",\n".join(out) + f" select chrom, bin, round(b * sqrt(avg(s) over (partition by chrom)), 6) as bias from s{rounds}")


def _bh_sql(src: str, p: str = "p", by: str = "chrom") -> str:
    return f"select *, least(1.0, min({p} * n / r) over (partition by {by} order by {p} range between current row and unbounded following)) as q from (select *, count(*) over (partition by {by}) as n, count(*) over (partition by {by} order by {p} range between unbounded preceding and current row) as r from {src})"


def register(add) -> None:
    add("gap_bins", lambda s, d: balance.local_gaps(_dm(s, d), _z(s)), sql("corr", "select chrom, bin from gap_m"))
    add("gap_bins_paternal", lambda s, d: balance.local_gaps(_dp(s, d), _z(s)), sql("corr", "select chrom, bin from gap_p"))
    add("gap_bins_low_resolution", lambda s, d: balance.low_resolution_gaps(_dm(s, d), _z(s), 0.12), sql("corr", "select chrom, bin from rows_m where coverage < 0.12"))
    add("snp_density_factor", lambda s, d: _round(_factor(s, d), "alpha"), sql("corr", "select chrom, bin, round(alpha, 6) as alpha from alpha"))
    add("symmetrise_local", lambda s, d: _round(balance.symmetrise_mean(balance.scale_rows(_dm(s, d), _factor(s, d)), balance.local_gaps(_dm(s, d), _z(s)))), sql("sym", "select chrom, bin1, bin2, round(value, 6) as value from sym_m"))
    add("symmetrise_global", lambda s, d: _round(balance.symmetrise_sum(balance.scale_rows(_dm(s, d), _factor(s, d)))), sql(["corr", "sums_m"], "select chrom, bin1, bin2, round(value, 6) as value from sums_m"))
    add("vc_correct", lambda s, d: _round(balance.vc_correct(_m(s, d))), sql("mx", "select m.chrom, m.bin1, m.bin2, round(value / (pow(a.s, 2.0/3) * pow(b.s, 2.0/3)), 6) as value from mx m join (select chrom, bin1 as bin, sum(value) as s from mx group by 1, 2) a on a.chrom = m.chrom and a.bin = m.bin1 join (select chrom, bin1 as bin, sum(value) as s from mx group by 1, 2) b on b.chrom = m.chrom and b.bin = m.bin2"))
    add("two_step_local", lambda s, d: _round(balance.two_step_local(_m(s, d), _dm(s, d), _dp(s, d), _z(s))[0]), sql("local", "select chrom, bin1, bin2, round(value, 6) as value from cor_m"))
    add("two_step_local_paternal", lambda s, d: _round(balance.two_step_local(_m(s, d), _dm(s, d), _dp(s, d), _z(s))[1]), sql("local", "select chrom, bin1, bin2, round(value, 6) as value from cor_p"))

    def two_step_global(s, d):
        at = lambda x: x.select(F.lit("all").alias("chrom"), *[(F.col(b) + (F.col("chrom").cast("long") - 1) * N).alias(b) for b in ("bin1", "bin2")], "value")
        f = _factor(s, d).select(F.lit("all").alias("chrom"), (F.col("bin") + (F.col("chrom").cast("long") - 1) * N).alias("bin"), "alpha")
        return _round(balance.two_step_global(at(_dm(s, d)), f)).drop("chrom")

    add(
        "two_step_global", two_step_global,
        sql(["corr", "sums_m"], f""", v as (select m.chrom, m.bin1, m.bin2, value / (pow(a.s, 2.0/3) * pow(b.s, 2.0/3)) as value from sums_m m
        join (select chrom, bin1 as bin, sum(value) as s from sums_m group by 1, 2) a on a.chrom = m.chrom and a.bin = m.bin1 join (select chrom, bin1 as bin, sum(value) as s from sums_m group by 1, 2) b on b.chrom = m.chrom and b.bin = m.bin2)
        select bin1 + (cast(chrom as bigint) - 1) * {N} as bin1, bin2 + (cast(chrom as bigint) - 1) * {N} as bin2, round(value * (select sum(value) from dm) / (select sum(value) from v), 6) as value from v"""),
    )
    add("ice_balance_3", lambda s, d: _round(balance.ice_weights(_m(s, d), 3, 0.0), "bias"), _ice_sql(3))
    # Compartments.
    add("distance_decay", lambda s, d: _round(_decay(s, d), "expected"), sql("decay", "select chrom, d, round(expected, 6) as expected from decay"))
    add("oe_matrix", lambda s, d: _round(_oe(s, d)), sql("decay", "select chrom, bin1, bin2, round(value, 6) as value from oe"))
    e = lambda k: f"coalesce((select expected from decay e where e.chrom = b.chrom and e.d = abs(abs(b.bin1 - b.bin2) + {k})), 0)"
    add(
        "sliding_oe", lambda s, d: _round(compartments.sliding_oe(_m(s, d), _decay(s, d), _z(s), 160_000, RES)),
        sql("decay", f""", o as (select i - 2 as x, j - 2 as y from range(5) a(i), range(5) b(j)),
        b as (select m.chrom, bin1 + x as bin1, bin2 + y as bin2, sum(value) as v from mx m, o where bin1 + x between 2 and {N - 3} and bin2 + y between 2 and {N - 3} group by 1, 2, 3)
        select chrom, bin1, bin2, round(v / mix, 6) as value from (select *, 3 * {e(0)} + 2 * {e(-1)} + 2 * {e(1)} + {e(-2)} + {e(2)} as mix from b) where mix > 0
        union all select chrom, bin1, bin2, round(value, 6) from oe where not (bin1 between 2 and {N - 3} and bin2 between 2 and {N - 3})"""),
    )
    add(
        "oe_correlation", lambda s, d: _round(compartments.oe_correlation(_oe(s, d), balance.row_sums(_m(s, d), _z(s)).where("coverage > 0.05").select("chrom", "bin")), "r"),
        sql("decay", """, u as (select chrom, bin from rows_t where coverage > 0.05), c as (select a.chrom, a.bin as row, b.bin as col, coalesce(value, 0) as v from u a join u b on a.chrom = b.chrom left join oe on oe.chrom = a.chrom and oe.bin1 = a.bin and oe.bin2 = b.bin)
        select x.chrom, x.col as bin1, y.col as bin2, round(coalesce(case when var_pop(x.v) > 1e-15 and var_pop(y.v) > 1e-15 then corr(x.v, y.v) else 0 end, 0), 6) as r from c x join c y on x.chrom = y.chrom and x.row = y.row group by 1, 2, 3"""),
    )
    add("compartments_pc", _components, structure_sql.COMPARTMENTS)
    add(
        "select_allelic_pc",
        lambda s, d: _round(compartments.choose_by_reference(_pc(s, d, "m").selectExpr("chrom", "bin", "pc", "cast(bin % 7 as double) as pc2").select("chrom", "bin", F.expr("stack(2, 1, pc, 2, pc2) as (component, value)")), _pc(s, d, "p")), "r"),
        sql("fx_pairs", f""", {_PC}, c as (select chrom, 1 as component, corr(m, p) as r from pcm join pcp using (chrom, bin) group by 1 union all select chrom, 2, corr(bin % 7, p) from pcm join pcp using (chrom, bin) group by 1)
        select chrom, component, round(r, 6) as r from (select *, row_number() over (partition by chrom order by abs(r) desc, component) as k from c) where k = 1"""),
    )
    add(
        "zero_crossings", lambda s, d: compartments.zero_crossings(_pc(s, d, "m")),
        sql("fx_pairs", f""", {_PC}, n as (select chrom, row_number() over w - 1 as i, m, lead(m) over w as nxt from pcm window w as (partition by chrom order by bin))
        select chrom, cast(i as double) as at, m as value from n where nxt is not null union all select chrom, i + 0.5::double, 0.0::double from n where m * nxt < 0"""),
    )
    # Domains.
    add("tad_gap_bins", _tgaps, sql("tad", "select chrom, bin from tgap"))
    isl = "x as (select distinct chrom, bin from fx_signal where bin % 7 <> 3 and bin % 11 < 8), g as (select chrom, bin, bin - row_number() over (partition by chrom order by bin) as g from x)"
    add("gap_islands", lambda s, d: domains.islands(_islands_in(s, d)), sql("fx_signal", f""", {isl} select chrom, min(bin) as start, max(bin) + 1 as "end", count(*) as length from g group by chrom, g"""))
    add(
        "long_gaps", lambda s, d: domains.long_gaps(_islands_in(s, d), s.range(1, 6).selectExpr("cast(id as string) as chrom", "cast(500 as bigint) as n")),
        sql("fx_signal", f""", {isl}, i as (select chrom, min(bin) as a, max(bin) as b, count(*) as k from g group by chrom, g), k as (select i.* from i join (select chrom, avg(k) as m from i group by 1) using (chrom) where k >= least(10, m))
        select chrom, unnest(range(a, b + 1)) as bin from k union select chrom, unnest([0, 499]) from x"""),
    )
    di = lambda body: sql("tad", f"select chrom, bin, round(case when exists (select 1 from tgap g where g.chrom = x.chrom and g.bin = x.bin) or bin < 15 or bin > n - 16 then 0 else {body} end, 6) as di from di0 x")
    root = "sqrt(greatest(uu - u * u / 15, 0) / 210 + greatest(dd - d * d / 15, 0) / 210)"
    add("directionality_ttest", lambda s, d: _di(s, d, "ttest"), di(f"case when {root} > 1e-12 then (d - u) / 15 / {root} else 0 end"))
    add("directionality_chitest", lambda s, d: _di(s, d, "chitest"), di("case when u + d > 0 then sign(d - u) * (pow(u - (u + d) / 2, 2) + pow(d - (u + d) / 2, 2)) / ((u + d) / 2) else 0 end"))
    big = lambda s: s.range(1, 6).selectExpr("cast(id as string) as chrom", "cast(500 as bigint) as n")
    few = lambda s, d: fx.signal(s, d).where("bin % 60 < 3 or bin % 97 = 5").select("chrom", "bin").distinct()
    add(
        "di_segments", lambda s, d: domains.segments(few(s, d), big(s)),
        sql("fx_signal", """, x as (select distinct chrom, bin from fx_signal where bin % 60 < 3 or bin % 97 = 5), g as (select chrom, bin, bin - row_number() over (partition by chrom order by bin) as g from x),
        i as (select chrom, min(bin) as a, max(bin) as b, count(*) as k from g group by chrom, g), kept as (select i.* from i join (select chrom, avg(k) as m from i group by 1) using (chrom) where k >= least(10, m)),
        l as (select chrom, unnest(range(a, b + 1)) as bin from kept union select chrom, unnest([0, 499]) from x), e as (select chrom, bin from x union select chrom, unnest([0, 499]) from x),
        n as (select chrom, bin, lead(bin) over (partition by chrom order by bin) as nxt from l)
        select chrom, bin + 1 as start, nxt as "end" from n where nxt - bin > 7 and (select count(*) from e where e.chrom = n.chrom and e.bin > n.bin and e.bin < nxt) / (nxt - bin - 1) <= (select count(*) from e where e.chrom = n.chrom) / 500 / 2"""),
    )

    def hmm(s, d):
        di_ = _signal_di(s, d)
        segs = domains.segments(few(s, d), big(s))
        return domains.decode_states(di_, segs, domains.train_hmm(di_, segs, 3, 2))

    add("hmm_states", hmm)

    def trained(s, d):
        """The model after one round of re-estimation, cell by cell."""
        model = domains.train_hmm(_signal_di(s, d), domains.segments(few(s, d), big(s)), 3, 1)
        cells = [(what, i + 1, k + 1, float(a[i, k])) for what, a in (("move", model.move), ("weight", model.weight), ("mean", model.mean), ("var", model.var)) for i in range(3) for k in range(3)]
        return s.createDataFrame(cells, "what string, state long, k long, value double").withColumn("value", F.round("value", 5))

    add("hmm_trained_once", trained, structure_sql.TRAINED_ONCE)
    add("viterbi_states", lambda s, d: domains.decode_states(_signal_di(s, d), domains.segments(few(s, d), big(s)), domains.MixtureHMM.prior(3)), structure_sql.VITERBI)
    add(
        "boundary_patterns", lambda s, d: domains.boundaries_of(_states(s, d)).select("chrom", "bin"),
        sql("fx_signal", f""", {_STATES}, w as (select *, concat(state, coalesce(cast(lead(state) over x as varchar), ''), coalesce(cast(lead(state, 2) over x as varchar), ''), coalesce(cast(lead(state, 3) over x as varchar), '')) as p from st window x as (partition by chrom, start order by bin))
        select chrom, bin + 2 as bin from w where p like '220%' union select chrom, bin + 1 from w where p like '200%' union select chrom, bin + 3 from w where p = '2221' union select chrom, bin + 1 from w where p = '1000'"""),
    )
    add(
        "boundary_patterns_5", lambda s, d: domains.boundaries_of(_states(s, d, 5), 5).select("chrom", "bin"),
        sql("fx_signal", f""", {_STATES.replace('% 3 as state', '% 5 as state')}, w as (select *, lead(state) over (partition by chrom, start order by bin) as nxt from st) select chrom, bin + 1 as bin from w where state = 4 and nxt = 0"""),
    )
    marks = "b as (select distinct chrom, bin, case bin % 4 when 0 then 'start' when 1 then 'end' else 'both' end as mark from fx_signal where bin % 9 = 0), g as (select distinct chrom, bin from fx_signal where bin % 13 < 4)"
    add(
        "boundary_filter", lambda s, d: domains.filter_boundaries(_marks(s, d), _mark_gaps(s, d)),
        sql("fx_signal", f""", {marks}, c as (select b.chrom, b.bin, mark, count(*) filter (g.bin <= b.bin) >= 3 as l, count(*) filter (g.bin >= b.bin) >= 3 as r from b left join g on g.chrom = b.chrom and g.bin between b.bin - 7 and b.bin + 7 group by 1, 2, 3),
        m as (select chrom, bin, case when l and r then null when l then case when mark <> 'end' then 'start' end when r then case when mark <> 'start' then 'end' end else mark end as mark from c) select * from m where mark is not null"""),
    )
    add(
        "domains", lambda s, d: domains.domains(_marks(s, d), _regions(s, d), _fake_di(s, d), RES),
        sql("fx_signal", f""", {marks}, di as (select cast(c as varchar) as chrom, i as bin, case when (i * 7919 + 13) % 17 in (0, 3) then 0 else (i * 31) % 7 - 3 end as di from range(1, 6) a(c), range(500) b(i)),
        p as (select chrom, bin, mark, lead(bin) over w as e, lead(mark) over w as m2 from b where bin % 100 <= 95 window w as (partition by chrom, bin // 100 order by bin)),
        q as (select chrom, bin as s, e from p where e is not null and mark in ('start', 'both') and m2 in ('end', 'both') and (e - bin) * {RES} between 200000 and 4000000),
        z as (select q.*, di.bin, di.di = 0 as zero from q join di on di.chrom = q.chrom and di.bin >= s and di.bin < e), zz as (select *, sum(case when zero then 0 else 1 end) over (partition by chrom, s, e order by bin) as g from z),
        r as (select chrom, s, e, g, count(*) as k, min(bin) as at_ from zz where zero group by 1, 2, 3, 4), f as (select chrom, s, e, min(at_) as at_, min_by(k, at_) as k from r where k >= 3 group by 1, 2, 3)
        select q.chrom, q.s as start, q.e as "end" from q left join f using (chrom, s, e) where coalesce(f.k, 0) < 4
        and (select count(*) from r where r.chrom = q.chrom and r.s = q.s and r.e = q.e and r.k = 2 and (f.at_ is null or r.at_ < f.at_)) < 3 and (select count(*) from z where z.chrom = q.chrom and z.s = q.s and z.e = q.e and zero) * 3 <= q.e - q.s"""),
    )
    add("domains_called", lambda s, d: domains.call_domains(*_planted(s, d), 10_000, window=150_000, min_tad=100_000))
    # Loops.
    add("diagonal_expected", lambda s, d: _round(loops.diagonal_means(_t(s, d), _z(s), 40), "mean"), sql("mx", f"select z.chrom, d, round(coalesce((select sum(value) from px where px.chrom = z.chrom and bin2 - bin1 = d), 0) / ({N} - d), 6) as mean from sizes z, range(41) r(d)"))
    iso = lambda s, d: loops.isotonic_expected(loops.diagonal_means(_t(s, d), _z(s), 60))
    add("isotonic_expected", lambda s, d: _round(iso(s, d), "expected"), structure_sql.ISOTONIC)
    mean = lambda s, d: loops.diagonal_means(_t(s, d), _z(s), 60).withColumnRenamed("mean", "expected")
    add(
        "donut_ll_sums", lambda s, d: _round(loops.donut_sums(_loops_in(s, d), _t(s, d), _t(s, d), mean(s, d), _z(s), 4, 1, 3), "k_s", "k_e", "y_s", "y_e", "y_reads"),
        sql("mx", f""", pk as (select chrom, bin1, bin2 from px where bin2 - bin1 between 2 and 30 and value >= 2), o as (select i - 4 as di, j - 4 as dj from range(9) a(i), range(9) b(j) where i <> 4 and j <> 4 and not (abs(i - 4) <= 1 and abs(j - 4) <= 1)),
        ex as (select z.chrom, d, coalesce((select sum(value) from px where px.chrom = z.chrom and bin2 - bin1 = d), 0) / ({N} - d) as expected from sizes z, range({N}) r(d)),
        c as (select pk.*, bin1 + di as x, bin2 + dj as y, (di >= 1 and dj <= -1 and not (di <= 1 and dj >= -1)) as low from pk, o where bin1 + di between 0 and {N - 1} and bin2 + dj between 0 and {N - 1}),
        v as (select c.*, case when y - x >= 3 then coalesce(m.value, 0) else 0 end as s, case when x <> y then coalesce(m.value, 0) else 0 end as r, case when y - x >= 3 then coalesce(expected, 0) else 0 end as e from c left join px m on m.chrom = c.chrom and m.bin1 = x and m.bin2 = y left join ex on ex.chrom = c.chrom and ex.d = y - x)
        select chrom, bin1, bin2, round(sum(s), 6) as k_s, round(sum(e), 6) as k_e, round(sum(case when low then s else 0 end), 6) as y_s, round(sum(case when low then e else 0 end), 6) as y_e, round(sum(case when low then r else 0 end), 6) as y_reads from v group by 1, 2, 3"""),
    )
    add("local_expected", lambda s, d: _round(loops.local_ratios(_t(s, d), _t(s, d), iso(s, d), _z(s), RES), "k_ratio", "y_ratio"), structure_sql.LOCAL)
    lam = lambda s, d: _t(s, d).withColumn("lam", (F.col("value") + 0.7) * (1 + F.col("bin1") % 5))
    add(
        "lambda_chunks", lambda s, d: lam(s, d).select("chrom", "bin1", "bin2", loops.lambda_chunk(F.col("lam")).alias("chunk")),
        sql("mx", "select chrom, bin1, bin2, cast(case when l < 1 then 1 else floor(3 * log2(l)) + 2 end as int) as chunk from (select *, (value + 0.7) * (1 + bin1 % 5) as l from px)"),
    )
    add("lambda_chunk_poisson", lambda s, d: _round(loops.poisson_peaks(lam(s, d).select("chrom", "bin1", "bin2", F.col("value").alias("obs"), "lam"), "lam", "d"), "d_p", "d_q", "d_fold"), structure_sql.CHUNK_POISSON)
    add(
        "peak_gap_filter", lambda s, d: loops.away_from_gaps(_loops_in(s, d), _z(s).selectExpr("chrom", "cast(17 + cast(chrom as int) as bigint) as bin")),
        sql("mx", "select chrom, bin1, bin2 from px where bin2 - bin1 between 2 and 30 and value >= 2 and not (17 + cast(chrom as int) between bin1 - 5 and bin1 + 4) and not (17 + cast(chrom as int) between bin2 - 5 and bin2 + 4)"),
    )
    add(
        "blank_filter", lambda s, d: loops.without_blanks(_loops_in(s, d), _m(s, d), _z(s).select("chrom", F.explode(F.array(*[F.lit(x).cast("long") for x in range(10, 30)])).alias("bin"))),
        sql("mx", """select chrom, bin1, bin2 from px p where bin2 - bin1 between 2 and 30 and value >= 2 and not (bin1 between 10 and 29 and bin2 between 10 and 29)
        and (select count(*) from mx m where m.chrom = p.chrom and (abs(m.bin1 - p.bin1) + abs(m.bin2 - p.bin2)) = 1) = 4"""),
    )
    add(
        "loops_called", lambda s, d: _round(loops.call_loops(_t(s, d), _t(s, d), _z(s), balance.grid(_z(s)).withColumn("bias", F.lit(1.0)), RES, significance=0.5), *[f"{k}_{x}" for k in ("d", "ll") for x in ("fold", "p", "q")]),
        structure_sql.LOOPS,
    )
    add(
        "loop_select", lambda s, d: _round(loops.select_loops(_loops_in(s, d), _t(s, d), _z(s), 0.6, 2), "rank_ratio"),
        sql("mx", f"""select chrom, bin1, bin2, value, round(r, 6) as rank_ratio from (select chrom, bin1, bin2, value, (select count(*) from grid g where g.chrom = p.chrom and g.bin < {N} - (p.bin2 - p.bin1) and coalesce((select value from px q where q.chrom = p.chrom and q.bin1 = g.bin and q.bin2 = g.bin + p.bin2 - p.bin1), 0) < p.value) / ({N} - (bin2 - bin1)) as r
        from px p where bin2 - bin1 between 2 and 30 and value >= 2) where r >= 0.6"""),
    )
    add("loop_cluster", lambda s, d: _round(loops.cluster_loops(_q_loops(s, d), RES), "q"), structure_sql.CLUSTERS)
    wq = lambda s, d: _q_loops(s, d).withColumn("n", (F.col("start") / RES % 4 + 1).cast("long"))
    add(
        "loop_weighted_q", lambda s, d: _round(loops.weighted_q(wq(s, d), _t(s, d), RES, 1e-3, True), "weighted_q"),
        sql("mx", f""", c as (select chrom, bin1 * {RES} as start, bin2 * {RES} as "end", value, 1 / (1 + value * value * (1 + bin1 % 3)) / pow(10.0, bin1 % 4 + 1) as w, bin1 % 4 + 1 as n from px where bin2 - bin1 >= 2 and value >= 3),
        s as (select *, -value * log10(w) as score from c where w < 1e-3) select chrom, start, "end", value, round(w, 6) as weighted_q, n from s join (select chrom, quantile_cont(score, 0.15) as low from s group by 1) using (chrom) where score >= low"""),
    )
    p = lambda s, d: _t(s, d).select("chrom", "bin1", "bin2", (1 / (1 + F.col("value") * (1 + (F.col("bin1") * 7 + F.col("bin2") * 3) % 50))).alias("p"))
    add("bh_adjust", lambda s, d: _round(bh_adjust(p(s, d), "p", "q", ["chrom"]), "p", "q"), sql("mx", f", t as (select chrom, bin1, bin2, 1 / (1 + value * (1 + (bin1 * 7 + bin2 * 3) % 50)) as p from px) select chrom, bin1, bin2, round(p, 6) as p, round(q, 6) as q from ({_bh_sql('t')})"))
    # Specificity.
    pairs = lambda s, d: _loops_in(s, d).selectExpr("chrom", "bin1 as m1", "bin2 as m2", "bin1 as p1", "bin2 as p2")
    add("loop_specificity_stat", lambda s, d: _round(specificity.loop_specificity(pairs(s, d), _dm(s, d), _dp(s, d)).select("chrom", "m1", "m2", "m", "p", "z", "rank_ratio", "log2fc"), "z", "rank_ratio", "log2fc"), sql(["mx", "dm", "dp"], """, l as (select k.chrom, k.bin1 as m1, k.bin2 as m2, coalesce(a.value, 0) as m, coalesce(b.value, 0) as p from px k left join dm a using (chrom, bin1, bin2) left join dp b using (chrom, bin1, bin2) where k.bin2 - k.bin1 between 2 and 30 and k.value >= 2),
        f as (select *, floor((m + p) / 2) as mean from l), n as (select mean from f where mean > 0),
        g as (select *, (select count(*) from n where n.mean < f.mean) / (select count(*) from n) as below from f where m <> 0 and p <> 0 and (m + p) / 2 <= (select quantile_cont(mean, 0.95) from n)),
        e as (select *, (m + p) * p0 as e1, (m + p) * (1 - p0) as e2, sqrt((m + p) * p0 * (1 - p0)) as sd from (select *, (select sum(m) / sum(m + p) from g) as p0 from g)),
        t as (select *, case when least(e1, e2) >= 5 then case when e1 >= 30 and e2 >= 30 then (m - e1) / sd else (abs(m - e1) - 0.5) / sd end end as z from e)
        select chrom, m1, m2, m, p, round(z, 6) as z, round(case when z is not null then below end, 6) as rank_ratio, round(case when z is not null then log2(m / p) end, 6) as log2fc from t"""))
    add("loop_specificity", lambda s, d: specificity.loop_specificity_tested(pairs(s, d), _dm(s, d), _dp(s, d)).select("chrom", "m1", "m2", "m", "p", F.round("pvalue", 6).alias("pvalue"), F.round("qvalue", 6).alias("qvalue")), structure_sql.LOOP_SPECIFICITY)
    bounds = lambda s: _z(s).select("chrom", F.explode(F.array(*[F.lit(x).cast("long") for x in (14, 25, 36)])).alias("bin"))
    samp = lambda src: f"""(select c.chrom, c.b, c.i, c.j, coalesce(v.value / (select avg(value) from {src} w where w.chrom = c.chrom and w.bin1 between c.b - 10 and c.b + 9 and w.bin2 between c.b - 10 and c.b + 9 and not (w.bin1 >= c.b and w.bin2 < c.b)), 0) as x from cells c left join {src} v on v.chrom = c.chrom and v.bin1 = c.i and v.bin2 = c.j)"""
    sm = lambda s, d: contacts.symmetric(_t(s, d))
    add(
        "boundary_specificity_stat", lambda s, d: _round(specificity.paired_t(specificity.boundary_samples(bounds(s), sm(s, d)), specificity.boundary_samples(bounds(s), sm(s, d).where("(bin1 + bin2) % 3 <> 0"))), "m_mean", "p_mean", "t"),
        sql("mx", f""", my as (select * from mx where (bin1 + bin2) % 3 <> 0), cells as (select chrom, b, b - 10 + r as i, b + c as j from sizes, (values (14), (25), (36)) t(b), range(10) x(r), range(10) y(c) where r >= c),
        a as {samp("mx")}, e as {samp("my")}, u as (select chrom, b from a group by 1, 2 having avg(case when x = 0 then 1 else 0 end) < 0.85), w as (select chrom, b from e group by 1, 2 having avg(case when x = 0 then 1 else 0 end) < 0.85),
        s as (select a.chrom, a.b, a.x as xm, e.x as xp from a join e using (chrom, b, i, j) join u using (chrom, b) join w using (chrom, b) where a.x <> 0 and e.x <> 0)
        select chrom, b, count(*) as n, round(avg(xm), 6) as m_mean, round(avg(xp), 6) as p_mean, round(case when count(*) > 1 and stddev_samp(xm - xp) > 1e-12 then avg(xm - xp) / (stddev_samp(xm - xp) / sqrt(count(*))) end, 6) as t from s group by 1, 2"""),
    )
    cand = lambda s: bounds(s).selectExpr("chrom", "bin as m_bin", "bin + 1 as p_bin")
    add("boundary_specificity", lambda s, d: _round(specificity.boundary_specificity(cand(s), _dm(s, d), _dp(s, d)), "pvalue", "m_mean", "p_mean", "t", "qvalue"), structure_sql.BOUNDARY_SPECIFICITY)
    add(
        "compartment_specificity", lambda s, d: _round(specificity.compartment_specificity(_pc(s, d, "m"), _pc(s, d, "p")), "m", "p", "diff", "pvalue", "qvalue"),
        sql("fx_pairs", f""", {_PC}, j as (select * from pcm join pcp using (chrom, bin)), f as (select j.chrom, bin, case when r < 0 then -m else m end as m, p from j join (select chrom, corr(m, p) as r from j group by 1) using (chrom)),
        c as (select *, m - p as diff from f where m * p < 0), k as (select a.chrom, a.bin, count(*) filter (x.m - y.p < a.diff) as r, count(*) as n from c a, c x, c y group by 1, 2),
        v as (select *, least(r, n - r) / n as pv from c join k using (chrom, bin)), w as (select *, pv * (select count(*) from v) / (select count(*) from v u where u.pv <= v.pv) as bh from v)
        select chrom, bin, round(m, 6) as m, round(p, 6) as p, round(diff, 6) as diff, round(pv, 6) as pvalue, round((select least(1, min(u.bh)) from w u where u.pv >= w.pv), 6) as qvalue from w"""),
    )
    share = lambda s, d: fx.pairs(s, d).groupBy(F.col("chrom1").alias("chrom")).agg(*[F.count_if(F.col("snp" + k) == 0).alias("x" + k) for k in "12"], F.count(F.lit(1)).alias("n"))
    add(
        "share_difference", lambda s, d: share(s, d).select("chrom", F.round(two_proportion_z(F.col("x1"), F.col("n"), F.col("x2"), F.col("n")), 6).alias("z")),
        sql("fx_pairs", """, c as (select chrom1 as chrom, count(*) filter (snp1 = 0) as x1, count(*) filter (snp2 = 0) as x2, count(*) as n from fx_pairs group by 1), p as (select *, (x1 + x2) / (2 * n) as p from c)
        select chrom, round((x1 / n - x2 / n) / sqrt(p * (1 - p) * (1 / n + 1 / n)), 6) as z from p"""),
    )
    add("position_units", lambda s, d: fx.pairs(s, d).selectExpr("pos1 - pos1 % 500 as bp").distinct().select("bp", domains.position_text(F.col("bp")).alias("text")), f"with {'fx_pairs'} as ({CTE['fx_pairs']}), p as (select distinct pos1 - pos1 % 500 as bp from fx_pairs) select bp, case when bp // 1000000 > 0 and bp % 1000000 // 1000 > 0 then concat(bp // 1000000, 'M', bp % 1000000 // 1000, 'K') when bp // 1000000 > 0 then concat(bp // 1000000, 'M') else concat(bp // 1000, 'K') end as text from p")
    add(
        "heatmap_window", lambda s, d: _m(s, d).where("chrom = '2' and bin1 between 5 and 25 and bin2 between 5 and 25").crossJoin(_m(s, d).where("chrom = '2' and bin1 between 5 and 25 and bin2 between 5 and 25").agg(F.percentile("value", F.lit(0.95)).alias("vmax"))),
        sql("mx", "select chrom, bin1, bin2, value, (select quantile_cont(value, 0.95) from mx where chrom = '2' and bin1 between 5 and 25 and bin2 between 5 and 25) as vmax from mx where chrom = '2' and bin1 between 5 and 25 and bin2 between 5 and 25"),
    )
