"""Chromatin loops: expectations, local neighbourhoods, Poisson tests, selection, clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.stats import bh_adjust, poisson_tail

MAX_WINDOW, MAX_APART, SIGNIFICANCE, LEAST_READS, STOP_SHARE = 20, 2_000_000, 0.05, 16, 0.1
LOOP_RATIO, LOOP_STRENGTH, WEIGHTED_Q = 0.6, 16, 1e-4


def windows_of(res: int) -> tuple[int, int]:
    """(peak width, first window) by resolution."""
    return (1, 3) if res >= 20_000 else (2, 5) if res >= 10_000 else (4, 7)


def diagonal_means(m: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(chrom, d, mean): mean of each diagonal up to `most` of upper-triangle pixels, zeros counted."""
    s = m.where(F.col("bin2") - F.col("bin1") <= most).groupBy("chrom", (F.col("bin2") - F.col("bin1")).alias("d")).agg(F.sum("value").alias("s"))
    d = sizes.select("chrom", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most).cast("long"), F.col("n") - 1))).alias("d"))
    return d.join(s, ["chrom", "d"], "left").select("chrom", "d", (F.coalesce("s", F.lit(0.0)) / (F.col("n") - F.col("d"))).alias("mean"))


def isotonic_fit(y: np.ndarray) -> np.ndarray:
    """Least-squares monotone fit of a sequence, in the direction of its rank correlation with the index; pool adjacent violators."""
    rank = lambda v: pd.Series(v).rank().to_numpy()
    up = len(y) < 2 or np.ptp(y) == 0 or np.corrcoef(rank(np.arange(len(y))), rank(y))[0, 1] >= 0
    blocks: list[list[float]] = []
    for v in y if up else -y:
        blocks.append([v, 1.0])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    fit = np.concatenate([np.full(int(n), v) for v, n in blocks]) if blocks else np.zeros(0)
    return fit if up else -fit


def isotonic_expected(means: DataFrame) -> DataFrame:
    """(chrom, d, expected), not below 0; a chromosome's diagonals are as many as the distance limit has bins."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        return pd.DataFrame({"chrom": pdf.chrom, "d": pdf.d, "expected": np.maximum(isotonic_fit(pdf["mean"].to_numpy()), 0)})

    return means.groupBy("chrom").applyInPandas(fit, "chrom string, d long, expected double")


def _box(prefix: np.ndarray, x0, x1, y0, y1) -> np.ndarray:
    """Sums over [x0, x1) x [y0, y1), cut to the matrix."""
    n = prefix.shape[0] - 1
    x0, x1, y0, y1 = (np.clip(a, 0, n) for a in (x0, x1, y0, y1))
    x1, y1 = np.maximum(x0, x1), np.maximum(y0, y1)
    return prefix[x1, y1] - prefix[x0, y1] - prefix[x1, y0] + prefix[x0, y0]


def window_sums(value: np.ndarray, i: np.ndarray, j: np.ndarray, w: int, pw: int) -> tuple[np.ndarray, np.ndarray]:
    """(donut, lower-left) sums of a dense tile around (i, j), from prefix sums."""
    p = np.zeros((value.shape[0] + 1, value.shape[1] + 1))
    np.cumsum(np.cumsum(value, 0), 1, out=p[1:, 1:])
    box = lambda a, b, c, d: _box(p, i + a, i + b + 1, j + c, j + d + 1)
    donut = box(-w, w, -w, w) - box(-pw, pw, -pw, pw)
    cross = box(0, 0, -w, w) + box(-w, w, 0, 0) - box(0, 0, -pw, pw) - box(-pw, pw, 0, 0)
    lower = box(1, w, -w, -1) - box(1, pw, -pw, -1)
    return donut - cross, lower


#: Side of the tiles that peaks' windows are summed in.
TILE = 512


def donut_sums(peaks: DataFrame, m: DataFrame, raw: DataFrame, expected: DataFrame, sizes: DataFrame, w: int, pw: int, ww: int, tile: int = TILE) -> DataFrame:
    """Per peak (chrom, bin1, bin2): sums over the donut (K) and lower-left (Y) of balanced (s) and expected (e) values at distances of ww or more, and raw reads in Y.

    m, raw are upper-triangle; the window's cells outside the matrix do not count. Peaks meet the
    pixels of their tile and a margin of w around it, and windows are differences of prefix sums:
    a pixel is in four tiles at most, whatever the window.
    """
    at = lambda x, lo, hi: F.explode(F.sequence(F.floor((F.col(x) + lo) / tile), F.floor((F.col(x) + hi) / tile)))
    kind = lambda d, k: d.select("chrom", "ti", "tj", F.lit(k).alias("kind"), "bin1", "bin2", F.col("value").cast("double").alias("value"))
    p = peaks.select("chrom", "bin1", "bin2").distinct().join(sizes, "chrom")
    p = p.select("chrom", F.floor(F.col("bin1") / tile).alias("ti"), F.floor(F.col("bin2") / tile).alias("tj"), "bin1", "bin2", F.col("n").alias("value"))
    mine = p.select("chrom", "ti", "tj").distinct()
    near = lambda d: d.withColumn("ti", at("bin1", -w, w)).withColumn("tj", at("bin2", -w, w)).join(mine, ["chrom", "ti", "tj"], "left_semi")
    v = near(m.where(F.col("bin2") - F.col("bin1") >= ww).select("chrom", "bin1", "bin2", "value"))
    r = near(raw.where("bin1 <> bin2").select("chrom", "bin1", "bin2", "value"))
    # Distances that occur in a tile and its margin.
    span = F.sequence(F.greatest(F.lit(ww).cast("long"), (F.col("tj") - F.col("ti") - 1) * tile - 2 * w), (F.col("tj") - F.col("ti") + 1) * tile + 2 * w)
    d = mine.where((F.col("tj") - F.col("ti") + 1) * tile + 2 * w >= ww).withColumn("d", F.explode(span)).join(expected.select("chrom", "d", "expected"), ["chrom", "d"])
    e = d.select("chrom", "ti", "tj", F.col("d").alias("bin1"), F.col("d").alias("bin2"), F.col("expected").alias("value"))
    every = kind(v, 0).unionByName(kind(r, 1)).unionByName(kind(e, 2)).unionByName(kind(p, 3))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0, side = int(key[1]) * tile - w, int(key[2]) * tile - w, tile + 2 * w
        k, b1, b2, value = pdf.kind.to_numpy(), pdf.bin1.to_numpy(), pdf.bin2.to_numpy(), pdf.value.to_numpy()
        n = int(value[k == 3][0])
        a = np.zeros((3, side, side))
        for which in (0, 1):
            a[which, b1[k == which] - x0, b2[k == which] - y0] = value[k == which]
        x, y = np.arange(side) + x0, np.arange(side) + y0
        far = y[None] - x[:, None]
        by = np.zeros(1 + max(0, int(far.max()), *b1[k == 2].tolist()))
        by[b1[k == 2]] = value[k == 2]
        inside = ((x >= 0) & (x < n))[:, None] & ((y >= 0) & (y < n))[None]
        a[2] = np.where(inside & (far >= ww), by[np.clip(far, 0, len(by) - 1)], 0.0)
        i, j = b1[k == 3] - x0, b2[k == 3] - y0
        (ks, ys), (_, yr), (ke, ye) = (window_sums(t, i, j, w, pw) for t in a)
        return pd.DataFrame({"chrom": key[0], "bin1": b1[k == 3], "bin2": b2[k == 3], "k_s": ks, "k_e": ke, "y_s": ys, "y_e": ye, "y_reads": yr})

    return every.groupBy("chrom", "ti", "tj").applyInPandas(run, "chrom string, bin1 long, bin2 long, k_s double, k_e double, y_s double, y_e double, y_reads double")


_LOCAL = "chrom string, bin1 long, bin2 long, value double, window int, k_ratio double, y_ratio double"


def local_ratios(m: DataFrame, raw: DataFrame, expected: DataFrame, sizes: DataFrame, res: int, max_apart: int = MAX_APART, tile: int = 1000) -> DataFrame:
    """Per contact at distance ww..max_apart: the smallest window with enough lower-left reads, and balanced over expected sums (donut, lower-left).

    A chromosome's band is cut into tiles along the diagonal with the largest window as margin,
    one task each. How many contacts a window settles is counted over the whole chromosome, so
    a second pass applies the rule that windows stop once under a tenth of the rest qualifies.
    """
    pw, ww = windows_of(res)
    far = max_apart // res
    margin = MAX_WINDOW

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, n = int(key[1]), int(pdf.n.iloc[0])
        lo = max(0, t * tile - margin)
        hi = min(n, (t + 1) * tile + far + 2 * margin)
        size = hi - lo
        s, r, e = np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size))
        x, y = pdf.bin1.to_numpy() - lo, pdf.bin2.to_numpy() - lo
        kind = pdf.kind.to_numpy()
        for which, out in ((0, s), (1, r)):
            k = (kind == which) & (x >= 0) & (y >= 0) & (x < size) & (y < size)
            out[x[k], y[k]] = pdf.value.to_numpy()[k]
        np.fill_diagonal(r, 0)
        ex = pdf[kind == 2]
        by_d = np.zeros(n + 1)
        by_d[ex.bin1.to_numpy()] = ex.value.to_numpy()
        d = np.arange(size)[None] - np.arange(size)[:, None]
        e = np.where((d >= ww) & (d <= n), by_d[np.clip(d, 0, n)], 0.0)
        s0 = np.where(d >= ww, s, 0.0)
        i, j = np.nonzero((s != 0) & (d >= ww) & (d <= far))
        mine = (i + lo >= t * tile) & (i + lo < (t + 1) * tile)
        i, j = i[mine], j[mine]
        out = np.full((len(i), 3), np.nan)
        open_ = np.ones(len(i), bool)
        for w in range(ww, MAX_WINDOW + 1):
            if not open_.any():
                break
            a, b = i[open_], j[open_]
            reads = window_sums(r, a, b, w, pw)[1]
            ks, ys = window_sums(s0, a, b, w, pw)
            ke, ye = window_sums(e, a, b, w, pw)
            ok = reads >= LEAST_READS
            at = np.flatnonzero(open_)[ok]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at] = np.stack([np.full(ok.sum(), w), (ks / ke)[ok], (ys / ye)[ok]], 1)
            open_[at] = False
        return pd.DataFrame({"chrom": key[0], "bin1": i + lo, "bin2": j + lo, "value": s[i, j], "window": np.nan_to_num(out[:, 0], nan=0).astype("int32"), "k_ratio": out[:, 1], "y_ratio": out[:, 2]})

    def tiles(d: DataFrame, kind: int) -> DataFrame:
        d = d.select("chrom", "bin1", "bin2", "value", F.lit(kind).alias("kind")).join(sizes, "chrom")
        first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("bin1") - far - 2 * margin) / tile)).cast("long")
        return d.withColumn("t", F.explode(F.sequence(first, F.floor((F.col("bin1") + margin) / tile).cast("long"))))

    band = lambda d: d.where(F.col("bin2") - F.col("bin1") <= far + 2 * margin)
    cells = tiles(band(m), 0).unionByName(tiles(band(raw), 1))
    every = sizes.select("chrom", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / tile).cast("long"))).alias("t"))
    exp = every.join(expected, "chrom").select("chrom", F.col("d").alias("bin1"), F.lit(0).cast("long").alias("bin2"), F.col("expected").alias("value"), F.lit(2).alias("kind"), "n", "t")
    found = cells.unionByName(exp).groupBy("chrom", "t").applyInPandas(run, _LOCAL)
    per = found.groupBy("chrom", "window").agg(F.count(F.lit(1)).alias("k"))
    last = _last_window(per)
    return found.join(last, "chrom").where((F.col("window") > 0) & (F.col("window") <= F.col("last"))).drop("last")


def _last_window(per: DataFrame) -> DataFrame:
    """(chrom, last): the first window that settles under a tenth of what is left, or the largest."""
    w = Window.partitionBy("chrom").orderBy("w")
    total = per.groupBy("chrom").agg(F.sum("k").alias("total"))
    ws = total.withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(MAX_WINDOW))))
    k = ws.join(per.withColumnRenamed("window", "w"), ["chrom", "w"], "left").na.fill(0, ["k"])
    left = F.col("total") - F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    began = F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0
    k = k.withColumns({"left": left, "began": began})
    stop = F.min(F.when(F.coalesce(F.col("began"), F.lit(False)) & (F.col("k") < STOP_SHARE * F.col("left")), F.col("w")))
    return k.groupBy("chrom").agg(F.coalesce(stop, F.lit(MAX_WINDOW)).alias("last"))


def lambda_chunk(lam):
    """Chunk of an expectation: 1 for (0, 1), c for (2^((c-2)/3), 2^((c-1)/3)); null on the edges, which are never tested."""
    c = F.floor(3 * F.log2(lam)) + 2
    edge = (lam <= 0) | (F.abs(3 * F.log2(lam) - F.round(3 * F.log2(lam))) < 1e-12)
    return F.when(lam.isNull() | F.isnan(lam) | edge & (lam >= 1) | (lam <= 0), None).when(lam < 1, 1).otherwise(c).cast("int")


def poisson_peaks(d: DataFrame, lam: str, name: str) -> DataFrame:
    """d(chrom, .., obs, <lam>) with <name>_fold, _p and _q: the chance of more than obs at the chunk's upper edge, BH within chromosome and chunk."""
    d = d.withColumn("__c", lambda_chunk(F.col(lam)))
    edge = F.when(F.col("__c").isNotNull(), F.pow(F.lit(2.0), (F.col("__c") - 1) / 3))
    d = d.withColumn(name + "_p", F.when(edge.isNotNull(), poisson_tail(F.col("obs"), F.coalesce(edge, F.lit(1.0)))).otherwise(1.0))
    d = bh_adjust(d, name + "_p", name + "_q", ["chrom", "__c"])
    return d.withColumn(name + "_q", F.when(F.col("__c").isNull(), 1.0).otherwise(F.col(name + "_q"))).withColumn(name + "_fold", F.col("obs") / F.col(lam)).drop("__c")


def call_loops(m: DataFrame, raw: DataFrame, sizes: DataFrame, bias: DataFrame, res: int, max_apart: int = MAX_APART, significance: float = SIGNIFICANCE) -> DataFrame:
    """Peaks significant against both neighbourhoods: chrom, bin1, bin2, obs, d_fold, d_p, d_q, ll_fold, ll_p, ll_q.

    m is balanced, raw are counts, both upper-triangle; bias(chrom, bin, bias) turns a balanced
    expectation into counts (1 for haplotype matrices).
    """
    pw, ww = windows_of(res)
    far = max_apart // res
    e = isotonic_expected(diagonal_means(m, sizes, far + 2 * MAX_WINDOW))
    c = local_ratios(m, raw, e, sizes, res, max_apart).withColumn("d", F.col("bin2") - F.col("bin1")).join(e, ["chrom", "d"])
    for k in "12":
        c = c.join(bias.select("chrom", F.col("bin").alias("bin" + k), F.col("bias").alias("b" + k)), ["chrom", "bin" + k])
    scale = F.col("expected") * F.col("b1") * F.col("b2")
    c = c.join(raw.select("chrom", "bin1", "bin2", F.col("value").alias("obs")), ["chrom", "bin1", "bin2"])
    c = c.select("chrom", "bin1", "bin2", "obs", (scale * F.col("k_ratio")).alias("k"), (scale * F.col("y_ratio")).alias("y"))
    c = poisson_peaks(poisson_peaks(c, "k", "d"), "y", "ll")
    keep = c.where((F.col("d_q") <= significance) & (F.col("ll_q") <= significance))
    empty = empty_rows(raw, sizes)
    keep = away_from_gaps(keep, empty)
    return keep.select("chrom", "bin1", "bin2", "obs", "d_fold", "d_p", "d_q", "ll_fold", "ll_p", "ll_q")


def empty_rows(m: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, bin) without any contact, of upper-triangle pixels."""
    from .balance import grid

    some = m.where("value <> 0").select("chrom", F.explode(F.array("bin1", "bin2")).alias("bin")).distinct()
    return grid(sizes).join(some, ["chrom", "bin"], "left_anti")


def away_from_gaps(peaks: DataFrame, gaps: DataFrame, reach: int = 5) -> DataFrame:
    """Peaks with no gap bin in [anchor - reach, anchor + reach) of either anchor."""
    near = gaps.select("chrom", F.explode(F.sequence(F.col("bin") - reach + 1, F.col("bin") + reach)).alias("bin")).distinct()
    for k in "12":
        peaks = peaks.join(near.withColumnRenamed("bin", "bin" + k), ["chrom", "bin" + k], "left_anti")
    return peaks


def without_blanks(contacts: DataFrame, m: DataFrame, gaps: DataFrame) -> DataFrame:
    """Contacts whose bins are not both gaps and none of whose four neighbours in the full matrix m is zero."""
    g = lambda k: gaps.select("chrom", F.col("bin").alias("bin" + k)).distinct().withColumn("gap" + k, F.lit(True))
    c = contacts.join(g("1"), ["chrom", "bin1"], "left").join(g("2"), ["chrom", "bin2"], "left").where("gap1 is null or gap2 is null").drop("gap1", "gap2")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    around = c.select("chrom", "bin1", "bin2", step).select("chrom", F.col("bin1").alias("x"), F.col("bin2").alias("y"), (F.col("bin1") + F.col("s.i")).alias("bin1"), (F.col("bin2") + F.col("s.j")).alias("bin2"))
    full = around.join(m.where("value <> 0").select("chrom", "bin1", "bin2"), ["chrom", "bin1", "bin2"], "left_semi").groupBy("chrom", F.col("x").alias("bin1"), F.col("y").alias("bin2")).agg(F.count(F.lit(1)).alias("k"))
    return c.join(full.where("k = 4").drop("k"), ["chrom", "bin1", "bin2"], "left_semi")


def select_loops(loops: DataFrame, m: DataFrame, sizes: DataFrame, ratio: float = LOOP_RATIO, strength: float = LOOP_STRENGTH) -> DataFrame:
    """loops(chrom, bin1, bin2, ..) whose value exceeds `ratio` of its diagonal's cells, zeros counted, and is at least `strength`.

    Ranks come from counts of smaller cells of the same diagonal, joined on value buckets only
    for diagonals that hold loops.
    """
    d = m.select("chrom", "bin1", "bin2", "value", (F.col("bin2") - F.col("bin1")).alias("d"))
    own = loops.join(d, ["chrom", "bin1", "bin2"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("d", F.col("bin2") - F.col("bin1"))
    own = own.where(F.col("value") >= strength)
    per = d.where("value > 0").groupBy("chrom", "d", "value").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("chrom", "d").orderBy("value")
    below = per.withColumns({"below": F.sum("k").over(w) - F.col("k"), "some": F.sum("k").over(Window.partitionBy("chrom", "d"))}).select("chrom", "d", "value", "below", "some")
    j = own.join(below, ["chrom", "d", "value"]).join(sizes, "chrom")
    cells = F.col("n") - F.col("d")
    rank = (F.col("below") + cells - F.col("some")) / cells
    return j.where(rank >= ratio).select(*loops.columns, "value", rank.alias("rank_ratio"))


def cluster_points(points: np.ndarray, q: np.ndarray, size: np.ndarray, reach: float) -> list[tuple[int, float]]:
    """Greedy clusters of (S, E) points by S, E: each grows around its moving centre. Returns (best member, total size)."""
    left = sorted(range(len(points)), key=lambda k: (points[k][0], points[k][1]))
    out = []
    while left:
        members, centre, rest = [left[0]], points[left[0]].astype(float), []
        for k in left[1:]:
            if math.dist(centre, points[k]) <= reach:
                members.append(k)
                centre = points[members].mean(0)
            else:
                rest.append(k)
        left = rest
        best = min(members, key=lambda k: (q[k], points[k][0], points[k][1]))
        out.append((best, float(size[members].sum())))
    return out


def independent_groups(points: DataFrame, reach: float) -> DataFrame:
    """points(chrom, start, end, ..) with a `group` such that no cluster of that reach can hold points of two groups.

    A cluster's centre lies among its members. Where neighbours by start, or by end, are more
    than reach apart, no centre on one side comes within reach of a point on the other; so such
    gaps cut a chromosome, then each part by its other coordinate, and both again.
    """
    d, by = points, ["chrom"]
    for k in range(4):
        at = "start" if k % 2 == 0 else "end"
        order = Window.partitionBy(*by).orderBy(at)
        d = d.withColumn("__apart", F.coalesce((F.col(at) - F.lag(at).over(order)) > reach, F.lit(False)).cast("int"))
        d = d.withColumn(f"__g{k}", F.sum("__apart").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        by = [*by, f"__g{k}"]
    return d.withColumn("group", F.struct(*by[1:])).drop("__apart", *by[1:])


def cluster_loops(loops: DataFrame, res: int) -> DataFrame:
    """loops(chrom, start, end, q) -> one row a cluster: its best member and how many loops it gathers.

    Clusters of radius res * sqrt(2) + 1000, then twice that until their number is stable. Groups
    of loops that gaps set apart are clustered on their own, with the result of one pass over all;
    a group is as large as the densest stretch, not as a chromosome.
    """
    reach = res * math.sqrt(2) + 1000

    def grouped(points: DataFrame, reach: float, until_stable: bool) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            p, q, n = pdf[["start", "end"]].to_numpy(), pdf.q.to_numpy(), pdf.n.to_numpy(float)
            while True:
                c = cluster_points(p, q, n, reach)
                k, stable = [b for b, _ in c], len(c) == len(p)
                p, q, n = p[k], q[k], np.array([x for _, x in c])
                if stable or not until_stable:
                    break
            return pd.DataFrame({"chrom": pdf.chrom.iloc[0], "start": p[:, 0], "end": p[:, 1], "q": q, "n": n.astype("int64")})

        g = independent_groups(points, reach)
        return g.groupBy("chrom", "group").applyInPandas(run, "chrom string, start long, end long, q double, n long")

    first = grouped(loops.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "q", F.lit(1).cast("long").alias("n")), reach, False)
    return grouped(first, 2 * reach, True)


def weighted_q(clusters: DataFrame, m: DataFrame, res: int, most: float = WEIGHTED_Q, allelic: bool = False) -> DataFrame:
    """clusters with value (of their pixel) and weighted_q = q / 10^n, under `most`; allelic ones also above the 15th percentile of value * -log10."""
    c = clusters.withColumns({"bin1": F.floor(F.col("start") / res), "bin2": F.floor(F.col("end") / res), "weighted_q": F.col("q") / F.pow(F.lit(10.0), F.col("n"))}).where(F.col("weighted_q") < most)
    c = c.join(m.select("chrom", "bin1", "bin2", "value"), ["chrom", "bin1", "bin2"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    out = ["chrom", "start", "end", "value", "weighted_q", "n"]
    if not allelic:
        return c.select(*out)
    c = c.withColumn("weighted_q", F.when(F.col("weighted_q") == 0, 1e-20).otherwise(F.col("weighted_q")))
    c = c.withColumn("score", -F.col("value") * F.log10("weighted_q"))
    low = c.groupBy("chrom").agg(F.percentile("score", F.lit(0.15)).alias("low"))
    return c.join(low, "chrom").where("score >= low").select(*out)
