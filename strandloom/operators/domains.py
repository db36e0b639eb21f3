"""Topological domains: gaps, directionality, hidden states, boundaries, domains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.store import Scope, stored

from .balance import grid
from .rangejoin import bucket_of, buckets_of

MIN_TAD, MAX_TAD, WINDOW, WIDTH = 200_000, 4_000_000, 600_000, 7
#: Bins of a bucket of the join of boundaries with regions.
BUCKET = 512
#: State patterns that mark a boundary, and the index of its bin: fixed values of the three- and five-state models.
PATTERNS = {3: (("220", 2), ("200", 1), ("2221", 3), ("1000", 1)), 5: (("40", 1),)}


def tad_gaps(m: DataFrame, sizes: DataFrame, res: int, min_tad: int = MIN_TAD) -> DataFrame:
    """(chrom, bin): bins whose column has under 1.6 L non-zero cells in rows [bin - L, bin + L), and the L bins at either end; L = min_tad // res."""
    side = min_tad // res
    near = m.where((F.col("value") != 0) & (F.col("bin1") >= F.col("bin2") - side) & (F.col("bin1") < F.col("bin2") + side))
    n = near.groupBy("chrom", F.col("bin2").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    d = grid(sizes).join(sizes, "chrom").join(n, ["chrom", "bin"], "left")
    return d.where((F.coalesce("k", F.lit(0)) < 1.6 * side) | (F.col("bin") < side) | (F.col("bin") > F.col("n") - 1 - side)).select("chrom", "bin")


def islands(bins: DataFrame) -> DataFrame:
    """(chrom, start, end, length) runs of consecutive bins, end exclusive."""
    by = Window.partitionBy("chrom").orderBy("bin")
    d = bins.distinct().withColumn("g", F.col("bin") - F.row_number().over(by))
    return d.groupBy("chrom", "g").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("end"), F.count(F.lit(1)).alias("length")).drop("g")


def long_gaps(gaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chrom, bin) of the gap runs of at least min(10, the mean length) bins, and both ends of a chromosome."""
    i = islands(gaps)
    mean = i.groupBy("chrom").agg(F.avg("length").alias("mean"))
    kept = i.join(mean, "chrom").where(F.col("length") >= F.least(F.lit(10.0), F.col("mean")))
    bins = kept.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("bin"))
    ends = sizes.select("chrom", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))
    return bins.union(ends).distinct()


def directionality(m: DataFrame, sizes: DataFrame, gaps: DataFrame, res: int, window: int = WINDOW, test: str = "ttest") -> DataFrame:
    """(chrom, bin, di): downstream against upstream contacts within the window, zeros counted; 0 for gaps and the ends."""
    w = window // res
    d = F.col("bin2") - F.col("bin1")
    near = m.where(d.between(-w, w) & (d != 0))
    part = lambda up, f: F.sum(F.when((d < 0) if up else (d > 0), f).otherwise(0.0))
    v = F.col("value")
    s = near.groupBy("chrom", F.col("bin1").alias("bin")).agg(part(True, v).alias("u"), part(True, v * v).alias("uu"), part(False, v).alias("d"), part(False, v * v).alias("dd"))
    all_bins = grid(sizes).join(sizes, "chrom").join(s, ["chrom", "bin"], "left").na.fill(0.0, ["u", "uu", "d", "dd"])
    all_bins = all_bins.join(gaps.distinct().withColumn("gap", F.lit(True)), ["chrom", "bin"], "left")
    c = F.col
    if test == "ttest":
        spread = lambda s1, s2: F.greatest(s2 - s1 * s1 / w, F.lit(0.0)) / (w * (w - 1))
        root = F.sqrt(spread(c("u"), c("uu")) + spread(c("d"), c("dd")))
        di = F.when(root > 1e-12, (c("d") - c("u")) / w / root).otherwise(0.0)
    elif test == "chitest":
        e = (c("u") + c("d")) / 2
        di = F.when(e > 0, F.signum(c("d") - c("u")) * ((c("u") - e) ** 2 + (c("d") - e) ** 2) / e).otherwise(0.0)
    else:
        raise ValueError(f"test is ttest or chitest, not {test!r}")
    inside = c("gap").isNull() & c("bin").between(w, c("n") - w - 1)
    return all_bins.select("chrom", "bin", F.when(inside, di).otherwise(0.0).alias("di"))


def segments(gaps: DataFrame, sizes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chrom, start, end): stretches between long gaps, end exclusive, wider than `width` and with a gap share of at most half the chromosome's."""
    ends = sizes.select("chrom", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))
    every = gaps.select("chrom", "bin").union(ends).distinct()
    most = every.groupBy("chrom").agg(F.count(F.lit(1)).alias("g")).join(sizes, "chrom").select("chrom", (F.col("g") / F.col("n") / 2).alias("most"))
    by = Window.partitionBy("chrom").orderBy("bin")
    s = long_gaps(gaps, sizes).withColumn("next", F.lead("bin").over(by)).where(F.col("next") - F.col("bin") > width)
    inner = s.select("chrom", "bin", "next", F.explode(F.sequence(F.col("bin") + 1, F.col("next") - 1)).alias("at"))
    n = inner.join(every.select("chrom", F.col("bin").alias("at")), ["chrom", "at"], "left_semi").groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("k"))
    s = s.join(n, ["chrom", "bin"], "left").join(most, "chrom")
    share = F.coalesce("k", F.lit(0)) / (F.col("next") - F.col("bin") - 1)
    return s.where(share <= F.col("most")).select("chrom", (F.col("bin") + 1).alias("start"), F.col("next").alias("end"))


class MixtureHMM:
    """A hidden Markov model with Gaussian-mixture emissions, in log space. Zero transitions stay zero."""

    def __init__(self, start: np.ndarray, move: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.start, self.move, self.weight, self.mean, self.var = start, move, weight, mean, var

    @classmethod
    def prior(cls, states: int) -> "MixtureHMM":
        # Fixed values of the initial models.
        if states == 3:
            move = [[0.85, 0.15, 0], [0.05, 0.80, 0.15], [0.19, 0.01, 0.80]]
            start, shift = [0.4, 0.3, 0.3], (1, -1, -2)
        elif states == 5:
            move = [[0, 1, 0, 0, 0], [0, 0.5, 0.5, 0, 0], [0.33, 0, 0.34, 0.33, 0], [0, 0, 0, 0.5, 0.5], [0.5, 0, 0.5, 0, 0]]
            start, shift = [0.05, 0.3, 0.3, 0.3, 0.05], (1, 0, -1, -2, -3)
        else:
            raise ValueError("the model has 3 or 5 states")
        mean = np.array([[3.0 * (i + s) for i in range(3)] for s in shift])
        return cls(np.array(start), np.array(move, float), np.full((states, 3), 1 / 3), mean, np.full((states, 3), 3.0))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(T, states, 3) log of weight times density."""
        with np.errstate(divide="ignore"):
            return np.log(self.weight) - 0.5 * (np.log(2 * np.pi * self.var) + (x[:, None, None] - self.mean) ** 2 / self.var)

    @staticmethod
    def _lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    def expect(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Expected counts of one sequence: moves, and weight, sum and square of each mixture part."""
        parts = self.parts(x)
        emit = self._lse(parts, 2)
        with np.errstate(divide="ignore"):
            move, start = np.log(self.move), np.log(self.start)
        n = len(x)
        f, b = np.empty_like(emit), np.zeros_like(emit)
        f[0] = start + emit[0]
        for t in range(1, n):
            f[t] = self._lse(f[t - 1][:, None] + move, 0) + emit[t]
        for t in range(n - 2, -1, -1):
            b[t] = self._lse(move + emit[t + 1] + b[t + 1], 1)
        total = self._lse(f[-1], 0)
        gamma = np.exp(f + b - total)
        xi = np.exp(f[:-1, :, None] + move + (emit + b)[1:, None, :] - total).sum(0) if n > 1 else np.zeros_like(self.move)
        with np.errstate(invalid="ignore"):
            part = gamma[:, :, None] * np.exp(np.where(np.isfinite(emit)[:, :, None], parts - emit[:, :, None], -np.inf))
        return {"xi": xi, "w": part.sum(0), "s": (part * x[:, None, None]).sum(0), "ss": (part * x[:, None, None] ** 2).sum(0)}

    def update(self, c: dict[str, np.ndarray]) -> "MixtureHMM":
        """The model of summed counts; the start distribution is kept."""
        out = c["xi"].sum(1, keepdims=True)
        move = np.where(out > 0, c["xi"] / np.where(out > 0, out, 1), self.move)
        w = c["w"]
        some = w > 1e-9
        safe = np.where(some, w, 1)
        mean = np.where(some, c["s"] / safe, self.mean)
        var = np.where(some, np.maximum(c["ss"] / safe - mean**2, 1e-3), self.var)
        total = w.sum(1, keepdims=True)
        weight = np.where(total > 1e-9, w / np.where(total > 1e-9, total, 1), self.weight)
        return MixtureHMM(self.start, move, weight, mean, var)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        emit = self._lse(self.parts(x), 2)
        with np.errstate(divide="ignore"):
            move, v = np.log(self.move), np.log(self.start) + emit[0]
        back = np.zeros((len(x), len(v)), int)
        for t in range(1, len(x)):
            s = v[:, None] + move
            back[t] = s.argmax(0)
            v = s.max(0) + emit[t]
        path = [int(v.argmax())]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return np.array(path[::-1])


def _sequences(di: DataFrame, segs: DataFrame) -> DataFrame:
    s = segs.select("chrom", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("bin"))
    return s.join(di, ["chrom", "bin"]).select("chrom", "start", "bin", "di")


def train_hmm(di: DataFrame, segs: DataFrame, states: int = 3, rounds: int = 3) -> MixtureHMM:
    """Baum-Welch over all segments: counts per segment where it lies, summed by Spark; the driver sees one model."""
    model = MixtureHMM.prior(states)
    seq = _sequences(di, segs)
    shapes = {"xi": (states, states), "w": (states, 3), "s": (states, 3), "ss": (states, 3)}
    for _ in range(rounds):
        now = model

        def count(pdf: pd.DataFrame, now=now) -> pd.DataFrame:
            c = now.expect(pdf.sort_values("bin").di.to_numpy())
            return pd.DataFrame([(k, i, float(v)) for k, a in c.items() for i, v in enumerate(a.ravel())], columns=["k", "i", "v"])

        sums = seq.groupBy("chrom", "start").applyInPandas(lambda pdf: count(pdf), "k string, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
        if not sums:
            return model
        c = {k: np.zeros(shape) for k, shape in shapes.items()}
        for r in sums:
            c[r["k"]].ravel()[r["i"]] = r["v"]
        model = model.update(c)
    return model


def decode_states(di: DataFrame, segs: DataFrame, model: MixtureHMM) -> DataFrame:
    """(chrom, start, bin, state) of the bins of segments."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pd.DataFrame({"chrom": pdf.chrom, "start": pdf.start, "bin": pdf.bin, "state": model.viterbi(pdf.di.to_numpy())})

    return _sequences(di, segs).groupBy("chrom", "start").applyInPandas(run, "chrom string, start long, bin long, state int")


def boundaries_of(states: DataFrame, n_states: int = 3) -> DataFrame:
    """(chrom, bin, mark) where a pattern of states stands in consecutive bins of (chrom, start, bin, state); every mark is both an end and a start."""
    by = Window.partitionBy("chrom", "start").orderBy("bin")
    ahead = F.concat_ws("", *[F.coalesce(F.lead("state", k).over(by).cast("string"), F.lit("")) for k in range(4)])
    d = states.withColumn("ahead", ahead)
    at = F.array(*[F.when(F.col("ahead").startswith(p), F.col("bin") + i) for p, i in PATTERNS[n_states]])
    return d.select("chrom", F.explode(F.array_compact(at)).alias("bin")).distinct().withColumn("mark", F.lit("both"))


def filter_boundaries(boundaries: DataFrame, gaps: DataFrame, width: int = WIDTH, most: int = 3) -> DataFrame:
    """boundaries(chrom, bin, mark) with the side next to at least `most` gaps within `width` bins taken off the mark; those left without one go."""
    g = gaps.select("chrom", F.col("bin").alias("gap")).distinct()
    near = boundaries.select("chrom", "bin", F.explode(F.sequence(F.col("bin") - width, F.col("bin") + width)).alias("gap")).join(g, ["chrom", "gap"], "left_semi")
    n = near.groupBy("chrom", "bin").agg(F.count_if(F.col("gap") <= F.col("bin")).alias("gl"), F.count_if(F.col("gap") >= F.col("bin")).alias("gr"))
    d = boundaries.join(n, ["chrom", "bin"], "left").na.fill(0, ["gl", "gr"])
    left, right = F.col("gl") >= most, F.col("gr") >= most
    mark = F.when(left & right, None).when(left, F.when(F.col("mark") != "end", "start")).when(right, F.when(F.col("mark") != "start", "end")).otherwise(F.col("mark"))
    return d.select("chrom", "bin", mark.alias("mark")).where("mark is not null")


def domains(boundaries: DataFrame, regions: DataFrame, di: DataFrame, res: int, min_tad: int = MIN_TAD, max_tad: int = MAX_TAD) -> DataFrame:
    """(chrom, start, end) bins of domains between consecutive boundaries of one region(chrom, start, end, both inclusive).

    A stretch is rejected by a run of four zero DI values met before any of exactly three, by
    three double zeros before the first such run, by over a third of zeros, or by its size.
    """
    r = regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    # Regions are cut into buckets: a boundary meets those of its own bucket only.
    r = r.withColumn("__bucket", F.explode(buckets_of(F.col("r_start"), F.col("r_end"), BUCKET)))
    near = boundaries.withColumn("__bucket", bucket_of(F.col("bin"), BUCKET)).join(r, ["chrom", "__bucket"])
    b = near.where(F.col("bin").between(F.col("r_start"), F.col("r_end"))).groupBy("chrom", "bin", "mark").agg(F.min("r_start").alias("region"))
    by = Window.partitionBy("chrom", "region").orderBy("bin")
    d = b.withColumns({"end": F.lead("bin").over(by), "next": F.lead("mark").over(by)}).where("end is not null and mark in ('start', 'both') and next in ('end', 'both')")
    d = d.select("chrom", F.col("bin").alias("start"), "end").where(((F.col("end") - F.col("start")) * res).between(min_tad, max_tad))
    inner = d.select("chrom", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("bin")).join(di, ["chrom", "bin"])
    run = Window.partitionBy("chrom", "start", "end").orderBy("bin")
    z = inner.withColumn("zero", (F.col("di") == 0).cast("int"))
    z = z.withColumn("g", F.sum(1 - F.col("zero")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = z.where("zero = 1").groupBy("chrom", "start", "end", "g").agg(F.count(F.lit(1)).alias("k"), F.min("bin").alias("at"))
    first = runs.where("k >= 3").groupBy("chrom", "start", "end").agg(F.min(F.struct("at", "k")).alias("f")).select("chrom", "start", "end", "f.at", "f.k")
    twos = runs.where("k = 2").select("chrom", "start", "end", F.col("at").alias("two"))
    key = ["chrom", "start", "end"]
    n2 = twos.join(first.select(*key, "at"), key, "left").where("at is null or two < at").groupBy(*key).agg(F.count(F.lit(1)).alias("n2"))
    zeros = z.groupBy(*key).agg(F.sum("zero").alias("zeros"))
    d = d.join(first, key, "left").join(n2, key, "left").join(zeros, key, "left").na.fill(0, ["n2", "zeros", "k"])
    return d.where((F.col("k") < 4) & (F.col("n2") < 3) & (F.col("zeros") * 3 <= F.col("end") - F.col("start"))).select(*key)


def call_domains(m: DataFrame, sizes: DataFrame, res: int, states: int = 3, window: int = WINDOW, min_tad: int = MIN_TAD, max_tad: int = MAX_TAD, test: str = "ttest") -> DataFrame:
    """Domains (chrom, start, end) of matrices, from gaps to boundaries."""
    with Scope(m.sparkSession) as scope:
        gaps = scope.stored(tad_gaps(m, sizes, res, min_tad), "gaps")
        di = scope.stored(directionality(m, sizes, gaps, res, window, test), "di")
        segs = scope.stored(segments(gaps, sizes), "segments")
        model = train_hmm(di, segs, states)
        marks = filter_boundaries(boundaries_of(decode_states(di, segs, model), states), gaps)
        return stored(domains(marks, segs.select("chrom", "start", "end"), di, res, min_tad, max_tad), "domains")


def position_text(bp: Column) -> Column:
    """1500000 -> 1M500K, 40000 -> 40K, 1000000 -> 1M, 0 -> 0K."""
    mega, kilo = F.floor(bp / 1_000_000), F.floor(bp % 1_000_000 / 1000)
    return F.when((mega > 0) & (kilo > 0), F.concat(mega.cast("string"), F.lit("M"), kilo.cast("string"), F.lit("K"))).when(mega > 0, F.concat(mega.cast("string"), F.lit("M"))).otherwise(F.concat(kilo.cast("string"), F.lit("K")))
