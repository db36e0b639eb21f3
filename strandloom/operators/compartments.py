"""Compartments: distance decay, observed over expected, correlation, principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.store import Scope, stored

from . import tiles
from .balance import row_sums

GAP_COVERAGE = 0.05


def compartment_gaps(m: DataFrame, sizes: DataFrame) -> DataFrame:
    return row_sums(m, sizes).where(F.col("coverage") <= GAP_COVERAGE).select("chrom", "bin")


def distance_decay(m: DataFrame, sizes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(chrom, d, expected): mean of both diagonals at distance d over columns that are no gaps.

    The number of cells is analytic: zeros are not stored. Without such cells the sum stands.
    """
    use = m.join(gaps.select("chrom", F.col("bin").alias("bin2")), ["chrom", "bin2"], "left_anti")
    s = use.groupBy("chrom", F.abs(F.col("bin1") - F.col("bin2")).alias("d")).agg(F.sum("value").alias("s"))
    d = sizes.select("chrom", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("d"))
    # A gap column j loses a cell at j - d where j >= d and one at j + d where j <= n - 1 - d: both
    # are counts of gaps from one end, taken as running sums over distances.
    g = gaps.join(sizes, "chrom")
    ends = g.select("chrom", F.explode(F.array("bin", F.col("n") - 1 - F.col("bin"))).alias("d")).groupBy("chrom", "d").agg(F.count(F.lit(1)).alias("k"))
    later = Window.partitionBy("chrom").orderBy(F.desc("d"))
    all_gaps = gaps.groupBy("chrom").agg(F.count(F.lit(1)).alias("gaps"))
    d = d.join(s, ["chrom", "d"], "left").join(ends, ["chrom", "d"], "left").join(all_gaps, "chrom", "left")
    lost = F.when(F.col("d") == 0, F.coalesce("gaps", F.lit(0))).otherwise(F.sum(F.coalesce("k", F.lit(0))).over(later))
    cells = F.when(F.col("d") == 0, F.col("n")).otherwise(2 * (F.col("n") - F.col("d"))) - lost
    d = d.withColumn("cells", cells)
    cells = F.col("cells")
    total = F.coalesce("s", F.lit(0.0))
    return d.select("chrom", "d", F.when(cells > 0, total / cells).otherwise(total).alias("expected"))


def observed_over_expected(m: DataFrame, decay: DataFrame) -> DataFrame:
    """Cells over the expectation at their distance; a zero expectation counts as the smallest other one."""
    low = decay.where("expected > 0").groupBy("chrom").agg(F.min("expected").alias("low"))
    e = decay.join(low, "chrom").select("chrom", "d", F.when(F.col("expected") == 0, F.col("low")).otherwise(F.col("expected")).alias("e"))
    m = m.withColumn("d", F.abs(F.col("bin1") - F.col("bin2")))
    return m.join(e, ["chrom", "d"]).select("chrom", "bin1", "bin2", (F.col("value") / F.col("e")).alias("value"))


def sliding_oe(m: DataFrame, decay: DataFrame, sizes: DataFrame, window: int, res: int) -> DataFrame:
    """Box sums over a fixed mix of expectations, inside; plain ratios in the border of step = window // res // 2 cells."""
    step = window // res // 2
    box = tiles.box_sums(m, step).withColumnRenamed("value", "box")
    inside = lambda c: F.col(c).between(step, F.col("n") - 1 - step)
    box = box.join(sizes, "chrom").where(inside("bin1") & inside("bin2"))
    e = decay.select("chrom", "d", "expected")
    for k in range(-2, 3):
        at = e.select("chrom", F.col("d").alias(f"d{k}"), F.col("expected").alias(f"e{k + 2}"))
        box = box.withColumn(f"d{k}", F.abs(F.abs(F.col("bin1") - F.col("bin2")) + k)).join(at, ["chrom", f"d{k}"], "left").na.fill(0.0, [f"e{k + 2}"])
    mix = 3 * F.col("e2") + 2 * F.col("e1") + 2 * F.col("e3") + F.col("e0") + F.col("e4")
    inner = box.where(mix > 0).select("chrom", "bin1", "bin2", (F.col("box") / mix).alias("value"))
    border = observed_over_expected(m, decay).join(sizes, "chrom").where(~(inside("bin1") & inside("bin2"))).select("chrom", "bin1", "bin2", "value")
    return inner.unionByName(border)


def _correlation(oe: DataFrame, bins: DataFrame, size: int) -> DataFrame:
    """Tiles (i <= j) of the correlations of oe's columns over the rows of bins(chrom, bin)."""
    b = lambda k: bins.select("chrom", F.col("bin").alias(k))
    m = oe.join(b("bin1"), ["chrom", "bin1"], "left_semi").join(b("bin2"), ["chrom", "bin2"], "left_semi")
    n = bins.groupBy("chrom").agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = m.groupBy("chrom", F.col("bin2").alias("bin")).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    sums = bins.select("chrom", "bin").join(s, ["chrom", "bin"], "left").na.fill(0.0, ["s", "ss"]).join(n, "chrom")
    return tiles.correlation(tiles.tiles_of(m, size), sums, size)


def oe_correlation(oe: DataFrame, bins: DataFrame, size: int = tiles.TILE) -> DataFrame:
    """(chrom, bin1, bin2, r): Pearson correlations of the columns of bins(chrom, bin), zeros counted.

    Sums of products come from products of tiles; a constant column correlates with nothing.
    """
    oe, bins = stored(oe, "oe"), stored(bins, "bins")  # both are read several times
    b = lambda k: bins.select("chrom", F.col("bin").alias(k))
    cells = tiles.cells_of(_correlation(oe, bins, size), size, mirrored=True).withColumnRenamed("value", "r")
    return cells.join(b("bin1"), ["chrom", "bin1"], "left_semi").join(b("bin2"), ["chrom", "bin2"], "left_semi")


def choose_components(corr: DataFrame, axes: DataFrame, entries: DataFrame, size: int = tiles.TILE) -> DataFrame:
    """(chrom, component, score): the one of the axes whose signs best split the correlations, and by how much.

    An axis's score is the mean correlation within its two signs less that between them, over
    cells above -1 and, within, below 1. Bins of either sign must reach over more than half of
    what all signed bins reach over. Without any such axis it is (1, 0). corr are tiles (i <= j),
    axes block vectors and entries(chrom, bin, component, value) their cells; tiles' sums leave
    them, not cells.
    """

    def run(batches):
        for batch in batches:
            out = []
            for c, i, j, data, u, v in zip(*(x.to_pylist() for x in batch.columns)):
                r, u, v = (tiles.array_of(x, size) for x in (data, u, v))
                within, between = (r > -1) & (r < 1 - 1e-5), (r > -1) & (r < 1)
                for k in range(u.shape[1]):
                    up, down = [(x[:, k] > 0).astype(float) for x in (u, v)], [(x[:, k] < 0).astype(float) for x in (u, v)]
                    both = lambda a, b, m, w: float(a @ (np.where(m, w, 0.0) @ b))
                    sums = [sum(both(x[0], x[1], within, w) for x in (up, down)) * (1 if i == j else 2) for w in (r, 1.0)]
                    cross = [both(up[0], down[1], between, w) + (both(down[0], up[1], between, w) if i != j else 0.0) for w in (r, 1.0)]
                    out.append((c, k + 1, *sums, *cross))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["chrom", "component", "s", "n", "xs", "xn"])

    parts = tiles.with_blocks(corr, axes).mapInArrow(run, "chrom string, component long, s double, n double, xs double, xn double")
    sums = parts.groupBy("chrom", "component").agg(*[F.sum(c).alias(c) for c in ("s", "n", "xs", "xn")])
    at = lambda f, w: f(F.when(w, F.col("bin")))
    up, down = F.col("value") > 0, F.col("value") < 0
    reach = entries.groupBy("chrom", "component").agg(at(F.min, up).alias("u0"), at(F.max, up).alias("u1"), at(F.min, down).alias("d0"), at(F.max, down).alias("d1"))
    d = sums.join(reach, ["chrom", "component"]).withColumn("reach", F.greatest("u1", "d1") - F.least("u0", "d0"))
    cross = F.col("xs") / F.col("xn")
    wide = (2 * (F.col("u1") - F.col("u0")) > F.col("reach")) & (2 * (F.col("d1") - F.col("d0")) > F.col("reach"))
    score = F.when(wide & (F.col("n") > 0) & (F.col("xn") > 0) & ~cross.isin(0.0, -1.0), F.col("s") / F.col("n") - cross)
    d = d.withColumn("score", F.when(score > 0, score))
    best = d.groupBy("chrom").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), (-F.col("component")).alias("c"))).alias("x"))
    return best.select("chrom", F.when(F.col("x.score") > 0, -F.col("x.c")).otherwise(1).cast("int").alias("component"), "x.score")


def call_compartments(m: DataFrame, sizes: DataFrame, components: int = 3, size: int = tiles.TILE) -> DataFrame:
    """(chrom, bin, pc, component, score, pc1, pc2, pc3) of the bins that are no gaps: the chosen component, A positive, its number and how well it splits the correlations, and all.

    Axes are unit vectors, positive at their largest entry. A score of 0 marks a chromosome that
    no component splits; its first one stands there. Correlations and axes are block matrices:
    no task holds a chromosome.
    """
    names = [f"pc{k + 1}" for k in range(components)]
    with Scope(m.sparkSession) as scope:
        gaps = compartment_gaps(m, sizes)
        used = scope.stored(row_sums(m, sizes).select("chrom", "bin").join(gaps, ["chrom", "bin"], "left_anti"), "used")
        oe = scope.stored(observed_over_expected(m, distance_decay(m, sizes, gaps)), "oe")
        corr = scope.stored(_correlation(oe, used, size), "correlation")
        axes = scope.stored(tiles.principal_axes(corr, used, components, scope, size), "axes")
        each = tiles.block_cells(axes, names, size).join(used, ["chrom", "bin"])
        entries = scope.stored(each.select("chrom", "bin", F.posexplode(F.array(*names)).alias("k", "value")).select("chrom", "bin", (F.col("k") + 1).alias("component"), "value"), "entries")
        top = entries.groupBy("chrom", "component").agg(F.max_by(F.signum("value"), F.struct(F.abs("value"), -F.col("bin"))).alias("sign"))
        signed = entries.join(top, ["chrom", "component"]).select("chrom", "bin", "component", (F.col("value") * F.when(F.col("sign") < 0, -1.0).otherwise(1.0)).alias("value"))
        chosen = choose_components(corr, axes, entries, size)
        pc = signed.join(chosen, ["chrom", "component"]).select("chrom", "bin", F.col("value").alias("pc"), "component", "score")
        side = lambda k: pc.select("chrom", F.col("bin").alias("bin" + k), F.signum("pc").alias("s" + k))
        same = oe.where("value <> 0").join(side("1"), ["chrom", "bin1"]).join(side("2"), ["chrom", "bin2"]).where("s1 = s2 and s1 <> 0")
        mean = lambda s: F.coalesce(F.avg(F.when(F.col("s1") == s, F.col("value"))), F.lit(0.0))
        turn = same.groupBy("chrom").agg((mean(-1) > mean(1)).alias("turn"))
        pc = pc.join(turn, "chrom", "left").withColumn("pc", F.when(F.col("turn"), -F.col("pc")).otherwise(F.col("pc")))
        wide = signed.groupBy("chrom", "bin").agg(*[F.max(F.when(F.col("component") == k + 1, F.col("value"))).alias(n) for k, n in enumerate(names)])
        return stored(pc.join(wide, ["chrom", "bin"]).select("chrom", "bin", "pc", "component", "score", *names), "compartments")


def choose_by_reference(components: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, component, r): of components(chrom, component, bin, value) the one that correlates best, in absolute value, with reference(chrom, bin, pc)."""
    c = components.join(reference, ["chrom", "bin"]).groupBy("chrom", "component").agg(F.corr("value", "pc").alias("r"))
    return c.groupBy("chrom").agg(F.max_by(F.struct("component", "r"), F.struct(F.abs("r"), -F.col("component"))).alias("x")).select("chrom", "x.component", "x.r")


def zero_crossings(pc: DataFrame) -> DataFrame:
    """(chrom, at, value) for drawing pc(chrom, bin, pc): each bin but a chromosome's last, and a zero half a step after those whose next bin has the other sign.

    Places are those among the chromosome's bins, from 0.
    """
    by = Window.partitionBy("chrom").orderBy("bin")
    d = pc.select("chrom", (F.row_number().over(by) - 1).cast("double").alias("at"), F.col("pc").alias("value"), F.lead("pc").over(by).alias("next")).where("next is not null")
    own = F.struct("at", "value")
    points = F.when(F.col("value") * F.col("next") < 0, F.array(own, F.struct((F.col("at") + 0.5).alias("at"), F.lit(0.0).alias("value")))).otherwise(F.array(own))
    return d.select("chrom", F.explode(points).alias("p")).select("chrom", "p.at", "p.value")
