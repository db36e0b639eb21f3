"""Block matrices: tiles of cells, their products, and principal axes of block matrices.

A tile is (chrom, i, j, data): the dense size x size block of rows from i * size and columns from
j * size, row by row, as little-endian doubles. Absent tiles are zero. A block vector is (chrom,
i, data) with size x k values. Products meet in joins on a tile's row or column and are summed by
tile, so no task holds more than a bounded number of tiles, whatever a chromosome's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.store import Scope

TILE = 256
#: Tiles along a row that are multiplied in one task.
RUN = 32
#: Columns of the iterated subspace, its rounds and the relative residual at which they end.
COLUMNS, ROUNDS, RESIDUAL = 16, 300, 1e-9

_TILE = "chrom string, i long, j long, data binary"
_VECTOR = "chrom string, i long, data binary"


def array_of(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1)


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    parts = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts)], [n for n, _ in parts])


def tiles_of(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of cells (chrom, bin1, bin2, value); cells that repeat add up."""

    def fill(key, t):
        a = np.zeros((size, size))
        np.add.at(a, (t["bin1"].to_numpy() % size, t["bin2"].to_numpy() % size), t["value"].to_numpy())
        return _table([[key[0].as_py()], [key[1].as_py()], [key[2].as_py()], [a.astype("<f8").tobytes()]], _TILE)

    at = lambda c: F.floor(F.col(c) / size).cast("long")
    d = cells.select("chrom", at("bin1").alias("i"), at("bin2").alias("j"), "bin1", "bin2", F.col("value").cast("double").alias("value"))
    return d.groupBy("chrom", "i", "j").applyInArrow(fill, _TILE)


def cells_of(tiles: DataFrame, size: int = TILE, mirrored: bool = False) -> DataFrame:
    """(chrom, bin1, bin2, value) of all cells of tiles; mirrored ones stand for both triangles."""

    def run(batches):
        for batch in batches:
            for c, i, j, data in zip(*(x.to_pylist() for x in batch.columns)):
                a = array_of(data, size)
                for x, y, v in ((i, j, a), (j, i, a.T)) if mirrored and i != j else ((i, j, a),):
                    b1, b2 = np.divmod(np.arange(size * size), size)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * (size * size)), pa.array(b1 + x * size), pa.array(b2 + y * size), pa.array(v.ravel())], ["chrom", "bin1", "bin2", "value"])

    return tiles.select("chrom", "i", "j", "data").mapInArrow(run, "chrom string, bin1 long, bin2 long, value double")


def _summed(parts: DataFrame, by: list[str], schema: str) -> DataFrame:
    """The sum of data over equal keys, RUN parts at a time."""

    def add(key, t):
        total = None
        for data in t["data"]:
            v = np.frombuffer(data.as_py(), "<f8")
            total = v.copy() if total is None else total + v
        return _table([*[[k.as_py()] for k in key[: len(by)]], [total.astype("<f8").tobytes()]], schema)

    return parts.groupBy(*by).applyInArrow(add, schema)


def gram(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles (i <= j) of X' X for the tiles of X: column blocks i and j meet in every row block.

    Row blocks are taken RUN at a time, so that a task holds 2 RUN tiles; the runs' products are
    summed by tile.
    """
    left = tiles.select("chrom", F.col("i").alias("k"), F.col("j").alias("i"), F.col("data").alias("x"))
    right = tiles.select("chrom", F.col("i").alias("k"), "j", F.col("data").alias("y"))
    pairs = left.join(right, ["chrom", "k"]).where("i <= j").withColumn("run", F.floor(F.col("k") / RUN))

    def product(key, t):
        out = np.zeros((size, size))
        for x, y in zip(t["x"], t["y"]):
            out += array_of(x.as_py(), size).T @ array_of(y.as_py(), size)
        return _table([[k.as_py()] for k in key[:3]] + [[out.astype("<f8").tobytes()]], _TILE)

    products = pairs.select("chrom", "i", "j", "run", "x", "y").groupBy("chrom", "i", "j", "run").applyInArrow(product, _TILE)
    return _summed(products, ["chrom", "i", "j"], _TILE)


def box_sums(cells: DataFrame, step: int, size: int = TILE) -> DataFrame:
    """(chrom, bin1, bin2, value): for each place the sum of cells within step rows and columns of it, where there is any.

    Tiles come with a margin of step on all sides, so a cell is in four tiles at most; boxes are
    differences of a tile's prefix sums.
    """
    at = lambda c: F.explode(F.sequence(F.floor((F.col(c) - step) / size), F.floor((F.col(c) + step) / size)))
    d = cells.select("chrom", "bin1", "bin2", F.col("value").cast("double").alias("value")).withColumn("i", at("bin1")).withColumn("j", at("bin2")).where("i >= 0 and j >= 0")

    def run(key, t):
        a = np.zeros((2, size + 2 * step + 1, size + 2 * step + 1))
        i, j = (t[c].to_numpy() - key[k].as_py() * size + step + 1 for c, k in (("bin1", 1), ("bin2", 2)))
        np.add.at(a[0], (i, j), t["value"].to_numpy())
        np.add.at(a[1], (i, j), 1.0)
        p = a.cumsum(1).cumsum(2)
        w = 2 * step + 1
        total, some = p[:, w:, w:] - p[:, :-w, w:] - p[:, w:, :-w] + p[:, :-w, :-w]
        x, y = np.nonzero(some > 0.5)
        return _table([[key[0].as_py()] * len(x), x + key[1].as_py() * size, y + key[2].as_py() * size, total[x, y]], "chrom string, bin1 long, bin2 long, value double")

    return d.groupBy("chrom", "i", "j").applyInArrow(run, "chrom string, bin1 long, bin2 long, value double")


def column_blocks(values: DataFrame, names: list[str], size: int = TILE) -> DataFrame:
    """Block vectors of values(chrom, bin, names..): one column each, zero where there is no row."""

    def fill(key, t):
        a = np.zeros((size, len(names)))
        a[t["bin"].to_numpy() % size] = np.stack([t[n].to_numpy() for n in names], 1)
        return _table([[key[0].as_py()], [key[1].as_py()], [a.astype("<f8").tobytes()]], _VECTOR)

    d = values.select("chrom", F.floor(F.col("bin") / size).cast("long").alias("i"), "bin", *[F.col(n).cast("double").alias(n) for n in names])
    return d.groupBy("chrom", "i").applyInArrow(fill, _VECTOR)


def block_cells(blocks: DataFrame, names: list[str], size: int = TILE) -> DataFrame:
    """(chrom, bin, names..) of every place of block vectors."""

    def run(batches):
        for batch in batches:
            for c, i, data in zip(*(x.to_pylist() for x in batch.columns)):
                a = array_of(data, size)
                yield pa.RecordBatch.from_arrays([pa.array([c] * size), pa.array(np.arange(size) + i * size), *[pa.array(a[:, k].copy()) for k in range(len(names))]], ["chrom", "bin", *names])

    return blocks.select("chrom", "i", "data").mapInArrow(run, "chrom string, bin long, " + ", ".join(f"{n} double" for n in names))


def with_blocks(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tiles with the blocks of their rows (u) and of their columns (v)."""
    at = lambda k, name: blocks.select("chrom", F.col("i").alias(k), F.col("data").alias(name))
    return tiles.join(at("i", "u"), ["chrom", "i"]).join(at("j", "v"), ["chrom", "j"]).select("chrom", "i", "j", "data", "u", "v")


def correlation(tiles: DataFrame, sums: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles (i <= j) of the Pearson correlations of X's columns, zeros counted.

    sums(chrom, bin, s, ss, n): each used column's sum and sum of squares and the number of rows.
    Constant and unused columns correlate with nothing.
    """
    blocks = column_blocks(sums, ["s", "ss", "n"], size)

    def run(batches):
        for batch in batches:
            out = []
            for data, u, v in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                (s1, ss1, n1), (s2, ss2, n2) = array_of(u, size).T, array_of(v, size).T
                n = max(n1.max(), n2.max())
                v1, v2 = n * ss1 - s1 * s1, n * ss2 - s2 * s2
                ok = np.outer(v1 > 1e-12, v2 > 1e-12)
                r = (n * array_of(data, size) - np.outer(s1, s2)) / np.where(ok, np.sqrt(np.outer(np.maximum(v1, 0), np.maximum(v2, 0))), 1.0)
                out.append(np.where(ok, r, 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["chrom", "i", "j", "data"])

    # Tiles without a product still have correlations: those of columns that never meet.
    zero = np.zeros((size, size)).tobytes()
    at = blocks.select("chrom", "i")
    every = at.join(at.withColumnRenamed("i", "j"), "chrom").where("i <= j")
    whole = every.join(gram(tiles, size), ["chrom", "i", "j"], "left").select("chrom", "i", "j", F.coalesce("data", F.lit(zero)).alias("data"))
    return with_blocks(whole, blocks).mapInArrow(run, _TILE)


def multiply(tiles: DataFrame, blocks: DataFrame, size: int = TILE) -> DataFrame:
    """The block vector A V of a symmetric A, given by its tiles with i <= j."""

    def run(batches):
        for batch in batches:
            out = []
            for c, i, j, data, u, v in zip(*(x.to_pylist() for x in batch.columns)):
                a = array_of(data, size)
                out.append((c, i, (a @ array_of(v, size)).astype("<f8").tobytes()))
                if i != j:
                    out.append((c, j, (a.T @ array_of(u, size)).astype("<f8").tobytes()))
            if out:
                yield _table(list(zip(*out)), _VECTOR).to_batches()[0]

    return _summed(with_blocks(tiles, blocks).mapInArrow(run, _VECTOR), ["chrom", "i"], _VECTOR)


def _small(blocks: DataFrame, make, size: int) -> dict[str, np.ndarray]:
    """Per chromosome the sum of make(block) over its blocks: a small matrix, for the driver."""

    def run(batches):
        for batch in batches:
            rows = [(c, make(array_of(d, size)).astype("<f8").tobytes()) for c, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            if rows:
                yield _table(list(zip(*rows)), "chrom string, data binary").to_batches()[0]

    parts = blocks.select("chrom", "i", "data").mapInArrow(run, "chrom string, data binary")
    found = _summed(parts, ["chrom"], "chrom string, data binary").collect()  # a matrix of few rows for each chromosome
    return {r["chrom"]: np.frombuffer(r["data"], "<f8") for r in found}


def _mapped(blocks: DataFrame, matrices: dict[str, np.ndarray], make, size: int) -> DataFrame:
    """make(block, the chromosome's small matrix) for each block."""

    def run(batches):
        for batch in batches:
            out = [make(array_of(d, size), matrices[c]).astype("<f8").tobytes() for c, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["chrom", "i", "data"])

    return blocks.select("chrom", "i", "data").mapInArrow(run, _VECTOR)


def _basis(g: np.ndarray) -> np.ndarray:
    """What makes columns with inner products g orthonormal; columns that the others span become zero."""
    w, q = np.linalg.eigh(g)
    some = w > 1e-13 * max(float(w[-1]), 1e-300)
    return np.where(some, q / np.sqrt(np.where(some, w, 1.0)), 0.0)


def _direct(k: int, size: int):
    """The axes of a chromosome whose bins all lie in one tile."""

    def run(batches):
        for batch in batches:
            for c, i, data, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                r, on = array_of(data, size), np.flatnonzero(array_of(used, size)[:, 0])
                out = np.zeros((size, k))
                if len(on):
                    a = r[np.ix_(on, on)]
                    vt = np.linalg.svd(a - a.mean(0), full_matrices=False)[2][:k]
                    out[on, : len(vt)] = vt.T
                yield _table([[c], [i], [out.astype("<f8").tobytes()]], _VECTOR).to_batches()[0]

    return run


def principal_axes(corr: DataFrame, used: DataFrame, k: int, scope: Scope, size: int = TILE, columns: int = COLUMNS) -> DataFrame:
    """Block vectors of the first k principal axes of a correlation matrix's rows, from its tiles with i <= j.

    used(chrom, bin) are the bins that count; axes are zero elsewhere. They are the eigenvectors
    of C H C, where H takes the mean over used bins away, found by iteration of a subspace: tiles
    meet blocks of vectors, and only inner products of the columns come to the driver. A
    chromosome within one tile is solved there.
    """
    marks = scope.stored(column_blocks(used.withColumn("one", F.lit(1.0)), ["one"], size), "axes-used")
    spread = marks.groupBy("chrom").agg(F.count(F.lit(1)).alias("blocks"))
    one, more = (spread.where(w).select("chrom") for w in ("blocks = 1", "blocks > 1"))
    at = marks.select("chrom", "i", F.col("data").alias("used"))
    near = corr.join(one, "chrom", "left_semi").join(at, ["chrom", "i"]).select("chrom", "i", "j", "data", "used")
    direct = scope.stored(near.mapInArrow(_direct(k, size), _VECTOR), "axes-direct")
    if more.isEmpty():
        return direct
    far = scope.stored(corr.join(more, "chrom", "left_semi"), "axes-tiles")

    def start(batches):
        for batch in batches:
            out = []
            for i, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = np.random.default_rng(11 + i).normal(size=(size, columns)) * array_of(data, size)
                out.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["chrom", "i", "data"])

    mine = marks.join(more, "chrom", "left_semi").select("chrom", "i", "data")
    n = _small(mine, lambda u: u.sum(0, keepdims=True), size)
    v = scope.stored(mine.mapInArrow(start, _VECTOR), "axes")

    def centred(w: DataFrame) -> DataFrame:
        mean = {c: x / n[c][0] for c, x in _small(w, lambda b: b.sum(0, keepdims=True), size).items()}
        both = w.join(marks.select("chrom", "i", F.col("data").alias("used")), ["chrom", "i"])

        def run(batches):
            for batch in batches:
                out = [(array_of(d, size) - array_of(u, size) * mean[c]).astype("<f8").tobytes() for c, d, u in zip(*(batch.column(x).to_pylist() for x in (0, 2, 3)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["chrom", "i", "data"])

        return both.select("chrom", "i", "data", "used").mapInArrow(run, _VECTOR)

    def inner(x: DataFrame) -> dict[str, np.ndarray]:
        return {c: g.reshape(round(len(g) ** 0.5), -1) for c, g in _small(x, lambda b: b.T @ b, size).items()}

    basis = {c: _basis(g) for c, g in inner(v).items()}
    for _ in range(ROUNDS):
        q = scope.stored(_mapped(v, basis, lambda b, m: b @ m, size), "axes")
        scope.drop(v)
        w = scope.stored(multiply(far, q, size), "axes")
        y = scope.stored(multiply(far, centred(w), size), "axes")
        scope.drop(w)
        # Ritz vectors of the subspace, and how far the first k are from being eigenvectors.
        both = q.join(y.withColumnRenamed("data", "y"), ["chrom", "i"]).select("chrom", "i", F.col("data").alias("q"), "y")

        def stacked(batches):
            for batch in batches:
                out = [np.concatenate([array_of(a, size), array_of(b, size)], 1).astype("<f8").tobytes() for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["chrom", "i", "data"])

        worst, turn, following = 0.0, {}, {}
        for c, g in inner(both.mapInArrow(stacked, _VECTOR)).items():
            h, yy = g[:columns, columns:], g[columns:, columns:]
            values, s = np.linalg.eigh((h + h.T) / 2)
            values, s = values[::-1], s[:, ::-1]
            turn[c] = s
            following[c] = s @ _basis(s.T @ yy @ s)
            residual = [np.sqrt(max(0.0, s[:, x] @ yy @ s[:, x] - values[x] ** 2)) / max(values[0], 1e-300) for x in range(k)]
            worst = max(worst, *residual)
        if worst < RESIDUAL:
            break
        scope.drop(q)
        v, basis = y, following
    found = scope.stored(_mapped(q, turn, lambda b, m: (b @ m)[:, :k], size), "axes-found")
    for t in (q, y, far):
        scope.drop(t)
    return direct.unionByName(found)
