"""A store of pixels that takes chunks in any order, with bins' balance weights and gaps beside them.

Each append is a run: the chunk's pixels, added up, sorted, and partitioned by resolution and by
range of the first bin. A manifest names the runs that count; it is replaced by a new one of the
next number, which only one writer can create. Reads add up equal pixels of all runs, and prune
runs' files by resolution and range; compaction writes the runs as one, in the same layout.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import _fs, exists, remove

#: Bins of the first chromosome that share a folder.
RANGE = 4096
_KEYS = ["res", "chrom1", "bin1", "chrom2", "bin2"]
_PIXELS = "chrom1 string, bin1 long, chrom2 string, bin2 long, n long, res long, range long"
HAPLOTYPES = {None: "", "Maternal": "M", "Paternal": "P"}


class PixelStore:
    """Pixels (res, chrom1, bin1, chrom2, bin2, n) of one genome under a path.

    Of a pixel and its mirror one is stored: that with the smaller (chrom1, bin1).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Manifests.
    def _latest(self) -> int:
        fs, p = _fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def runs(self, at: int | None = None) -> list[str]:
        """Names of the runs that count."""
        k = self._latest() if at is None else at
        if k == 0:
            return []
        fs, p = _fs(self.spark, f"{self.path}/manifests/{k}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, change) -> None:
        """Replace the runs by change(runs); another writer's manifest in between is taken into account."""
        while True:
            k = self._latest()
            body = json.dumps(change(self.runs(k))).encode()
            own = f"{self.path}/manifests/.{uuid.uuid4().hex}"
            fs, p = _fs(self.spark, own)
            stream = fs.create(p, False)
            stream.write(bytearray(body))
            stream.close()
            target = _fs(self.spark, f"{self.path}/manifests/{k + 1}")[1]
            if not fs.exists(target) and fs.rename(p, target):
                return
            fs.delete(p, False)

    # Pixels.
    def _write(self, pixels: DataFrame) -> str:
        name = f"run={uuid.uuid4().hex}"
        d = pixels.withColumn("range", F.floor(F.col("bin1") / RANGE))
        d = d.repartitionByRange("res", "chrom1", "bin1").sortWithinPartitions(*_KEYS)
        d.write.partitionBy("res", "range").parquet(f"{self.path}/runs/{name}")
        return name

    def append(self, pixels: DataFrame) -> None:
        """Add a chunk of pixels in any order and orientation, repeated ones too."""
        a, b = F.struct("chrom1", "bin1"), F.struct("chrom2", "bin2")
        side = lambda f, k: F.when(a <= b, F.col(f"chrom{k}" if f else f"bin{k}")).otherwise(F.col(f"chrom{3 - k}" if f else f"bin{3 - k}"))
        d = pixels.select(F.col("res").cast("long").alias("res"), side(1, 1).alias("c1"), side(0, 1).alias("b1"), side(1, 2).alias("c2"), side(0, 2).alias("b2"), "n")
        d = d.groupBy("res", F.col("c1").alias("chrom1"), F.col("b1").alias("bin1"), F.col("c2").alias("chrom2"), F.col("b2").alias("bin2")).agg(F.sum("n").cast("long").alias("n"))
        name = self._write(d)
        self._commit(lambda runs: [*runs, name])

    def _all(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _PIXELS)
        return self.spark.read.schema(_PIXELS + ", run string").option("basePath", f"{self.path}/runs").parquet(*[f"{self.path}/runs/{r}" for r in runs])

    def compact(self) -> None:
        """Write all runs as one. Runs that come in meanwhile stay beside it; the old ones' files go afterwards."""
        old = self.runs()
        if len(old) < 2:
            return
        d = self._all(old)
        name = self._write(d.groupBy(*_KEYS).agg(F.sum("n").alias("n")))
        self._commit(lambda runs: [name, *[r for r in runs if r not in old]])
        for r in old:
            remove(self.spark, f"{self.path}/runs/{r}")

    def read(self, res: int, chrom: str | None = None, haplotype: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """(chrom1, bin1, chrom2, bin2, n) of one resolution; of one chromosome with itself, of one parent's (Maternal or Paternal), with first bins in [start, end)."""
        if haplotype not in HAPLOTYPES:
            raise ValueError(f"haplotype is Maternal or Paternal, not {haplotype!r}")
        d = self._all(self.runs()).where(F.col("res") == res)
        if chrom is not None:
            d = d.where((F.col("chrom1") == chrom) & (F.col("chrom2") == chrom))
        if haplotype:
            letter = HAPLOTYPES[haplotype]
            d = d.where(F.col("chrom1").startswith(letter) & F.col("chrom2").startswith(letter))
        if start is not None:
            d = d.where((F.col("range") >= start // RANGE) & (F.col("bin1") >= start))
        if end is not None:
            d = d.where((F.col("range") <= (end - 1) // RANGE) & (F.col("bin1") < end))
        return d.groupBy(*_KEYS[1:]).agg(F.sum("n").alias("n"))

    # Weights and gaps, by resolution.
    def _put(self, what: str, res: int, d: DataFrame) -> None:
        d.write.mode("overwrite").parquet(f"{self.path}/{what}/{res}")

    def put_weights(self, res: int, weights: DataFrame) -> None:
        """weights(chrom, bin, weight); a masked bin's is null."""
        self._put("weights", res, weights.select("chrom", "bin", F.col("weight").cast("double").alias("weight")))

    def weights(self, res: int, chrom: str | None = None) -> DataFrame:
        """(chrom, bin, weight, bias), bias = 1 / weight; null where a bin is masked."""
        if not exists(self.spark, f"{self.path}/weights/{res}"):
            raise ValueError(f"no weights are stored for bins of {res}")
        d = self.spark.read.parquet(f"{self.path}/weights/{res}").withColumn("bias", 1 / F.col("weight"))
        return d if chrom is None else d.where(F.col("chrom") == chrom)

    def balanced(self, res: int, chrom: str | None = None, haplotype: str | None = None) -> DataFrame:
        """(chrom1, bin1, chrom2, bin2, value): n times both bins' weights; pixels of masked bins are zero, and so not there."""
        d = self.read(res, chrom, haplotype)
        w = self.weights(res).where("weight is not null")
        for k in "12":
            d = d.join(w.select(F.col("chrom").alias("chrom" + k), F.col("bin").alias("bin" + k), F.col("weight").alias("w" + k)), ["chrom" + k, "bin" + k])
        return d.select("chrom1", "bin1", "chrom2", "bin2", (F.col("n") * F.col("w1") * F.col("w2")).alias("value"))

    def put_gaps(self, res: int, gaps: DataFrame) -> None:
        """gaps(chrom, bin)."""
        self._put("gaps", res, gaps.select("chrom", "bin").distinct())

    def gaps(self, res: int, chrom: str | None = None) -> DataFrame:
        """(chrom, bin) of a resolution; none were stored: an error, as for weights."""
        if not exists(self.spark, f"{self.path}/gaps/{res}"):
            raise ValueError(f"no gaps are stored for bins of {res}")
        d = self.spark.read.parquet(f"{self.path}/gaps/{res}")
        return d if chrom is None else d.where(F.col("chrom") == chrom)

    def chromosomes(self, res: int, haplotype: str | None = None) -> list[str]:
        """Names that pixels of a resolution have, natural order; of one parent's (Maternal or Paternal)."""
        if haplotype not in HAPLOTYPES:
            raise ValueError(f"haplotype is Maternal or Paternal, not {haplotype!r}")
        d = self._all(self.runs()).where(F.col("res") == res).select("chrom1").distinct()
        names = [r[0] for r in d.where(F.col("chrom1").startswith(HAPLOTYPES[haplotype])).collect()]  # chromosomes
        return sorted(names, key=lambda c: (not c.lstrip("MP").isdigit(), int(c.lstrip("MP")) if c.lstrip("MP").isdigit() else 0, c))


def balance_store(store: PixelStore, res: int, sizes: DataFrame, iterations: int = 200, tolerance: float = 1e-5, ignore_diagonals: int = 1, least_pixels: int = 0) -> float:
    """Balance a resolution within chromosomes and write the weights beside the bins; returns the rows' variance.

    Bins with fewer than least_pixels pixels, or without any, are masked: their weight is null.
    """
    from strandloom.operators.balance import grid, ice_weights
    from strandloom.operators.contacts import symmetric

    px = store.read(res).where("chrom1 = chrom2").select(F.col("chrom1").alias("chrom"), "bin1", "bin2", F.col("n").cast("double").alias("value"))
    if least_pixels:
        ends = px.where(F.abs(F.col("bin1") - F.col("bin2")) >= ignore_diagonals).select("chrom", F.explode(F.array("bin1", "bin2")).alias("bin"))
        full = ends.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_pixels)
        for k in "12":
            px = px.join(full.select("chrom", F.col("bin").alias("bin" + k)), ["chrom", "bin" + k], "left_semi")
    bias, spread = ice_weights(symmetric(px), iterations, tolerance, ignore_diagonals, with_spread=True)
    weights = grid(sizes).join(bias, ["chrom", "bin"], "left").select("chrom", "bin", (1 / F.col("bias")).alias("weight"))
    store.put_weights(res, weights)
    return spread
