"""FASTQ and FASTA read where their blocks lie.

Spark reads a plain text file in blocks, a compressed one whole; a line belongs to the block in
which it begins, and the block's start is known with each line. What a record needs from other
blocks is little: of FASTQ the lines before a block's first record and those of an unfinished last
one, of FASTA the name and the number of bases that earlier blocks end with. So blocks are parsed
where they are read, and only these seams are shuffled, by file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored

#: Bases of a tile of a sequence.
TILE = 1 << 16


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line): lines of text files; within a partition those of a block are in order."""
    d = spark.read.text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _blocks(batches):
    """(key, lines, whether the block ends) of a partition's blocks as their lines come in.

    The key is (file, block) and what other columns there are. The list is the reader's to
    shorten: lines that it leaves are there again with those that follow.
    """
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = [c for n, c in zip(batch.schema.names, batch.columns) if n != "line"]
        start, names = rest[1].to_numpy(), rest[0].dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero((np.diff(start) != 0) | (np.diff(names) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            k = tuple(c[a].as_py() for c in rest)
            if key is not None and k != key:
                yield key, held, True
                held = []
            key = k
            held.extend(batch.column("line")[a:b].to_pylist())
            yield key, held, False
    if key is not None:
        yield key, held, True


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """lines with i, a line's place in its block."""

    def run(batches):
        at = 0
        for key, held, last in _blocks(batches):
            n = len(held)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(np.arange(at, at + n)), pa.array(held, pa.string())], ["file", "block", "i", "line"])
            at = 0 if last else at + n
            held.clear()

    return lines(spark, path).mapInArrow(run, "file string, block long, i long, line string")


def first_record(part: list[str]) -> int:
    """Where the first FASTQ record of a run of lines begins; the number of lines if that can't be told.

    A record's head begins with @ and its third line with +. A quality line may begin with @, but
    then a sequence stands in the third line after it, and bases never begin with +.
    """
    for i in range(len(part) - 2):
        if part[i].startswith("@") and part[i + 2].startswith("+"):
            return i
    return len(part)


_PARSED = "file string, block long, head string, seq string, qual string, before array<string>, after array<string>"


def _parse(batches):
    """Whole records of blocks, and a row with the lines of a block's two seams."""
    names = [x.split()[0] for x in _PARSED.split(", ")]
    strings = pa.list_(pa.string())

    def out(key, records, seams):
        n = len(records) // 4
        head, seq, _, qual = (records[k::4] for k in range(4))
        cols = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(head, pa.string()), pa.array(seq, pa.string()), pa.array(qual, pa.string()), pa.nulls(n, strings), pa.nulls(n, strings)]
        yield pa.RecordBatch.from_arrays(cols, names)
        if seams is not None:
            none = pa.nulls(1, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), none, none, none, pa.array([seams[0]], strings), pa.array([seams[1]], strings)], names)

    before, started, done = [], False, 0
    for key, held, last in _blocks(batches):
        if not started:
            if key[1] == 0:
                before, started, done = [], True, 0
            else:
                at = first_record(held)
                if at < len(held) or last:
                    before, started, done = held[:at], True, at
        if started:
            whole = done + (len(held) - done) // 4 * 4
            if whole > done or last:
                yield from out(key, held[done:whole], (before, held[whole:]) if last else None)
            del held[:whole]
            done = 0
        if last:
            started = False


def read_fastq(spark: SparkSession, path, mate: int) -> DataFrame:
    """(name, mate, seq, qual, chunk) of four-line records, plain or compressed; names get the suffix _<mate>, chunk comes from the file name.

    A plain file is read by as many tasks as it has blocks. Records whose head does not begin
    with @ are left out, as are unfinished ones at a file's end. Records over a seam come from a
    second pass over the plain files, of which only the seams are kept.
    """
    parsed = lines(spark, path).mapInArrow(_parse, _PARSED)
    whole = parsed.where("head is not null").select("file", "head", "seq", "qual")
    # A compressed file is one block: its seams are the lines left at its end, which are no record.
    split = lines(spark, path).where(~F.col("file").rlike(r"\.(gz|bz2|zst|zstd|deflate|snappy|lz4)$")).mapInArrow(_parse, _PARSED)
    seams = split.where("before is not null").select("file", "block", "before", "after")

    def join(key, t):
        rows = t.sort_by("block")
        left = [x for b, a in zip(rows["before"].to_pylist(), rows["after"].to_pylist()) for x in (*b, *a)]
        n = len(left) // 4
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), *[pa.array(left[k : 4 * n : 4], pa.string()) for k in (0, 1, 3)]], ["file", "head", "seq", "qual"])

    d = whole.unionByName(seams.groupBy("file").applyInArrow(join, "file string, head string, seq string, qual string")).where(F.col("head").startswith("@"))
    from strandloom.operators.reads import mark_mate

    name = mark_mate(F.regexp_extract("head", r"^@(\S+)", 1), mate)
    return d.select(name.alias("name"), F.lit(mate).alias("mate"), "seq", "qual", F.regexp_extract("file", r"_chunk(\d+)", 1).try_cast("int").alias("chunk"))


def _named(line: str) -> str:
    """The sequence's name in a header: its first word, without chr."""
    words = line[1:].split()
    return words[0].removeprefix("chr") if words else ""


def _ends(batches):
    """Per block: bases before its first header, its last header's name and bases after that."""
    before, name, after = 0, None, 0
    for key, held, last in _blocks(batches):
        for line in held:
            if line.startswith(">"):
                name, after = _named(line), 0
            elif name is None:
                before += len(line.strip())
            else:
                after += len(line.strip())
        held.clear()
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([before], pa.int64()), pa.array([name], pa.string()), pa.array([after], pa.int64())], ["file", "block", "before", "name", "after"])
            before, name, after = 0, None, 0


def _pieces(size: int):
    """Blocks' lines with the name and offset they begin under -> pieces (chrom, tile, at, piece) that no tile's edge cuts."""

    def cut(chrom, at, parts):
        s, rows = "".join(parts), []
        while s and chrom is not None:
            n = size - at % size
            rows.append((chrom, at // size, at % size, s[:n]))
            at, s = at + n, s[n:]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["chrom", "tile", "at", "piece"])

    def run(batches):
        chrom, at, parts, some, fresh = None, 0, [], 0, True
        for key, held, last in _blocks(batches):
            if fresh:
                chrom, at, parts, some, fresh = key[2], key[3], [], 0, False
            for line in held:
                head = line.startswith(">")
                if not head:
                    parts.append(line.strip().upper())
                    some += len(parts[-1])
                if head or some >= 4 * size:
                    yield from cut(chrom, at, parts)
                    at, parts, some = at + some, [], 0
                if head:
                    chrom, at = _named(line), 0
            held.clear()
            if last:
                yield from cut(chrom, at, parts)
                parts, some, fresh = [], 0, True

    return run


def fasta_tiles(spark: SparkSession, path, size: int = TILE) -> DataFrame:
    """(chrom, offset, seq): sequences in upper case as tiles of `size` bases, offset counting from 0.

    Headers give the first word without 'chr', names that differ; lines before the first header
    are left out. Two passes: the first finds what each block ends with, a row a block, from
    which running sums give the name and offset each block begins under; the second cuts lines
    into tiles. No sequence is in one row or task.
    """
    ends = stored(lines(spark, path).mapInArrow(_ends, "file string, block long, before long, name string, after long"), "fasta-ends")
    run = Window.partitionBy("file").orderBy("block")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    e = ends.withColumns({"group": F.count("name").over(upto), "under": F.last("name", ignorenulls=True).over(upto)})
    # Bases since the last header: those after it in its own block, then those of whole blocks.
    own = F.when(F.col("name").isNotNull(), F.col("after")).otherwise(F.col("before"))
    e = e.withColumn("done", F.sum(own).over(Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    starts = stored(e.select("file", "block", F.lag("under").over(run).alias("chrom"), F.coalesce(F.lag("done").over(run), F.lit(0)).alias("offset")), "fasta-starts")
    d = lines(spark, path).join(F.broadcast(starts), ["file", "block"])  # a row for each block of the files, of 128 MB as Spark has it
    pieces = d.select("file", "block", "chrom", "offset", "line").mapInArrow(_pieces(size), "chrom string, tile long, at long, piece string")
    tiles = pieces.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return tiles.select("chrom", (F.col("tile") * size).alias("offset"), F.array_join(F.col("p.piece"), "").alias("seq"))
