"""BAM as a Spark data source: files are split by byte ranges, records decoded into Arrow batches.

A BAM file is a chain of compressed blocks, and records run on over their ends. A task of a byte
range looks for the first block that begins in it, then for the first record in that block: the
place from which a chain of records holds together. It reads the records that begin in its
blocks, the last one to its end. A filter on `unmapped` can be taken into the reader, which then
passes over other records without decoding them: by an option, or, where the session hands
filters on to Python sources, by a plain where().

Files are opened through pyarrow's file systems (local paths, and URIs that it knows).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

SPLIT = 32 << 20
_BLOCK = 65280  # bytes of a written block before compression
_CHAIN = 12  # records that must hold together
_BATCH = 4096
# The empty block at a file's end, and the letters of four-bit bases.
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_BASES = "=ACMGRSVTWYHKDBN"
_TO_BASES = str.maketrans("0123456789abcdef", _BASES)
_FROM_BASES = str.maketrans(_BASES, "0123456789abcdef")
_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_FIXED = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}

SCHEMA = "name string, flag int, ref string, pos long, mapq int, cigar string, seq string, qual string, as_score int, xs_score int, unmapped int"
_ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("as_score", pa.int32()), ("xs_score", pa.int32()), ("unmapped", pa.int32())])


def _open(uri: str):
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return at, path


def _files(uri: str) -> list[tuple[str, int]]:
    """(uri, size) of a file, or of a folder's .bam files."""
    from pyarrow import fs

    at, path = _open(uri)
    info = at.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = sorted((i.base_name, i.size) for i in at.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and i.base_name.endswith(".bam"))
    return [(f"{uri.rstrip('/')}/{n}", size) for n, size in found]


def block_size(data: bytes, at: int) -> int:
    """Bytes of the compressed block that begins at data[at]; 0 if none does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    k, end = at + 12, at + 12 + extra
    while k + 4 <= min(end, len(data) - 2):
        n = struct.unpack_from("<H", data, k + 2)[0]
        if data[k : k + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + n
    return 0


def inflate(block: bytes) -> bytes:
    return zlib.decompress(block, 31)


def deflate(data: bytes, level: int = 6) -> bytes:
    """data as one compressed block."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """A file's compressed blocks from a place on, one after the other."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def first(self, start: int, end: int) -> int:
        """Where the first block that begins in [start, end) begins; end if none does. A block counts if it unpacks and another one or the file's end follows."""
        at = start
        while at < end:
            data = self._at(at, 1 << 18)
            k = data.find(b"\x1f\x8b\x08\x04")
            while 0 <= k and at + k < end:
                n = block_size(data, k)
                if n and k + n + 18 > len(data) and at + len(data) < self.size:
                    break  # too near the end of what was read: read again from here
                if n and (at + k + n == self.size or block_size(data, k + n)):
                    try:
                        inflate(data[k : k + n])
                        return at + k
                    except zlib.error:
                        pass
                k = data.find(b"\x1f\x8b\x08\x04", k + 1)
            if k < 0:
                at += max(1, len(data) - 17)
            elif at + k >= end:
                return end
            else:
                at += k
        return end

    def read(self, at: int):
        """(place, contents) of each block from at on."""
        data, base = b"", at
        while base < self.size:
            if len(data) < 18 or len(data) < block_size(data, 0):
                data = self._at(base, 1 << 20)
            n = block_size(data, 0)
            if not n or n > len(data):
                raise ValueError(f"no whole block at {base}")
            yield base, inflate(data[:n])
            data, base = data[n:], base + n


@dataclass
class Header:
    text: str
    refs: list[tuple[str, int]]


def _header(blocks: Blocks) -> tuple[Header, int, int]:
    """(header, block and place in it where the first record begins)."""
    held, ends = b"", []
    for at, data in blocks.read(0):
        ends.append((at, len(held)))
        held += data
        if len(held) < 8:
            continue
        n = struct.unpack_from("<i", held, 4)[0]
        if len(held) < 12 + n:
            continue
        k, refs = 12 + n, []
        for _ in range(struct.unpack_from("<i", held, 8 + n)[0]):
            if len(held) < k + 4:
                break
            m = struct.unpack_from("<i", held, k)[0]
            if len(held) < k + 8 + m:
                break
            refs.append((held[k + 4 : k + 3 + m].decode(), struct.unpack_from("<i", held, k + 4 + m)[0]))
            k += 8 + m
        else:
            text = held[8 : 8 + n].rstrip(b"\0").decode()
            at, before = next((a, b) for a, b in reversed(ends) if b <= k)
            return Header(text, refs), at, k - before
    raise ValueError("the file has no whole header")


def _holds(data: bytes, k: int, refs: list[tuple[str, int]]) -> int:
    """Bytes of the record at data[k]; 0 if there can be none, -1 if data ends too early to tell."""
    if len(data) < k + 36:
        return -1
    n, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, k)
    ok = n >= 32 and name >= 1 and bases >= 0 and all(-1 <= r < len(refs) and -1 <= p <= (refs[r][1] if r >= 0 else 1 << 30) for r, p in ((ref, pos), (mate, mate_pos)))
    if not ok or 32 + name + 4 * ops + (bases + 1) // 2 + bases > n:
        return 0
    if len(data) < k + 36 + name + 4 * ops:
        return -1
    text = data[k + 36 : k + 35 + name]
    if data[k + 35 + name] or any(not 33 <= c <= 126 for c in text):
        return 0
    if any(data[x] & 15 > 8 for x in range(k + 36 + name, k + 36 + name + 4 * ops, 4)):
        return 0
    return n + 4


def first_record(data: bytes, refs: list[tuple[str, int]]) -> int:
    """The first place in data from which records follow each other; -1 if none is certain within it."""
    for k in range(len(data)):
        at, chain = k, 0
        while chain < _CHAIN:
            n = _holds(data, at, refs)
            if n <= 0:
                break
            at, chain = at + n, chain + 1
        if chain == _CHAIN or chain and (n == -1 or at == len(data)):
            return k
    return -1


def _tags(data: bytes, k: int, end: int) -> dict[str, int]:
    out = {}
    while k + 3 <= end:
        tag, kind = data[k : k + 2], chr(data[k + 2])
        k += 3
        if kind in _INTS:
            if tag in (b"AS", b"XS"):
                out[tag.decode()] = struct.unpack_from(_INTS[kind], data, k)[0]
            k += _FIXED[kind]
        elif kind in _FIXED:
            k += _FIXED[kind]
        elif kind in "ZH":
            k = data.index(b"\0", k) + 1
        else:  # an array
            k += 5 + _FIXED[chr(data[k])] * struct.unpack_from("<i", data, k + 1)[0]
    return out


def decode(data: bytes, k: int, n: int, refs: list[tuple[str, int]]) -> tuple:
    """The row of the record of n bytes at data[k]."""
    _, ref, pos, name, mapq, _, ops, flag, bases, _, _, _ = struct.unpack_from("<iiiBBHHHiiii", data, k)
    at = k + 36
    text = data[at : at + name - 1].decode()
    at += name
    cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in struct.unpack_from(f"<{ops}I", data, at))
    at += 4 * ops
    seq = data[at : at + (bases + 1) // 2].hex().translate(_TO_BASES)[:bases]
    at += (bases + 1) // 2
    raw = data[at : at + bases]
    qual = "*" if not bases or raw[0] == 255 else bytes(q + 33 for q in raw).decode()
    tags = _tags(data, at + bases, k + n)
    return text, flag, refs[ref][0] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", seq or "*", qual, tags.get("AS"), tags.get("XS"), flag >> 2 & 1


def encode(row, refs: dict[str, int]) -> bytes:
    """The record of a row; numbers of tags take four bytes."""
    name = row["name"].encode() + b"\0"
    ops = [] if row["cigar"] in (None, "*") else _cigar(row["cigar"])
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    four = bytes.fromhex((seq.upper().translate(_FROM_BASES) + ("0" if len(seq) % 2 else ""))) if seq else b""
    tags = b"".join(t + b"i" + struct.pack("<i", row[c]) for t, c in ((b"AS", "as_score"), (b"XS", "xs_score")) if row[c] is not None)
    ref = refs.get(row["ref"], -1)
    body = struct.pack("<iiBBHHHiiii", ref, row["pos"] - 1, len(name), row["mapq"] or 0, 4680, len(ops), row["flag"], len(seq), -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *ops) + four + qual + tags
    return struct.pack("<i", len(body)) + body


def _cigar(text: str) -> list[int]:
    out, n = [], 0
    for c in text:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append(n << 4 | "MIDNSHP=X".index(c))
            n = 0
    return out


@dataclass
class Range(InputPartition):
    uri: str
    size: int
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.unmapped = {"0": 0, "1": 1, "": None}[options.get("unmapped", "")]

    def partitions(self):
        return [Range(uri, size, a, min(a + self.split, size)) for uri, size in _files(self.path) for a in range(0, size, self.split)]

    def read(self, part: Range):
        at, path = _open(part.uri)
        with at.open_input_file(path) as f:
            blocks = Blocks(f, part.size)
            header, first, skip = _header(blocks)
            # The block in which the header ends is the first one with records; its place in it is known.
            begin = first if part.start <= first else blocks.first(part.start, part.end)
            if begin >= part.end:
                return
            skip = skip if begin == first else None
            yield from self._records(blocks, begin, part.end, skip, header.refs)

    def _records(self, blocks: Blocks, begin: int, end: int, skip: int | None, refs):
        """Records that begin in blocks from begin to before end, from skip on or from where the first one is found."""
        held, k, rows, inside = b"", skip, [], True
        limit = None  # where, in held, the blocks of this range end
        source = blocks.read(begin)
        while True:
            if limit is None:
                nxt = next(source, None)
                if nxt is None or nxt[0] >= end:
                    limit = len(held)
                    if nxt is not None:
                        held += nxt[1]
                else:
                    held += nxt[1]
            else:
                nxt = next(source, None)
                if nxt is not None:
                    held += nxt[1]
            done = nxt is None
            if k is None:
                found = first_record(held, refs)
                if found < 0 or (limit is not None and found >= limit):
                    if limit is not None:
                        return
                    continue
                if limit is None and len(held) - found < 1 << 16:
                    continue  # more blocks make the chain longer
                k = found
            while inside and (limit is None or k < limit) and len(held) >= k + 4:
                n = struct.unpack_from("<i", held, k)[0] + 4
                if len(held) < k + n:
                    break
                flag = struct.unpack_from("<H", held, k + 18)[0]
                if self.unmapped is None or flag >> 2 & 1 == self.unmapped:
                    rows.append(decode(held, k, n, refs))
                k += n
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows = []
            if done or (limit is not None and k >= limit):
                break
            held, k, limit = held[k:], 0, None if limit is None else limit - k
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class _FilteringReader(_Reader):
    """A reader that takes filters on `unmapped`, for sessions that hand filters on."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("unmapped",) and f.value in (0, 1):
                self.unmapped = int(f.value)
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """One file a task: header, records in the rows' order, and the empty block at the end."""

    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path = options["path"]
        self.refs = [(n, int(k)) for n, k in (x.split(":") for x in options["refs"].split(","))]
        self.columns = columns
        at, path = _open(self.path)
        at.create_dir(path, recursive=True)
        self.before = [u for u, _ in _files(self.path)] if overwrite else []

    def write(self, iterator):
        at, path = _open(self.path)
        name = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}.bam"
        text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.refs)
        held = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in self.refs)
        of = {n: i for i, (n, _) in enumerate(self.refs)}
        with at.open_output_stream(name, compression=None) as f:
            for row in iterator:
                held += encode(row, of)
                while len(held) >= _BLOCK:
                    f.write(deflate(held[:_BLOCK]))
                    held = held[_BLOCK:]
            f.write(deflate(held))
            f.write(_END)
        return _Written(name)

    def commit(self, messages):
        for uri in self.before:
            at, path = _open(uri)
            at.delete_file(path)

    def abort(self, messages):
        for m in messages:
            if m is not None:
                at, path = _open(self.path)
                at.delete_file(m.path)


class BamSource(DataSource):
    """spark.read.format("bam"), df.write.format("bam"). Options: path; split, bytes of a task; unmapped, 0 or 1; pushdown, whether the session hands on filters; of the writer refs, as name:length,name:length."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (_FilteringReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema.names, overwrite)


def read_bam(spark: SparkSession, path: str, unmapped: bool | None = None, split: int = SPLIT) -> DataFrame:
    """(name, tag, ref, flag, pos, len, as_score, xs_score, seq, unmapped), as text.read_sam has them.

    path is a file or a folder of .bam files; pos is 1-based, names lose their role tag. With
    unmapped only such records, or none of them, are decoded.
    """
    from strandloom.operators.reads import split_name

    spark.dataSource.register(BamSource)
    d = spark.read.format("bam").option("path", path).option("split", split).option("unmapped", "" if unmapped is None else str(int(unmapped)))
    d = d.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()
    pair, tag = split_name(F.col("name"))
    return d.select(pair.alias("name"), tag.alias("tag"), F.regexp_replace("ref", "^chr", "").alias("ref"), "flag", "pos", F.char_length("seq").alias("len"), "as_score", "xs_score", "seq", "unmapped")


def read_bams(spark: SparkSession, paths: list[str], unmapped: bool | None = None) -> DataFrame:
    """read_bam of several files or folders, as of two mates' mappings and of later ones: their rows together.

    Alignments of one read meet in reads.integrate, whose one shuffle on the name takes the place
    of merging files sorted by name.
    """
    out = read_bam(spark, paths[0], unmapped)
    for p in paths[1:]:
        out = out.unionByName(read_bam(spark, p, unmapped))
    return out


def write_bam(records: DataFrame, path: str, refs: list[tuple[str, int]]) -> None:
    """records(name, flag, ref, pos, mapq, cigar, seq, qual, as_score, xs_score) as a folder of files, a file a partition, in the partitions' order."""
    records.sparkSession.dataSource.register(BamSource)
    columns = [f.split()[0] for f in SCHEMA.split(", ")][:-1]
    d = records.select(*columns).withColumn("unmapped", F.col("flag").bitwiseAND(4).cast("boolean").cast("int"))
    d.write.format("bam").mode("append").option("path", path).option("refs", ",".join(f"{n}:{k}" for n, k in refs)).save()
