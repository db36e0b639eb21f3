"""WARC archives of web pages: writing, an index merged from local runs, and reading.

Every task writes gzip-member archives to the shared folder, together with a run of index rows
sorted by URL key and time. A payload of some size that several captures share is stored once;
the other captures are revisit records. The runs are dealt to ranges of the global order, each of
a bounded number of rows, and in each range a loser tree merges the runs' parts, which gives
globally ordered capture histories. Records are read by the merged index alone: by file, offset
and length, and each must be the one that its index row names. Archives are named by task attempt,
and only the index rows of the attempts that counted name them, so lost executors leave at most
files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, scratch_path

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
_ROLL_BYTES = 64 << 20
#: Index rows of a range of the merged index, and bytes of one archive that a task reads at a time.
_RANGE_ROWS, _READ_BYTES = 200_000, 16 << 20
_EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "run string, run_pos long, url_key string, ts string, page_id long, record_type string, digest string, payload_bytes long, refers_to long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, without scheme, user, fragment or a leading www."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url or "", re.I)
    if not m:
        return (url or "").split("#")[0]
    host, _, port = m[1].lower().partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def written(url: str | None) -> str:
    """A URL as a record's header holds it; the index is keyed by this form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")


def capture_time(page_id: int | None) -> str:
    """A page's capture time; pages carry none, so their ids count seconds."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(url: str | None, page_id: int | None, record_type: str, refers_to: int | None, payload: bytes, digest: bytes, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if record_type == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {capture_time(page_id)}"]
    if url:
        head.append("WARC-Target-URI: " + written(url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(path: str, mode: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    if mode == "at":
        return system.open_input_file(name)
    return system.open_input_stream(name, compression=None, buffer_size=1 << 20)


def _write(folder: str):
    def run(batches):
        import pyarrow as pa

        ctx = TaskContext.get()
        task = f"{ctx.stageId()}-{ctx.partitionId()}-{ctx.taskAttemptId()}" if ctx else "local"
        number, out, offset, rows = 0, None, 0, []

        def finish():
            out.close()
            rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
            cols = list(zip(*rows))
            run_name = [file] * len(rows)
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(run_name), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], ["run", "run_pos", "url_key", "ts", "page_id", "record_type", "digest", "payload_bytes", "refers_to", "file", "offset", "length"])

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    file = f"{folder}/pages-{task}-{number:05d}.warc.gz"
                    out, offset, rows, number = _open(file, "w"), 0, [], number + 1
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).digest()
                kind = "response" if refers is None else "revisit"
                data = _gzip(record_bytes(url, page_id, kind, refers, payload, digest, len(payload)))
                out.write(data)
                rows.append((url_key(written(url)), capture_time(page_id), page_id, kind, digest.hex(), len(payload), refers, file, offset, len(data)))
                offset += len(data)
                if offset >= _ROLL_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); returns the index, as sorted runs.

    Of records with equal payloads of at least least_bytes bytes that with the largest page_id
    is a response, and those with a smaller or no id revisit it; rows that repeat that id are
    responses too. Payloads are html in UTF-8; a null html is an empty payload.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    large = F.octet_length("html") >= least_bytes
    p = p.withColumn("key", F.when(large, F.sha1(payload)))
    shared = p.where(large).groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("k")).where("k > 1 and last is not null").select("key", "last")
    # Copies are few or many rows of one key: only the keyed side is dealt by key, and AQE splits large keys.
    p = p.join(materialize(shared, "shared"), "key", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("last"), F.lit(False)), F.col("last"))
    with arrow_batches(pages.sparkSession, 500):
        return materialize(p.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write(folder), _INDEX), "index")


class LoserTree:
    """K-way merge of sorted iterators: each inner node holds the loser of its match, so the next item costs one path to the root."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.items = [next(r, None) for r in self.runs] + [None] * (self.k - len(self.runs))
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.items[a], self.items[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for its opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while True:
            i = self.losers[0]
            item = self.items[i]
            if item is None:
                return
            yield i, item
            self.items[i] = next(self.runs[i], None)
            self._play(i)


def _merge(batches):
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    runs = t.column("run").to_pylist()
    number = {r: i for i, r in enumerate(sorted(set(runs)))}
    run = np.array([number[r] for r in runs])
    order = np.lexsort((np.array(t.column("run_pos")), run))
    keys = list(zip(t.column("url_key").to_pylist(), t.column("ts").to_pylist(), [-1 if x is None else x for x in t.column("page_id").to_pylist()]))
    begin = np.append(np.flatnonzero(np.diff(run[order], prepend=-1)), len(order))
    parts = [order[a:b] for a, b in zip(begin, begin[1:])]
    merged = [j for _, (_, j) in LoserTree(((keys[j], int(j)) for j in part) for part in parts)]
    out = t.take(pa.array(merged))
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    out = out.append_column("index_part", pa.array(np.full(len(merged), part, np.int32))).append_column("index_pos", pa.array(np.arange(len(merged), dtype=np.int64)))
    yield from out.to_batches(max_chunksize=10000)


def merge_index(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """The runs as one index, ordered by (url_key, ts, page_id): by index_part, then index_pos within it.

    Ranges have about _RANGE_ROWS rows each, however large the index is or however many captures
    one URL has; equal rows stay together. A null page_id comes first.
    """
    n = partitions or max(1, -(-index.count() // _RANGE_ROWS))
    return index.repartitionByRange(n, "url_key", "ts", "page_id").mapInArrow(_merge, _INDEX + ", index_part int, index_pos long")


def read_records(stream):
    """(WARC headers, HTTP headers, body) of each record of a gzip-member archive, one member in memory at a time."""
    buffer, z, data = b"", zlib.decompressobj(31), bytearray()
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                break
        data += z.decompress(buffer)
        buffer = z.unused_data
        if not z.eof:
            continue
        z = zlib.decompressobj(31)
        head, _, block = bytes(data).partition(b"\r\n\r\n")
        data = bytearray()
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        warc = dict(x.split(": ", 1) for x in lines[1:])
        block = block[: int(warc["Content-Length"])]
        http, _, body = block.partition(b"\r\n\r\n")
        yield warc, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), body


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, capture long, last_page_id long"


def _read(batches):
    """Index rows, by file and offset -> what their records say, and their place in the history that the index has."""
    import pyarrow as pa

    def page(name: str | None):
        return int(name[len("<urn:page:") : -1]) if name and name != "<urn:page:>" else None

    name, stream = None, None
    try:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if stream is not None:
                        stream.close()
                    name, stream = row["file"], _open(row["file"], "at")
                stream.seek(row["offset"])
                found = list(read_records(io.BytesIO(stream.read(row["length"]))))
                if len(found) != 1:
                    raise ValueError(f"no record of {row['length']} bytes at {row['offset']} of {name}")
                warc, http, body = found[0]
                declared = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind, size = warc["WARC-Type"], int(http["Content-Length"])
                if kind == "response" and (hashlib.sha1(body).hexdigest() != declared or len(body) != size):
                    raise ValueError(f"damaged record at {row['offset']} of {name}")
                one = (page(warc["WARC-Record-ID"]), size, declared, kind, page(warc.get("WARC-Refers-To")))
                if (*one, url_key(warc.get("WARC-Target-URI")), warc["WARC-Date"]) != (row["page_id"], row["payload_bytes"], row["digest"], row["record_type"], row["refers_to"], row["url_key"], row["ts"]):
                    raise ValueError(f"another record than the index names at {row['offset']} of {name}")
                rows.append((*one, row["capture"], row["last_page_id"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], [x.split()[0] for x in _READ.split(", ")])
    finally:
        if stream is not None:
            stream.close()


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex SHA-1), record_type and refers_to of every record that an index names, with capture and last_page_id of histories, null where the index has none.

    Index rows are dealt by stretches of their archives and read in the order of offsets. A
    response's digest and size are taken from its payload and must be those it declares; a
    revisit's are those of the payload it refers to, as declared. A record that is not the one
    its index row names is an error. Rows that repeat are read as often.
    """
    for c in ("capture", "last_page_id"):
        if c not in index.columns:
            index = index.withColumn(c, F.lit(None).cast("long"))
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # A number of partitions of its own: the rows are few, but the bytes behind them are not.
    n = max(1, -(-size // _READ_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    dealt = index.repartition(n, "file", F.floor(F.col("offset") / _READ_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read, _READ)


def histories(merged: DataFrame) -> DataFrame:
    """A merged index with capture (from 1) and last_page_id, the capture before, of each row among its URL key's, in the index's order.

    One URL may have any share of the captures, so both come from neighbours in the index and from
    counts of its ranges; only a range's own rows meet in a window.
    """
    inside = Window.partitionBy("index_part").orderBy("index_pos")
    of_key = Window.partitionBy("index_part", "url_key").orderBy("index_pos")
    ranges = merged.groupBy("url_key", "index_part").agg(F.count(F.lit(1)).alias("n"), F.max_by("page_id", "index_pos").alias("page"))
    # Few rows: a key of several ranges has one row in each.
    over = Window.partitionBy("url_key").orderBy("index_part")
    ranges = ranges.select("url_key", "index_part", (F.sum("n").over(over) - F.col("n")).alias("earlier"), F.lag("page").over(over).alias("page"))
    m = merged.withColumn("nth", F.row_number().over(of_key)).withColumn("before", F.lag("page_id").over(inside))
    m = m.join(ranges, ["url_key", "index_part"])
    return m.select(*merged.columns, (F.col("earlier") + F.col("nth")).cast("long").alias("capture"), F.when(F.col("nth") > 1, F.col("before")).otherwise(F.col("page")).alias("last_page_id"))


def archive_and_read(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write pages to archives, merge their index, and read back the records that the merged index names.

    One row a page, with its place among the captures of its URL as the merged index orders them;
    see write_archives, histories and read_archives. An empty table gives an empty result;
    columns other than page_id, url and html are ignored. A record, of whatever length, is
    written and read in one task.
    """
    merged = materialize(merge_index(write_archives(pages, least_bytes=least_bytes)), "merged")
    return read_archives(materialize(histories(merged), "histories"))
