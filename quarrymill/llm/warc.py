"""WARC archives with a two-level capture index.

Records go to gzip-per-record WARC files, one file or more a task. Their captures, keyed by the
URL with its host reversed, are range-partitioned and sorted; each task writes its run as gzip
blocks of some thousand lines (the first level). A Parquet table, sorted alike, holds the first key and the place
of each block (the second level). A look-up sorts the wanted keys among the first keys, which gives each its blocks,
then bisects the lines of a block, then reads the byte ranges of the records. All of it runs in tasks, over any number
of keys; what a key has many captures of is spread by blocks.

Layout under a root: warc/*.warc.gz, index/*.cdx.gz, captures/ and directory/ (Parquet). Files are
written under names that no other attempt uses, and only files named by `captures` or
`directory` count, so tasks can be repeated.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import materialise, partitions, with_row_key

BLOCK_LINES = 3000
FILE_BYTES = 512 << 20
READ_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host reversed and joined by commas, then path and query.

    The scheme, user and fragment are dropped. Null gives the empty key; what has no host is its
    own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=row & ((1 << 64) - 1) | 0x4000 << 64 | 2 << 126)}>"


def _record(row: int, page_id: str | None, url: str | None, payload: bytes, digest: str, size: int, first_row: int | None, refers_to: str | None) -> bytes:
    """One record, compressed. A revisit (first_row given) holds no payload."""
    revisit = first_row is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(row)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first_row))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", refers_to))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _make_dirs(root: str) -> None:
    fs, path = pafs.FileSystem.from_uri(root)
    for d in ("warc", "index"):
        fs.create_dir(f"{path}/{d}", recursive=True)


def write_archive(pages: DataFrame, root: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 100) -> None:
    """Write a record for each row of `pages`, and the index, under the URI `root`.

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of
    `least_revisit` bytes or more, the one with the smallest page_id (null last; of equal ids,
    the first row) is the response and the others revisit it. Shorter ones are all responses.
    Other columns are not read. Without rows the archive is empty.
    """
    _make_dirs(root)
    rows = with_row_key(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")), "row")
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    small = materialise(rows.where(F.col("size") >= least_revisit).select("row", "page_id", "digest"), "warc-digests")
    first = small.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")).where("n > 1")
    # Written, so that both sides of the join are exchanged and a payload that a third of the pages share can be split.
    first = materialise(first.select("digest", "first"), "warc-first")
    again = small.join(first.hint("merge"), "digest").where("row != first.row")
    again = again.select(F.col("row").alias("again"), F.col("first.row").alias("first_row"), F.col("first.page_id").cast("string").alias("refers_to"))
    todo = rows.join(again.hint("merge"), rows["row"] == again["again"], "left").select("row", F.col("page_id").cast("string").alias("page_id"), "url", F.when(F.col("first_row").isNull(), F.col("payload")).alias("payload"), "digest", "size", "first_row", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        out = None
        for batch in batches:
            keys, files, places, sizes, ids, urls = [], [], [], [], [], []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row, pid, address, payload, digest, size, first_row, refers_to = (c[i].as_py() for c in columns)
                data = _record(row, pid, address, payload or b"", digest, size, first_row, refers_to)
                if out is None or out.tell() > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"warc/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                keys.append(url_key(address))
                files.append(name)
                places.append(out.tell())
                sizes.append(len(data))
                ids.append(pid)
                urls.append(address)
                out.write(data)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "file": pa.array(files, pa.string()), "place": pa.array(places, pa.int64()), "length": pa.array(sizes, pa.int64()), "page_id": pa.array(ids, pa.string()), "url": pa.array(urls, pa.string())})
        if out is not None:
            out.close()

    spark = pages.sparkSession
    fields = "key string, file string, place long, length long, page_id string, url string"
    todo.mapInArrow(write, fields).write.option("compression", "zstd").parquet(f"{root}/captures")
    captures = spark.read.schema(fields).parquet(f"{root}/captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        name, out, lines, found = f"index/{uuid.uuid4().hex}.cdx.gz", None, [], []

        def flush() -> None:
            nonlocal out
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = pack.compress("".join(x for _, x in lines).encode()) + pack.flush()
            found.append((lines[0][0], lines[-1][0], name, out.tell(), len(data), len(lines)))
            out.write(data)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                lines.append((r["key"], json.dumps([r["key"], r["file"], r["place"], r["length"], r["page_id"], r["url"]]) + "\n"))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({k: pa.array([f[i] for f in found], t) for i, (k, t) in enumerate((("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("place", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())))})

    order = ["key", "file", "place"]
    ordered = captures.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(index, "first_key string, last_key string, file string, place long, length long, lines long").write.parquet(f"{root}/directory")

#: Captures that a look-up hands on together.
HITS_AT_ONCE = 4096


class _Files:
    """Byte ranges of files under a root, the last file kept open."""

    def __init__(self, root: str):
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        self.name, self.file = None, None

    def read(self, name: str, place: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, place)


_DIRECTORY = "first_key string, last_key string, file string, place long, length long, lines long"


def _blocks_of(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """key, file, place, length: the index blocks that may hold each of the distinct keys.

    A key's blocks are those that begin with it, and the last that begins before it. For the latter, keys and first keys are
    sorted together by ranges; what a range begins with comes from a table of one row for each range.
    """
    blocks = spark.read.schema(_DIRECTORY).parquet(f"{root}/directory")
    same = blocks.select(F.col("first_key").alias("key"), "file", "place", "length").join(wanted.hint("merge"), "key")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("last_key", "string"), ("file", "string"), ("place", "long"), ("length", "long"))]
    both = wanted.select("key", F.lit(0).alias("kind"), *none).unionByName(blocks.select(F.col("first_key").alias("key"), F.lit(1).alias("kind"), "last_key", "file", "place", "length"))
    order = ["key", "kind", "file", "place"]
    sort = materialise(both.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "warc-keys")
    part = F.shiftright("at", 33).alias("part")
    block = F.struct("last_key", "file", "place", "length")
    ends = sort.where("kind = 1").groupBy(part).agg(F.max_by(block, "at").alias("last")).orderBy("part").collect()  # a row for each partition
    before = spark.createDataFrame([(e["part"], e["last"]) for e in ends], "part long, last struct<last_key:string,file:string,place:long,length:long>")
    # Partitions without a block pass on what the one before them had.
    parts = sort.select(part).distinct().unionByName(before.select("part")).distinct()
    carried = parts.join(before, "part", "left").withColumn("carried", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "carried")
    inside = F.last(F.when(F.col("kind") == 1, block), True).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    found = sort.withColumn("part", part).withColumn("inside", inside).join(F.broadcast(carried), "part").where("kind = 0").select("key", F.coalesce("inside", "carried").alias("b"))
    return found.where("b.last_key >= key").select("key", "b.file", "b.place", "b.length").unionByName(same.select("key", "file", "place", "length"))


def lookup(spark: SparkSession, root: str, wanted: DataFrame, *, page_id_type: str = "bigint", payload: bool = True) -> DataFrame:
    """Every capture whose key is among the `key`s of `wanted` (see `url_key`); repeated and null keys, and keys without captures, add nothing.

    Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload
    (null for revisits) unless `payload` is false. Size and digest of a response are taken from
    the payload read; one that differs from its header raises.
    """

    def located(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in out], pa.string()), "place": pa.array([x[1] for x in out], pa.int64()), "length": pa.array([x[2] for x in out], pa.int64())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, lines = _Files(root), None, []
        for batch in batches:
            out: list[list] = []
            for r in batch.to_pylist():
                if now != (r["file"], r["place"]):
                    now = r["file"], r["place"]
                    lines = zlib.decompress(files.read(r["file"], r["place"], r["length"]), 31).decode().splitlines()
                at = bisect.bisect_left(lines, r["key"], key=lambda x: json.loads(x)[0])
                while at < len(lines) and (line := json.loads(lines[at]))[0] == r["key"]:
                    out.append(line[1:4])
                    at += 1
                    if len(out) == HITS_AT_ONCE:  # a key may fill many blocks
                        yield located(out)
                        out = []
            yield located(out)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    head, body = parse_record(files.read(r["file"], r["place"], r["length"]))
                    revisit, size = head["WARC-Type"] == "revisit", int(head["X-Payload-Length"])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"damaged record at {r}")
                    out.append((head.get("X-Page-Id"), head.get("WARC-Target-URI"), head["WARC-Type"], size, digest, head.get("X-Refers-To-Page-Id"), *([None if revisit else body] if payload else [])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payload else [])]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if payload else [])]
    types = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {types[k]}" for n, k in zip(names, kinds, strict=True))
    keys = materialise(wanted.select("key").where("key is not null").distinct(), "warc-wanted")
    blocks = _blocks_of(spark, root, keys).repartition(partitions(spark), "file", "place").sortWithinPartitions("file", "place", "key")
    found = blocks.mapInArrow(search, "file string, place long, length long").withColumn("part", F.floor(F.col("place") / READ_BYTES))
    found = found.repartition(partitions(spark), "file", "part").sortWithinPartitions("file", "place").select("file", "place", "length")
    return found.mapInArrow(records, schema).withColumns({c: F.col(c).cast(page_id_type) for c in ("page_id", "refers_to")})


def keys_of(urls: DataFrame, url: str = "url") -> DataFrame:
    """The `key` of each URL of a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())], ["key"])

    return urls.select(F.col(url).cast("string")).mapInArrow(run, "key string")


def read_archive(spark: SparkSession, root: str, **options) -> DataFrame:
    """Every record of an archive: a look-up of all the keys that its captures have (see `lookup`)."""
    return lookup(spark, root, spark.read.schema("key string").parquet(f"{root}/captures"), **options)
