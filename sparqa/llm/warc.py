"""Deterministic sharded WARC writer and reader.

Records are sorted by page id, payload digest and a hash of the url and cut into shards of equal bytes; the cuts follow from byte
sums alone, not from how the input is partitioned, and fall inside an id, even between equal rows: those travel once
for each shard, with the number of records to write. A shard's task writes gzip members, one per record, and rolls to the next file once
the compressed size is reached. Headers and digests are made anew. Files are written under temporary names of the
attempt; only the files of attempts that Spark reports as done enter the manifest and get their final
names, so a lost executor or a second attempt leaves nothing behind that a reader would see.

Payloads of at least 100 bytes that occur again become revisit records that name the response's page.

Edge cases: a NULL payload is empty, a NULL url is written as empty; rows with a NULL id come last and are
responses; rows that repeat an id with one payload are all response; an empty table gives an empty manifest;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparqa.llm.common import scratch, stored

MIN_REVISIT = 100
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Rows of the plan that one task sums up; bytes that a record has besides its payload.
PLAN_ROWS = 20_000
HEAD_BYTES = 512
ORDER = ["_key", "digest", "_u"]
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
CRLF = b"\r\n"
MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string, temporary string"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    page = "" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}>"),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", page),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("X-Refers-To-Page", str(refers)))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF + CRLF


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roll:
    """The files of one shard, written under the names of this attempt."""

    def __init__(self, base: str, shard: int, roll: int):
        self.fs, self.root = _fs(base)
        self.shard, self.roll, self.seq, self.out = shard, roll, 0, None
        self.temp = f"_temporary/{uuid.uuid4().hex}"
        self.rows: list[dict] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.fs.create_dir(f"{self.root}/{self.temp}", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}/{self.name}", compression=None)
            self.size, self.count, self.sha = 0, 0, hashlib.sha256()
        member = _member(data)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append({"file": self.name, "shard": self.shard, "seq": self.seq, "records": self.count, "bytes": self.size,
                              "sha256": self.sha.hexdigest(), "temporary": f"{self.temp}/{self.name}"})
            self.out, self.seq = None, self.seq + 1


_MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()),
                       ("sha256", pa.string()), ("temporary", pa.string())])


def _writer(base: str, roll: int):
    def write(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _MANIFEST.empty_table()
        known_keys = zip(*(known[c].to_pylist() for c in ORDER), strict=True)
        told = dict(zip(known_keys, zip(known["refers_to"].to_pylist(), known["records"].to_pylist(), strict=True), strict=True))
        keys, digests, hashes, urls = (t[c].to_pylist() for c in (*ORDER, "url"))
        out = _Roll(base, t["shard"][0].as_py(), roll)
        pages, payloads = t["page_id"].combine_chunks(), t["payload"].combine_chunks()
        for i in sorted(range(t.num_rows), key=lambda i: (keys[i], digests[i], hashes[i], urls[i])):
            refers, n = told[keys[i], digests[i], hashes[i]]
            data = record(pages[i].as_py(), urls[i], payloads[i].as_py().encode(), digests[i], "response" if refers is None else "revisit", refers)
            for _ in range(n):
                out.add(data)
        out.close()
        return pa.Table.from_pylist(out.rows, _MANIFEST)
    return write


def _commit(base: str):
    """Give finished files their final names; a repeated call finds them there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(base)
        for t in batches:
            for file, temp in zip(t.column("file").to_pylist(), t.column("temporary").to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{file}")
            yield t
    return run


def plan(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(_key, digest, _u, refers_to, shard, records, split) of the distinct (page_id, payload, url), from small columns only; _key is
    the id, or above all ids where it is NULL, and _u a hash of the url.

    Where ``split``, equal rows lie on both sides of a cut: there is a row for each shard with its number of ``records``;
    elsewhere every row of the input is a record.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = stored(pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), _url_hash().alias("_u"))
                  .groupBy("page_id", "digest", "bytes", "_u").agg(F.count(F.lit(1)).alias("copies")), "warc-rows")
    ends = rows.agg(F.max("page_id"), F.count(F.lit(1))).first()
    hi, n = ends[0] or 0, ends[1] or 0
    rows = rows.withColumn("_key", F.coalesce("page_id", F.lit(hi + 1)).cast("long")).withColumn("_unit", F.col("bytes") + HEAD_BYTES)
    # bytes before each record in order: sums over ranges of rows, then inside a range
    rows = rows.withColumn("_size", F.col("_unit") * F.col("copies")).repartitionByRange(-(-n // PLAN_ROWS) or 1, *ORDER)
    rows = stored(rows.withColumn("_bin", F.spark_partition_id()), "warc-order")
    bins = rows.groupBy("_bin").agg(F.sum("_size").alias("_t"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("_bin", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_bin").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(bins, "_bin").withColumn("_at", F.col("_o") + F.col("_i"))
    at = lambda copy: F.floor((F.col("_at") + copy * F.col("_unit")) / shard_bytes).cast("int")
    rows = rows.withColumn("_first_shard", at(F.lit(0))).withColumn("split", F.col("_first_shard") < at(F.col("copies") - 1))
    rows = rows.withColumn("shard", F.explode(F.sequence("_first_shard", at(F.col("copies") - 1))))
    # equal rows that start below a cut
    below = lambda cut: F.least(F.col("copies"), F.greatest(F.lit(0), F.ceil((cut.cast("long") * shard_bytes - F.col("_at")) / F.col("_unit"))))
    rows = rows.withColumn("records", F.when(F.col("split"), below(F.col("shard") + 1) - below(F.col("shard"))).otherwise(1).cast("long"))
    rows = rows.filter("records > 0")
    first = (rows.filter(f"bytes >= {MIN_REVISIT} and page_id is not null").groupBy("digest")
             .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    rows = rows.join(first.filter("_n > 1").drop("_n"), "digest", "left")
    refers = F.when(F.col("page_id") > F.col("_first"), F.col("_first"))
    return rows.select(*ORDER, refers.alias("refers_to"), "shard", "records", "split")


def _url_hash():
    return F.md5(F.coalesce("url", F.lit("")).cast("binary"))


def write(pages: DataFrame, base: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``base``; returns the committed manifest, which is also
    stored there as ``manifest``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = stored(plan(pages, shard_bytes), "warc-plan")
    # one record per shard of 32 MB: the first in it; and the rows that a cut splits, one a shard at most
    first = sorted((tuple(r["k"]), r["shard"]) for r in known.groupBy("shard").agg(F.min(F.struct(*ORDER)).alias("k")).collect())
    starts, shards = [k for k, _ in first], [x for _, x in first]
    halved = known.filter("split").select(*ORDER, "shard")
    split = {tuple(r)[:3] for r in halved.collect()}
    last = known.agg(F.max("_key")).first()[0] or 0
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), _url_hash().alias("_u"))
    schema = "page_id long, url string, payload string, digest string, _u string, _key long, shard int"

    def placed(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                page = t.column("page_id").cast(pa.int64())
                key = page.fill_null(last)
                place = list(zip(key.to_pylist(), t.column("digest").to_pylist(), t.column("_u").to_pylist(), strict=True))
                shard = pa.array([shards[max(0, bisect.bisect_right(starts, x) - 1)] for x in place], pa.int32())
                out = pa.RecordBatch.from_arrays([page, *t.columns[1:], key, shard], ["page_id", "url", "payload", "digest", "_u", "_key", "shard"])
                yield out.filter(pa.array([(x in split) != whole for x in place], pa.bool_())) if split or not whole else out
        return run
    every = rows.mapInArrow(placed(True), schema)
    if split:
        equal = rows.mapInArrow(placed(False), schema).drop("shard").dropDuplicates(ORDER)
        every = every.unionByName(equal.join(halved, ORDER))
    rows = every
    written = stored(rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_writer(base, roll_bytes), MANIFEST), "warc-written")
    done = written.repartition(max(1, min(written.count(), 10_000)), "file").mapInArrow(_commit(base), MANIFEST).drop("temporary")
    path = f"{base}/manifest"
    done.write.parquet(path)
    return spark.read.parquet(path)


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            break
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; digests are confirmed."""
    head, _, rest = raw.partition(CRLF + CRLF)
    out = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[:int(out["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != out["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {out['WARC-Record-ID']}")
    payload = block.partition(CRLF + CRLF)[2]
    if out["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != out["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest differs in {out['WARC-Record-ID']}")
    return out | {"payload": payload}


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, base: str, payloads: bool = True) -> DataFrame:
    """The records of the committed files; a file whose size differs from the manifest is an error.

    A revisit has no payload of its own (NULL); its length and digest are those of the full one.
    """
    files = spark.read.parquet(f"{base}/manifest").select("file", "bytes")
    schema = READ if payloads else READ.rpartition(",")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(base)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        shape = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for t in batches:
            for file, size in zip(t.column("file").to_pylist(), t.column("bytes").to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{file}").size != size:
                    raise ValueError(f"{file} is not as long as its manifest says")
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for raw in _members(stream):
                        r = parse(raw)
                        revisit = r["WARC-Type"] == "revisit"
                        rows.append({"page_id": int(r["X-Page-Id"]) if r["X-Page-Id"] else None, "url": r["WARC-Target-URI"], "record_type": r["WARC-Type"],
                                     "refers_to": int(r["X-Refers-To-Page"]) if revisit else None,
                                     "payload_bytes": int(r["X-Payload-Length"]) if revisit else len(r["payload"]),
                                     "payload_digest": r["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None if revisit else r["payload"]})
                        held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in rows], shape)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in rows], shape)
    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and return what they say of every page."""
    spark = pages.sparkSession
    base = scratch(spark, "warc")
    write(pages, base)
    return read(spark, base, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
