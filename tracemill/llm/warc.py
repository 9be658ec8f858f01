"""Deterministic sharded WARC writer and its reader.

Writing: payload digests are taken first (one narrow table). Shards are ranges
of page_id, cut where a histogram of payload bytes says (refined where ids
cluster), so they don't depend on sampling; they are as many as the payload
asks for, up to MOST_SHARDS (beyond 800 GB a shard grows, to 1.5 GB at 100 TB;
it streams). The pages are shuffled once, by
shard; which page a record revisits travels in small rows that sort just
before the page's own row. Each shard (some `shard_bytes` of payload) writes
its records in page order as one gzip member each, and starts a new file once
the compressed size passes `roll_bytes`. A file is written under a temporary name that carries the task
attempt and moved to its own name when it is closed, so a retried or
speculative task replaces it by the same bytes. The manifest (file, records,
bytes, SHA-1) is written by Spark when all shards are done; the reader opens
only files that it lists. Headers, record ids and dates derive from the rows.

Records with equal payloads (by SHA-1) of at least `least` bytes: the one with
the largest page_id is a response, the others revisit it.

Given cases: null html is an empty payload; a null page_id sorts first and
counts as the smallest; rows that repeat a page_id with an equal payload are
all responses if that id is the largest, else all revisits; null url becomes
urn:page:<id>, line breaks in a url are percent-coded; an empty table gives an
empty archive and result; other columns are ignored. One page_id stays in one
shard, which streams, so memory is bounded by a record, however long. Payloads
that very many pages share are joined from a broadcast list, which holds
MOST_HOT of them at most.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.batches import small_batches
from tracemill.llm.sharding import points_before
from tracemill.session import fresh_path, stored

SLICE = 8 << 10  # compressed bytes that are handed on at a time
MOST_HOT = 10_000
LITERALS, MOST_SHARDS = 4096, 65_536  # shards in the plan itself; shards at all, since a shuffle has blocks for each with every task
DATE = "2024-01-01T00:00:00Z"
CELLS = 1024
MANIFEST = "file string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, sha1_hex: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{sha1_hex}"))


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; refers_to is the page that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}^`\\\"<>") if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id, sha1_hex)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, sha1_hex)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A record's row as in RECORD; digests and lengths that don't fit are an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't fit")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't fit")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("X-Page-Id"), fields["WARC-Target-URI"], payload, int(fields["X-Payload-Length"]), digest, kind, number("X-Refers-To-Page-Id")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        view, at = memoryview(data), 0
        while at < len(view):
            piece = view[at : at + SLICE]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
            if z.eof:
                yield b"".join(parts)
                parts, z = [], zlib.decompressobj(31)
    if parts:
        raise ValueError("the last member is cut off")


class Roller:
    """Writes members to numbered files of a shard under temporary names."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.roll_bytes, self.shard, self.out, self.done = roll_bytes, None, None, []
        self.attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0

    def put(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:05d}-{self.number:05d}.warc.gz"
            self.fs.create_dir(f"{self.root}/_temporary-{self.attempt}")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/_temporary-{self.attempt}/{self.name}", compression=None), 0, 0, hashlib.sha1()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.root}/_temporary-{self.attempt}/{self.name}", f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None
            self.number += 1

    def finish(self) -> list[tuple]:
        self.close()
        if self.done:
            self.fs.delete_dir(f"{self.root}/_temporary-{self.attempt}")
        return self.done


def shard_starts(sizes: DataFrame, shard_bytes: int, most: int = MOST_SHARDS) -> list[int]:
    """First page_ids of all shards but the first; shards are larger where `most` of them wouldn't do. sizes(page_id, bytes). Each pass brings at most CELLS rows per refined range to the driver."""
    whole = sizes.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum(F.col("bytes") + 512).alias("n")).first()
    if whole["lo"] is None:
        return []
    target = max(shard_bytes, -(-whole["n"] // most))
    done: list[tuple[int, int]] = []
    ranges = [(whole["lo"], whole["hi"])]
    while ranges:
        cells = []
        for lo, hi in ranges:
            width = max(1, -(-(hi - lo + 1) // CELLS))
            inside = sizes.where((F.col("page_id") >= lo) & (F.col("page_id") <= hi))
            first = (F.col("page_id") - lo) - F.pmod(F.col("page_id") - lo, F.lit(width)) + lo
            for r in inside.groupBy(first.alias("first")).agg(F.sum(F.col("bytes") + 512).alias("n")).collect():
                cells.append((r["first"], min(hi, r["first"] + width - 1), r["n"]))
        ranges = [(a, b) for a, b, n in cells if n > target and b > a]
        done += [(a, n) for a, b, n in cells if n <= target or b == a]
    starts, held = [], 0
    for first, n in sorted(done):
        if held and held + n > target:
            starts.append(first)
            held = 0
        held += n
    return starts


def partition_numbers(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning deals to a partition each."""
    found = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    by = {r["p"]: r["id"] for r in found}
    return [by.get(p, p) for p in range(n)]


def placed(rows: DataFrame, starts: list[int]) -> DataFrame:
    """rows(page_id, ...) with `shard`, and `dealt`, by which repartition() gives every shard a partition of its own.

    Up to LITERALS shards are looked up in the plan; beyond, in two steps: blocks
    of shards in the plan, and the shards of each block in a broadcast table, of
    16 bytes a shard, so at most a megabyte.
    """
    n, spark = len(starts) + 1, rows.sparkSession
    numbers = partition_numbers(spark, n)
    step = -(-n // LITERALS)
    before = lambda points: F.coalesce(points_before(F.col("page_id"), points, equal=True), F.lit(0))
    if step == 1:
        return rows.withColumn("shard", before(starts)).withColumn("dealt", F.element_at(F.array(*[F.lit(x).cast("long") for x in numbers]), F.col("shard") + 1))
    blocks = [(c, c * step, starts[c * step : (c + 1) * step - 1], numbers[c * step : (c + 1) * step]) for c in range(-(-n // step))]
    table = F.broadcast(spark.createDataFrame(blocks, "__block int, __first int, __starts array<long>, __numbers array<long>"))
    heads = [starts[first - 1] for _, first, _, _ in blocks[1:]]
    inside = F.size(F.filter("__starts", lambda s: s <= F.col("page_id")))
    found = rows.withColumn("__block", before(heads)).join(table, "__block").withColumn("__inside", inside)
    return found.select(*rows.columns, (F.col("__first") + F.col("__inside")).alias("shard"), F.element_at("__numbers", F.col("__inside") + 1).alias("dealt"))


def write(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = 12 << 20, roll_bytes: int = 2 << 20) -> DataFrame:
    """Write pages(page_id, url, html) as archives into folder and return its manifest."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    facts = stored(pages.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes")), "warc-digests")
    groups = facts.where(F.col("bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    often = max(1000, -(-facts.count() // MOST_HOT))
    hot, few = groups.where(F.col("n") > often).drop("n"), groups.where(F.col("n") <= often).drop("n")
    revisits = facts.join(F.broadcast(hot), "sha1").unionByName(facts.join(F.broadcast(hot.select("sha1")), "sha1", "left_anti").join(few, "sha1"))
    notes = revisits.where((F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()

    starts = shard_starts(facts, shard_bytes)
    rows = pages.select("page_id", F.sha1("payload").alias("sha1"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    dealt = placed(rows.unionByName(notes.withColumn("kind", F.lit(0)), allowMissingColumns=True), starts)
    ordered = dealt.repartition(len(starts) + 1, "dealt").sortWithinPartitions("shard", "page_id", "sha1", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, note = Roller(folder, roll_bytes), (None, None, None)
        for b in batches:
            for page_id, sha1, kind, url, payload, refers_to, shard in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    note = (page_id, sha1, refers_to)
                    continue
                to = note[2] if note[:2] == (page_id, sha1) else None
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.put(shard, z.compress(record(page_id, url, payload, sha1, to)) + z.flush())
        if done := out.finish():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["file", "records", "bytes", "sha1"])

    made = ordered.select("page_id", "sha1", "kind", "url", "payload", "refers_to", "shard").mapInArrow(run, MANIFEST)
    made.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that folder's manifest lists, in RECORD's columns (payload left null if not asked for)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = max(1, min(manifest.count(), 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for name in b.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for m in members(f):
                        row = parse(m)
                        held.append(row if payloads else (*row[:2], None, *row[3:]))
                        size += len(m)
                        if size > 8 << 20 or len(held) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return manifest.select("file").repartition(files).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, **params) -> DataFrame:
    """Write pages, read the archives back, and return a row per record without its payload."""
    folder = fresh_path(pages.sparkSession, "warc")
    write(pages, folder, **params)
    return read(pages.sparkSession, folder, payloads=False).drop("payload")
