"""Deterministic sharded WARC writer, and a reader that verifies what it reads.

Pages are range-partitioned by id: byte counts per id range (all pages) give
shards of similar size, a range too heavy is refined, and an id that alone
outweighs a shard is dealt by its URL and digest.  A task sorts its shards,
writes one gzip member per record under a temporary name, rolls to the next
file once the compressed size passes a limit, renames the finished file and
reports it; the manifest is a table that exists only once every shard is
reported.  Names, record ids and dates depend on the input alone, so a task that
runs again leaves the same bytes.

Of records with equal payloads of at least ``dedup_from`` bytes the one with the
smallest id is a response, the others revisit it and carry no payload.

Defined results: a null html is an empty payload; a null url leaves out the
target; blanks and control characters of a url are percent-encoded; rows that repeat the smallest id of a payload are all responses; a null
id is never referred to, and revisits if the payload has a page with an id; an
empty table gives an archive without files.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import looked_up, map_batches
from entigraph.plans.workspace import fresh_path, saved

#: Payload bytes of a shard, at least.
SHARD_BYTES = 64 << 20
#: Compressed bytes at which a file is rolled, as a share of a shard's payload bytes: markup packs to a quarter, so a full shard has several files.
ROLL_SHARE = 1 / 16
#: No more shards than this many, and so many ranges at first: both are lists on the driver.
MOST_SHARDS, RANGES, REFINED, LEVELS = 20_000, 4096, 64, 10
#: Parts that pages without an id are dealt to.
LOOSE_PARTS = 64
DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
_READ = 1 << 20


class Range(NamedTuple):
    """Ids from ``low`` to ``high`` (inclusive), the ``coarse`` range they lie in, and their payload bytes."""

    low: int
    high: int
    coarse: int
    size: int


def _split(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    width = max(1, -(-(high - low + 1) // parts))
    return [(a, min(high, a + width - 1)) for a in range(low, high + 1, width)]


def id_ranges(meta: DataFrame, shard_bytes: int) -> tuple[list[Range], int, int]:
    """Ranges of page ids in order, none heavier than a shard unless it is one id; the first id and the coarse width."""
    ends = meta.agg(F.min("page_id"), F.max("page_id"), F.sum("payload_bytes")).first()
    if ends[0] is None:
        return [], 0, 1
    target = max(shard_bytes, -(-ends[2] // MOST_SHARDS))
    first, width = ends[0], max(1, -(-(ends[1] - ends[0] + 1) // RANGES))
    coarse = F.floor((F.col("page_id").cast("decimal(38,0)") - F.lit(first)) / F.lit(width)).cast("long")
    sizes = {r["c"]: r["b"] for r in meta.where("page_id is not null").groupBy(coarse.alias("c")).agg(F.sum("payload_bytes").alias("b")).collect()}  # at most RANGES rows
    done, heavy = [], []
    for c, size in sorted(sizes.items()):
        own = Range(first + c * width, min(ends[1], first + (c + 1) * width - 1), c, size)
        (heavy if size > target and own.low < own.high else done).append(own)
    for _ in range(LEVELS):
        if not heavy:
            break
        parts = [Range(a, b, r.coarse, 0) for r in heavy for a, b in _split(r.low, r.high, REFINED)]
        table = meta.sparkSession.createDataFrame([(k, *p[:3]) for k, p in enumerate(parts)], "k int, low long, high long, coarse long")
        found = meta.withColumn("coarse", coarse).join(F.broadcast(table), "coarse").where("page_id between low and high").groupBy("k").agg(F.sum("payload_bytes").alias("b")).collect()
        heavy = []
        for r in found:
            own = parts[r["k"]]._replace(size=r["b"])
            (heavy if r["b"] > target and own.low < own.high else done).append(own)
    return sorted(done + heavy), first, width


def shard_table(ranges: list[Range], shard_bytes: int) -> list[tuple[int, int, int, int, int]]:
    """(coarse, low, high, shard, parts): neighbouring ranges up to the size of a shard; parts deals an overweight id."""
    total = sum(r.size for r in ranges)
    target = max(shard_bytes, -(-total // MOST_SHARDS), 1)
    out, shard, held = [], 0, 0
    for r in ranges:
        if held and held + r.size > target:
            shard, held = shard + 1, 0
        out.append((r.coarse, r.low, r.high, shard, max(1, -(-r.size // target))))
        held += r.size
    return out


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_record(row: dict, date: str) -> bytes:
    payload = (row["html"] or "").encode()
    digest = row["payload_digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    name = f"page {row['page_id']} {row['url']} {digest}"
    headers = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"), ("WARC-Date", date)]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: quote(m[0]), row["url"])))
    if row["page_id"] is not None:
        headers.append(("WARC-Page-ID", str(row["page_id"])))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if row["refers_to"] is None:
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"page {row['page_id']}: the payload doesn't have its digest")
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(row["refers_to"]))]
    return _record("revisit", headers, http)


class _Files:
    """The files of one shard, written one after the other."""

    def __init__(self, root: str, stem: str, roll: int, date: str) -> None:
        self.system, self.base = file_system(root)
        self.stem, self.roll, self.date = stem, roll, date
        self.number, self.stream = 0, None

    def add(self, record: bytes) -> list[tuple]:
        done = []
        if self.stream is not None and self.size >= self.roll:
            done.append(self.close())
        if self.stream is None:
            self.temporary = f"{self.base}/.{self.stem}-{self.number:05d}.{uuid.uuid4().hex}"
            self.stream = self.system.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
            info = f"software: entigraph\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.stem}\r\n".encode()
            name = f"{self.stem}-{self.number:05d}.warc.gz"
            self._write(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
        self._write(record)
        self.records += 1
        return done

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.stream.close()
        name = f"{self.stem}-{self.number:05d}.warc.gz"
        self.system.move(self.temporary, f"{self.base}/{name}")
        self.number, self.stream = self.number + 1, None
        return name, self.records, self.size, self.digest.hexdigest()


_MANIFEST = [("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it; Spark's names of object stores are known."""
    scheme, colon, rest = root.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest if colon else root)


def write(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None, dedup_from: int = 100, date: str = DATE) -> None:
    """Write pages (page_id, url, html) as archive files below ``root``, then the manifest table ``root/manifest``.

    Without ``roll_bytes`` files are rolled at ROLL_SHARE of a shard's size.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    meta = saved(rows.drop("html", "url"), "payloads")
    repeated = meta.where(F.col("payload_bytes") >= dedup_from).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1 and _first is not null").drop("n")
    ranges, first, width = id_ranges(meta, shard_bytes)
    if roll_bytes is None:
        roll_bytes = int(ROLL_SHARE * max(shard_bytes, -(-sum(r.size for r in ranges) // MOST_SHARDS)))
    dealt_to, slots, loose = shard_table(ranges, shard_bytes), {}, 0 if meta.where("page_id is null").isEmpty() else LOOSE_PARTS
    for _, _, _, shard, parts in dealt_to:
        slots[shard] = max(slots.get(shard, 0), parts)
    first_slot = dict(zip(slots, itertools.accumulate(slots.values(), initial=0)))
    shards = spark.createDataFrame([(*r, first_slot[r[3]]) for r in dealt_to], "_coarse long, _low long, _high long, shard int, _parts int, _slot int")
    rows = looked_up(rows, saved(repeated, "repeated"), "payload_digest", F.col("page_id"))
    revisits = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    rows = rows.withColumn("refers_to", F.when(revisits, F.col("_first"))).withColumn("html", F.when(~revisits, F.col("html")))
    coarse = F.floor((F.col("page_id").cast("decimal(38,0)") - F.lit(first)) / F.lit(width)).cast("long")
    here = (F.col("_own") == F.col("_coarse")) & F.col("page_id").between(F.col("_low"), F.col("_high"))
    rows = rows.withColumn("_own", coarse).join(F.broadcast(shards), here, "left")
    spread = F.xxhash64("url", "payload_digest")
    parts = F.when(F.col("page_id").isNull(), F.lit(LOOSE_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    part = F.pmod(spread, parts).cast("int")
    total = sum(slots.values())
    rows = rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", F.coalesce("shard", F.lit(-1)).alias("shard"), part.alias("part"), (F.coalesce("_slot", F.lit(total)) + part).alias("slot"))
    # Each part of a shard is a partition of its own: no task gets two of them, and none is joined to another.
    dealt = rows.repartitionById(max(1, total + loose), "slot").drop("slot").sortWithinPartitions("shard", "part", "page_id", "payload_digest", "url")
    system, base = file_system(root)
    system.create_dir(base, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, of, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["shard"], row["part"])
                if at != of:
                    if files is not None:
                        done.append(files.close())
                    stem = f"pages-{row['shard']:06d}-{row['part']:04d}" if row["shard"] >= 0 else f"pages-noid-{row['part']:04d}"
                    files, of = _Files(root, stem, roll_bytes, date), at
                done += files.add(_page_record(row, date))
        if files is not None:
            done.append(files.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(_MANIFEST)], [n for n, _ in _MANIFEST])

    map_batches(dealt, work, "file string, records long, bytes long, sha256 string").write.parquet(f"{root}/manifest")
    # Attempts that died have left files under temporary names.
    left = fs.FileSelector(base, recursive=False)
    for file in system.get_file_info(left):
        if file.base_name.startswith(".pages-"):
            system.delete_file(file.path)


def _members(stream: pa.NativeFile, digest: "hashlib._Hash") -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := stream.read(_READ):
        digest.update(data)
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; its length and block digest are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {headers.get('warc-record-id')} is damaged")
    return headers, block


_PAGES = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]


def read(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """One row per page record of the files in the manifest; files, blocks and payloads are verified against their digests."""
    columns = _PAGES if payloads else _PAGES[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for entry in batch.to_pylist():
                digest, rows, n = hashlib.sha256(), [], 0
                with system.open_input_stream(f"{base}/{entry['file']}", compression=None) as stream:
                    for member in _members(stream, digest):
                        headers, block = parse(member)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        n += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        of = headers["warc-payload-digest"].removeprefix("sha256:")
                        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
                        own = headers["warc-type"] == "response"
                        if own and (len(payload) != size or hashlib.sha256(payload).hexdigest() != of):
                            raise ValueError(f"{entry['file']}: a payload is damaged")
                        page, to = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
                        rows.append((None if page is None else int(page), size, of, headers["warc-type"], None if to is None else int(to), headers.get("warc-target-uri"), payload if own else None))
                        if len(rows) >= 256:
                            yield _batch(rows, columns)
                            rows = []
                if digest.hexdigest() != entry["sha256"] or n != entry["records"]:
                    raise ValueError(f"{entry['file']} isn't as the manifest has it")
                yield _batch(rows, columns)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{root}/manifest")
    return map_batches(manifest.repartition(max(1, manifest.count()), "file"), work, ", ".join(f"{n} {kinds[t]}" for n, t in columns))


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])


def written_and_read(pages: DataFrame) -> DataFrame:
    """Write an archive to the shared folder and read it back."""
    root = fresh_path(pages.sparkSession, "archive")
    write(pages, root)
    return read(pages.sparkSession, root, payloads=False).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
