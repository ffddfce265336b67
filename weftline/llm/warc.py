"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page_id and payload digest and cut into shards of about equal payload bytes. The cuts are exact
quantiles: the distinct (id, digest) keys are range-sorted with their bytes, and a key's place is the sum of what lies before it,
whatever the partitioning. So ids may be dense, sparse, null or all the same. Each shard is written by one task
that streams its records, one gzip member each, and rolls to a new file at a compressed size. A file is written under
a temporary name and renamed when whole; a rerun task writes the same bytes to the same name. The list of files of a
shard is its manifest row; the manifest is written last, and readers take only the files that it names.

Payloads are the html in UTF-8 (null: empty). Of records with equal payloads of ``REVISIT_BYTES`` or more the one of
least page_id is the response, the rest are revisits without a payload block; a null page_id sorts last and is
kept as null. Rows equal in page_id and payload are written as they come, and are all responses if theirs is the least id;
they share a shard. A page of any size is one record. An empty table gives no file and an empty result; other columns are not
read. The folder may be on any store that pyarrow reaches (``file``, ``hdfs``, ``s3``...).
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import MAX_LONG, fresh_dir, materialize, remove, ship

REVISIT_BYTES = 100
#: Compressed bytes at which a file is closed, gzip level.
ROLL_BYTES, LEVEL = 16 << 20, 2
#: Payload bytes of a shard: a 64th of the table within these limits.
SHARD_SPLIT, SHARD_LEAST, SHARD_MOST = 64, 1 << 20, 512 << 20
#: Files of a manifest up to which it is broadcast to the readers (names of 26 bytes).
MANIFEST_BROADCAST = 200_000
#: Bytes that a record has besides its payload, about.
OVERHEAD = 512
#: Records carry one fixed date, so archives of one table are equal byte by byte.
DATE = "2024-01-01T00:00:00Z"
_NULL_ID = "null"


def shard_starts(described: DataFrame, shard_bytes: int | None = None) -> list[tuple[int, int]]:
    """First (id, mark) of each shard, in order: one key for each shard's bytes, so few."""
    keys = described.groupBy("id", "mark").agg(F.sum(F.col("payload_bytes") + OVERHEAD).alias("size"))
    ranged = materialize(keys.repartitionByRange("id", "mark").withColumn("part", F.spark_partition_id()), "keys")
    parts = sorted(ranged.groupBy("part").agg(F.sum("size").alias("size")).collect())  # a row for each partition
    total = sum(r["size"] for r in parts)
    if not total:
        return []
    shard_bytes = shard_bytes or min(SHARD_MOST, max(SHARD_LEAST, total // SHARD_SPLIT))
    before, offsets = 0, []
    for part, size in parts:
        offsets.append((part, before))
        before += size
    ahead = described.sparkSession.createDataFrame(offsets, "part int, ahead long")
    order = Window.partitionBy("part").orderBy("id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))
    placed = ranged.join(F.broadcast(ahead), "part").withColumn("shard", F.floor(place / shard_bytes))
    starts = sorted(tuple(r["first"]) for r in placed.groupBy("shard").agg(F.min(F.struct("id", "mark")).alias("first")).collect())
    remove(ranged)
    return starts


def _shard(starts: list[tuple[int, int]]):
    """The shard of an (id, mark): the number of starts at or below it, less one. Only these two columns pass to Python."""
    ids, marks = (np.array([s[k] for s in starts] or [0], np.int64) for k in (0, 1))

    @F.pandas_udf("int")
    def shard(id_: pd.Series, mark: pd.Series) -> pd.Series:
        id_, mark = id_.to_numpy(), mark.to_numpy()
        low, high = np.searchsorted(ids, id_, "left"), np.searchsorted(ids, id_, "right")
        below = low.copy()
        for split in np.unique(id_[high > low]):  # ids at which a shard starts
            rows = np.flatnonzero(id_ == split)
            a, b = low[rows[0]], high[rows[0]]
            below[rows] = a + np.searchsorted(marks[a:b], mark[rows], "right")
        return pd.Series(np.maximum(below - 1, 0).astype(np.int32))

    return shard


def _mark(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def digests(pages: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, mark) of every page; id is page_id, null as the greatest long."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    named = pages.select(F.coalesce("page_id", F.lit(MAX_LONG)).alias("id"), F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    return named.withColumn("mark", _mark(F.col("payload_digest")))


def revisits(described: DataFrame) -> DataFrame:
    """(id, payload_digest, refers_to) of the pages that revisit another."""
    large = described.where(F.col("payload_bytes") >= REVISIT_BYTES).select("id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return large.join(first, "payload_digest").where("id > refers_to").select("id", "payload_digest", "refers_to").distinct()


def _one_line(text: str) -> str:
    return " ".join(text.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; its id, digests and lengths follow from the content."""
    name = _NULL_ID if page_id is None else str(page_id)
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{name}:{digest}")
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Page-ID: {name}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Rolling files of one shard."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.roll, self.shard, self.out, self.done = roll, None, None, []

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.path}/_temporary-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
            self.number += 1
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.path}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.digest.hexdigest()))
            self.out = None


def _writer(folder: str, roll: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, refers, at = _Files(folder, roll), {}, None
        for batch in batches:  # of each (id, mark) the revisit rows come first, then its pages
            for shard, id_, mark, page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (id_, mark) != at:
                    refers, at = {}, (id_, mark)
                if refers_to is not None:
                    refers[digest] = refers_to
                else:
                    payload = (html or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    files.add(shard, _gzip(record(page_id, url, payload, digest, refers.get(digest)), level))
        files.close()
        columns = [pa.array(c) for c in zip(*files.done, strict=True)]
        if columns:
            yield pa.RecordBatch.from_arrays(columns, ["name", "records", "bytes", "sha256"])

    return write


def write_archive(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shard_bytes: int | None = None, level: int = LEVEL) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files into the new ``folder``; returns the manifest, which is also written."""
    spark = pages.sparkSession
    ship(spark)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    described = materialize(digests(pages), "digests")
    starts = shard_starts(described, shard_bytes)
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    key = F.coalesce("page_id", F.lit(MAX_LONG)).alias("id")
    mark = _mark(F.sha2(F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")), 256)).alias("mark")
    rows = pages.select(key, mark, "page_id", "url", "html", null("digest", "string"), null("refers_to", "long"))
    again = revisits(described).select(
        "id", _mark(F.col("payload_digest")).alias("mark"), null("page_id", "long"), null("url", "string"), null("html", "string"), F.col("payload_digest").alias("digest"), "refers_to"
    )
    both = rows.unionAll(again).select(_shard(starts)("id", "mark").alias("shard"), "*")
    order = ["shard", "id", "mark", F.asc_nulls_last("refers_to"), "url", "html"]
    dealt = both.repartitionByRange(max(1, len(starts)), "shard").sortWithinPartitions(*order)
    manifest = dealt.mapInArrow(_writer(folder, roll, level), "name string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/_manifest")
    remove(described)
    return spark.read.parquet(f"{folder}/_manifest")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; raises if its length or block digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in _chunks(content.as_buffer()):
                    fields, block = parse(data)
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, page = fields["WARC-Type"], fields["X-Page-ID"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(fields["X-Payload-Length"])
                    if kind == "response":
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"payload of page {page} differs from its digest")
                    refers = fields.get("X-Refers-To-Page")
                    rows.append((
                        None if page == _NULL_ID else int(page), fields["WARC-Target-URI"], size, digest, kind,
                        None if refers is None else int(refers), payload if with_payload and kind == "response" else None,
                    ))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return read


def _chunks(buffer: pa.Buffer, step: int = 1 << 16) -> Iterator[bytes]:
    """Records of a buffer of gzip members; reads on in steps, so no copy of the rest is made for each record."""
    source, left = io.BytesIO(buffer), b""
    while True:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            left = left or source.read(step)
            if not left:
                if out:
                    raise ValueError("the file ends within a record")
                return
            out.append(unpacker.decompress(left))
            left = unpacker.unused_data
        yield b"".join(out)


def read_archive(folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the files that the manifest names."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("name", "content")
    names = manifest.select("name")
    names = F.broadcast(names) if names.count() <= MANIFEST_BROADCAST else names
    return named.join(names, "name", "left_semi").select("content").mapInArrow(_reader(with_payload), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive into the shared folder and return the contract's columns of what is read back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    if ":/" not in folder:
        folder = f"file://{folder}"
    manifest = write_archive(pages, folder)
    return read_archive(folder, manifest, with_payload=False).drop("payload", "url")
