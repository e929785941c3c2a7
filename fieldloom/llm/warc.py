"""WARC archives of web pages: a deterministic sharded writer and a verifying reader.

Records are ordered by page id and dealt to shards of about equal payload bytes; the cut
points follow from the data alone (running sums over ids), not from partitions or
executors. A shard is written by one task, which starts a new file whenever the next
compressed record would take the current one over ``roll_bytes``. Headers, lengths and
digests are made anew from the payload, so a second run gives the same files, byte for
byte. Each task attempt writes under a temporary name of its own; the attempts that
Spark counts hand in manifest rows, their files are renamed, and the manifest is written
last. Readers open what the manifest lists and nothing else.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fieldloom.operators.ranking import exclusive_prefix
from fieldloom.session import materialize

LEAST_BYTES = 100
"""Payloads of fewer bytes are never replaced by a revisit record."""
SHARD_BYTES = 64 << 20
MAX_SHARDS = 1 << 16
"""Shards grow beyond SHARD_BYTES rather than in number beyond this, so that the table of cut
points has a bound."""
ROLL_BYTES = 16 << 20
DATE = "2026-01-01T00:00:00Z"
"""Date of every record: pages carry none, and the clock would make runs differ."""
TAG = "tag:fieldloom,2026:page/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BAD = re.compile(r"[\x00-\x20\x7f]")

MANIFEST = "name string, shard int, seq int, temporary string, bytes long, records long, sha256 string, first_id long, last_id long"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder that all executors reach."""
    return fs.FileSystem.from_uri(path)


def record_id(page, digest: str, copy: int) -> str:
    return f"<{TAG}{'null' if page is None else page}/{digest[:16]}/{copy}>"


def page_of(rid: str | None) -> int | None:
    if rid is None:
        return None
    page = rid[len(TAG) + 1 :].split("/")[0]
    return None if page == "null" else int(page)


def _record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + body + b"\r\n\r\n") + packer.flush()


def info_record(name: str) -> bytes:
    body = b"software: fieldloom\r\nformat: WARC File Format 1.1\r\n"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return _record(
        [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<{TAG.replace('page', 'file')}{digest[:32]}>"),
            ("WARC-Date", DATE),
            ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"),
        ],
        body,
    )


def page_record(page, copy: int, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """A response, or with ``refers_to`` = (page,) a revisit of that page's record."""
    digest = hashlib.sha256(payload).hexdigest()
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest, copy)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], digest, 0))]
    body = http if refers_to is not None else http + payload
    headers.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}"))
    return _record(headers, body)


class _Files:
    """Rolling output of one task."""

    def __init__(self, path: str, roll_bytes: int):
        self.store, self.root = open_store(path)
        self.attempt, self.roll = uuid.uuid4().hex, roll_bytes
        self.store.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
        self.done: list[dict] = []
        self.out, self.row = None, {}

    def add(self, shard: int, page, member: bytes) -> None:
        row = self.row
        if self.out is None or row["shard"] != shard or row["records"] and row["bytes"] + len(member) > self.roll:
            seq = row["seq"] + 1 if row and row["shard"] == shard else 0
            self.close()
            name = f"{shard:06d}-{seq:05d}.warc.gz"
            temporary = f"_temporary/{self.attempt}/{name}"
            self.row = row = {"name": name, "shard": shard, "seq": seq, "temporary": temporary, "bytes": 0, "records": 0, "first_id": page}
            self.sha = hashlib.sha256()
            self.out = self.store.open_output_stream(f"{self.root}/{temporary}", compression=None)
            self._put(info_record(name))
        self._put(member)
        row["records"] += 1
        row["last_id"] = page

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.row["bytes"] += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({**self.row, "sha256": self.sha.hexdigest()})
            self.out = None


_MANIFEST_ARROW = pa.schema(
    [("name", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("bytes", pa.int64()),
     ("records", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]
)


def _writer(path: str, roll_bytes: int):
    """Task body: sorted markers and pages in, manifest rows out. The marker of an id and
    digest comes before its pages and says whom they revisit."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path, roll_bytes)
        marker, copy = None, 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("shard", "id", "mark", "target", "shared", "url", "payload")]
            for shard, page, mark, target, shared, url, payload in zip(*columns):
                if mark == 0:
                    marker, copy = (target, shared), 0
                    continue
                target, shared = marker
                refers_to = None
                if shared and target is not None and (target != page or copy):
                    refers_to = (target,)
                files.add(shard, page, page_record(page, copy, url, payload, refers_to))
                copy += 1
        files.close()
        yield pa.RecordBatch.from_pylist(files.done, _MANIFEST_ARROW)

    return write


def _commit(path: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for batch in batches:
            for row in batch.to_pylist():
                here, there = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                if store.get_file_info(here).type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    store.move(here, there)
                if store.get_file_info(there).size != row["bytes"]:
                    raise OSError(f"{there} is not whole")
            yield batch

    return rename


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write one record per row of ``pages`` below the new folder ``path``; the manifest.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least
    ``least_bytes`` the one with the smallest id is a response and the others revisit it;
    so do further copies of the row itself. A null id sorts first and is never revisited:
    it revisits a page with an id, or is a response. ids are whole numbers and may repeat;
    a null url has no target header. Other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    keys = materialize(
        rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("payload")).alias("size")),
        "warc-keys",
    )
    targets = keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("target"))
    markers = keys.join(targets, "digest", "left").withColumn("shared", F.col("size") >= least_bytes)

    weights = keys.where("id is not null").groupBy("id").agg(F.sum(F.expr("n * (size + 512)")).alias("w"))
    total = weights.agg(F.sum("w")).first()[0] or 0
    wide = max(shard_bytes, -(-total // MAX_SHARDS))
    offsets = exclusive_prefix(weights, "id", "w") if total else weights.withColumn("offset", F.lit(0))
    cuts = offsets.groupBy(F.floor(F.col("offset") / wide).alias("s")).agg(F.min("id").alias("id"))
    borders = np.sort(np.array([r["id"] for r in cuts.collect()], np.int64))[1:]  # at most MAX_SHARDS numbers
    held = spark.sparkContext.broadcast(borders)

    @F.arrow_udf(IntegerType())
    def shard(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(np.asarray(ids.is_null()), 0, at).astype(np.int32))

    first = markers.select("id", "digest", F.lit(0).alias("mark"), "target", "shared")
    then = rows.select("id", "digest", F.lit(1).alias("mark"), "url", "payload")
    stream = first.unionByName(then, allowMissingColumns=True).withColumn("shard", shard("id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = (
        stream.repartition(n, "shard")
        .sortWithinPartitions("shard", "id", "digest", "mark", "url")
        .mapInArrow(_writer(path, roll_bytes), MANIFEST)
    )
    manifest = materialize(written, "warc-written")
    materialize(manifest.repartition("name").mapInArrow(_commit(path), MANIFEST), "warc-committed")
    manifest.drop("temporary").repartitionByRange(1, "name").sortWithinPartitions("name").write.parquet(f"{path}/_manifest")
    store, root = open_store(path)
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{path}/_manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked members of a gzip stream, one at a time."""
    data = stream.read(chunk)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data:
                raise EOFError("the archive ends inside a record")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else stream.read(chunk)
        yield b"".join(parts)
        data = data or stream.read(chunk)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = {k.lower(): v for k, v in (s.split(": ", 1) for s in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what its header says")
    return headers, rest[:size]


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, file string"
_READ_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("file", pa.string())]
)


def read_record(headers: dict[str, str], block: bytes, file: str) -> tuple[dict, bytes | None]:
    """(row, payload); a revisit has no payload, its length and digest are its headers'."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    row = {
        "page_id": page_of(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": headers["warc-type"],
        "refers_to": page_of(headers.get("warc-refers-to")),
        "payload_bytes": int(fields["Content-Length"]),
        "payload_digest": stated,
        "verified": headers["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}",
        "file": file,
    }
    if row["record_type"] == "revisit":
        return row, None
    row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
    row["verified"] &= row["payload_digest"] == stated and row["payload_bytes"] == int(fields["Content-Length"])
    return row, payload


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, verified, file),
    with ``payload`` also the payload, null for a revisit: one row per page record of the
    files that the manifest lists. Length and digest of a response are taken from its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        schema = _READ_ARROW.append(pa.field("payload", pa.binary())) if payload else _READ_ARROW
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        headers, block = parse(record)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        row, data = read_record(headers, block, name)
                        rows.append({**row, "payload": data} if payload else row)
                        size += len(block) if payload else 256
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    manifest = spark.read.parquet(f"{path}/_manifest").select("name")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "name").mapInArrow(read, READ + (", payload binary" if payload else ""))
