"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Reader: an archive is cut into byte ranges without an index. A task looks for the gzip
magic from its range's start, validates a candidate by decoding the member's first bytes
(they must be a WARC version line), and from there goes from member to member. It owns
the records that start inside its range, so it may read past the end for the last one.

Writer: each task writes archives under names of its own and reports them; the manifest
table holds only what successful tasks reported, so files of lost tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
MAX_TASKS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "target_uri string, offset long, archive string"
)


def open_shared(uri: str, mode: str) -> BinaryIO:
    """A file of the shared store, by any scheme that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None) if mode == "w" else system.open_input_file(path)


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit keeps the HTTP head, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_page(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: {_page(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http if record_type == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def plan_records(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, html, record_type, refers_to.

    Of equal payloads of at least min_bytes, rows with the largest page_id are responses
    and the others revisit it; null ids count as smallest; smaller payloads are responses.
    Ids are counted by payload digest first, so a frequent payload is reduced before it is moved.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("__key", F.sha1(F.col("html").cast("binary")))
    last = rows.where(F.octet_length("html") >= min_bytes).groupBy("__key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    last = scratch.small(last.where("n > 1").select("__key", "last"), "equal-payloads")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(last, "__key", "left").select(
        "page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Writes records to archives in folder; returns the manifest (archive, bytes, records), to be written as a table at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, size, count = None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, html, kind, ref in zip(batch["page_id"], batch["url"], batch["html"], batch["record_type"], batch["refers_to"]):
                if out is None:
                    name, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(name, "w")
                member = record_bytes(
                    None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None,
                    html.encode("utf-8", "surrogatepass"), kind, None if pd.isna(ref) else int(ref),
                )
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= max_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pd.DataFrame(done, columns=["archive", "bytes", "records"])

    # ids as strings: pandas would turn nullable longs into floats
    ids = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    return ids.mapInPandas(run, "archive string, bytes long, records long")


class _Members:
    """Gzip members of one archive from a byte position on."""

    def __init__(self, file: BinaryIO, at: int):
        self.file, self.at, self.held = file, at, b""

    def _more(self) -> bool:
        self.file.seek(self.at + len(self.held))
        got = self.file.read(CHUNK)
        self.held += got
        return bool(got)

    def _skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def _is_record(self) -> bool:
        """Whether the bytes at this position decode to the beginning of a WARC record."""
        unpack = zlib.decompressobj(31)
        got, fed = b"", 0
        while len(got) < 7 and not unpack.eof:
            if fed >= len(self.held) and not self._more():
                return False
            part = self.held[fed : fed + 4096]
            fed += len(part)
            try:
                got += unpack.decompress(part, 64)
                while unpack.unconsumed_tail and len(got) < 7:
                    got += unpack.decompress(unpack.unconsumed_tail, 64)
            except zlib.error:
                return False
        return got[:7] in (b"WARC/1.", b"WARC/0.")

    def find(self, end: int) -> bool:
        """Moves to the next record that starts before end."""
        while self.at < end:
            i = self.held.find(MAGIC)
            if i < 0:
                self._skip(max(0, len(self.held) - 2))
                if not self._more():
                    return False
                continue
            self._skip(i)
            if self.at >= end:
                return False
            if self._is_record():
                return True
            self._skip(1)
        return False

    def read(self) -> bytes:
        """The member at this position, decoded; moves behind it."""
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not self.held and not self._more():
                raise EOFError("a member is cut off")
            parts.append(unpack.decompress(self.held))
            used = len(self.held)
            rest = unpack.unused_data if unpack.eof else b""
            self.held, self.at = rest, self.at + used - len(rest)
        return b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of a decoded record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "revisit":
        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        digest = stated
    else:
        length, digest = len(payload), digest32(payload)
        if stated and stated != digest:
            raise ValueError(f"payload digest of {fields.get('warc-record-id')} doesn't match")
    return {
        "page_id": _page_id(fields.get("warc-record-id")), "payload_bytes": length, "payload_digest": digest,
        "record_type": fields.get("warc-type"), "refers_to": _page_id(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"),
    }


def read_range(file: BinaryIO, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the records that start in [start, end)."""
    members = _Members(file, start)
    while members.find(end):
        at = members.at
        yield at, members.read()


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """Records of the archives in manifest (archive, bytes), a task for every split_bytes.

    Tasks are numbered by range, MAX_TASKS at most; beyond that a task reads several ranges.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = manifest.select("archive", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "bytes"))
    # a stated number, dealt out in turn: left to itself Spark merges these few small rows into one task
    tasks = manifest.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(tasks), MAX_TASKS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for archive, start, end in zip(batch["archive"], batch["start"], batch["end"]):
                with open_shared(archive, "r") as file:
                    rows = []
                    for at, data in read_range(file, int(start), int(end)):
                        rows.append({**parse_record(data), "offset": at, "archive": archive})
                        if len(rows) >= 1000:
                            yield _frame(rows, names)
                            rows = []
                    if rows:
                        yield _frame(rows, names)

    return ranges.mapInPandas(run, RECORD)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, scratch: Scratch | None = None, min_bytes: int = 0, split_bytes: int = 32 << 20) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and reads all archives back.

    A null html is an empty payload; a null url leaves the target out; null ids are kept.
    Repeated rows give repeated records (with one record id). An empty table gives no rows.
    Other columns of pages are not part of a record and don't come back, whatever their names.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.path("archives"))
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    folder = store.makeQualified(where).toString()
    manifest = scratch.table(write_archives(plan_records(pages, scratch, min_bytes), folder), "manifest")
    return read_archives(spark, manifest, split_bytes)
