"""WARC archives in seekable Zstandard bundles: independent frames, a seek table, an index by record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, StringType

from ._common import fresh_path, map_batches, materialise, outlive, steps, table, unused

#: Fixed values of the seekable format: skippable frame, footer, and the size of an entry and of the footer.
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, 8, 9
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    """A frame closes when it holds frame_bytes, a bundle when it has written bundle_bytes; a longer record has its own frame.

    Of records with equal payloads of least_revisit bytes or more all but the first are revisits.
    """

    frame_bytes: int = 1 << 18
    bundle_bytes: int = 1 << 28
    level: int = 3
    least_revisit: int = 0
    date: str = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | str | None) -> str:
    """A record's identifier; a string is marked as one and escaped."""
    return f"<urn:page:{'none' if page_id is None else 'text:' + quote(page_id, safe='') if isinstance(page_id, str) else page_id}>"


def page_of(identifier: str | None) -> int | str | None:
    found = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    if found.startswith("text:"):
        return unquote(found.removeprefix("text:"))
    return int(found) if found not in ("", "none") else None


def record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the payload's headers and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")  # no header may be forged
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at `at`, and where the next one starts."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(head["Content-Length"])
    block = raw[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (base32_sha1(payload) != digest or len(payload) != int(fields["Content-Length"])):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    found = {
        "page_id": page_of(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload": None if revisit else payload,
        "payload_bytes": int(fields["Content-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": page_of(head.get("WARC-Refers-To")),
    }
    return found, start + size + 4


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A shared folder or file by its URI; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


class BundleWriter:
    """Writes records in order to one file; close() appends the seek table and gives the file its name."""

    def __init__(self, path: str, settings: Settings, attempt: str):
        self.files, self.path = located(path)
        self.draft, self.settings = f"{self.path}.{attempt}", settings
        self.out = self.files.open_output_stream(self.draft)
        self.compressor = zstandard.ZstdCompressor(level=settings.level)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.length = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """The record's frame and its offset in the frame's plain bytes."""
        if self.held and self.length + len(raw) > self.settings.frame_bytes:
            self._frame()
        at = len(self.sizes), self.length
        self.held.append(raw)
        self.length += len(raw)
        return at

    def _frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.held))
        self.out.write(packed)
        self.sizes.append((len(packed), self.length))
        self.written += len(packed)
        self.held, self.length = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        table_ = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table_)) + table_)
        self.out.close()
        self.files.move(self.draft, self.path)


class BundleReader:
    """Opens a bundle by its seek table; reads any frame alone."""

    def __init__(self, path: str):
        files, name = located(path)
        self.file = files.open_input_file(name)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(FOOTER, end - FOOTER))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entries = struct.iter_unpack("<II", self.file.read_at(count * ENTRY, end - FOOTER - count * ENTRY))
        self.frames, at = [], 0
        for packed, plain in entries:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=max(plain, 1))

    def record(self, frame: int, offset: int) -> dict:
        return parse(self.frame(frame), offset)[0]

    def close(self) -> None:
        self.file.close()


#: Revisits up to which they are broadcast, so that payloads are not shuffled; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Plain bytes that a task reads: the least for more tasks than the cluster runs at once, and the most.
READ_LEAST, READ_MOST = 1 << 22, 1 << 27


def _page_kind(df: DataFrame) -> DataType:
    kind = df.schema["page_id"].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"page_id must be an integer or a string, not {kind.simpleString()}")
    return kind


def revisits(pages: DataFrame, settings: Settings) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, digest, refers_to) for each distinct page_id and payload that is a revisit.

    The least page_id of a payload is its response. Rows that share that page_id and payload are responses too;
    rows without a page_id are revisits if the payload has a page with one.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("bytes"))
    own = materialise(own.filter(F.col("bytes") >= settings.least_revisit).select("page_id", "digest").distinct(), "payloads")
    first = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return own.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def write_archive(pages: DataFrame, folder: str, settings: Settings | None = None) -> DataFrame:
    """Writes pages(page_id, url, html, ...) to bundles in a shared folder; returns the index.

    The index has (page_id, path, frame, offset, length) for each row of pages, offset and length being of the frame's plain
    bytes. page_id is an integer or a string. A null html is an empty payload, a null url about:blank. Each task sorts its rows
    and writes drafts that it renames when whole, so a task that runs again gives the same files. Repeated rows give repeated
    records, and an empty table an empty index. Payloads are shuffled only if there are more than BROADCAST_ROWS revisits.
    """
    settings, kind = settings or Settings(), _page_kind(pages)
    files, path = located(folder)
    files.create_dir(path)
    names = [unused(["page_id", "url", "html", "refers_to"], n) for n in ("page", "digest")]
    own = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, n = None, 0
        for batch in batches:
            out = []
            for page, url, html, refers, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if writer and writer.written >= settings.bundle_bytes:
                    writer.close()
                    writer, n = None, n + 1
                if not writer:
                    name = f"{folder}/pages-{context.partitionId():06d}-{n:04d}.warc.zst"
                    writer = BundleWriter(name, settings, f"draft-{context.taskAttemptId()}")
                raw = record(page, url, (html or "").encode(), refers, revisit, settings.date)
                out.append((page, name, *writer.add(raw), len(raw)))
            columns = list(zip(*out)) or [()] * 5
            types = [own, pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "path", "frame", "offset", "length"])
        if writer:
            writer.close()

    with steps():
        links = materialise(revisits(pages, settings), "revisits")
        small = links.count() <= BROADCAST_ROWS
        links = links.withColumnsRenamed({"page_id": names[0], "digest": names[1]})
        digest = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
        met = F.col("page_id").eqNullSafe(F.col(names[0])) & (digest == F.col(names[1]))
        rows = pages.select("page_id", "url", "html").join(F.broadcast(links) if small else links, met, "left")
        rows = rows.select("page_id", "url", "html", "refers_to", F.col(names[1]).isNotNull().alias("revisit"))
        schema = f"page_id {kind.simpleString()}, path string, frame int, offset long, length long"
        return outlive(map_batches(rows.sortWithinPartitions("page_id", "url", "html"), run, schema), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """The records that an index points to: (page_id, url, payload_bytes, payload_digest, record_type, refers_to).

    Frames are dealt out whole, by their bytes, and read alone; each payload that is there is checked against its digest.
    """
    kind, context = _page_kind(index), index.sparkSession.sparkContext
    plain = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, plain // READ_MOST, min(plain // READ_LEAST, 2 * context.defaultParallelism))
    # A frame's records are bounded by its bytes.
    frames = index.repartition(parts, "path", "frame").groupBy("path", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    kinds = {"page_id": to_arrow_type(kind), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": to_arrow_type(kind)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            for path, frame, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    if reader:
                        reader.close()
                    reader, opened = BundleReader(path), path
                raw = reader.frame(frame)
                found = [parse(raw, at)[0] for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in kinds.items()], names=list(kinds))
        if reader:
            reader.close()

    name = kind.simpleString()
    return map_batches(frames.sortWithinPartitions("path", "frame"), run, f"page_id {name}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {name}")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archives back."""
    index = write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archive(index).drop("url")


ORACLE = r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT n, h, min(page_id) AS first FROM d GROUP BY n, h),
digits AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(10 * part AS INTEGER) + 1, 10) AS BIGINT) >> (35 - 5 * k)) & 31 AS INTEGER) + 1, 1), '' ORDER BY part, k) AS digest
  FROM (SELECT DISTINCT h FROM d), unnest(range(4)) AS a(part), unnest(range(8)) AS b(k) GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (n, h) JOIN digits USING (h)
"""
