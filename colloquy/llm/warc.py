"""WARC archives: a writer of gzip members and a sequential reader.

Writer: one gzip member per record, one archive per task and `roll_bytes`; equal payloads are stored once, the others
as `revisit` records. Reader: streams an archive through an incremental zlib decompressor, frames records by
Content-Length, and verifies payload and block digests. A broken record gives a row with `error`; the reader goes on with
the next member, which it finds by its gzip header where the data themselves are broken.

Defined results: a null html is an empty payload; an empty table gives no archive and no rows; rows that repeat a
page_id with an equal payload are all `response` when that id is the largest of its payload; a null page_id is written
without an id, counts as the smallest id of its payload, and is read back as null (its group's response is a row with
an id, if there is one); other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_batches, shared_dir, slices, written

#: High half of the record ids; the low half is the page_id.
ID_HIGH = 0x5A1E_0C0D_E000_8000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 18
#: A record's header is at most so long; so much of a member is looked at to tell whether it starts a record.
HEADER_BYTES, PROBE_BYTES = 1 << 20, 512
DIGESTS = ("sha1", "sha256", "sha512", "md5")
GZIP_MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "archive string, offset long, record_type string, page_id long, target_uri string, refers_to long, "
    "payload_bytes long, payload_digest string, verified boolean, error string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=ID_HIGH << 64 | page_id % 2**64)}>"


def page_of(record: str | None) -> int | None:
    """The page_id in a record id of this writer; null for other ids."""
    try:
        value = uuid.UUID((record or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if value >> 64 != ID_HIGH:
        return None
    low = value % 2**64
    return low - 2**64 if low >= 2**63 else low


def header_safe(text: str | None) -> str:
    return " ".join((text or "").split())


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, header_safe(url))}>'}",
        f"WARC-Target-URI: {header_safe(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}"]
        lines += [f"WARC-Refers-To: {record_id(refers_to)}"] if refers_to is not None else []
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head + block + b"\r\n\r\n") + gz.flush()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Local folders and whatever pyarrow has a file system for (hdfs, s3, gs, ...)."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and, of pages with equal payloads of at least min_bytes, which one the others refer to.

    The largest page_id of each payload comes from an aggregation with map-side combine; the join back has one row per
    payload on the other side, so that a payload of very many pages is split by adaptive skew handling.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("_sha", F.sha1(F.encode("html", "utf-8")))
    responders = own.filter(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"))
    responders = responders.withColumnRenamed("_sha", "_of")
    joined = own.join(responders, own["_sha"] == responders["_of"], "left")
    revisit = F.coalesce(F.col("_last") != F.col("page_id"), F.col("_last").isNotNull() & F.col("page_id").isNull())
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("_last")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives into a shared folder; returns their manifest (path, records, bytes), itself a written table.

    A task writes under a name of its own attempt and renames when an archive is whole. Only archives that the manifest
    lists count, so that what lost executors or repeated attempts leave behind is never read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            files.move(f"{base}/.{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": count, "bytes": size}])

        for row in (row for batch in batches for part in slices(batch, "html") for row in part.to_pylist()):
            if out is None:
                name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = files.open_output_stream(f"{base}/.{name}.part", compression=None)
            data = member(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], row["revisit"])
            out.write(data)
            count, size = count + 1, size + len(data)
            if size >= roll_bytes:
                yield close()
                out = None
        if out is not None:
            yield close()

    return written(with_roles(pages, min_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


class Members:
    """The bytes of consecutive gzip members, decompressed bit by bit; holds no more than a chunk, what is asked for, and
    the compressed bytes of the open member, from which a broken one is searched for the next."""

    def __init__(self, source) -> None:
        self.source, self.raw, self.have, self.past = source, b"", bytearray(), bytearray()
        self.gz, self.done, self.offset, self.used = None, True, 0, 0

    def start(self) -> bool:
        """Goes to the next member; false at the end of the archive."""
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
        if not self.raw:
            return False
        self.gz, self.done, self.offset = zlib.decompressobj(31), False, self.used
        self.have.clear()
        self.past.clear()
        return True

    def more(self) -> bool:
        """Decompresses another chunk of this member; false at its end."""
        if self.done:
            return False
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise ValueError("truncated member")
        got = self.gz.decompress(self.raw, READ_BYTES)
        rest = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        taken = len(self.raw) - len(rest)
        self.past += self.raw[:taken]
        self.used += taken
        self.have += got
        self.raw, self.done = rest, self.gz.eof
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        """What stands before and with the mark, within the first `most` bytes."""
        seen = 0
        while (at := self.have.find(mark, seen)) < 0:
            seen = max(0, len(self.have) - len(mark) + 1)
            if seen > most or not self.more():
                raise ValueError("record without an end of its header")
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("record shorter than its Content-Length")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def ends_with(self, rest: bytes) -> bool:
        """Whether exactly this is left of the member."""
        while len(self.have) <= len(rest) and self.more():
            pass
        return bytes(self.have) == rest

    def recover(self) -> None:
        """Goes behind a broken member: to its end, or where it can't be read to the next start of a record's member."""
        try:
            while self.more():
                self.have.clear()
            return
        except (ValueError, zlib.error):
            self.done = True
        self.raw, self.used = bytes(self.past[1:]) + self.raw if self.past else self.raw[1:], self.offset + 1
        while True:
            at = self.raw.find(GZIP_MAGIC)
            skipped = at if at >= 0 else max(0, len(self.raw) - len(GZIP_MAGIC) + 1)
            self.raw, self.used = self.raw[skipped:], self.used + skipped
            if at < 0 or len(self.raw) < PROBE_BYTES:
                if more := self.source.read(READ_BYTES):
                    self.raw += more
                    continue
                if at < 0:
                    self.raw = b""
                    return
            try:
                if zlib.decompressobj(31).decompress(self.raw[:PROBE_BYTES], 5) == b"WARC/":
                    return
            except zlib.error:
                pass
            self.raw, self.used = self.raw[1:], self.used + 1


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def agrees(told: str, data: bytes) -> bool:
    """Whether a labelled digest (base32 or hexadecimal) is that of data; true for none and for unknown algorithms."""
    algorithm, _, value = told.partition(":")
    if algorithm.lower() not in DIGESTS or not value:
        return True
    own = hashlib.new(algorithm.lower(), data)
    return value.upper().rstrip("=") in (base64.b32encode(own.digest()).decode().rstrip("="), own.hexdigest().upper())


def records(source, archive: str, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive, in order. A broken record gives a row that has `error`."""
    stream = Members(source)
    while True:
        try:
            if not stream.start():
                return
            head = stream.until(b"\r\n\r\n", HEADER_BYTES)
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC version line")
            fields = headers(head)
            block = stream.take(int(fields["content-length"]))
            if not stream.ends_with(b"\r\n\r\n"):
                raise ValueError("record longer than its Content-Length")
        except (ValueError, KeyError, zlib.error) as e:
            yield dict.fromkeys(("record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")) | {"archive": archive, "offset": stream.offset, "verified": False, "error": str(e)}
            stream.recover()
            continue
        kind = fields.get("warc-type")
        http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
        told = fields.get("warc-payload-digest", "")
        wrong = ["block digest"] if not agrees(fields.get("warc-block-digest", ""), block) else []
        if kind == "revisit":  # the payload is in another record: its size stands in the kept HTTP header
            size, told = headers(http).get("content-length", "0").strip() or "0", told.removeprefix("sha1:")
            if not (size.isascii() and size.isdigit() and len(size) < 19):
                wrong.append("Content-Length")
            size = None if "Content-Length" in wrong else int(size)
        else:
            size = len(payload)
            if not agrees(told, payload):
                wrong.append("payload digest")
            told = base32_sha1(payload)
        yield {
            "archive": archive, "offset": stream.offset, "record_type": kind, "page_id": page_of(fields.get("warc-record-id")),
            "target_uri": fields.get("warc-target-uri"), "refers_to": page_of(fields.get("warc-refers-to")), "payload_bytes": size,
            "payload_digest": told, "verified": not wrong, "error": "wrong " + ", ".join(wrong) if wrong else None,
            "payload": payload if payloads and kind != "revisit" else None,
        }


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that manifest lists (column path), one row each; each archive streams through a task."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("error", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = filesystem(path)
                with files.open_input_stream(at, compression=None) as source:
                    held, size = [], 0
                    for r in records(source, path, payloads):
                        held.append(r)
                        size += 200 + len(r["payload"] or b"")
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    spark = manifest.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    return manifest.select("path").repartition(tasks, "path").mapInArrow(read, RECORDS)


def archive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The *.warc.gz files of a folder, as a manifest for read_warc; only names and sizes are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))


def against_responses(read: DataFrame) -> DataFrame:
    """The records of a written table, each revisit held against the response it names: one of its size and digest must be there.

    A revisit that names none has nothing to be held against. Only revisits are joined; payloads aren't shuffled.
    """
    told = ["payload_bytes", "payload_digest"]
    names = F.col("record_type").eqNullSafe("revisit") & F.col("refers_to").isNotNull()
    responses = read.filter("record_type = 'response'").select(F.col("page_id").alias("_to"), *[F.col(c).alias(f"_{c}") for c in told], F.lit(True).alias("_found")).distinct()
    same = (F.col("refers_to") == F.col("_to")) & F.col("payload_bytes").eqNullSafe(F.col("_payload_bytes")) & F.col("payload_digest").eqNullSafe(F.col("_payload_digest"))
    held = read.filter(names).join(responses, same, "left")
    lost = F.col("_found").isNull()
    error = F.when(lost, F.concat_ws("; ", "error", F.lit("no response of this size and digest"))).otherwise(F.col("error"))
    held = held.withColumns({"verified": F.col("verified") & ~lost, "error": error}).select(*read.columns)
    return read.filter(~names).unionByName(held)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives and reads them back; a record that can't be verified raises."""
    back = against_responses(written(read_warc(write_warc(pages, min_bytes=min_bytes), payloads=False), "records"))
    checked: Column = F.when(F.col("verified"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("bad WARC record: "), F.coalesce("error", F.lit("?")))))
    return back.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")
