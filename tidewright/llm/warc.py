"""WARC archives: written as one gzip stream a file, normalised to one gzip member a record with a sidecar index of offsets, read back by it."""

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import tidy
from .store import new_path, save, text_batches

#: Bytes of payload after which an archive is closed and a new one begun, so that one stream, which only one task can inflate, stays bounded.
ARCHIVE_BYTES = 64 << 20
#: Payloads below this are always written in full.
REVISIT_BYTES = 100
#: A payload that more than one row in so many has is hot; there can't be more hot payloads than this.
HOT_SHARE = 1_000
#: Tasks that rewrite archives, at most; more archives share them.
REWRITE_TASKS = 10_000
CHUNK = 1 << 16
GZIP = 31  # window bits that make zlib read and write the gzip format

# fixed values of the format
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture

PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, as tasks reach it, and the path in it."""
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:", folder) else (fs.LocalFileSystem(), folder)


def record_id(page_id: int | None, digest: str) -> str:
    """Name of a record by page_id and payload; rows that are equal in both share it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header(fields: dict[str, str | int | None]) -> bytes:
    """Version and fields of a record. Control characters in values are written as %XX, so that a value never ends its line."""
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    lines = [f"{k}: {clean(v)}".encode("utf-8", "replace") for k, v in fields.items() if v is not None]
    return b"\r\n".join([VERSION, *lines, b"", b""])


def parse_header(raw: bytes) -> dict[str, str]:
    """Fields of a record's header by lower-case name; continued lines are joined."""
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", raw).split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"a record begins with {first[:40]!r}")
    pairs = (line.split(b":", 1) for line in lines if b":" in line)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in pairs}


def page_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, size: int, digest: str) -> Iterator[bytes]:
    """A response with its payload, or a revisit with the HTTP header alone, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    revisit = {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-Id": refers_to} if kind == "revisit" else {}
    yield header({"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "Page-Id": page_id} | revisit | {"Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + len(body)})
    yield http
    yield body
    yield b"\r\n\r\n"


def described(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each row of pages (page_id, url, html).

    Of equal payloads of at least `least` bytes the row with the smallest page_id
    is the response; the others revisit it. Rows that repeat that page_id are
    responses too, as none revisits itself; rows without page_id come after all
    others. A null html is an empty payload. Only payloads that occur twice are
    looked up, hot ones (at most HOT_SHARE) by broadcast, so that no payload
    gathers its rows in one task.
    """
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    each = each.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    twice = save(each.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated_payloads")
    rows = pages.count()
    hot = twice.where(F.col("n") * HOT_SHARE > rows).select(F.col("payload_digest").alias("_hot"), F.col("first").alias("_hot_first"))
    cool = twice.where(F.col("n") * HOT_SHARE <= rows).select(F.col("payload_digest").alias("_cool"), F.col("first").alias("_cool_first"))
    each = each.join(F.broadcast(hot), F.col("payload_digest") == F.col("_hot"), "left")  # HOT_SHARE rows at most
    # hot rows look for a name that no payload has, each its own, so that they spread
    own = F.concat_ws("/", F.lit("-"), F.col("page_id").cast("string"), "url")
    each = each.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("payload_digest")).otherwise(own)).join(cool, F.col("_key") == F.col("_cool"), "left")
    first = F.coalesce("_hot_first", "_cool_first")
    known = F.coalesce("_hot", "_cool").isNotNull()
    revisit = known & first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return each.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, first).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write pages as archives in folder, each one gzip stream over all its records; returns (path, records).

    A task writes its archives under new names and only those of tasks that end
    are in the result, so a task that runs twice leaves a file but no record
    twice. An empty table gives no archive.
    """

    @tidy
    def write(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        out = deflate = path = None
        held = records = 0

        def close():
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(len(batch)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.raw.warc.gz"
                    out, deflate, held, records = system.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                    info = b"software: tidewright\r\nformat: WARC File Format 1.1\r\n"
                    out.write(deflate.compress(header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": len(info)}) + info + b"\r\n\r\n"))
                page_id, url, payload, size, digest, kind, refers = (c[i].as_py() for c in columns)
                for part in page_record(page_id, url, payload, kind, refers, size, digest):
                    out.write(deflate.compress(part))
                held, records = held + size, records + 1
                if held >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    # a revisit's payload stays behind in the JVM
    rows = described(pages, least).withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    with text_batches(pages.sparkSession):
        return save(rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(write, "path string, records long"), "archives")


class Inflated:
    """The bytes of a gzip file of one or more members, inflated once from front to back with little held."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.rest = source, zlib.decompressobj(GZIP), bytearray(), b""
        self.begun = self.ended = False

    def fill(self, wanted: int) -> None:
        """Hold at least wanted bytes, if the file has them."""
        while len(self.held) < wanted and not self.ended:
            raw = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                self.ended = True
                if self.begun and not self.inflate.eof:
                    raise ValueError("the gzip stream is cut off")
                return
            if self.inflate.eof:
                if not raw.strip(b"\x00"):
                    continue  # padding between or after members
                self.inflate = zlib.decompressobj(GZIP)
            self.begun = True
            self.held += self.inflate.decompress(raw, CHUNK * 4)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is passed over; None at the end."""
        at = self.held.find(mark)
        while at < 0:
            before = len(self.held)
            self.fill(before + CHUNK)
            if len(self.held) == before:
                if self.held.strip():
                    raise ValueError("the last record is cut off")
                return None
            at = self.held.find(mark, max(0, before - len(mark)))
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, count: int) -> Iterator[bytes]:
        """The next count bytes, in parts."""
        while count:
            self.fill(min(count, CHUNK))
            part = bytes(self.held[:count])
            if not part:
                raise ValueError("the last record is cut off")
            del self.held[: len(part)]
            count -= len(part)
            yield part


def records_of(source) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(header as written, fields, parts of the block) of each record of an open gzip file. A block must be used up before the next record."""
    stream = Inflated(source)
    while (raw := stream.until(b"\r\n\r\n")) is not None:
        raw = raw.lstrip(b"\r\n")
        fields = parse_header(raw)
        yield raw, fields, stream.take(int(fields["content-length"]))
        for gap in stream.take(4):
            if gap.strip(b"\r\n"):
                raise ValueError("a record isn't followed by two empty lines")


INDEX = "record_id string, record_type string, page_id long, offset long, length long, archive string"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (path) as one gzip member a record, each with a sidecar index (.idx) beside it in folder; returns (archive, index, records).

    Each archive is inflated once, as a stream, whether it has one member or
    many, and no record is held whole. The sidecar has a tab-separated line for
    each record: id, type, page_id, offset and length of the member, and the
    archive's name. A cut-off or damaged archive raises ValueError.
    """

    @tidy
    def rewrite(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = uuid.uuid4().hex
                target, sidecar, lines, at = f"{root}/{name}.warc.gz", f"{root}/{name}.idx", [], 0
                origin, inside = open_folder(path)
                with origin.open_input_stream(inside, compression=None) as source, system.open_output_stream(target, compression=None) as out:
                    for raw, fields, block in records_of(source):
                        member, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
                        for part in chain([raw, b"\r\n\r\n"], block, [b"\r\n\r\n"]):
                            size += out.write(member.compress(part))
                        size += out.write(member.flush())
                        lines.append("\t".join([fields.get("warc-record-id", ""), fields["warc-type"], fields.get("page-id", ""), str(at), str(size), f"{name}.warc.gz"]) + "\n")
                        at += size
                with system.open_output_stream(sidecar, compression=None) as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([sidecar]), pa.array([len(lines)], pa.int64())], ["archive", "index", "records"])

    # a file a task up to REWRITE_TASKS, as a stream can't be shared
    spread = archives.select("path").repartition(max(1, min(archives.count(), REWRITE_TASKS)))
    return save(spread.mapInArrow(rewrite, "archive string, index string, records long"), "normalised")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all sidecars in a folder, with the archive's whole path."""
    lines = spark.read.schema(INDEX).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").csv(folder)
    return lines.withColumn("archive", F.concat(F.lit(folder.rstrip("/") + "/"), "archive"))


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the member at an offset of an open archive; nothing else is read."""
    source.seek(offset)
    for _, fields, block in records_of(pa.BufferReader(source.read(length))):
        return fields, b"".join(block)
    raise ValueError(f"there is no record at {offset}")


def read_pages(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload, NULL for revisits, if asked for) of the records of an index.

    Each record is fetched by its own range of bytes. A response whose payload
    doesn't have the digest in its header raises ValueError.
    """

    @tidy
    def read(batches):
        path = source = None
        for batch in batches:
            rows, payloads = [], []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != path:
                    if source is not None:
                        source.close()
                    system, inside = open_folder(archive)
                    path, source = archive, system.open_input_file(inside)
                fields, block = read_record(source, offset, length)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                http, payload = block.split(b"\r\n\r\n", 1)
                size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                if kind == "response":
                    digest_read = hashlib.sha256(payload).hexdigest()
                    if (len(payload), digest_read) != (size, digest):
                        raise ValueError(f"the payload at {offset} of {archive} has the digest {digest_read}, not {digest}")
                number = lambda k: int(fields[k]) if k in fields else None
                rows.append((number("page-id"), fields.get("warc-target-uri"), kind, number("refers-to-page-id"), size, digest))
                payloads.append(payload if kind == "response" else None)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)] + [pa.array(payloads, pa.binary())] * with_payload
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload)

    wanted = index.where(F.col("record_type").isin("response", "revisit")).select("archive", "offset", "length")
    return wanted.mapInArrow(read, PAGE + ", payload binary" * with_payload)


def warc_round_trip(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as archives, normalise these and read them back by their sidecars: a row for each page.

    Nulls are empty payloads or missing header fields; repeated rows are records
    of their own; long pages are streamed, so a task holds one page and a chunk.
    Other columns of pages are left alone and don't enter the archives.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    normalise(write_archives(pages, f"{folder}/raw", archive_bytes), f"{folder}/records")
    with text_batches(spark):
        return save(read_pages(read_index(spark, f"{folder}/records")), "pages_read")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    found = warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH each AS (
  SELECT page_id::BIGINT AS page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM each WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT e.page_id, e.payload_bytes, e.payload_digest,
  CASE WHEN f.first IS NOT NULL AND e.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN e.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM each e LEFT JOIN firsts f ON e.payload_digest = f.payload_digest AND e.payload_bytes >= 100
"""
