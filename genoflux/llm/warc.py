"""WARC archives of pages: a writer that stores equal payloads once, and a reader that salvages damaged files.

Records are gzip members of their own (or plain), written by Spark's text writer as raw bytes: what it puts after each row is
an empty gzip member, or the second of the line ends that close a plain record. A reader's task holds one file, so the writer keeps
files near FILE_BYTES of payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean_batches

#: Payload bytes of one file, on average.
FILE_BYTES = 32 << 20
#: Payloads of fewer bytes are stored wherever they occur.
LEAST_REVISIT = 100
#: Parts that the rows of one payload are dealt to where its first page is looked up.
SALTS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = member(b"")


# --- writing -------------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, digest, refers_to: what only revisits an earlier page. pages: page_id, digest, payload_bytes.

    Of the pages of one payload of `least` bytes or more that of the smallest page_id is stored, so a row's fate depends on its page_id
    and digest alone; rows that repeat both are all stored or all revisits, and null ids come last. The ids of one
    payload are counted in SALTS parts, and each part learns the smallest on its own.
    """
    ids = pages.where(F.col("payload_bytes") >= least).select("digest", "page_id").distinct()
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    parts = ids.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    payloads = parts.groupBy("digest").agg(F.min("first").alias("refers_to"), F.sum("n").alias("ids")).where("ids > 1").drop("ids")
    wanted = parts.select("digest", "salt").join(payloads, "digest")
    return ids.join(wanted, ["digest", "salt"]).where("page_id is null or page_id != refers_to").select("page_id", "digest", "refers_to")


def records(pages: DataFrame, date: str = DATE, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, record_type, refers_to, record (the WARC record's bytes, without the line end that closes it) for each row of `pages`
    (page_id, url, html). A null html is an empty payload, a null url is left out, line ends in a url are percent-encoded; a null page_id
    has the record id <urn:page:>. Other columns are ignored."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    r = revisits(p.select("page_id", "digest", "payload_bytes"), least).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "refers_to", F.lit(True).alias("again"))
    p = p.join(r.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")  # revisits grow with the input: never broadcast
    again = F.col("again").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return p.select("page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "refers_to", F.concat(head, block, F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str, compressed: bool = True, date: str = DATE, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Writes `records` of `pages` as WARC files in the new folder `path`. No file holds more rows than those that have
    `file_bytes` of payload on average, one at least; an empty table gives a folder without records."""
    lean_batches(pages.sparkSession)
    size = pages.agg(F.avg(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)))).first()[0] or 0
    rows = records(pages, date, least).select("record")

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(x.as_buffer().to_pybytes() + b"\r\n") for x in b.column(0)], pa.binary())], ["record"])

    end = b"\r\n"
    if compressed:
        rows, end = rows.mapInArrow(packed, "record binary").select(F.col("record").cast("string").alias("record")), EMPTY_MEMBER
    out = rows.write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", max(1, int(file_bytes / (size + 512)))).text(path)


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Record:
    """A record that passed all checks. offset, length: its bytes in the file (of its member, where that is compressed)."""

    offset: int
    length: int
    headers: dict[str, str] = field(repr=False)
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """The block without its HTTP headers."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block[max(0, self.block.find(b"\r\n\r\n") + 4) :]

    @property
    def http_length(self) -> int | None:
        """The length that the HTTP headers state; a revisit keeps it although it has no payload."""
        for line in self.block[: max(0, self.block.find(b"\r\n\r\n"))].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return None


@dataclass
class Gap:
    """Bytes without a valid record, and what was wrong at their begin."""

    offset: int
    length: int
    reason: str


class Bad(Exception):
    pass


VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MAGIC = b"\x1f\x8b\x08"


class Plain:
    """Records of uncompressed bytes."""

    def __init__(self, data: bytes):
        self.data, self.head = data, -1

    def record(self, at: int) -> Record:
        """The record that begins at `at`; raises Bad where a check fails."""
        data = self.data
        if not data.startswith(VERSIONS, at):
            raise Bad("no version line")
        if self.head < at:  # the next empty line serves every begin before it
            found = data.find(b"\r\n\r\n", at)
            self.head = len(data) if found < 0 else found
        if self.head == len(data):
            raise Bad("header without end")
        headers, i = {}, data.index(b"\r\n", at) + 2
        while i < self.head + 2:
            j = data.index(b"\r\n", i)
            name, colon, value = data[i:j].partition(b":")
            if not colon:
                raise Bad("header line without a colon")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            i = j + 2
        if not {"warc-type", "warc-record-id", "content-length"} <= headers.keys() or not headers["content-length"].isdecimal():
            raise Bad("header without type, id or length")
        begin = self.head + 4
        end = begin + int(headers["content-length"])
        if end > len(data):
            raise Bad("record beyond the end")
        if data[end : end + 4] != b"\r\n\r\n":
            raise Bad("record without its two line ends")
        out = Record(at, end + 4 - at, headers, data[begin:end])
        for name, what in (("warc-block-digest", out.block), ("warc-payload-digest", None if headers["warc-type"] == "revisit" else out.payload)):
            kind, _, stated = headers.get(name, "").partition(":")
            if kind == "sha256" and what is not None and sha256(what).hexdigest() != stated.lower():
                raise Bad(f"{name[5:]} differs")
        return out


class Finder:
    """Where one of some strings begins next. What was found stays for later begins before it, so a file is searched once."""

    def __init__(self, data: bytes, *what: bytes):
        self.data, self.what, self.found = data, what, [-1] * len(what)

    def next(self, at: int) -> int:
        for i, w in enumerate(self.what):
            if self.found[i] < at:
                found = self.data.find(w, at)
                self.found[i] = len(self.data) if found < 0 else found
        return min(self.found)


def inflated(data: memoryview) -> tuple[bytes, int]:
    """The content of the gzip member at the begin of data and the member's length; raises Bad where it is damaged. One that has no
    content in its first 2 KB (a header without end) counts as damaged, so that a search through junk stays short."""
    z = zlib.decompressobj(31)
    out, at, step = [], 0, 1 << 11
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(data[at : at + step]))
            at, step = at + step, 1 << 16
            if not z.eof and at < len(data) and not out[0]:
                raise Bad("damaged member")
    except zlib.error as e:
        raise Bad("damaged member") from e
    if not z.eof:
        raise Bad("member beyond the end")
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def salvaged(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of a file and the gaps between them, in order. The file may be plain, of gzip members, or both.

    A member is taken whole or not at all: its checksum, and that it holds records only, is checked before its records are given. Where a
    check fails, the search goes on at the next byte that begins a version line or a member whose checks hold. Empty members are no gap.
    """
    plain, view, begins = Plain(data), memoryview(data), Finder(data, MAGIC, *VERSIONS)
    at, gap, reason = 0, None, ""

    def at_member(begin: int) -> tuple[list[Record], int]:
        content, length = inflated(view[begin:])
        inner, out, i = Plain(content), [], 0
        while i < len(content):
            r = inner.record(i)
            i += r.length
            out.append(Record(begin, length, r.headers, r.block))
        return out, length

    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                found, length = at_member(at)
            else:
                r = plain.record(at)
                found, length = [r], r.length
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            at = begins.next(at + 1)
            continue
        if gap is not None and (found or at > gap):
            yield Gap(gap, at - gap, reason)
            gap = None
        yield from found
        at += length
    if gap is not None:
        yield Gap(gap, len(data) - gap, reason)


FIELDS = "path string, kind string, offset long, length long, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the WARC files under `path`, damaged or not.

    kind `record`: where it stands (path, offset, length), its type, ids and target, payload_bytes and payload_digest (hex SHA-256) of the
    full payload, which for a revisit are those of the record that it refers to, and the payload (null if not asked for, or a
    revisit). kind `gap`: quarantined bytes between valid records, and which check failed at their begin. An empty file or folder
    gives no rows. A task holds one file, of at most 2 GB.
    """
    lean_batches(spark)

    def rows(name: str, data: bytes):
        for x in salvaged(data):
            if isinstance(x, Gap):
                yield name, "gap", x.offset, x.length, x.reason, None, None, None, None, None, None, None
                continue
            h, payload = x.headers, x.payload
            again = h["warc-type"] == "revisit"
            kind, _, digest = h.get("warc-payload-digest", "").partition(":")
            size, digest = (x.http_length, digest if kind == "sha256" else None) if again else (len(payload), sha256(payload).hexdigest())
            yield name, "record", x.offset, x.length, None, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), size, digest, payload if payloads and not again else None

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split(" ") for f in FIELDS.split(", "))])

        def table(held):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                held, size = [], 0
                for r in rows(name, data.as_buffer().to_pybytes()):
                    held.append(r)
                    size += 200 + len(r[-1] or b"")
                    if size > 1 << 20:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


def archived(pages: DataFrame) -> DataFrame:
    """`pages` written as archives in the shared folder and read back: one row a record, with page_id, payload_bytes, payload_digest,
    record_type and refers_to (a page_id). Bytes that can't be read back are an error: the files were written just before."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    path = scratch.new_path()
    write_archives(pages, path)
    read = read_archives(spark, path, payloads=False)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    whole = F.when(F.col("kind") == "record", F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("archive just written has a gap: "), "reason")))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), number("refers_to").alias("refers_to"))
