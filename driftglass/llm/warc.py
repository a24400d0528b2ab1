"""Convert legacy ARC archives to WARC, write WARC archives and read them back.

An ARC file opens with a version block that names the fields of its header lines; each record is one
such line, as many bytes as the line declares, and a line feed. Version 1 lines have five fields,
version 2 lines ten. The converter parses these and synthesises what WARC wants beside them: record
identifiers (name-based UUIDs), timestamps, record types and digests. A payload that another record
already holds becomes a revisit of that record.

Every WARC record is a gzip member of its own. Files are written by Spark's own text writer, so they go wherever Spark
can write and commit like any table; a file is one row, so it is bounded by bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_end, new_path

#: Field names of header lines by ARC version (fixed by the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}

#: Date given to records whose own date is missing or unreadable.
NO_DATE = "19700101000000"

# --- ARC -----------------------------------------------------------------------------------


def arc_version_block(name: str, version: int = 1, date: str = NO_DATE) -> bytes:
    """The block that opens an ARC file."""
    body = f"{version} 0 driftglass\n{' '.join(ARC_FIELDS[version])}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body) + 1}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body) + 1}\n"
    return line.encode() + body + b"\n\n"


def arc_field(text: str) -> str:
    """A value without the blanks and control characters that would end a field; '-' if nothing is left."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) or "-"


def arc_record(url: str | None, body: bytes, date: str = NO_DATE, version: int = 1, ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    """One ARC record of an HTTP response with the given body."""
    block = b"HTTP/1.0 200 OK\r\nContent-Type: " + kind.encode() + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    fields = [arc_field(url or ""), ip, date, kind]
    if version == 2:
        fields += ["200", "-", "-", "0", "-"]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


class _Stream(io.RawIOBase):
    """A file over a read(n) that gives up to n more bytes."""

    def __init__(self, read):
        self._read = read

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._read(len(into))
        into[:len(data)] = data
        return len(data)


def parse_arc(source) -> Iterator[dict]:
    """Records of an ARC file (bytes, or a read(n) as of inflate()), one held at a time: the header line's fields by name, and 'block', the bytes of
    the declared length.

    The version block (the first record, if its URL starts with filedesc://) is yielded too and decides how later lines are read.
    A line with the other version's number of fields is read as that version. Blank lines between
    records are passed over; a header line that is neither, or a length beyond the file, is a ValueError.
    """
    file = io.BytesIO(source) if isinstance(source, bytes) else io.BufferedReader(_Stream(source), 1 << 16)
    version, first = 1, True
    while line := file.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        values = line.decode("utf-8", "surrogateescape").split(" ")
        as_version = next((v for v in (version, 1, 2) if len(values) == len(ARC_FIELDS[v])), None)
        if as_version is None:
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        record = dict(zip(ARC_FIELDS[as_version], values))
        said = record["Archive-length"]
        record["block"] = file.read(int(said)) if said.isdigit() else b""
        if not said.isdigit() or len(record["block"]) < int(said):
            raise ValueError(f"bad length in ARC header line: {line[:80]!r}")
        if first and record["URL"].startswith("filedesc://"):
            named = record["block"].split(b" ", 1)[0]
            version = int(named) if named in (b"1", b"2") else 1
        first = False
        yield record


# --- WARC ----------------------------------------------------------------------------------


def warc_date(date: str) -> str:
    """ISO 8601 of an ARC date of 14, 12, 10 or 8 digits; of NO_DATE if it is none."""
    digits = date if re.fullmatch(r"\d{8}(\d\d){0,3}", date) else NO_DATE
    digits = digits.ljust(14, "0")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(headers with their blank line, body) of an HTTP response, None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[:m.end()], block[m.end():]) if m else (block, b"")


def warc_record(kind: str, url: str, date: str, content: bytes, content_type: str, extra: list[tuple[str, str]], identity: str) -> bytes:
    """A WARC/1.1 record without the CRLF CRLF after its content."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", url))
    head += [*extra, ("Content-Type", content_type), ("Content-Length", str(len(content)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogateescape") for k, v in head) + b"\r\n" + content


def convert_record(arc: dict, original: tuple[str, str] | None = None, extra: list[tuple[str, str]] = (), identity: str | None = None) -> bytes:
    """The WARC record that says what an ARC record says; its id is made of its content unless one is given.

    filedesc (unless it holds an HTTP response) becomes warcinfo, dns a resource, an HTTP response a response, or a revisit if `original` names
    (record id, date) of the record that holds its payload; anything else a resource.
    """
    url, date, block = arc["URL"], warc_date(arc["Archive-date"]), arc["block"]
    http = split_http(block)
    payload = block if http is None else http[1]
    digest = base32_sha1(payload)
    identity = identity or record_id(url, date, digest, *[v for _, v in extra])
    if url.startswith("filedesc://") and http is None:
        name = url.removeprefix("filedesc://")
        return warc_record("warcinfo", "", date, b"format: WARC File Format 1.1\r\n", "application/warc-fields", [("WARC-Filename", name), *extra], identity)
    if http is None:
        kind = "text/dns" if url.startswith("dns:") else arc["Content-type"]
        return warc_record("resource", url, date, block, kind, [("WARC-Block-Digest", base32_sha1(block)), ("WARC-Payload-Digest", digest), *extra], identity)
    told = [("WARC-IP-Address", arc["IP-address"]), ("WARC-Payload-Digest", digest), *extra]
    if original is None:
        return warc_record("response", url, date, block, "application/http; msgtype=response", [("WARC-Block-Digest", base32_sha1(block)), *told], identity)
    told += [("WARC-Refers-To", original[0]), ("WARC-Refers-To-Date", original[1]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return warc_record("revisit", url, date, http[0], "application/http; msgtype=response", told, identity)


def parse_warc(read) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, content) of each record; read(n) gives up to n more bytes, b'' at the end."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = read(1 << 16)
            if not more:
                return False
            held.extend(more)
        return True

    while True:
        while held[:2] == b"\r\n" or (not held and fill(1) and held[:2] == b"\r\n"):
            if len(held) < 2 and not fill(2):
                break
            del held[:2]
        if not fill(1):
            return
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a WARC record's header does not end")
        lines = bytes(held[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not fill(end + 4 + size):
            raise ValueError("a WARC record's content is cut off")
        content = bytes(held[end + 4:end + 4 + size])
        del held[:end + 4 + size]
        if not fill(4) or held[:4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end with CRLF CRLF")
        del held[:4]
        yield head, content


def inflate(data: bytes, step: int = 1 << 14):
    """A read(n) over plain or gzip bytes (of one or many members) that never holds the whole of what they unpack to."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":

        def plain(n: int) -> bytes:
            nonlocal at
            at += n
            return bytes(view[at - n:at])

        return plain
    engine, rest = zlib.decompressobj(31), b""

    def packed(n: int) -> bytes:
        nonlocal at, engine, rest
        while True:
            if engine.eof:
                at -= len(engine.unused_data)
                engine, rest = zlib.decompressobj(31), b""
            if not rest:
                rest = view[at:at + step]
                at += len(rest)
                if not rest:
                    return b""
            out = engine.decompress(rest, n)
            rest = engine.unconsumed_tail
            if out:
                return out

    return packed


# --- Spark ---------------------------------------------------------------------------------


#: Bytes of packed records after which a file is closed.
FILE_BYTES = 32 << 20

#: What the text writer puts after a row: the last byte of a gzip member whose content is smaller than 16 MB.
LAST = "\x00"


def member(record: bytes) -> bytes:
    """A record and the CRLF CRLF after it as a gzip member that ends with LAST; an empty member follows if it would not."""
    content = record + b"\r\n\r\n"
    packed = gzip.compress(content, 6, mtime=0)
    return packed if len(content) % 2**32 < 1 << 24 else packed + gzip.compress(b"", mtime=0)


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write binary WARC records (one column) as gzip WARC files, a member for each record, each file closed at the first record that
    brings it to `file_bytes`."""
    def pack(batches):
        held = bytearray()
        for batch in batches:
            for record in batch.column(0):
                held += member(record.as_py())
                if len(held) >= file_bytes:
                    yield _file(held)
                    held = bytearray()
        if held:
            yield _file(held)

    files = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", LAST).option("maxRecordsPerFile", 1).text(path)


def _file(held: bytearray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bytes(memoryview(held)[:-1])], pa.binary())], names=["value"])


def read_warc(spark: SparkSession, path: str, pick, schema: str) -> DataFrame:
    """One row for each record of the WARC files under path: pick(headers, content) as a tuple of the schema's columns.

    Every file is one task's work at a time and is inflated as it is read; pick may return None to pass a record over.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, content in parse_warc(inflate(data.as_py())):
                    row = pick(head, content)
                    if row is not None:
                        rows.append(row)
                    if len(rows) == 4096:
                        yield _batch(rows, names, types)
                        rows = []
                if rows:
                    yield _batch(rows, names, types)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str], types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], names=names)


def convert_arc_files(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert every ARC file (plain or gzip) under arc_path; payloads are not deduplicated."""
    def convert(batches):
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for record in parse_arc(inflate(data.as_py())):
                    out.append(convert_record(record))
                    size += len(out[-1])
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    files = spark.read.format("binaryFile").load(arc_path).select("content")
    write_warc(files.mapInArrow(convert, "record binary"), warc_path)


#: Rows of the pages table that one in-memory ARC holds.
ARC_ROWS = 256

#: Bytes of payload that a task writes, about, where a shuffle leaves less to each.
TASK_BYTES = 4 << 20


def pages_to_warc(pages: DataFrame, path: str, min_bytes: int = 1000, version: int = 1, date: str = NO_DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write each page as an ARC record, convert it, and write the WARC records under path.

    Equal payloads are found by their SHA-1 and length: counts of (digest, largest page id) are partly summed
    before they move, only digests that come more than once are joined back, and the join keeps both
    sides splittable, so a payload shared by a third of all pages is spread over tasks. Where adaptive execution
    leaves the join in many small partitions, a task writes several, about `TASK_BYTES`, into the same files. A null html
    is an empty payload. All rows with the largest page_id of a group are responses; a null page_id
    is smaller than any other.
    """
    total = pages.agg(F.sum(F.octet_length("html").cast("long"))).head()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body")).withColumn("sha1", F.sha1("body")).withColumn("bytes", F.octet_length("body").cast("long"))
    known = pages.select("page_id", body.alias("body")).filter(F.octet_length("body") >= min_bytes)
    twice = (known.select("page_id", F.sha1("body").alias("s")).groupBy("s").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
             .filter("n > 1").select(F.concat("s", F.lit("")).alias("s"), "first_id").hint("shuffle_hash"))
    told = rows.join(twice, (F.col("sha1") == F.col("s")) & (F.col("bytes") >= min_bytes), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    told = told.select("page_id", "url", "body", refers.alias("refers")).coalesce(tasks)

    def convert(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ARC_ROWS):
                ids, urls, bodies, refs = (c.to_pylist() for c in batch.slice(k, ARC_ROWS).columns)
                arc = arc_version_block("pages.arc", version, date) + b"".join(arc_record(u, b, date, version) for u, b in zip(urls, bodies))
                records = islice(parse_arc(arc), 1, None)  # without the version block
                out = []
                for page, body, refer, record in zip(ids, bodies, refs, records, strict=True):
                    extra = [("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(body)))]
                    original = None
                    if refer is not None:
                        extra.append(("X-Refers-To-Page-Id", str(refer)))
                        original = (record_id("page", str(refer)), warc_date(date))
                    out.append(convert_record(record, original, extra, None if page is None else record_id("page", str(page))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    write_warc(told.mapInArrow(convert, "record binary"), path, file_bytes)


def page_row(head: dict, content: bytes) -> tuple | None:
    """What a record written by pages_to_warc says of its page; digests of responses are taken from the payload read."""
    if "x-page-id" not in head:
        return None
    page = int(head["x-page-id"]) if head["x-page-id"] else None
    if head["warc-type"] == "response":
        payload = split_http(content)[1]
        if base32_sha1(payload) != head["warc-payload-digest"]:
            raise ValueError("a payload does not have its digest")
        return page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    return page, int(head["x-payload-length"]), digest, "revisit", int(head["x-refers-to-page-id"])


def archive_pages(pages: DataFrame, min_bytes: int = 1000, version: int = 1) -> DataFrame:
    """Write the pages' WARC archives into the shared folder, read them back and tell what they hold of each page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per row of pages, repeated rows as often as they come. Null
    html is an empty payload, null urls and ids are passed on; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    delete_at_end(spark, path)
    pages_to_warc(pages, path, min_bytes, version)
    return read_warc(spark, path, page_row, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
