"""WARC archives: written from pages in tasks, and read back by a reader that salvages what damage has left.

write() makes one record a page, each its own gzip member, in archives of about ARCHIVE bytes. Of pages with equal payloads
of REVISIT bytes or more, the one of largest page_id is a response and the others are revisit records that name it; all
other pages are responses. Archives go to the folder it is given, under names of their own for each attempt of a task; the
list of archives that it returns is written by Spark, so it names those of committed tasks only, and only these are read.

read() walks each archive. A record is taken if its member's checksum holds, its header parses, its block is as long as the
header says and followed by a blank line, and its digests, where given, agree. After a failed check the reader looks for the
next place that starts a valid record (a gzip member, or a line with the version where nothing is compressed), goes on from
there and logs the bytes between as a gap. A damaged member's bytes up to the damage are searched for whole records too, and
these count if their own digest holds; such a member is logged as a gap as well. All other bytes lie in one record or one gap.

Defined cases: a null html is an empty payload; a null or empty url leaves the target out; control characters in it are
percent-encoded. Rows that repeat the largest page_id of their payload are responses too, under one record id. Null page_ids
are smaller than all others and revisit like them; among null page_ids alone all are responses, and a record without
page_id is read back without one. Empty files and files without any record give gaps only (an empty file gives nothing). An
archive longer than memory allows is one that a single record made: payloads are held whole, one at a time. Inside the block
of a damaged record, a well-formed record that the page quotes is taken for one. Where nothing is compressed no checksum covers
a header: damage to it is seen only if it no longer parses or its numbers no longer fit. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._spark import prepare, written
from millrace.session import shared_dir

#: Bytes after which an archive is closed, and the least payload that is written once for all its copies.
ARCHIVE, REVISIT = 32_000_000, 1000
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, start long, stop long, kind string, reason string, record_id string, record_type string, page_id long, target string, refers_to_id string, payload_bytes long, payload_digest string, declared_digest string, payload binary"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(*what) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(what).encode()).digest()[:16])}>"


def encoded(page_id: int | None, url: str | None, payload: bytes, digest: str, head: int | None) -> bytes:
    """One record, uncompressed. head: the page that holds the payload, if this record revisits it."""
    revisit = head is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    declared = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id("revisit" if revisit else "response", page_id, digest)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id("response", head, digest))]
    fields += [("WARC-Payload-Digest", declared), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, archive: int = ARCHIVE, level: int = 1) -> DataFrame:
    """Archives of pages (page_id, url, html) under folder, a URI that driver and executors share; returns (archive, records, bytes)."""
    prepare(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    slim = slim.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    sizes = slim.select("page_id", "digest", F.octet_length("html").alias("size")).where(F.col("size") >= REVISIT)
    # heads of payloads that occur once are not needed: their pages are responses anyway
    heads = sizes.groupBy(F.col("digest").alias("hd"), F.col("size").alias("hs")).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("head")).where("n > 1 AND head IS NOT NULL").drop("n")
    heads = written(heads, "warc-heads")
    met = slim.join(heads, (F.col("digest") == F.col("hd")) & (F.octet_length("html") == F.col("hs")), "left")
    met = met.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("head"))

    def work(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, records, size = None, None, 0, 0
        for batch in batches:
            closed = []
            for page_id, url, html, digest, head in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "head")), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(encoded(page_id, url, html.encode(), digest, head)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive:
                    out.close()
                    closed.append((name, records, size))
                    out = None
            if closed:
                yield _archives(closed)
        if out is not None:
            out.close()
            yield _archives([(name, records, size)])

    return written(met.mapInArrow(work, "archive string, records long, bytes long"), "warc-archives")


def _archives(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    names, records, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])


class Broken(ValueError):
    """A failed check."""


def _parsed(data: memoryview, at: int) -> tuple[int, dict[str, str], memoryview]:
    """The record at `at`: where it ends, its fields (names in lower case) and its block."""
    line = _VERSION.match(data, at)
    if not line:
        raise Broken("no version line")
    blank = re.compile(rb"\r?\n\r?\n").search(data, line.end() - 2, line.end() + 65_536)
    if not blank:
        raise Broken("header without end")
    fields: dict[str, str] = {}
    for raw in re.split(rb"\r?\n(?![ \t])", bytes(data[line.end() : blank.start()])):
        name, colon, value = raw.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise Broken("header line without a name")
        fields[name.strip().lower()] = " ".join(value.split())
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        raise Broken("no content length")
    stop = blank.end() + int(fields["content-length"])
    if stop > len(data):
        raise Broken("block is cut short")
    tail = re.compile(rb"\r?\n\r?\n").match(data, stop)
    if not tail:
        raise Broken("no blank line behind the block")
    block = data[blank.end() : stop]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"].upper() != _digest(block).upper():
        raise Broken("block digest differs")
    return tail.end(), fields, block


def _plain(data: memoryview, at: int, digested: bool = False) -> Iterator[tuple[int, int, str | None, dict, memoryview]]:
    """Records and gaps of uncompressed data as (start, stop, reason, fields, block); reason is null for records."""
    reason, gap = None, at
    while at < len(data):
        try:
            stop, fields, block = _parsed(data, at)
            if digested and "warc-block-digest" not in fields:
                raise Broken("no digest to trust in a damaged member")
        except Broken as why:
            reason = reason or str(why)
            following = next((m.start() for m in _VERSION.finditer(data, at + 1) if data[m.start() - 1] == 10), len(data))
            at = following
            continue
        if gap < at:
            yield gap, at, reason, {}, memoryview(b"")
        yield at, stop, None, fields, block
        at = gap = stop
        reason = None
    if gap < len(data):
        yield gap, len(data), reason, {}, memoryview(b"")


def _member(data: memoryview, at: int) -> tuple[int | None, bytes]:
    """The gzip member at `at`: where it ends, or null if it is damaged, and what could be unpacked of it."""
    opened, out = zlib.decompressobj(31), bytearray()
    for step in (1 << 20, 4096, 1):  # what stands before the damage is lost with the step that meets it, so steps get smaller
        while at < len(data):
            before = opened.copy()
            try:
                out += opened.decompress(data[at : at + step])
            except zlib.error:
                opened = before
                break
            at += step
            if opened.eof:
                return min(at, len(data)) - len(opened.unused_data), bytes(out)
        else:
            break
    return None, bytes(out)


def records(data: bytes) -> Iterator[tuple[int, int, str | None, dict, memoryview]]:
    """Records and gaps of one archive, compressed or not, mixed or not: (start, stop, reason, fields, block).

    start and stop are places in the archive; records of one member share them.
    """
    view, at, gap, reason = memoryview(data), 0, 0, None
    while at < len(view):
        if view[at : at + 3] == _MAGIC:
            stop, inner = _member(view, at)
            whole = list(_plain(memoryview(inner), 0, digested=stop is None))
            good = [x for x in whole if x[2] is None]
            if good:
                # a damaged member reaches to the next valid start; the search for it begins behind its magic
                if gap < at:
                    yield gap, at, reason, {}, memoryview(b"")
                here = stop if stop is not None else _next_start(view, at + 1)
                for _, _, why, fields, block in whole:
                    if why is None:
                        yield at, here, None, fields, block
                if stop is None or len(good) < len(whole):
                    yield at, here, "member damaged behind the records that were recovered" if stop is None else f"inside a member: {next(x[2] for x in whole if x[2])}", {}, memoryview(b"")
                at = gap = here
                reason = None
                continue
            reason = reason or ("member is damaged" if stop is None else (whole[0][2] if whole else "empty member"))
        else:
            try:
                stop, fields, block = _parsed(view, at)
                if gap < at:
                    yield gap, at, reason, {}, memoryview(b"")
                yield at, stop, None, fields, block
                at = gap = stop
                reason = None
                continue
            except Broken as why:
                reason = reason or str(why)
        at = _next_start(view, at + 1, sure=False)
    if gap < len(view):
        yield gap, len(view), reason, {}, memoryview(b"")


def _next_start(view: memoryview, at: int, sure: bool = True) -> int:
    """The next place from `at` that looks like a start of a record; with sure, one whose record is valid."""
    look = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/1\.[01]\r?\n")
    for m in look.finditer(view, at):
        if not sure:
            return m.start()
        if m[0] == _MAGIC:
            stop, inner = _member(view, m.start())
            if stop is None or not any(x[2] is None for x in _plain(memoryview(inner), 0)):
                continue
        else:
            try:
                _parsed(view, m.start())
            except Broken:
                continue
        return m.start()
    return len(view)


def _payload(fields: dict, block: memoryview) -> memoryview:
    """What follows the HTTP header of a response; other blocks are payloads themselves."""
    if fields.get("content-type", "").startswith("application/http"):
        blank = re.compile(rb"\r?\n\r?\n").search(block)
        return block[blank.end() :] if blank else block[len(block) :]
    return block


def _rows(archive: str, data: bytes, payload: bool) -> Iterator[tuple]:
    for start, stop, reason, fields, block in records(data):
        if reason is not None:
            yield archive, start, stop, "gap", reason, *[None] * 9
            continue
        body, kind = _payload(fields, block), fields.get("warc-type")
        number = fields.get("page-id", "")
        found = None if kind == "revisit" else hashlib.sha1(body).hexdigest()
        declared = fields.get("warc-payload-digest", "").partition(":")[2].upper()
        try:
            declared = base64.b32decode(declared).hex() or None
        except ValueError:
            declared = None
        if found and declared and found != declared:
            yield archive, start, stop, "gap", "payload digest differs", *[None] * 9
            continue
        size = None if kind == "revisit" else len(body)
        yield archive, start, stop, "record", None, fields.get("warc-record-id"), kind, int(number) if re.fullmatch(r"-?[0-9]{1,18}", number) else None, fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, found, declared, bytes(body) if payload and kind != "revisit" else None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += len(row[-1] or b"") + 300
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])


def read(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records and gaps (see RECORDS) of the archives that write() listed under folder; payloads only if asked for."""
    prepare(archives.sparkSession)

    def work(batches):
        store, path = fs.FileSystem.from_uri(folder)

        def each():
            for batch in batches:
                for name in batch.column("archive").to_pylist():
                    with store.open_input_file(f"{path}/{name}") as f:
                        yield from _rows(name, f.read(), payload)
        yield from _batches(each(), _schema())

    # dealt by number, as a shuffle of so few bytes would be merged into one task
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(work, RECORDS)


def read_files(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The same of any .warc or .warc.gz files that Spark can list, each held whole by its task."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")

    def work(batches):
        yield from _batches((row for batch in batches for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for row in _rows(name, data.as_py(), payload)), _schema())

    return files.mapInArrow(work, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size and digest of what they revisit: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit whose response is missing, or differs from the digest that it declares, has null payload_bytes and keeps its own digest.
    """
    known = records.where("kind = 'record'")
    # repeated responses are equal, so any of them will do
    heads = known.where("record_type = 'response'").groupBy(F.col("record_id").alias("hid")).agg(F.max("page_id").alias("hp"), F.max("payload_bytes").alias("hb"), F.max("payload_digest").alias("hd"))
    wanted = known.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("w")).distinct()
    heads = written(heads.join(wanted, F.col("hid") == F.col("w"), "left_semi"), "warc-referred")
    met = known.join(heads, (F.col("record_type") == "revisit") & (F.col("refers_to_id") == F.col("hid")) & (F.col("declared_digest") == F.col("hd")), "left")
    return met.select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("hb")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.coalesce("payload_digest", "declared_digest").alias("payload_digest"),
        "record_type", F.when(F.col("record_type") == "revisit", F.col("hp")).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row a page, as resolved() gives them."""
    folder = f"{shared_dir(pages.sparkSession)}/millrace/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    return resolved(written(read(write(pages, folder), folder, payload=False), "warc-records"))
