"""Web archives: a converter from legacy ARC files to WARC, with revisit records, and readers of both.

ARC files begin with a version block that tells which fields a header line has; records follow it, each
a header line and the declared number of bytes. The converter parses them by version and synthesises
what WARC asks for: record identifiers, ISO timestamps, record types and SHA-1 digests.

Files are written and read by Spark's text source with CR LF CR LF as the line separator: every WARC
record ends with it, and tasks commit by Spark's protocol. Compressed archives aren't split, so the
pieces of a file come in order; lengths alone decide where records end. A task holds a record at
a time, whatever the size of the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

END = b"\r\n\r\n"
#: Archive dates have 14 digits; legacy ones may end early.
DATE = "19700101000000"
ID_HEADER = "X-Page-Id"
#: Bytes that a batch of output holds, and copies of each join key, so that no key meets in one task.
BATCH_BYTES, SALTS = 4 << 20, 32

#: Fixed values of the ARC format: field names of both versions, and of the WARC format: the revisit profile.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Header lines by version; a URL or a type with blanks gives way to the fields after it.
_LINES = {
    1: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<mime>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<mime>.*) (?P<status>\d+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)"),
}
_CONTROL = re.compile(rb"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(head: bytes, name: str) -> str | None:
    """The first value of a header field, whatever the case of its name."""
    found = re.search(rb"(?:^|\n)" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*([^\r\n]*?)[ \t]*(?:\r?\n|\Z)", head, re.I)
    return found[1].decode("utf-8", "replace") if found else None


def fields_of(head: bytes) -> dict[str, str]:
    """The fields of a record's header by lower-case name; the first value of each counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP message."""
    ends = [(at, at + len(end)) for end in (END, b"\n\n") if (at := block.find(end)) >= 0]
    cut = min(ends)[1] if ends else len(block)
    return block[:cut], block[cut:]


class ArcParser:
    """Takes records off the front of an archive's bytes."""

    def __init__(self):
        self.version, self.name, self.at = 1, "", 0

    def take(self, held: bytearray, pos: int) -> tuple[dict | None, int, int]:
        """(record or None, bytes used, bytes needed for more) at ``pos``; line ends between records are passed over."""
        begin = pos
        while pos < len(held) and held[pos] in b"\r\n":
            pos += 1
        self.at += pos - begin
        end = held.find(b"\n", pos)
        if end < 0:
            return None, pos - begin, len(held) - pos + 1
        line = bytes(held[pos:end]).rstrip(b"\r")
        opens = line.startswith(b"filedesc:")
        found = next((m for v in ((1, 2) if opens else (self.version,)) if (m := _LINES[v].fullmatch(line))), None)
        if opens and (m := _LINES[2].fullmatch(line)):
            found = m
        if not found:
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        stop = end + 1 + int(found["length"])
        if len(held) < stop:
            return None, pos - begin, stop - pos
        record = {k: v.decode("utf-8", "replace") for k, v in found.groupdict().items()}
        record["block"] = bytes(held[end + 1 : stop])
        if opens:
            declared = re.match(rb"(\d+)", record["block"])
            self.version = 2 if declared and declared[1] == b"2" else 1
            self.name = record["url"].removeprefix("filedesc://")
        record |= {"version": self.version, "archive": self.name, "offset": self.at, "opens": opens}
        self.at += stop - pos
        return record, stop - begin, 1


class WarcParser:
    """Takes WARC records off the front of an archive's bytes."""

    def take(self, held: bytearray, pos: int) -> tuple[dict | None, int, int]:
        begin = pos
        while pos < len(held) and held[pos] in b"\r\n":
            pos += 1
        end = held.find(END, pos)
        if end < 0:
            return None, pos - begin, len(held) - pos + 1
        head = bytes(held[pos:end])
        fields = fields_of(head)
        length = fields.get("content-length", "")
        if not head.startswith(b"WARC/") or not length.isdigit():
            raise ValueError(f"not a WARC record: {head[:200]!r}")
        stop = end + 4 + int(length)
        if len(held) < stop:
            return None, pos - begin, stop - pos
        return {"fields": fields, "block": bytes(held[end + 4 : stop])}, stop - begin, 1


def _records(batches, parser) -> Iterator[dict]:
    """The records of archives that come in pieces, file after file; an unfinished one is an error."""
    held, pos, need, file, own = bytearray(), 0, 1, None, None
    for batch in batches:
        pieces, files, starts = (batch.column(c) for c in ("piece", "file", "start"))
        for piece, of, start in zip(pieces, files.to_pylist(), starts.to_pylist()):
            if of != file:
                if bytes(held[pos:]).strip():
                    raise ValueError("an archive ends within a record")
                if start:
                    raise ValueError("an archive was split: compress it, or raise spark.sql.files.maxPartitionBytes")
                held, pos, need, file, own = bytearray(), 0, 1, of, parser()
            held += piece.as_buffer()
            held += END
            while len(held) - pos >= need:
                record, used, need = own.take(held, pos)
                pos += used
                if record is None:
                    break
                yield record
            del held[:pos]
            pos = 0
    if bytes(held).strip():
        raise ValueError("an archive ends within a record")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the archives under a path between separators, in order within each file."""
    lines = spark.read.option("lineSep", END.decode()).schema("value string").text(path)
    return lines.select(F.col("value").cast("binary").alias("piece"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``BATCH_BYTES``."""
    kept, total = [], 0
    for row in rows:
        kept.append(row)
        total += 64 + size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, total = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


_LINE = pa.schema([("value", pa.binary())])


def _write(lines: DataFrame, path: str, separator: str, level: str) -> None:
    lines.select(F.col("value").cast("string")).write.options(lineSep=separator, compression="gzip", **{"zlib.compress.level": level}).text(path)


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", versions: tuple[int, ...] = (1, 2), date: str = DATE, level: str = "BEST_SPEED") -> None:
    """Write pages as gzip ARC files of HTTP responses, one file a task; tasks take turns at ``versions``.

    The id travels as the header ``X-Page-Id``. Null html is an empty payload, a null or empty url is
    ``-``; blanks and control characters of urls are percent-encoded. Other columns are not read.
    ``level`` is zlib's, by Hadoop's names (``DEFAULT_COMPRESSION``, ``BEST_SPEED`` ...).
    """
    rows = pages.select(F.col(id_col).cast("string").cast("binary").alias("id"), F.col(url_col).cast("string").cast("binary").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))

    def line(version, url, mime, status, at, name, block):
        ends = f"{status} - - {at} {name} {len(block)}" if version == 2 else f"{len(block)}"
        return b"%b 0.0.0.0 %b %b %b\n%b" % (url, date.encode(), mime.encode(), ends.encode(), block)

    def records(batches):
        task = TaskContext.get().partitionId()
        version, name, at = versions[task % len(versions)], f"pages-{task:07d}.arc", 0
        for batch in batches:
            for key, url, html in zip(*(c for c in batch.columns)):
                if not at:
                    told = f"{version} 0 tessera\n{FIELDS[version]}\n".encode()
                    opens = line(version, b"filedesc://" + name.encode(), "text/plain", 200, 0, name, told)
                    at = len(opens) + 1
                    yield (opens,)
                html, key, url = html.as_py(), key.as_py(), url.as_py()
                shown = b"" if key is None else ID_HEADER.encode() + b": %b\r\n" % key
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%bContent-Length: %d\r\n\r\n%b" % (shown, len(html), html)
                url = _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url or b"") or b"-"
                made = line(version, url, "text/html", 200, at, name, block)
                at += len(made) + 1
                yield (made,)

    _write(rows.mapInArrow(lambda batches: _batches(records(batches), _LINE, lambda r: len(r[0])), "value binary"), path, "\n", level)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files: (archive, offset, version, url, ip, date, mime, status, block); version blocks are left out."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.string()), ("block", pa.binary())])

    def run(batches):
        rows = (tuple(r.get(n) for n in schema.names) for r in _records(batches, ArcParser) if not r["opens"])
        return _batches(rows, schema, lambda r: len(r[-1]))

    return _pieces(spark, path).mapInArrow(run, "archive string, offset long, version int, url string, ip string, date string, mime string, status string, block binary")


_WARC = pa.schema(
    [("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("ip", pa.string()), ("content_type", pa.string()), ("source_id", pa.string())]
    + [("payload_length", pa.int64()), ("payload_digest", pa.string()), ("payload_sha256", pa.binary()), ("head", pa.binary()), ("payload", pa.binary())]
)
_WARC_DDL = "record_id string, warc_type string, target_uri string, warc_date string, ip string, content_type string, source_id string, payload_length long, payload_digest string, payload_sha256 binary, head binary, payload binary"


def warc_date(date: str) -> str:
    """ISO 8601 of up to 14 digits; missing ones are the least that a date can have."""
    full = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """An identifier that follows from a record's place, so that a task which runs again gives the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def convert_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The WARC equivalents of ARC records; ``payloads`` come with their heads but without ``payload_sha256``, which comes without them.

    HTTP messages become ``response`` records, the payload being what follows the HTTP head; all else
    (DNS answers, bare contents) becomes a ``resource`` of its type, ``-`` and no-type being octets.
    """

    def run(batches):
        for r in _records(batches, ArcParser):
            if r["opens"]:
                continue
            http = r["block"].startswith(b"HTTP/")
            head, payload = _split_http(r["block"]) if http else (b"", r["block"])
            mime = r["mime"] if r["mime"] not in ("", "-", "no-type") else "application/octet-stream"
            yield (
                record_id(r["archive"], r["offset"]),
                "response" if http else "resource",
                r["url"],
                warc_date(r["date"]),
                r["ip"],
                "application/http;msgtype=response" if http else mime,
                header_value(head, ID_HEADER),
                len(payload),
                sha1_base32(payload),
                b"" if payloads else hashlib.sha256(payload).digest(),  # told by the pass that looks for equal payloads
                head if payloads else b"",
                payload if payloads else b"",
            )

    return _pieces(spark, path).mapInArrow(lambda batches: _batches(run(batches), _WARC, lambda r: 256 + len(r[-1])), _WARC_DDL)


def _order(name: str) -> Column:
    """Ids in the order of their numbers; others after them as texts, null ones last."""
    number = F.expr(f"try_cast({name} AS decimal(38,0))")
    return F.struct(F.col(name).isNull().alias("null"), number.isNull().alias("text"), number.alias("number"), F.col(name).alias("id"), "record_id")


def _salted(rows: DataFrame, keyed: DataFrame, key: list[str], by: str) -> DataFrame:
    """``rows`` joined to ``keyed``, which has a row a key: each key is dealt over ``SALTS`` tasks."""
    copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*key, "salt"]).drop("salt")


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """(record_id, refers_to, refers_to_uri, refers_to_date) of records that repeat a payload of at least ``least`` bytes.

    Of equal payloads (by SHA-256 and length; SHA-1 alone can be forged) the record of the smallest
    ``source_id`` is the first; ties go by record id.
    """
    key = ["payload_sha256", "payload_length"]
    long = records.where(F.col("payload_length") >= least)
    first = F.min(F.struct(_order("source_id").alias("at"), F.col("target_uri").alias("refers_to_uri"), F.col("warc_date").alias("refers_to_date"))).alias("first")
    firsts = long.groupBy(*key).agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    found = _salted(long.select(*key, "record_id"), firsts, key, "record_id").where("record_id <> first.at.record_id")
    return found.select("record_id", F.col("first.at.record_id").alias("refers_to"), "first.refers_to_uri", "first.refers_to_date")


def write_warc(records: DataFrame, path: str, level: str = "BEST_SPEED") -> None:
    """Write records (the columns of ``convert_arc`` and ``revisits``) as gzip WARC 1.1 files, one a task, each opened by a warcinfo record.

    A record with ``refers_to`` becomes a revisit: it keeps its HTTP head and the digest and length of
    the payload, not the payload.
    """
    names = [*_WARC.names, "refers_to", "refers_to_uri", "refers_to_date"]

    def framed(fields, block):
        told = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
        return (f"WARC/1.1\r\n{told}WARC-Block-Digest: sha1:{sha1_base32(block)}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block,)

    def lines(batches):
        task, begun = TaskContext.get().partitionId(), False
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                r = dict(zip(names, row))
                if not begun:
                    begun, name = True, f"pages-{task:07d}.warc.gz"
                    yield framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", r["warc_date"]), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: tessera\r\nformat: WARC File Format 1.1\r\n")
                again = r["refers_to"] is not None
                fields = [("WARC-Type", "revisit" if again else r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]), ("WARC-IP-Address", r["ip"])]
                fields += [("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("X-Payload-Length", str(r["payload_length"]))]
                if again:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["refers_to"]), ("WARC-Refers-To-Target-URI", r["refers_to_uri"]), ("WARC-Refers-To-Date", r["refers_to_date"])]
                yield framed([*fields, ("Content-Type", r["content_type"])], r["head"] if again else r["head"] + r["payload"])

    _write(records.select(*names).mapInArrow(lambda batches: _batches(lines(batches), _LINE, lambda r: len(r[0])), "value binary"), path, END.decode(), level)


_BACK = "record_id string, warc_type string, target_uri string, warc_date string, source_id string, payload_length long, payload_digest string, refers_to string, intact boolean, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files but warcinfo: identifiers, type, payload digest and length, what a revisit refers to, payload.

    ``payload_digest`` is computed from the payload, for a revisit it is the declared one. ``intact``
    tells whether block and payload have the digests that the header declares.
    """
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip([c.split()[0] for c in _BACK.split(", ")], kinds)))

    def run(batches):
        for r in _records(batches, WarcParser):
            told = r["fields"].get
            kind = told("warc-type")
            if kind == "warcinfo":
                continue
            http = told("content-type", "").startswith("application/http")
            head, payload = _split_http(r["block"]) if http else (b"", r["block"])
            declared, block = (told(f"warc-{n}-digest", "").removeprefix("sha1:") for n in ("payload", "block"))
            again = kind == "revisit"
            digest = declared if again else sha1_base32(payload)
            intact = block in ("", sha1_base32(r["block"])) and declared in ("", digest)
            length = int(told("x-payload-length", 0)) if again else len(payload)
            yield told("warc-record-id"), kind, told("warc-target-uri"), told("warc-date"), header_value(head, ID_HEADER), length, digest, told("warc-refers-to"), intact, payload if payloads else b""

    return _pieces(spark, path).mapInArrow(lambda batches: _batches(run(batches), schema, lambda r: 256 + len(r[-1])), _BACK)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """Convert ARC files to WARC files, repeated payloads of at least ``least`` bytes as revisits.

    A first pass takes digests alone; the second reads payloads again and joins the revisits by record
    id, which no two records share. Spark broadcasts their table where it is small enough.
    """
    work = Workspace(spark, "convert")
    again = work.table(revisits(convert_arc(spark, arc, payloads=False), least), "revisits")
    write_warc(convert_arc(spark, arc).join(again, "record_id", "left"), warc)
    work.drop(again)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Archive pages as ARC, convert to WARC and read back: (id, payload_bytes, payload_digest, record_type, refers_to, intact).

    One row a page. Null and empty html are the same empty payload. A null id comes last among equal
    payloads, repeated ids and rows are records of their own (all but the first revisit it), and an
    empty table gives none. Other columns are not read.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    work = Workspace(spark, "warc")
    arc, warc = work.folder("arc"), work.folder("warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col)
    arc_to_warc(spark, arc, warc, least)
    work.remove(arc)
    back = work.table(read_warc(spark, warc, payloads=False).drop("payload"), "back")
    work.remove(warc)
    named = back.where("warc_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct().join(back.select("record_id", F.col("source_id").alias("first_id")), "record_id")
    own = back.where("warc_type = 'revisit'").select(F.col("refers_to").alias("record_id"), F.col("record_id").alias("own_id"), *[c for c in back.columns if c not in ("record_id", "refers_to")])
    linked = _salted(own, named, ["record_id"], "own_id")
    shown = [F.col("source_id").cast(kind).alias(id_col), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type")]
    first = back.where("warc_type <> 'revisit'").select(*shown, F.lit(None).cast(kind).alias("refers_to"), "intact")
    return first.unionByName(linked.select(*shown, F.col("first_id").cast(kind).alias("refers_to"), "intact"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 as base 32: five hexadecimal digits are four letters.
ORACLE_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), numbers AS (
  SELECT page_id, payload, list_transform(range(0, 40, 5), lambda i: list_reduce(list_transform(string_split(substr(hex, i + 1, 5), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: a * 16 + b)) AS n FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM numbers
)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(n, lambda x: array_to_string(list_transform([x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', d + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
