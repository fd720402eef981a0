"""Legacy archives: ARC files of versions 1 and 2 read by their declared lengths and rewritten as WARC records.

An ARC file begins with a version block: a record of URL ``filedesc://...`` whose body gives the version and the names of
the header's fields.  Each later record is a header line and as many bytes as the line's last field declares, followed by
a line feed.  Version 1 lines hold URL, IP address, date, content type and length; version 2 adds result code, checksum,
location, offset and file name before the length.  URLs may hold spaces, so fields are taken from the right.

Each record becomes a WARC record.  Its type is ``warcinfo`` for the version block, ``response`` for a network body that
begins with an HTTP status line, ``metadata`` for ``dns:`` URLs and ``resource`` otherwise.  The date is the ARC date as
ISO 8601 in UTC (shorter dates are filled up as in ``19960101000000``), the digest ``sha1:`` and the base-32 SHA-1 of the
block, and the identifier a UUID made from MD5 of file, URL, date and digest, so that conversion can be repeated.

Damage has a defined result: a header line that cannot be parsed, or a length that runs past the file's end, gives one
record of type ``error`` that holds all up to the next line that parses as a header, where reading goes on.  Members
compressed one by one with gzip are unpacked; a member that cannot be unpacked gives an ``error`` record of its bytes, up
to the next member that can, and what stands between members uncompressed is read like any other content (zero bytes
there are padding).  Null and empty content gives no records.

In ``pages_to_arc`` a null URL is written as ``unknown:`` and a null page as an empty body; line breaks and spaces in URLs
become %0A, %0D and %20; pages of a null id are left out; rows that repeat an id are records each, in order of URL and
page, so ties between equal rows do not matter; a page of any length is one record; no pages give no archives; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode, b64encode
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "arc_file string, position long, warc_type string, record_id string, target_uri string, warc_date string, ip_address string, content_type string, content_length long, block_digest string, block binary"
#: Pages in one archive of ``pages_to_arc``.
PER_FILE = 256
#: Bytes of blocks after which a batch of records is handed on.
BATCH = 4 << 20
V1, V2 = "URL IP-address Archive-date Content-type Archive-length", "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
GZIP = b"\x1f\x8b\x08"
_DATE = re.compile(r"\d{4,14}$")


def member(content: memoryview, at: int) -> tuple[bytes, int, bool] | None:
    """Content, end and completeness of the gzip member at a place, or None where it cannot be unpacked."""
    d, out, end = zlib.decompressobj(31), [], at
    try:
        while not d.eof and end < len(content):
            out.append(d.decompress(content[end : end + (1 << 16)]))
            end = min(end + (1 << 16), len(content))
        out.append(d.flush())
    except zlib.error:
        return None
    return b"".join(out), end - len(d.unused_data), d.eof


def unpacked(content: bytes) -> Iterator[tuple[bool, bytes]]:
    """(True, content) with gzip members unpacked, and (False, bytes) of members that cannot be, in turn."""
    if content[:2] != GZIP[:2]:
        yield True, content
        return
    view, at, good, bad = memoryview(content), 0, [], -1
    while at < len(content):
        one = member(view, at) if content[at : at + 3] == GZIP else None
        further = content.find(GZIP, at + 1)
        # an incomplete member counts only at the end: elsewhere it is damage that reads like data
        if one and (one[2] or further < 0):
            if bad >= 0:
                yield False, content[bad:at]
                bad = -1
            good.append(one[0])
            at = one[1]
            continue
        if bad < 0 and content[at : at + 2] != GZIP[:2]:
            good.append(content[at : further if further >= 0 else len(content)].strip(b"\0"))
        elif bad < 0:
            if good:
                yield True, b"".join(good)
            good, bad = [], at
        at = further if further >= 0 else len(content)
    if bad >= 0:
        yield False, content[bad:]
    if good:
        yield True, b"".join(good)


def iso_date(arc: str) -> str | None:
    """An ARC date of 4 to 14 digits as ISO 8601, or None."""
    if not _DATE.match(arc):
        return None
    try:
        return datetime.strptime(arc + "00000101000000"[len(arc) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def digest(block: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str) -> str:
    """A URN of a UUID (version 3 in form) from the MD5 of the parts."""
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-a{h[17:20]}-{h[20:]}>"


def header(line: bytes, version: int) -> tuple[str, str, str, str, int] | None:
    """URL, address, ISO date, content type and length of a header line of this version, or None."""
    fields = line.decode("utf-8", "replace").split(" ")
    n = 5 if version == 1 else 10
    if len(fields) < n or not re.fullmatch(r"[0-9]{1,18}", fields[-1]):
        return None
    url, (ip, date, kind) = " ".join(fields[: len(fields) - n + 1]), fields[len(fields) - n + 1 : len(fields) - n + 4]
    iso = iso_date(date)
    return None if iso is None or ":" not in url else (url, ip, iso, kind, int(fields[-1]))


def version_of(body: bytes) -> int | None:
    """Version that a version block's body names."""
    m = re.match(rb"([12]) (\d+) [^\n]*\n(URL [^\n]*)", body)
    return None if m is None else (1 if len(m[3].split()) == 5 else 2)


def kind_of(url: str, block: bytes) -> str:
    if url.startswith("filedesc:"):
        return "warcinfo"
    if url.startswith("dns:"):
        return "metadata"
    return "response" if block[:5] == b"HTTP/" else "resource"


def found_at(content: bytes, at: int, version: int) -> tuple[int, tuple[str, str, str, str, int] | None]:
    """Where the line at a place ends, and the header that it is, or None."""
    end = content.find(b"\n", at)
    end = len(content) if end < 0 else end
    line = content[at:end].rstrip(b"\r")
    # a version block has a version 1 header, whatever follows it
    return end, header(line, 1 if line.startswith(b"filedesc:") else version)


def records(name: str, content: bytes | None) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` from one archive."""
    version, position = 1, 0

    def row(kind: str, url: str | None, date: str | None, ip: str | None, media: str | None, block: bytes) -> tuple:
        nonlocal position
        position += 1
        d = digest(block)
        return name, position - 1, kind, identifier(name, url or "", date or "", d), url, date, ip, media, len(block), d, block

    for good, piece in unpacked(content or b""):
        if not good:
            yield row("error", None, None, None, None, piece)
            continue
        at = 0
        while at < len(piece):
            if piece[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end, found = found_at(piece, at, version)
            if found is None or end + 1 + found[4] > len(piece):
                begin, at = at, end + 1
                while at < len(piece):  # on to the next line that is a header
                    end, found = found_at(piece, at, version)
                    if found is not None:
                        break
                    at = end + 1
                yield row("error", None, None, None, None, piece[begin:at])
                continue
            url, ip, date, media, size = found
            block = piece[end + 1 : end + 1 + size]
            if url.startswith("filedesc:"):
                version = version_of(block) or version
            yield row(kind_of(url, block), url, date, ip, media, block)
            at = end + 1 + size


def warc(row: tuple) -> bytes:
    """Bytes of a WARC record, from a row of ``SCHEMA``; ``as_warc`` gives the same."""
    _, _, kind, record, url, date, ip, media, size, d, block = row
    media = "application/http; msgtype=response" if kind == "response" else "application/warc-fields" if kind == "warcinfo" else "application/octet-stream" if media is None else media
    fields = [("WARC-Type", "metadata" if kind == "error" else kind), ("WARC-Record-ID", record), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-IP-Address", ip), ("WARC-Block-Digest", d), ("Content-Type", media), ("Content-Length", size)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(files: DataFrame, name: str = "arc_file", content: str = "content", encoded: bool = False) -> DataFrame:
    """WARC records of a table of archives, one archive a row; a map without a shuffle.

    Where ``encoded``, the column ``warc`` takes the place of ``block``: the record's bytes in base 64.
    """
    schema = SCHEMA.replace("block binary", "warc string") if encoded else SCHEMA
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string() if encoded else pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for r in records(b.column(0)[i].as_py() or "", b.column(1)[i].as_py()):
                    rows.append((*r[:-1], b64encode(warc(r)).decode()) if encoded else r)
                    size += r[8]
                    if size > BATCH:
                        yield give(rows)
                        rows, size = [], 0
                if rows:
                    yield give(rows)

    return files.select(F.col(f"`{name}`"), F.col(f"`{content}`")).mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records of the ``.arc`` and ``.arc.gz`` files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{arc,arc.gz}").load(path)
    return convert(files.select(F.col("path").alias("arc_file"), "content"))


def as_warc() -> Column:
    """Bytes of a WARC record, from the columns of ``SCHEMA``."""
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    media = F.when(F.col("warc_type") == "response", "application/http; msgtype=response").when(F.col("warc_type") == "warcinfo", "application/warc-fields").otherwise(F.coalesce("content_type", F.lit("application/octet-stream")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(F.col("warc_type") == "error", "metadata").otherwise(F.col("warc_type")), F.lit("\r\n"), line("WARC-Record-ID", "record_id"), line("WARC-Target-URI", "target_uri"),
        line("WARC-Date", "warc_date"), line("WARC-IP-Address", "ip_address"), line("WARC-Block-Digest", "block_digest"), F.lit("Content-Type: "), media, F.lit("\r\n"), line("Content-Length", "content_length"), F.lit("\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def write_warc(found: DataFrame, path: str) -> None:
    """Records as WARC bytes, a row each, sorted within each archive, in Parquet under a path."""
    found.repartition("arc_file").sortWithinPartitions("arc_file", "position").select("arc_file", "position", as_warc().alias("warc")).write.parquet(path)


def pages_to_arc(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(arc_file, content): pages as archives of ``per_file`` consecutive ids, odd ones of version 2, in order of the id.

    The capture date is 2000-01-01 plus the id in seconds, the address comes from the id, and the body is an HTTP
    response.  Pages of a null id are left out.
    """
    url = lambda u: (u or "unknown:").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        version, name, out = 1 + number % 2, f"pages-{number}.arc", []
        body = f"{version} 0 quirefold\n{V1 if version == 1 else V2}\n".encode()
        out.append(f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {len(body)}\n".encode() + body + b"\n")
        rows = table.sort_by([(c, "ascending") for c in ("page_id", "url", "html")]).to_pylist()
        for r in rows:
            i = r["page_id"]
            body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (r["html"] or "").encode()
            extra = f"200 - - 0 {name} " if version == 2 else ""
            out.append(f"{url(r['url'])} 10.{i // 65536 % 256}.{i // 256 % 256}.{i % 256} {r['stamp']} text/html {extra}{len(body)}\n".encode() + body + b"\n")
        return pa.table({"arc_file": [name], "content": pa.array([b"".join(out)], pa.binary())})

    rows = pages.where("page_id IS NOT NULL").select("page_id", "url", "html", F.date_format(F.timestamp_seconds(F.lit(946684800) + F.col("page_id")), "yyyyMMddHHmmss").alias("stamp"), F.floor(F.col("page_id") / per_file).cast("long").alias("number"))
    return rows.groupBy("number").applyInArrow(write, "arc_file string, content binary")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived as ARC of both versions, as WARC records: their fields, and their bytes in base 64."""
    return convert(pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet")), encoded=True)


def sql() -> str:
    """The query in DuckDB's SQL: what a faithful conversion gives, straight from the pages."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    b32 = f"'sha1:' || array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{alphabet}', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31), 1)), '')"
    return f"""
WITH p AS (SELECT *, page_id // {PER_FILE} AS number FROM pages WHERE page_id IS NOT NULL),
blocks AS (
  SELECT 'pages-' || number || '.arc' AS arc_file, row_number() OVER (PARTITION BY number ORDER BY page_id, url, html) AS position, 'response' AS warc_type,
    replace(replace(replace(coalesce(url, 'unknown:'), chr(13), '%0D'), chr(10), '%0A'), ' ', '%20') AS target_uri,
    strftime(make_timestamp((946684800 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
    '10.' || (page_id // 65536 % 256) || '.' || (page_id // 256 % 256) || '.' || (page_id % 256) AS ip_address, 'text/html' AS content_type,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS b FROM p
  UNION ALL
  SELECT DISTINCT 'pages-' || number || '.arc', 0, 'warcinfo', 'filedesc://pages-' || number || '.arc', '2000-01-01T00:00:00Z', '0.0.0.0', 'text/plain',
    (1 + number % 2) || ' 0 quirefold' || chr(10) || CASE WHEN number % 2 = 0 THEN '{V1}' ELSE '{V2}' END || chr(10) FROM p),
hashed AS (SELECT *, sha1(encode(b)) AS h, octet_length(encode(b)) AS content_length FROM blocks),
done AS (SELECT *, {b32} AS block_digest FROM hashed),
marked AS (SELECT *, md5(arc_file || chr(10) || target_uri || chr(10) || warc_date || chr(10) || block_digest) AS m FROM done),
named AS (SELECT *, '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-3' || m[14:16] || '-a' || m[18:20] || '-' || m[21:32] || '>' AS record_id, chr(13) || chr(10) AS nl FROM marked)
SELECT arc_file, position, warc_type, record_id, target_uri, warc_date, ip_address, content_type, content_length, block_digest,
  base64(encode('WARC/1.0' || nl || 'WARC-Type: ' || warc_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Target-URI: ' || target_uri || nl || 'WARC-Date: ' || warc_date || nl
    || 'WARC-IP-Address: ' || ip_address || nl || 'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || CASE warc_type WHEN 'response' THEN 'application/http; msgtype=response' ELSE 'application/warc-fields' END || nl
    || 'Content-Length: ' || content_length || nl || nl || b || nl || nl)) AS warc FROM named"""
