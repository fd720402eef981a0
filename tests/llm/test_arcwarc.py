"""ARC to WARC: round trips of both versions, damage, and the SQL."""

import base64
import gzip
import hashlib

from quirefold.llm import arcwarc as A

from .support import same


def archive(version, entries, name="x.arc"):
    body = f"{version} 0 test\n{A.V1 if version == 1 else A.V2}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19970101000000 text/plain {len(body)}\n".encode() + body + b"\n"]
    for url, date, block in entries:
        extra = f"200 abc - 17 {name} " if version == 2 else ""
        out.append(f"{url} 1.2.3.4 {date} text/html {extra}{len(block)}\n".encode() + block + b"\n")
    return out


ENTRIES = [("http://a.example/", "19970102030405", b"HTTP/1.0 200 OK\r\n\r\nhello\n\nworld"), ("http://b.example/with space", "1998", b""), ("dns:a.example", "19990101000000", b"10 a.example\n"), ("http://c.example/", "20000229235959", b"plain text\nhttp://d 1.1.1.1 19990101000000 text/html 5\nabcde")]


def test_both_versions():
    for version in (1, 2):
        rows = list(A.records("x.arc", b"".join(archive(version, ENTRIES))))
        assert [r[2] for r in rows] == ["warcinfo", "response", "resource", "metadata", "resource"]
        for (url, date, block), r in zip(ENTRIES, rows[1:], strict=True):
            assert (r[4], r[6], r[7], r[8], r[10]) == (url, "1.2.3.4", "text/html", len(block), block)
            assert r[5].replace("-", "").replace("T", "").replace(":", "").startswith(date)
            assert len(r[9]) == 5 + 32 and r[9] == A.digest(block)
        assert len({r[3] for r in rows}) == len(rows)
        assert [r[3] for r in rows] == [r[3] for r in A.records("x.arc", b"".join(archive(version, ENTRIES)))]


def test_compressed_members():
    parts = archive(2, ENTRIES)
    plain = list(A.records("x.arc", b"".join(parts)))
    assert list(A.records("x.arc", b"".join(gzip.compress(p) for p in parts))) == plain


def test_damage():
    parts = archive(1, ENTRIES)
    rows = list(A.records("x.arc", parts[0] + b"garbage without a header\n" + parts[1] + parts[2]))
    assert [r[2] for r in rows] == ["warcinfo", "error", "response", "resource"]
    cut = list(A.records("x.arc", b"".join(parts)[:-10]))
    assert [r[2] for r in cut] == ["warcinfo", "response", "resource", "metadata", "error"]
    assert list(A.records("x.arc", None)) == [] and list(A.records("x.arc", b"")) == []
    assert [r[2] for r in A.records("x.arc", b"\x00\xff nothing")] == ["error"]


def test_damaged_members_cost_only_themselves():
    parts = [gzip.compress(p) for p in archive(2, ENTRIES)]
    broken = bytearray(parts[2])
    broken[12:20] = b"\xff" * 8
    rows = list(A.records("x.arc", b"".join([*parts[:2], bytes(broken), *parts[3:]])))
    assert [r[2] for r in rows] == ["warcinfo", "response", "error", "metadata", "resource"] and rows[2][10] == bytes(broken)
    plain = archive(2, ENTRIES)
    mixed = list(A.records("x.arc", parts[0] + parts[1] + b"\0" * 9 + parts[2] + plain[3] + plain[4]))
    assert [r[2:] for r in mixed] == [r[2:] for r in A.records("x.arc", b"".join(plain))]
    cut = list(A.records("x.arc", parts[0] + parts[1] + parts[2][:-3] + parts[3] + parts[4][:20]))
    assert [r[2] for r in cut][:4] == ["warcinfo", "response", "error", "metadata"]


def test_damage_keeps_what_follows_and_all_its_bytes():
    parts = archive(1, ENTRIES)
    long = parts[1].replace(b" 31\n", b" 99999\n", 1)
    assert long != parts[1]
    rows = list(A.records("x.arc", parts[0] + long + parts[2] + b"no header\nnor this one\n" + parts[3]))
    assert [r[2] for r in rows] == ["warcinfo", "error", "resource", "error", "metadata"]
    assert rows[1][10] == long and rows[3][10] == b"no header\nnor this one\n"
    assert [r[1] for r in rows] == list(range(5))


def test_dates():
    assert A.iso_date("1996") == "1996-01-01T00:00:00Z" and A.iso_date("19960231000000") is None and A.iso_date("soon") is None


def test_query(spark, sf):
    same(A.op3_arc_to_warc(spark, sf), sf, A.sql())


def test_awkward_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a b\n", "x"), (None, "http://c", "y"), (2, "http://a b\n", "x"), (700, "http://z", "é" * 100000)], "page_id long, url string, html string")
    arcs = A.pages_to_arc(pages)
    rows = A.convert(arcs).orderBy("arc_file", "position").collect()
    assert [r.target_uri for r in rows if r.warc_type == "response"] == ["unknown:", "http://a%20b%0A", "http://a%20b%0A", "http://z"]
    assert A.convert(A.pages_to_arc(pages.limit(0))).count() == 0
    for r in arcs.collect():
        (tmp_path / r.arc_file).write_bytes(bytes(r.content))
        (tmp_path / f"{r.arc_file}.gz").write_bytes(gzip.compress(bytes(r.content)))
    found = A.read_arc(spark, str(tmp_path))
    assert found.count() == 2 * len(rows) and found.where("warc_type = 'error'").count() == 0
    A.write_warc(found, str(tmp_path / "warc"))
    raw = bytes(spark.read.parquet(str(tmp_path / "warc")).where("position = 1").first().warc)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    assert head.startswith(b"WARC/1.0\r\n") and int(fields[b"Content-Length"]) == len(block) - 4 and hashlib.sha1(block[:-4]).digest()
    both = found.select(A.as_warc().alias("w")).collect(), A.convert(spark.read.format("binaryFile").load(str(tmp_path / "*.arc*")).selectExpr("path AS arc_file", "content"), encoded=True).collect()
    assert sorted(bytes(r.w) for r in both[0]) == sorted(base64.b64decode(r.warc) for r in both[1])
    clash = arcs.selectExpr("arc_file", "content", "1 AS position", "'x' AS block", "2 AS Warc_Type")
    assert A.convert(clash).count() == len(rows)
