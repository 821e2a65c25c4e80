import base64
import gzip
import hashlib
import io
import zipfile

import duckdb
import pytest

from ranklake.llm import warc
from ranklake.llm.common import new_dir

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a b/\n", None), (2, None, ""), (3, "http://www.x.com:8080/A?b#c", "hé\r\n\r\n"), (3, "u", "hé\r\n\r\n"), (None, "u", "hé\r\n\r\n"),
    (None, "u", "only"), (None, "u", "only"), (9, "v", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (-4, "w", "x" * 300_000), (12, "w", "x" * 300_000), (13, "w", "PK\x05\x06" * 9),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        first = min((p for p in same if p is not None), default=None)
        again = len(same) > 1 and page != first
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", first if again else None))
    return out


@pytest.mark.parametrize("groups", [0, 50_000])
@pytest.mark.parametrize("size", [1000, 16 << 20])
def test_pages_come_back(spark, monkeypatch, groups, size):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", size)
    pages = spark.createDataFrame(ROWS, SCHEMA)
    packages = warc.write(pages, new_dir(spark, "test-warc"))
    assert sum(r.n_records for r in packages.collect()) == len(ROWS)
    got = warc.read(packages, payload=True).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, brute(ROWS)))
    texts = {digest(h): (h or "").encode() for _, _, h in ROWS}
    assert all((r.payload is None) if r.record_type == "revisit" else bytes(r.payload) == texts[r.payload_digest] for r in got)


def test_query_and_sql(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    wide = pages
    for i, c in enumerate(("key", "n", "first_id", "group_key", "revisit", "uri", "payload_bytes")):
        wide = wide.withColumn(c, pages.page_id + i)
    for name, df in (("plain", pages), ("wide", wide), ("none", pages.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/pages.parquet")
    got = {n: sorted(str(tuple(r)) for r in warc.op13(spark, f"{tmp_path}/{n}").collect()) for n in ("plain", "wide", "none")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/plain/pages.parquet/*.parquet')")
    assert got["plain"] == got["wide"] == sorted(str(r) for r in con.execute(warc.OP13_SQL).fetchall()) and got["none"] == []


def records(n):
    return [warc.record(i, f"http://h.example/{i}", f"page {i} ".encode() * i, None, False)[0] for i in range(n)]


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    raw = records(5)
    made = b"".join(warc.package([(warc.ARCHIVE, raw), ("datapackage.json", [b"{}"]), ("ü.txt", [])], zip64))
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, "datapackage.json", "ü.txt"]
        assert z.read(warc.ARCHIVE) == b"".join(raw) and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    for front, behind in ((b"", b""), (b"#!/bin/sh\nPK\x03\x04", b"")):
        own = warc.Package(io.BytesIO(front + made + behind))
        m = own.members[warc.ARCHIVE]
        assert own.range(own.stored(m), m.size) == b"".join(raw) and own.read(own.members["ü.txt"]) == b""


@pytest.mark.parametrize("streamed", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it" + b"." * 40])
@pytest.mark.parametrize("indexed", [False, True])
def test_packages_of_other_makers(streamed, comment, indexed):
    raw = records(40)

    class Stream(io.BytesIO):  # a file that can't be sought is written with data descriptors
        def seekable(self):
            return not streamed

        def tell(self):
            if streamed:
                raise OSError
            return super().tell()

    f = Stream()
    with zipfile.ZipFile(f, "w") as z:
        z.comment = comment
        with z.open(zipfile.ZipInfo("archive/rec.warc.gz"), "w", force_zip64=True) as m:
            m.write(b"".join(raw))
        z.writestr("archive/plain.warc", b"".join(gzip.decompress(x) for x in raw[:7]))
        if indexed:
            at, lines = 0, []
            for i, x in enumerate(raw):
                lines.append(f'example,h)/{i} 20250101000000 {{"url": "u", "offset": "{at}", "length": "{len(x)}", "filename": "rec.warc.gz"}}\n')
                at += len(x)
            z.writestr("indexes/index.cdx", "".join(lines), zipfile.ZIP_DEFLATED)
    own = warc.Package(io.BytesIO(f.getvalue()))
    found = [warc.parse(own.range(at, n)) for _, at, n in own.records()]
    assert [int(r.fields["page-id"]) for r in found] == [*range(40), *([] if indexed else range(7))]
    assert all(r.payload == f"page {r.fields['page-id']} ".encode() * int(r.fields["page-id"]) for r in found)


def test_broken_packages_are_refused():
    raw = records(3)
    made = b"".join(warc.package([(warc.ARCHIVE, raw)]))
    with pytest.raises(ValueError, match="end record"):
        warc.Package(io.BytesIO(made[:-5]))
    with pytest.raises(ValueError):
        warc.parse(raw[0][:-60])
    plain = bytearray(gzip.decompress(raw[2]))
    plain[-6] ^= 1
    with pytest.raises(ValueError, match="digest"):
        warc.parse(bytes(plain))
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"".join(raw))
    with pytest.raises(ValueError, match="stored"):
        list(warc.Package(f).records())


def test_addresses():
    assert warc.surt("http://www.x.com:8080/A?b#c") == "com,x:8080)/a?b"
    assert warc.surt("https://a.b.example:443") == "example,b,a)/"
    assert warc._address("http://a b/\n") == "http://a%20b/%0A" and warc._address(None) == "about:blank"
    assert warc.headers(b"WARC/1.0\r\nA: 1\r\n two\r\nB:3")["a"] == "1 two"
