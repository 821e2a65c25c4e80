"""WARC records in ZIP packages: written by tasks, located through the ZIP directory, read by range.

A package is a ZIP file of stored members: `archive/data.warc.gz`, whose records are gzip members
of their own, and `indexes/index.cdxj`, a line a record with its offset and length in the archive.
A reader parses the end record, the ZIP64 records and the central directory, takes the place of a
stored member from its local header, and reads records by range: nothing is extracted.

Of records with equal payloads the one of the smallest page_id is a response, the others revisit
it: they hold the HTTP header alone, with the length and digest of the payload they leave out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_staged, new_dir, open_shared, staged, to_partitions, write_shared

#: A task closes a package when its archive reaches this size; a longer record has one of its own.
PACKAGE_BYTES = 16 << 20
#: Records that one range read takes at once, at most, unless a single one is longer.
READ_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20
#: More groups of equal payloads than this are joined by a shuffle instead of a broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000
DATE = "2025-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

# --- fixed values: signatures and layouts of ZIP records ---
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_FORM, LOCATOR_FORM = "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
# --- end of fixed values ---


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def package(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """The parts of a ZIP file of stored members; ZIP64 records where sizes need them, or if asked."""
    out, central, at = [], [], 0
    stamp = (0, 0x21)  # midnight of 1980-01-01
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        wide = zip64 or size >= FULL32
        far = zip64 or at >= FULL32
        extra = struct.pack("<2H2Q", 1, 16, size, size) if wide else b""
        short = FULL32 if wide else size
        local = struct.pack(LOCAL_FORM, LOCAL, 45 if wide else 20, 0x800, 0, *stamp, crc, short, short, len(raw), len(extra)) + raw + extra
        body = (struct.pack("<2Q", size, size) if wide else b"") + (struct.pack("<Q", at) if far else b"")
        tail = struct.pack("<2H", 1, len(body)) + body if body else b""
        central.append(
            struct.pack(CENTRAL_FORM, CENTRAL, 45, 45 if body else 20, 0x800, 0, *stamp, crc, short, short, len(raw), len(tail), 0, 0, 0, 0, FULL32 if far else at) + raw + tail
        )
        out += [local, *parts]
        at += len(local) + size
    size, n = sum(map(len, central)), len(central)
    out += central
    if zip64 or n >= FULL16 or at >= FULL32 or size >= FULL32:
        out.append(struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, n, n, size, at))
        out.append(struct.pack(LOCATOR_FORM, LOCATOR, 0, at + size, 1))
    out.append(struct.pack(END_FORM, END, 0, 0, FULL16 if zip64 else min(n, FULL16), FULL16 if zip64 else min(n, FULL16), FULL32 if zip64 else min(size, FULL32), FULL32 if zip64 else min(at, FULL32), 0))
    return out


class Package:
    """A ZIP file opened for range reads: its directory, and the bytes of stored members."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, io.SEEK_END) or file.tell()
        self.members = {m.name: m for m in self._directory()}

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) != n:
            raise ValueError(f"the package ends within {n} bytes at {at}")
        return out

    def _directory(self) -> list[Member]:
        """The central directory, by way of the last end record whose comment reaches the end of the file."""
        least = struct.calcsize(END_FORM)
        n = min(self.size, FULL16 + least)
        tail = self.range(self.size - n, n)
        at = tail.rfind(END)
        while at >= 0 and not (at + least <= n and at + least + struct.unpack_from("<H", tail, at + 20)[0] == n):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        place = self.size - n + at
        *_, count, size, start, _ = struct.unpack_from(END_FORM, tail, at)
        ends = place
        step = struct.calcsize(LOCATOR_FORM)
        if place >= step and (locator := self.range(place - step, step))[:4] == LOCATOR:
            wide = struct.calcsize(END64_FORM)
            where = struct.unpack(LOCATOR_FORM, locator)[2]
            if where + wide > place or self.range(where, 4) != END64:  # bytes stand before the archive
                where = place - step - wide
            record = struct.unpack(END64_FORM, self.range(where, wide))
            if record[0] != END64:
                raise ValueError("no ZIP64 end record")
            count, size, start = record[7], record[8], record[9]
            ends = where
        before = ends - size - start  # bytes in front of the archive move every offset
        if before < 0:
            raise ValueError("the ZIP directory overlaps its end record")
        raw, out, at = self.range(ends - size, size), [], 0
        for _ in range(count):
            form = struct.unpack_from(CENTRAL_FORM, raw, at)
            if form[0] != CENTRAL:
                raise ValueError("the ZIP directory is broken")
            flags, method, crc, packed, full = form[3], form[4], form[7], form[8], form[9]
            n_name, n_extra, n_comment, header = form[10], form[11], form[12], form[16]
            at += struct.calcsize(CENTRAL_FORM)
            name = raw[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:  # holds just those values that don't fit, in this order
                    held = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    full = next(held) if full == FULL32 else full
                    packed = next(held) if packed == FULL32 else packed
                    header = next(held) if header == FULL32 else header
                extra = extra[4 + length :]
            if flags & 1:
                raise ValueError(f"{name} is encrypted")
            out.append(Member(name, method, crc, packed, full, header + before))
        return out

    def start(self, member: Member) -> int:
        """Where a member's bytes begin: behind its local header, whose name and extra field have lengths of their own."""
        form = struct.unpack(LOCAL_FORM, self.range(member.header, struct.calcsize(LOCAL_FORM)))
        if form[0] != LOCAL:
            raise ValueError(f"{member.name} has no local header")
        return member.header + struct.calcsize(LOCAL_FORM) + form[9] + form[10]

    def read(self, member: Member) -> bytes:
        """A member whole (an index), stored or deflated, its checksum verified."""
        raw = self.range(self.start(member), member.packed)
        if member.method == 8:
            raw = zlib.decompress(raw, -15)
        elif member.method:
            raise ValueError(f"{member.name} is packed by method {member.method}")
        if zlib.crc32(raw) != member.crc:
            raise ValueError(f"{member.name} has another checksum")
        return raw

    def stored(self, member: Member) -> int:
        """Where the bytes of an archive member begin; one that isn't stored can't be read by range."""
        if member.method:
            raise ValueError(f"{member.name} isn't stored, so no range of it is a record")
        return self.start(member)

    def archives(self) -> list[Member]:
        return [m for m in self.members.values() if re.fullmatch(r"archive/.*\.warc(\.gz)?", m.name)]

    def records(self) -> Iterator[tuple[str, int, int]]:
        """Place (archive, offset in the package, length) of every record: from the indexes, else by a walk through the archives."""
        indexes = [m for m in self.members.values() if re.fullmatch(r"indexes/.*\.cdxj?", m.name)]
        starts = {m.name: self.stored(m) for m in self.archives()}
        if not indexes:
            for m in self.archives():
                yield from ((m.name, starts[m.name] + a, n) for a, n in self.walk(m))
            return
        for m in indexes:
            for line in self.read(m).decode().splitlines():
                _, _, found = line.partition(" {")
                if found:
                    entry = json.loads("{" + found)
                    name = next((n for n in (entry["filename"], f"archive/{entry['filename']}") if n in starts), None)
                    if name is None:
                        raise ValueError(f"no archive {entry['filename']}")
                    yield name, starts[name] + int(entry["offset"]), int(entry["length"])

    def walk(self, member: Member) -> Iterator[tuple[int, int]]:
        """Offset and length of the records of an archive without an index, read in blocks."""
        base, at = self.stored(member), 0
        zipped = member.size >= 2 and self.range(base, 2) == b"\x1f\x8b"
        while at < member.size:
            if zipped:
                unpack, used = zlib.decompressobj(31), at
                while not unpack.eof:
                    if used >= member.size:
                        raise ValueError(f"{member.name} ends within a record")
                    block = self.range(base + used, min(1 << 16, member.size - used))
                    unpack.decompress(block)
                    used += len(block) - len(unpack.unused_data)
                n = used - at
            else:
                head = b""
                while (end := head.find(b"\r\n\r\n")) < 0:
                    more = min(len(head) + 4096, member.size - at)
                    if more == len(head):
                        raise ValueError(f"{member.name} ends within a record")
                    head = self.range(base + at, more)
                n = end + 4 + int(headers(head[:end])["content-length"]) + 4
            yield at, n
            at += n


def headers(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def sha1_32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def _address(url: str | None) -> str:
    """A URL fit for a header and an index line: blanks and controls in percent form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> tuple[bytes, str]:
    """A WARC record as a gzip member, and its payload's digest."""
    digest = sha1_32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _address(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", date)]
        if refers_to is not None:
            fields.append(("Refers-To-Page", str(refers_to)))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush(), digest


class Record(NamedTuple):
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(raw: bytes) -> Record:
    """A record of a range: unpacked if packed, cut by its lengths, its block digest verified."""
    if raw[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(raw)
        if not unpack.eof:
            raise ValueError("a WARC record is cut off")
    end = raw.index(b"\r\n\r\n")
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = headers(raw[:end])
    n = int(fields["content-length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n:
        raise ValueError("a WARC record is cut off")
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and sha1_32(block) != digest:
        raise ValueError("a WARC block has another digest")
    http: dict[str, str] = {}
    if fields.get("content-type", "").startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        http = headers(head)
    return Record(fields, http, block)


def surt(url: str) -> str:
    """The key of an index line: the host's names from the last to the first, then the rest."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    if not m:
        return url.lower()
    host = ",".join(reversed([p for p in m[1].lower().removeprefix("www.").split(".") if p]))
    return f"{host}{f':{m[2]}' if m[2] and m[2] not in ('80', '443') else ''}){(m[3] or '/').lower()}"


def _package(folder: str, held: list[tuple[str, bytes, str]], date: str) -> tuple[str, int, int]:
    """Write a package of (url, record, digest); its name is its own, so that a second attempt of a task disturbs none."""
    at, lines = 0, []
    stamp = re.sub(r"\D", "", date)
    for url, raw, digest in held:
        lines.append(f"{surt(url)} {stamp} " + json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": at, "length": len(raw), "filename": ARCHIVE.rpartition("/")[2]}))
        at += len(raw)
    uri = f"{folder}/{uuid.uuid4().hex}.wacz"
    index = ("\n".join(sorted(lines)) + "\n").encode()
    write_shared(uri, package([(ARCHIVE, [raw for _, raw, _ in held]), (INDEX, [index])]))
    return uri, len(held), at


def write(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html); returns uri, n_records, n_bytes, a row a package.

    A null html is an empty payload, and equal payloads of any length count. Rows that repeat a
    group's smallest page_id are all responses; a null page_id comes after all others, and a group
    of nulls alone is all responses. A null or empty url is about:blank. An empty table writes none.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    groups = rows.groupBy(F.col("key").alias("group_key")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).filter("n > 1").drop("n")
    groups = staged(groups, "warc-groups")
    few = groups.count() <= BROADCAST_GROUPS
    out = rows.join(F.broadcast(groups) if few else groups, F.col("key") == F.col("group_key"), "left")
    out = out.select("page_id", "url", "html", "first_id", (F.col("group_key").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes, str]] = []
        size = 0
        done = []
        for b in chunks(batches, CHUNK_BYTES, "html"):
            for page, url, html, first, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "revisit")), strict=True):
                raw, digest = record(page, url, html.encode(), first, revisit, date)
                if held and size + len(raw) > PACKAGE_BYTES:
                    done.append(_package(folder, held, date))
                    held, size = [], 0
                held.append((_address(url), raw, digest))
                size += len(raw)
        if held:
            done.append(_package(folder, held, date))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["uri", "n_records", "n_bytes"])

    packages = staged(out.mapInArrow(run, "uri string, n_records long, n_bytes long"), "warc-packages")
    drop_staged(groups)
    return packages


def read(packages: DataFrame, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses, if asked) of every record.

    Records of a package are read by range, those side by side in one read. Length and digest of a
    response are of the bytes read, and its digest must be the stated one; those of a revisit are
    stated in its header. Of packages only uri is read; no package gives no rows.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(raw: bytes) -> tuple:
        r = parse(raw)
        kind, said = r.fields["warc-type"], r.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        page, refers = r.fields.get("page-id"), r.fields.get("refers-to-page")
        if kind == "revisit":
            n, digest = int(r.http["content-length"]), said
        else:
            n, digest = len(r.payload), sha1_32(r.payload)
            if said and said != digest:
                raise ValueError(f"the payload of page {page} has another digest")
        return (int(page) if page else None, r.fields.get("warc-target-uri"), n, digest, kind, int(refers) if refers else None, r.payload if kind != "revisit" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                with open_shared(uri, "rb") as f:
                    own = Package(f)
                    places = sorted((at, n) for _, at, n in own.records())
                    i = 0
                    while i < len(places):
                        j, first = i + 1, places[i][0]
                        while j < len(places) and places[j][0] == sum(places[j - 1]) and sum(places[j]) - first <= READ_BYTES:
                            j += 1
                        raw = own.range(first, sum(places[j - 1]) - first)
                        found = [row(raw[at - first : at - first + n]) for at, n in places[i:j]]
                        columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds + [pa.binary()] * payload)]
                        yield pa.RecordBatch.from_arrays(columns, names + ["payload"] * payload)
                        i = j

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return packages.select("uri").repartition(max(1, to_partitions(packages.sparkSession)), "uri").mapInArrow(run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_dir(spark, "warc"))).drop("url")


OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT html, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY html
), r AS (
  SELECT p.page_id, p.html, p.h, g.first_id, g.n > 1 AND p.page_id IS DISTINCT FROM g.first_id AS again FROM p JOIN g ON p.html = g.html
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
