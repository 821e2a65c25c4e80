"""Fill-in-middle: texts cut at token borders and put in another order, found through a sparse checkpoint index.

A token is a word with the white space before it, or the white space that ends a text. Counting
runs over the UTF-8 bytes STEP tokens at a time and notes the byte and code-point offset after each
run, so that an index has a row for every STEP tokens however long the text. A cut is found by
binary search of the checkpoints and a rescan of fewer than STEP tokens from there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_text

STEP = 256
SEED = 42
#: Of 100 documents, those that are cut, and of these those with the suffix first.
FIM_RATE = 50
SPM_RATE = 80
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK_BYTES = 4 << 20

_UNIT = rb"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
_RUN = re.compile(_UNIT + rb"{1,%d}+" % STEP)
_ONE = re.compile(_UNIT)
_REST = [re.compile(_UNIT + rb"{%d}+" % n) for n in range(STEP)]


def code_points(raw: bytes) -> int:
    return len(raw.decode())


class Index(NamedTuple):
    """Checkpoints of a text: after `units[i]` tokens it is at byte `at[i]` and code point `points[i]`; the last are its ends."""

    units: list[int]
    at: list[int]
    points: list[int]

    @property
    def n(self) -> int:
        return self.units[-1]


def index(text: bytes) -> Index:
    """The checkpoint index of a text; an empty one has no token."""
    out, at = Index([0], [0], [0]), 0
    size = len(text)
    while at < size:
        end = _RUN.match(text, at).end()
        # a run that stops before the end of the text is a full one; only the last is counted
        n = STEP if end < size else sum(1 for _ in _ONE.finditer(text, at))
        out.units.append(out.units[-1] + n)
        out.points.append(out.points[-1] + code_points(text[at:end]))
        out.at.append(end)
        at = end
    return out


def locate(text: bytes, marks: Index, unit: int) -> tuple[int, int]:
    """The byte and code-point offset after `unit` tokens: the checkpoint before it and a rescan."""
    i = bisect_right(marks.units, unit) - 1
    at, points, more = marks.at[i], marks.points[i], unit - marks.units[i]
    if not more:
        return at, points
    end = _REST[more].match(text, at).end()
    return end, points + code_points(text[at:end])


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transform(doc_id: int | None, text: bytes, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> Cut:
    """A text in its form, all choices drawn from the hash of seed and doc_id (null: no digits)."""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in range(0, 32, 8))
    marks = index(text)
    n = marks.n
    if not text or h3 % 100 >= fim_rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return Cut(n, "plain", None, None, text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_points), (b, b_points) = locate(text, marks, first), locate(text, marks, second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < spm_rate
    output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return Cut(n, "spm" if spm else "psm", a_points, b_points - a_points, output)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output and its form: parts hold no mark, so the first of each mark parts them."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"no output of the form {form}")
    one, found, rest = output[len(first) :].partition(second)
    two, also, middle = rest.partition(MIDDLE)
    if not (found and also):
        raise ValueError(f"no output of the form {form}")
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def transformed(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (string) of every row.

    A null text is an empty one, which stays plain, as do texts that hold a mark; rows that repeat
    a doc_id are drawn alike; a null doc_id is drawn from the seed alone; an empty table gives no
    rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK_BYTES):
            cuts = [transform(i, t.encode(), seed, fim_rate, spm_rate) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(cuts), pa.array([c.output.decode() for c in cuts], pa.string())], [*NAMES, "output"])

    return id_text(docs).mapInArrow(run, SCHEMA + ", output string")


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _columns(cuts: list[Cut]) -> list[pa.Array]:
    return [pa.array([c[i] for c in cuts], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; rows as in `transformed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, CHUNK_BYTES):
            cuts, made, back = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                c = transform(i, t.encode())
                made.append(hashlib.sha256(c.output).hexdigest())
                back.append(hashlib.sha256(restore(c.output, c.form)).hexdigest())
                cuts.append(c._replace(output=b""))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(cuts), pa.array(made, pa.string()), pa.array(back, pa.string())], [*NAMES, "output_sha256", "restored_sha256"])

    return id_text(docs).mapInArrow(run, SCHEMA + ", output_sha256 string, restored_sha256 string")


def op12(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, n, form, t, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
