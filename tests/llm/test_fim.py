import hashlib
import random
import re

import duckdb
import pytest

from ranklake.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_text(r, n):
    return "".join(r.choice(["a", "é", "日", "\U0001f600", " ", " ", "\n", "\t", "\x1c", "\x85", " ", "<", "P", ">", "S", "M"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_walk(seed):
    r = random.Random(seed)
    for i in range(1500):
        t = some_text(r, r.choice([0, 1, 2, 7, 40, 3000 if i % 40 == 0 else 11]))
        c = fim.transform(i, t.encode())
        assert (c.n, c.form, c.prefix_chars, c.middle_chars, c.output.decode()) == brute(i, t)
        assert fim.restore(c.output, c.form).decode() == t


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 511, 512, 513, 5000])
@pytest.mark.parametrize("tail", ["", " \n"])
def test_index_around_its_step(n, tail):
    text = "".join(f" wö{i}" for i in range(n)) + tail
    units, marks = UNITS.findall(text), fim.index(text.encode())
    assert marks.n == len(units) and len(marks.units) <= len(units) / fim.STEP + 2
    for u in {0, 1, 254, 255, 256, 257, 300, 511, 512, 513, len(units) - 1, len(units)}:
        if 0 <= u <= len(units):
            head = "".join(units[:u])
            assert fim.locate(text.encode(), marks, u) == (len(head.encode()), len(head))


def test_restore_refuses_other_outputs():
    for output, form in ((b"<P>a<S>b", "psm"), (b"a", "spm"), (b"<S>a<M>b", "spm")):
        with pytest.raises(ValueError):
            fim.restore(output, form)


def test_rows(spark, make):
    r = random.Random(9)
    texts = [some_text(r, 60) for _ in range(120)] + ["", None, "word " * 100_000, "x" * 200_000, "a <M> b", "nul\x00 in it"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, "no id at all", None, None), (3, texts[3], "en", "a")]
    df = make(rows)
    got = fim.transformed(df).collect()
    assert sorted(map(str, ((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got))) == sorted(str((i, *brute(i, t or ""))) for i, t, _, _ in rows)
    digest = fim.digest(df.withColumn("n", df.n_chars).withColumn("form", df.lang)).collect()
    assert len(digest) == len(rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(fim.OP12_SQL).fetchall()
    key = lambda x: str(tuple(x))
    assert sorted(map(key, digest)) == sorted(map(key, want))
    assert fim.digest(df.limit(0)).collect() == []
