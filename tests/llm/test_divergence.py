import math
import re
from collections import Counter

import duckdb
import pandas as pd

from ranklake.llm import divergence
from ranklake.llm.divergence import MAX_CHARS, MAX_COMMON, MIN_WORDS, SHARE

EN = "the man of the town and the river of that land is in the house and it was on a hill with the dog".split()


def corpus():
    rows = [(i, " ".join(EN[(i + j * 7) % len(EN)] + (f"x{j}" if j % 3 == 0 else "") for j in range(90 + i)) + ".\nEnd of it", "en", "s") for i in range(30)]
    rows += [
        (100, " | ".join(f"nav{j}" for j in range(80)), "en", "s"),
        (101, " ".join(f"{w}###" for w in EN * 4), "en", "s"),
        (102, "For " * 200, "en", "s"),
        (103, "one line\ntwo\none line\n\n  \none line", "en", "s"),
        (104, None, "en", "s"),
        (105, "", None, None),
        (106, " ".join(f"v{j} z{j}" for j in range(60)), None, "s"),
        (None, rows[0][1], "en", "s"),
        (0, rows[0][1], "en", "s"),
    ]
    return rows


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    total = 0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(total, 0))


def test_rows_equal_brute_force(make):
    rows = corpus()
    got = divergence.judged(make(rows), min_reference=50).collect()
    assert len(got) == len(rows)
    words = Counter(w for _, t, la, _ in rows if la == "en" and t for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words.values())
    q = {w: n / total for w, n in words.items() if n > 1 and n >= SHARE * total}
    classes = lambda t: [sum(c.islower() for c in t), sum(c.isupper() for c in t), sum(c.isdigit() for c in t), sum(c in " \t\n\x0b\x0c\r" for c in t)]
    for r in got:
        text = next(t for i, t, _, _ in rows if i == r.doc_id) or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed
        if r.lang == "en" and r.n_words:
            own = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
            p = [own[w] / r.n_words for w in q]
            assert math.isclose(r.common_distance, distance([*p, max(0, 1 - sum(p))], [*q.values(), max(0, 1 - sum(q.values()))]), rel_tol=1e-6, abs_tol=1e-6)
            assert [int(c) for c in r.chars[:4]] == classes(text)
            assert r.kept == (not failed and not (r.n_words >= MIN_WORDS and (r.char_distance > MAX_CHARS or r.common_distance > MAX_COMMON)))
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[100] and not kept[102] and kept[106] and kept[5]
    assert divergence.judged(make([])).collect() == []


def test_small_and_unspaced_languages(make):
    """A language has a reference from so many words on, whatever its share, and without common words one of its characters."""
    big = [(i, " ".join(EN[(i + j * 7) % len(EN)] + (f"x{j}" if j % 3 == 0 else "") for j in range(400)), "en", "s") for i in range(60)]
    zh = [(100 + i, " ".join(chr(0x4E00 + (i * 977 + j * 31) % 5000) * 8 for j in range(60)), "zh", "s") for i in range(20)]
    junk = (200, "123 456 " * 3 + " ".join(f"{i}90" for i in range(80)), "zh", "s")
    got = {r.doc_id: r for r in divergence.judged(make([*big, *zh, junk]), min_reference=500).collect()}
    assert got[0].common_distance is not None and got[0].kept
    assert all(got[100 + i].kept and got[100 + i].common_distance is None and got[100 + i].char_distance < MAX_CHARS for i in range(20))
    assert got[200].char_distance > MAX_CHARS and not got[200].kept
    few = {r.doc_id: r for r in divergence.judged(make([*big, *zh, junk]), min_reference=5_000).collect()}
    assert few[200].char_distance is None and few[200].kept


def test_many_languages_are_joined_by_a_shuffle(make, monkeypatch):
    rows = [(i, " ".join(f"{EN[(i + j * 7) % len(EN)]}{i % 7}" for j in range(120)), f"l{i % 7}", "s") for i in range(42)]
    run = lambda: sorted((r.doc_id, r.kept, round(r.common_distance, 9)) for r in divergence.judged(make(rows), min_reference=50).collect())
    plain = run()
    monkeypatch.setattr(divergence, "BROADCAST_LANGS", 3)
    assert run() == plain


def test_sql(make):
    rows = corpus()
    documents = pd.DataFrame([(i, t, la) for i, t, la, _ in rows], columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    want = con.execute(f"SELECT {columns} FROM ({divergence.op4_sql(50)})").fetchall()
    got = divergence.judged(make(rows), min_reference=50).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
