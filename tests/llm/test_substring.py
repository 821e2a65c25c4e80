import hashlib
import random

import numpy as np
import pytest

from ranklake.llm import substring


def brute(rows, span=20, tie=lambda text: 0):
    """Windows by their words; the earliest (doc_id, tie, start) of each stays. tie orders texts of one doc_id."""
    low = -(2**63)
    first, split = {}, []
    for i, text in rows:
        words = (text or "").encode().split()
        split.append(((low if i is None else i, tie(text or "")), words))
    for i, words in split:
        for s in range(len(words) - span + 1):
            w = tuple(words[s : s + span])
            first[w] = min(first.get(w, (i, s)), (i, s))
    marked = {}
    for i, words in split:
        for s in range(len(words) - span + 1):
            if first[tuple(words[s : s + span])] != (i, s):
                marked.setdefault(i, set()).update(range(s, s + span))
    out = []
    for (i, _), (k, words) in zip(rows, split, strict=True):
        kept = [w for j, w in enumerate(words) if j not in marked.get(k, ())]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    passage = [r.choice(vocabulary) for _ in range(55)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 5, 19, 20, 21, 80, 300]))]
        if r.random() < 0.4:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[r.randrange(10) : 55 - r.randrange(10)]
        gap = r.choice([" ", "\n", "  \t"])
        rows.append((i * 7 % 60, gap.join(words)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, "a " * 400), (73, None), (74, ""), (75, "a b " * 200), (76, "\x00 " * 50)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make, seed):
    rows = corpus(seed)
    got = substring.deduplicated(make([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_null_and_repeated_rows(make):
    base = " ".join(f"x{i}" for i in range(40))
    rows = [(None, base), (1, base), (1, base), (2, base + " more"), (None, base)]
    got = substring.deduplicated(make([(i, t, "en", "s") for i, t in rows]), texts=True).collect()
    assert sorted(map(tuple, (r[:4] for r in got)), key=repr) == brute(rows)
    assert {r.doc_id: r.text for r in got} == {None: base, 1: "", 2: "more"}
    assert substring.deduplicated(make([])).collect() == []


@pytest.mark.parametrize("few", [0, 100])
def test_rows_that_share_an_id_lose_no_word_of_their_own(spark, make, monkeypatch, few):
    monkeypatch.setattr(substring, "BROADCAST_IDS", few)
    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    rows = [(1, one), (7, one), (7, two), (7, two), (None, three), (None, three + " " + two), (None, one), (9, three)]
    ties = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    got = substring.deduplicated(make([(i, t, "en", "s") for i, t in rows]), texts=True).collect()
    assert sorted(map(tuple, (r[:4] for r in got)), key=repr) == brute(rows, tie=ties.__getitem__)
    assert {w for r in got for w in r.text.split()} == set(f"{one} {two} {three}".split())


def test_no_more_are_split_than_the_bound(make, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 1)
    monkeypatch.setattr(substring, "MOST_HOT", 3)
    rows = corpus(4)
    docs = make([(i, t, "en", "s") for i, t in rows])
    assert len(substring.hot_minimisers(substring.id_text(docs), 20, 4)) == 3
    assert sorted(map(tuple, substring.deduplicated(docs).collect()), key=repr) == brute(rows)


def test_split_minimisers(make, monkeypatch):
    rows = corpus(3)
    docs = make([(i, t, "en", "s") for i, t in rows])
    plain = sorted(map(tuple, substring.repeated(substring.named(docs)).collect()))
    monkeypatch.setattr(substring, "HOT", 1)
    texts = substring.id_text(docs)
    assert len(substring.hot_minimisers(texts, 20, 4)) > 5
    got = substring.deduplicated(docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert plain


def test_thinly_spread_phrase_is_hot(make, monkeypatch):
    """One phrase in many chunks, a few times in each, with other neighbours every time."""
    phrase = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(25)), phrase, *(f"b{i}x{j}" for j in range(25))]), "en", "s") for i in range(300)]
    monkeypatch.setattr(substring, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(substring, "HOT", 200)
    docs = make(rows)
    hot = substring.hot_minimisers(substring.id_text(docs), 20, 4)
    assert len(hot) >= 1
    assert sorted(map(tuple, substring.deduplicated(docs).collect()), key=repr) == brute([r[:2] for r in rows])
    # what a task hands on early is summed too
    monkeypatch.setattr(substring, "HOLD_BYTES", 5_000)
    monkeypatch.setattr(substring, "COUNTED", 100)
    assert set(hot) <= set(substring.hot_minimisers(substring.id_text(docs), 20, 4))


def test_counts_pack():
    r = np.random.default_rng(5)
    m = np.unique(r.integers(0, 2**63, 1000, np.uint64))
    m[-1], n = np.uint64(2**64 - 1), r.integers(1, 10**12, len(m))
    got = substring.unpack_counts(substring.pack_counts(m, n))
    assert (got[0] == m).all() and (got[1] == n).all()
    assert [x.tolist() for x in substring.summed([(m, n), (m[:3], n[:3])])][1][:4] == [*(2 * n[:3]).tolist(), int(n[3])]


def test_hash_collisions_are_resolved(monkeypatch):
    monkeypatch.setattr(substring, "word_hashes", lambda data, start, end, total=None: np.zeros(len(start), np.uint64))
    a, b = b" ".join(b"a%d" % i for i in range(20)), b"\n".join(b"b%d" % i for i in range(20))
    doc, _, start = substring.later_windows(np.array([1, 2, 3, 4]), np.zeros(4, int), np.array([0, 5, 9, 2]), [a, b, a.replace(b" ", b"\t"), b], 20)
    assert sorted(zip(doc.tolist(), start.tolist(), strict=True)) == [(3, 9), (4, 2)]
