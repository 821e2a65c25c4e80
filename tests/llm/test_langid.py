import itertools
import zlib

import numpy as np

from ranklake.llm import langid


def test_forward_sums_every_segmentation():
    own = langid.vocabulary(langid.default_path())
    r = np.random.default_rng(1)
    table = r.random((own.size + 1, 2)) / 50
    words = ["the", "hello", "naïve", "x", "日本", "ab" * 12]
    edges = own.edges(words)
    got = langid.forward(edges, langid.padded(table))
    for i, w in enumerate(words[:5]):
        marked = "▁" + w
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            bounds = [0, *[j + 1 for j, c in enumerate(cuts) if c], len(marked)]
            p = np.ones(2)
            for a, b in itertools.pairwise(bounds):
                e = edges[i, b - 1, b - a - 1] if b - a <= langid.SPAN else -1
                p = p * (table[e] if e >= 0 else 0)
            total += p
        assert np.allclose(got[i], np.log(total))
    assert np.isfinite(got).all()


def test_expected_counts_add_up():
    own = langid.vocabulary(langid.default_path())
    table = np.full(own.size + 1, 1 / own.size)
    edges = own.edges(["reading"])
    total = langid.expected(edges, table, np.array([3.0]))
    # every segmentation covers the 8 characters once
    spans = np.zeros(own.size + 1)
    for j in range(edges.shape[1]):
        for s in range(langid.SPAN):
            if edges[0, j, s] >= 0:
                spans[edges[0, j, s]] = s + 1
    assert np.isclose((total * spans).sum(), 24)


def test_expected_counts_of_long_words():
    """Scaled passes: every character of a word of 700 is covered once, and short words are as before."""
    own = langid.vocabulary(langid.default_path())
    table = np.full(own.size + 1, 1 / own.size)
    word = "reading日本語" * 70
    edges = own.edges([word, "reading"])
    spans = np.zeros(own.size + 1)
    for j, s in zip(*np.nonzero(edges[0] >= 0), strict=True):
        spans[edges[0, j, s]] = s + 1
    total = langid.expected(edges, table, np.array([2.0, 3.0]))
    assert np.isclose((total * spans).sum(), 2 * (len(word) + 1) + 3 * 8)
    short = langid.expected(own.edges(["reading"]), table, np.array([3.0]))
    assert np.allclose(langid.expected(edges, table, np.array([0.0, 3.0])), short)


def test_expected_counts_over_stretches(monkeypatch):
    """The passes that go from stretch to stretch count as those over the whole word, wherever stretches end."""
    own = langid.vocabulary(langid.default_path())
    r = np.random.default_rng(7)
    table = r.random(own.size + 1) ** 3
    table /= table.sum()
    for word in ("reading日本語" * 31, "x" * 200, "the quick".replace(" ", "") * 40, "日" * 65):
        marked = "▁" + word
        want = langid.expected(own.edges([word]), table, np.array([2.5]))
        for stretch in (16, 17, 50, 64, len(marked) - 1, len(marked), 10_000):
            monkeypatch.setattr(langid, "LONG", stretch)
            got = langid.expected_long(own, marked, table, 2.5)
            assert np.allclose(got, want, rtol=1e-9, atol=1e-12), (word[:8], stretch)


def test_long_words_are_not_cut(monkeypatch):
    own = langid.vocabulary(langid.default_path())
    r = np.random.default_rng(2)
    table = langid.padded(r.random((own.size + 1, 3)) / 50)
    word = "".join(r.choice(list("etaoin shrdlu".replace(" ", "")), 1000))
    whole = langid.forward(own.edges([word]), table)[0]
    monkeypatch.setattr(langid, "LONG", 37)
    assert np.allclose(langid.forward_long(own, word, table), whole)
    scorer = langid.Scorer(langid.default_path(), [table[:, :2], table[:, 2:]])
    assert np.allclose(scorer.score([f"{word} a {word}"])[0], 2 * whole + scorer.score(["a"])[0])


def test_languages_without_spaces(make):
    """Words are whole sentences; every one of them teaches."""
    zh, ja = list("的一是不了人我在有他这为之大来以个中上们"), list("のにはをたがでてとしれさあるいうかもなら")
    say = lambda letters, i: "".join(np.random.default_rng(i).choice(letters, 60 + i % 300))
    docs = make([(i, say(zh if i % 2 else ja, i), "zh" if i % 2 else "ja", "s") for i in range(80)])
    langs, uris = langid.fit(langid.training(docs))
    for row in langid.predict(docs, langs, uris).collect():
        assert row.lang_pred == ("zh" if row.doc_id % 2 else "ja") and row.score > 0.9


def test_more_languages_than_a_block(make, monkeypatch):
    monkeypatch.setattr(langid, "LANG_BLOCK", 3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    say = lambda k, i: " ".join("".join(np.random.default_rng((k, i, j)).choice(list(letters[2 * k : 2 * k + 3]), 5)) for j in range(30))
    docs = make([(k * 100 + i, say(k, i), f"l{k:02d}", "s") for k in range(11) for i in range(9 if k else 30)])
    langs, uris = langid.fit(langid.training(docs))
    assert langs == [f"l{k:02d}" for k in range(11)] and len(uris) == 4
    assert all(r.lang_pred == f"l{r.doc_id // 100:02d}" for r in langid.predict(docs, langs, uris).collect())


def test_fit_equals_brute_force(make):
    """One round of expectation maximisation by enumerating segmentations, then prediction and share."""
    own = langid.vocabulary(langid.default_path())
    docs = [("the cat", "en"), ("der hut", "de"), ("a hat", "en")]

    def cuts(word, table):
        marked = "▁" + word
        edges = own.edges([word])[0]
        for inner in itertools.product([0, 1], repeat=len(marked) - 1):
            bounds = [0, *[j + 1 for j, c in enumerate(inner) if c], len(marked)]
            ids = [edges[b - 1, b - a - 1] for a, b in itertools.pairwise(bounds)]
            if min(ids) >= 0:
                yield ids, float(np.prod([table[e] for e in ids]))

    tables = {}
    for lang in ("de", "en"):
        table = np.full(own.size + 1, 1 / (own.size + 1))
        for _ in range(langid.ROUNDS):
            count = np.full(own.size + 1, 1e-2)
            for text, la in docs:
                for word in text.split() if la == lang else ():
                    every = list(cuts(word, table))
                    for ids, p in every:
                        for e in ids:
                            count[e] += p / sum(x for _, x in every)
            table = count / count.sum()
        tables[lang] = table
    frame = make([(i, t, la, "s") for i, (t, la) in enumerate(docs)])
    langs, uris = langid.fit(frame)
    got = langid.mapped(uris[0], "<f8").reshape(own.size + 2, -1)
    assert np.allclose(got[:-1, 0], tables["de"]) and np.allclose(got[:-1, 1], tables["en"])
    said = langid.predict(make([(1, "the hut", None, None)]), langs, uris).collect()[0]
    p = {la: np.prod([sum(x for _, x in cuts(w, t)) for w in ("the", "hut")]) for la, t in tables.items()}
    best = max(p, key=p.get)
    assert said.lang_pred == best and np.isclose(said.score, p[best] / sum(p.values()))


def rows():
    en = "the people of the town have seen the river and they will go there with us"
    de = "die leute der stadt haben den fluss gesehen und sie werden mit uns dorthin gehen"
    out = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else de).split())), "en" if i % 2 else "de", "s") for i in range(60)]
    return [*out, (1000, None, "en", "s"), (1001, "12 34 !!", "en", "s"), (1002, "", None, None), (None, "the river and the town", None, "s"), (1003, "x" * 9000, None, "s"), (1004, "½ ①② Ⅷ 3", "en", "s")]


def test_rows(make):
    docs = make(rows())
    langs, table = langid.fit(langid.training(docs))
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(docs, langs, table).collect()}
    for i in range(60):
        if zlib.crc32(str(i).encode()) % 3 == 1:
            assert got[i].lang_pred == ("en" if i % 2 else "de")
    assert got[None].lang_pred == "en" and 0 <= got[None].score <= 1
    assert {got[i].lang_pred for i in (1000, 1001, 1002, 1004)} == {"und"}
    assert got[1003].lang_pred in langs
    clash = docs.selectExpr("*", "'x' as _lang_pred", "0 as _lang_score", "1 as score")
    kept = langid.accepted(clash, langs, table, 0.5)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.lang_pred != "und" and r.score >= 0.5}


def test_nothing_to_learn_from(make):
    langs, table = langid.fit(langid.training(make([])))
    assert langs == []
    assert langid.predict(make([(1, "the town", None, None)]), langs, table).collect()[0].lang_pred == "und"
