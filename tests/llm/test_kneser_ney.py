import math
import random
from collections import Counter

import numpy as np
import pytest

from ranklake.llm import kneser_ney as kn


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), "end"]


class Brute:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            w = split(t)
            self.c.update(w)
            self.pairs.update(zip(["begin", *w[:-1]], w, strict=True))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.before = Counter(w for _, w in self.pairs)
        self.after = Counter()
        self.kinds = {}
        for (u, _), n in self.pairs.items():
            self.after[u] += n
            self.kinds.setdefault(u, Counter())[min(n, 3)] += 1
        of = lambda counts: kn.discounts([sum(x == k for x in counts.values()) for k in range(1, 5)])
        self.d2, self.d1 = of(self.pairs), of(self.before)

    def p(self, u, w):
        total = len(self.pairs)
        b = self.before[w]
        left = sum(self.d1[min(x, 3) - 1] for x in self.before.values()) / total
        alone = (b - (self.d1[min(b, 3) - 1] if b else 0)) / total + left / (self.v + 1)
        if u not in self.kinds:
            return alone
        c = self.pairs[u, w]
        rest = sum(self.d2[k - 1] * n for k, n in self.kinds[u].items()) / self.after[u]
        return (c - (self.d2[min(c, 3) - 1] if c else 0)) / self.after[u] + rest * alone


def corpus():
    r = random.Random(4)
    words = [f"W{i}" for i in range(60)] + ["ö", "日本"]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, weight, k=r.choice([0, 1, 5, 40, 200])))) for i in range(80)]
    return [*rows, (200, None), (201, ""), (202, "never seen words w1 w2"), (None, "w1 w2"), (3, rows[3][1])]


def test_scores_equal_brute_force(make):
    rows = corpus()
    model = kn.train(make([(i, t, "en", "s") for i, t in rows[:60]]))
    own = Brute([t for _, t in rows[:60]])
    assert (model["tokens"], model["types"], model["kinds"]) == (own.n, own.v, len(own.pairs))
    got = kn.score(make([(i, t, "en", "s") for i, t in rows]), model).collect()
    assert len(got) == len(rows)
    want = sorted((repr(i), t or "") for i, t in rows)
    for r, (i, text) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_tokens)), want, strict=True):
        w = split(text)
        assert repr(r.doc_id) == i and r.n_tokens == len(w) and r.n_known == sum(own.c[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((own.c[x] + 1) / (own.n + own.v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(own.p(u, x)) for u, x in zip(["begin", *w[:-1]], w, strict=True)), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    own = Brute([t for _, t in corpus()[:60]])
    for u in ("begin", b"w1", b"unseen"):
        assert math.isclose(sum(own.p(u, w) for w in [*own.c, "unknown"]), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(make):
    model = kn.train(make([]))
    got = kn.score(make([(1, "a b", None, None)]), model).collect()
    assert got[0].n_known == 0 and got[0].score == 0
    assert kn.score(make([]), model).collect() == []


def test_more_words_than_ids_are_refused(make, monkeypatch):
    monkeypatch.setattr(kn, "MOST_TYPES", 5)
    with pytest.raises(ValueError, match="distinct words"):
        kn.train(make([(1, "a b c d e", "en", "s")]))
    assert kn.train(make([(1, "a b c d", "en", "s")]))["types"] == 5


def test_counts_beyond_32_bits():
    counts = np.array([2**32 + 5, 1, 2**40])
    (_, keys, blob), = kn._dealt(np.arange(3).astype(np.uint64), counts, np.zeros(3, int))
    assert kn.unpacked_sorted(keys).tolist() == [0, 1, 2] and kn.unplaned(blob, "<u8").tolist() == counts.tolist()


def test_packing():
    for dtype in ("<u8", "<u4"):
        x = np.sort(np.random.default_rng(0).integers(0, 2**31, 1000)).astype(dtype)
        assert (kn.unplaned(kn.planes(x), dtype) == x).all()
    assert (kn.unpacked_sorted(kn.packed_sorted(x.astype("<u8"))) == x).all()
