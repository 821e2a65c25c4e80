import random

import numpy as np
import pytest
import xxhash

from ranklake.llm import graph, simhash


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [(i, brute_fp(t or "")) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = {}
    for x, (i, _) in enumerate(fps):
        groups.setdefault(find(x), []).append(i)
    return [(i, f"{fp:016x}", min((y for y in groups[find(x)] if y is not None), default=None)) for x, (i, fp) in enumerate(fps)]


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 30, 200, 400]))]
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words).upper()
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    return [*rows, (9000, None), (9001, ""), (None, rows[0][1]), (None, "of its own kind entirely here"), (1, rows[0][1])]


def test_components_equal_brute_force(make):
    rows = corpus()
    got = simhash.near_duplicates(make([(i, t, "en", "s") for i, t in rows])).collect()
    want = brute_components(rows)
    assert sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def test_one_row_of_each_group_stays(make):
    rows = corpus()
    got = [r.doc_id for r in simhash.deduplicated(make([(i, t, "en", "s") for i, t in rows])).collect()]
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_large_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 16)
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = r.choice(sorted(fps)) if r.random() < 0.5 else base
        for _ in range(r.randrange(1, 4)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    roots = {r.node: r.root for r in graph.components(simhash.links(nodes)).collect()}
    own = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and own[a] != own[b]:
                own = [min(own[a], own[b]) if o in (own[a], own[b]) else o for o in own]
    assert [roots.get(i, i) for i in range(len(fps))] == own


@pytest.mark.parametrize("n", [2, 10_000, 10**8, 10**10])
def test_thresholds_cover_the_limit(n):
    r = np.random.default_rng(0)
    both = (lambda b: b.T @ b)((r.random((2000, 64)) < 0.5).astype(float)) * n / 2000
    scheme = simhash.plan(n, both)
    assert sum(t + 1 for _, t in scheme) == simhash.LIMIT + 1
    bits = [b for g, _ in scheme for b in g]
    assert len(bits) == len(set(bits))
    mask = simhash.masks(scheme)
    for _ in range(300):  # any 4 flips leave some probe's bits alone
        flip = np.uint64(sum(1 << int(b) for b in r.choice(64, 4, replace=False)))
        assert ((mask & flip) == 0).any()


@pytest.mark.parametrize("limit", [0, 1, 9, 31])
def test_any_limit_is_covered_or_refused(limit):
    r = np.random.default_rng(0)
    both = (lambda b: b.T @ b)((r.random((2000, 64)) < 0.5).astype(float))
    scheme = simhash.plan(2000, both, limit)
    assert sum(t + 1 for _, t in scheme) == limit + 1
    for wrong in (-1, 32, 64):
        with pytest.raises(ValueError, match="limit"):
            simhash.plan(2000, both, wrong)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_corpus(groups=30):
    """Groups of a text and edited copies of it, of a similarity from 0.5 to 1; one group is large."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([90, 200, 500]))]
        for k in range(70 if g == 0 else 4):
            copy = list(base)
            for _ in range(0 if k == 0 else round(len(base) * r.choice([0.005, 0.01, 0.02, 0.05]))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) + 1, " ".join(copy)))
    return rows


def test_similar_texts_are_found(make, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 32)
    rows = similar_corpus()
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(make([(i, t, "en", "s") for i, t in rows]), 5, similarity=0.8).collect()}
    own = {i: shingles(t) for i, t in rows}
    near = wrong = hit = 0
    for a in own:
        for b in own:
            if a < b and own[a] & own[b]:
                j = len(own[a] & own[b]) / len(own[a] | own[b])
                near += j >= 0.8
                hit += j >= 0.8 and found[a] == found[b]
    assert near > 50 and hit >= 0.9 * near
    # links go by fingerprints: what shares a component hangs together by pairs of a similarity that isn't far below
    close = {a: {b for b in own if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.65} for a in own}
    for a in own:
        seen, todo = {a}, [a]
        while todo:
            todo += [y for y in close[todo.pop()] if y not in seen and not seen.add(y)]
        wrong += sum(found[b] == found[a] and b not in seen for b in own)
    assert wrong == 0


def test_similar_texts_any_rows(make):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "two one"), (None, long), (7, long + " end"), (None, "alone of them"), (None, "alone of them"), (7, long + " end")]
    docs = make([(i, t, "en", "s") for i, t in rows]).selectExpr("*", "1 AS text_hash", "2 AS least_id", "3 AS least_hash", "4 AS component", "5 AS fp", "6 AS _stays")
    got = simhash.near_duplicates(docs, 5, similarity=0.8).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 7), (7, 7), (None, None), (None, None), (7, 7)], key=repr)
    kept = simhash.deduplicated(docs, 5, similarity=0.8)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 4, 6, 7, None]
    assert simhash.deduplicated(docs.limit(0), 5, similarity=0.8).collect() == []


def test_rows_of_one_id_leave_the_least_hash(spark, make):
    texts = [" ".join(f"{k}{i}" for i in range(50)) for k in "abc"]
    rows = [(3, texts[0], "en", "s"), (3, texts[1], "en", "s"), (3, texts[1], "en", "s"), (4, texts[2], "en", "s")]
    least = min(texts[:2], key=lambda t: spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t) AS h").first().h)
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicated(make(rows)).collect()) == [(3, least), (4, texts[2])]


def test_plan_reaches_its_recall():
    r = np.random.default_rng(0)
    bits = (r.random((2000, 16, 64)) < 0.5).astype(float)
    both = np.einsum("nwi,nwj->wij", bits, bits)
    for n in (100, 10**6, 10**9):
        scheme = simhash.plan_similar(n, both * n / 2000, 0.8)
        q = simhash.differing(0.8)
        miss = 1.0
        for _, own, t in scheme:
            p = (1 - q) ** len(own) * (1 + (len(own) * q / (1 - q) if t else 0))
            miss *= 1 - p
        assert miss <= 1 - simhash.RECALL + 1e-9
        assert len({(w, b) for w, own, _ in scheme for b in own}) == sum(len(own) for _, own, _ in scheme)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert graph.components(edges.limit(0)).collect() == []


def test_empty(make):
    assert simhash.near_duplicates(make([])).collect() == []
