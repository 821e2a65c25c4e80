import hashlib
import random
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from ranklake.llm import byte_bpe, pii, simhash

EN = "the people of this town have seen the river and they will go there with us when it is time for that".split()
DE = "die leute dieser stadt haben den fluss gesehen und sie werden mit uns dorthin gehen wenn es zeit dafür ist".split()


def corpus():
    r = random.Random(9)
    rows = []
    for i in range(90):
        base, lang = ((EN, "en"), (DE, "de"))[i % 3 == 0]
        words = [r.choice(base) for _ in range(r.choice([30, 80, 200]))]
        if i % 5 == 0:
            words[7:7] = ["write", "to", f"someone{i}@mail.example.com", "or", f"10.1.2.{i}"]
        rows.append((i, " ".join(words), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(10)]  # exact copies
    long = [f"{r.choice(EN)}{j}" if j % 2 else r.choice(EN) for j in range(300)]
    for i in range(12):  # near copies, of a similarity of about 0.9
        copy = list(long)
        for _ in range(i and 3):
            copy[r.randrange(300)] = r.choice(DE)
        rows.append((220 + i, " ".join(copy), "en", f"s{i % 4}"))
    rows += [(300, "12 34 !! 56", "en", "s1"), (301, None, "en", "s0"), (302, "", None, None)]
    return rows


def near(a, b):
    """Whether two texts are linked: all pairs, by the fingerprint that the stage takes."""
    x, y = (np.frombuffer(simhash.wide_fingerprint(t.encode().lower().split(), 5), "<u8") for t in (a, b))
    return np.bitwise_count(x ^ y).sum() <= simhash.similar_limit(0.8, simhash.WIDE)


def test_stages_equal_brute_force(spark, make, tmp_path):
    make(corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    rows = {i: (t, s) for i, t, _, s in corpus()}

    docs = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {i for i in rows if i < 300}

    docs = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert docs.columns == columns
    own = {i: i for i in rows if i < 300}
    for a in own:
        for b in own:
            if own[a] != own[b] and near(rows[a][0], rows[b][0]):
                low, high = sorted((own[a], own[b]))
                own = {k: low if v == high else v for k, v in own.items()}
    stays = set(own.values())
    assert not stays & set(range(200, 210)) and {i for i in stays if 220 <= i < 232} == {220}
    assert sorted(r.doc_id for r in docs.collect()) == sorted(stays)

    docs = corpus_pipeline.personal_data(spark, docs, str(tmp_path))
    assert docs.columns == columns
    text = {}
    for r in docs.collect():
        want, last = "", 0
        for k, a, b in sorted(pii.base_spans(rows[r.doc_id][0]), key=lambda s: s[1]):
            want += rows[r.doc_id][0][last:a] + f"<{pii.KINDS[k].upper()}>"
            last = b
        want += rows[r.doc_id][0][last:]
        assert r.text == want and r.n_chars == len(want)
        text[r.doc_id] = want

    mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert mixed.columns == columns
    copies = Counter(r.doc_id for r in mixed.collect())
    size = {i: len(t.split()) for i, t in text.items()}
    total = sum(size.values())
    weight = {f"s{i}": w for i, w in enumerate((1, 2, 3, 1))}
    for s in weight:
        own_size = sum(n for i, n in size.items() if rows[i][1] == s)
        taken = sum(size[i] * copies[i] for i in size if rows[i][1] == s)
        assert 2 * own_size > total * weight[s] / 7 or own_size * 3 >= taken
        if 3 * own_size >= total * weight[s] / 7:
            assert abs(taken - total * weight[s] / 7) <= 200
    assert set(copies.values()) <= {1, 2, 3}

    plain = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_path()), special_tokens={})
    got = corpus_pipeline.encoded(spark, mixed, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == copies
    for r in got:
        ids = plain.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, got))


def test_empty(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_names_pass_through(spark, make, tmp_path):
    """Columns named as the stages name theirs stay as they are, up to the last stage."""
    names = ("_stays", "_lang_pred", "_lang_score", "_mix_size", "mix_copies", "text_hash", "least_id", "_pii_uid", "_pii_more", "pii_uid", "pii_more", "hit", "score", "fp")
    docs = make(corpus()).selectExpr("*", *[f"'kept' AS {c}" for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r[c] == "kept" for r in rows for c in names)
    assert len(corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()) == len(rows)
