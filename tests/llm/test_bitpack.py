import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ranklake.llm import bitpack
from ranklake.llm.common import new_dir


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 15, 16, 17, 24, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_round_trip(bits, n):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, n, np.uint64).astype("<u4")
    data = bitpack.pack(ids, bits)
    assert len(data) == -(-n * bits // 8)
    assert (bitpack.unpack(data, bits, n) == ids).all()


@pytest.mark.parametrize("bits", [15, 16])
def test_random_access(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(bitpack, "BLOCK", 64)
    r = np.random.default_rng(0)
    docs = [r.integers(0, 1 << bits, n).astype("<u4") for n in (0, 5, 63, 64, 65, 5000, 1)]
    uri = f"file://{tmp_path}/a/x.bin"
    w = bitpack.Writer(uri, bits)
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    own, every = bitpack.Reader(uri), np.concatenate(docs)
    assert own.docs.tolist() == list(range(7)) and own.n == len(every)
    for _ in range(100):
        a = int(r.integers(0, len(every)))
        n = int(r.integers(0, len(every) - a + 1))
        assert (own.ids(a, n) == every[a : a + n]).all()


PLAIN = Tokenizer.from_file(bitpack.default_path())
PIECES = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "a", "B,", " ", "\n", "é.", "x's", "\u0308", "1", "<|endoftext|>,"]


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60) | st.text("aB xé\n'1Σ̈<|endoftext|>", max_size=120) | st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_words_give_the_ids_of_the_text(text):
    own = bitpack.encoder(bitpack.default_path()).encode([text])[0]
    assert np.frombuffer(own, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_found_as_the_library_does():
    own = bitpack.encoder(bitpack.default_path())
    for text in ("<|endoftext|>", "a <|startoftext|> b", "A<|endoftext|>B, c", "<|ENDOFTEXT|> x,"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(["<|endoftext|>"])[0], "<u4").tolist() == [49407]


def test_rows(spark, make):
    rows = [(5, "The cat's  hat\n", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "x y", "en", "b"), (5, "The cat's  hat\n", "en", "a"), (4, "word " * 30000, "en", "a"), (6, "Say <|endoftext|> or <|ENDOFTEXT|>.", "en", "a")]
    got = bitpack.read(bitpack.write(make(rows), new_dir(spark, "test-ids")), ids=True).orderBy("start").collect()
    start = 0
    for r, (i, text, _, _) in zip(got, sorted(rows, key=lambda x: -1 if x[0] is None else x[0]), strict=True):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    assert bitpack.read(bitpack.write(make([]), new_dir(spark, "test-ids"))).collect() == []
