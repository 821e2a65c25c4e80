import hashlib

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ranklake.llm import byte_bpe as bpe


def plain():
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})


REFERENCE = plain()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("aeth xö.\n'1", max_size=200))
def test_ids_equal_the_public_library(text):
    own = bpe.encoder(bpe.default_path(), bpe.default_pattern())
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_very_long_pre_tokens():
    ranks = bpe.load_ranks(bpe.default_path())
    for piece in ("a" * 5001, "ab" * 4000, "thequickbrown" * 900, "ö" * 3000):
        assert bpe.merge(piece.encode(), ranks) == REFERENCE.encode_ordinary(piece)


def test_rows(make):
    rows = [(1, "The cat's  hat\n", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "x", "en", "b"), (1, "The cat's  hat\n", "en", "a")]
    got = bpe.round_trip(make(rows)).collect()
    assert len(got) == 5
    for r in got:
        if r.doc_id == 1:
            ids = REFERENCE.encode_ordinary(rows[0][1])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
        if r.doc_id in (2, 3):
            assert r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest()
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(make(rows))).collect()}
    assert decoded[1] == rows[0][1].encode() and decoded[2] == b""
    assert bpe.round_trip(make([])).collect() == []
