import hashlib
import random
import zlib

import numpy as np
import pytest

from ranklake.llm import flac


def samples():
    r = np.random.default_rng(0)
    rows = [
        np.full(192 * 3, 65),
        r.integers(0, 256, 192 * 7),
        np.cumsum(r.integers(-2, 3, 192 * 5)) % 256,
        np.where(r.random(192 * 4) < 0.02, 255, 128),
        np.array([0, 255] * 96),
        (128 + 100 * np.sin(np.arange(192 * 20) / 9)).astype(int),
    ]
    return [x.astype(np.uint8) for x in rows]


def test_frames_decoded_together_equal_the_bit_reader():
    own = samples()
    media = flac.encode_payloads(np.concatenate(own), np.array([len(x) // 192 for x in own]))
    assert flac.decode_media(media) == [x.tobytes() for x in own]
    for m, x in zip(media, own, strict=True):
        info, channels = flac.decode_stream(m)
        assert info == {"rate": 8000, "channels": 1, "depth": 8, "samples": len(x)}
        assert (channels[0] + 128 == x).all()
        at = random.Random(1).randrange(len(x))
        assert flac.seek(m, at, 333) == x.tobytes()[at : at + 333]
    assert len(media[5]) < len(own[5])


def test_damage_is_found():
    own = samples()[1]
    media = bytearray(flac.encode_payloads(own, np.array([len(own) // 192]))[0])
    media[-50] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        flac.decode_media([bytes(media)])


def stereo(mid, side, md5=None):
    """A hand-made stream: one frame of 16-bit samples, mid and side, verbatim."""
    n = len(mid)
    bits = "".join(f"{v & ((1 << w) - 1):0{w}b}" for v, w in [(0b00000010, 8), *[(m, 16) for m in mid], (0b00000010, 8), *[(s, 17) for s in side]])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0xA8, 0x00, n - 1])
    head += bytes([int(flac.crc8(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]))[0])])
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    info = bytes([0, n, 0, n]) + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | n).to_bytes(8, "big") + (md5 or bytes(16))
    return b"fLaC\x80\x00\x00\x22" + info + frame + crc.to_bytes(2, "big")


LEFT, RIGHT = [1001, -299, -2, 7], [1000, -301, 3, 7]
MID, SIDE = [(a + b) >> 1 for a, b in zip(LEFT, RIGHT, strict=True)], [a - b for a, b in zip(LEFT, RIGHT, strict=True)]
PCM = np.array([LEFT, RIGHT], "<i2").T.tobytes()


def test_stereo_of_16_bits():
    _, (left, right) = flac.decode_stream(stereo(MID, SIDE))
    assert left.tolist() == LEFT and right.tolist() == RIGHT


def test_streams_of_any_origin_among_own_ones():
    own = samples()
    media = flac.encode_payloads(np.concatenate(own), np.array([len(x) // 192 for x in own]))
    mixed = [*media[:2], stereo(MID, SIDE, hashlib.md5(PCM).digest()), *media[2:]]
    want = [(x.tobytes(), 1, 1) for x in own]
    assert flac.decoded(mixed) == [*want[:2], (PCM, 2, 2), *want[2:]]
    with pytest.raises(ValueError, match="MD5"):
        flac.decoded([media[0], stereo(MID, SIDE, b"x" * 16)])
    assert flac.decoded([]) == []


def test_rows(make):
    text = "Grüße, " * 900
    rows = [(1, text, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "x" * 192, "en", "b"), (1, text, "en", "a")]
    media = flac.encode(make(rows))
    got = flac.features(media).collect()
    assert len(got) == 5
    for r in got:
        raw = {1: text, 2: "", 3: "", None: "x" * 192}[r.doc_id].encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
    assert sorted(map(str, flac.round_trip(make(rows)).collect())) == sorted(map(str, got))
    blocks = flac.pcm_blocks(media, 1000).filter("doc_id = 1").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks[::2]).rstrip(b" ") == text.encode().rstrip(b" ")
    assert flac.features(flac.encode(make([]))).collect() == []
    assert flac.round_trip(make([])).collect() == []


def test_no_stream_is_left_behind(spark, make, tmp_path):
    rows = [(i, "some words " * i, "en", "s") for i in range(50)]
    assert len(flac.round_trip(make(rows), f"file://{tmp_path}/spool").collect()) == 50
    assert list((tmp_path / "spool").iterdir()) == []


def test_stored_streams_and_blocks_are_read_back(spark, make, tmp_path):
    text = "".join(chr(33 + i * 7 % 90) for i in range(10_000))
    media = flac.stored(make([(1, text, "en", "a"), (2, "short", "en", "a"), (2, "short", "en", "a")]), f"file://{tmp_path}/media")
    assert sorted(map(str, flac.features(media).collect())) == sorted(map(str, flac.round_trip(make([(1, text, "en", "a"), (2, "short", "en", "a"), (2, "short", "en", "a")])).collect()))
    other = spark.createDataFrame([(3, bytearray(stereo(MID, SIDE))), (4, None)], "doc_id long, media binary")
    blocks = flac.write_pcm(media.select("doc_id", "media").unionByName(other), f"file://{tmp_path}/pcm", 1000)
    assert blocks.count() == 11 + 2 + 1
    got = flac.seek_pcm(blocks, 1, 2_990, 1_020).orderBy("sample_offset").collect()
    assert [(r.sample_offset, r.n_samples) for r in got] == [(2000, 1000), (3000, 1000), (4000, 1000)]
    assert b"".join(bytes(r.pcm) for r in got)[990:2010] == text.encode()[2990:4010]
    wide = blocks.filter("doc_id = 3").first()
    assert (wide.sample_offset, wide.n_samples, wide.channels, wide.sample_bytes, bytes(wide.pcm)) == (0, 4, 2, 2, PCM)


@pytest.mark.parametrize("samples", [1, 7, 192, 1 << 16])
def test_features_of_sought_blocks(tmp_path, monkeypatch, samples):
    """Blocks read back by their places describe a stream as its bytes in one piece do, and leave no file."""
    monkeypatch.setattr(flac, "PCM_SAMPLES", samples)
    streams = [b"", b"abc", bytes(range(256)) * 2, b"\xff" * 193]
    uri = f"file://{tmp_path}/pcm.bin"
    for pcm, blocks in zip(streams, flac._sought(uri, streams, samples), strict=True):
        x = (np.frombuffer(pcm, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
        says = f"samples={len(x)};peak={int(np.abs(x).max(initial=0))};energy={int((x**2).sum())};changes={int(np.count_nonzero(np.diff(x)))}"
        assert flac._described(blocks) == (len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-16:]), says)
    assert list(tmp_path.iterdir()) == []
