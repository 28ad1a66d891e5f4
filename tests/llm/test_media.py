import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from veilshift.llm import webp
from veilshift.llm.media import load, media_column, op2_media, payload, store, tight, transforms

RNG = np.random.default_rng(5)


def picture(h, w, colours=0):
    if colours:
        return RNG.choice(RNG.integers(0, 1 << 32, colours, dtype=np.uint32), (h, w))
    y, x = np.mgrid[:h, :w]
    base = (x * 3 + y * 2 & 255).astype(np.uint32)
    return base | (base + 7 & 255) << 8 | (base * 2 & 255) << 16 | (RNG.integers(0, 3, (h, w)).astype(np.uint32) + 200) << 24


@pytest.mark.parametrize("how", [
    {}, {"matches": True}, {"cached": 5}, {"cached": 11, "matches": True}, {"subtract_green": True}, {"cross": (5, -7, 100)},
    {"split": 2}, {"split": 3, "cached": 3, "matches": True}, *[{"predictor": m} for m in range(14)],
    {"predictor": 11, "cross": (-128, 127, 3), "subtract_green": True, "cached": 4, "matches": True, "split": 2},
])
@pytest.mark.parametrize("shape", [(1, 1), (9, 17), (20, 8)])
def test_round_trip(how, shape):
    p = picture(*shape)
    assert (webp.decode(webp.encode(p, **how)) == p).all()
    assert (webp.decode_many([webp.encode(p, **how)] * 2)[1] == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette(colours):
    p = picture(13, 21, colours)
    for how in ({}, {"matches": True, "cached": 6}, {"predictor": 2}, {"split": 2}):
        assert (webp.decode(webp.encode(p, palette=True, **how)) == p).all()


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_fast_path_equals_the_general_one():
    data = [payload(RNG.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 1, 192, 193, 12288, 12289, 50000)]
    for x, media, samples in zip(data, store(data), load(store(data)), strict=True):
        assert samples.tobytes() == x
        at, parts = 0, []
        while at < len(media):
            stream, at = webp.stream_of(media, at)
            parts.append(webp.decode(stream))
        rgb = np.concatenate(parts).view(np.uint8).reshape(-1, 4)[:, 2::-1]
        assert rgb.tobytes() == x
    assert webp.file_of(webp.encode(picture(2, 2)))[:4] == b"RIFF"
    with pytest.raises(ValueError):
        webp.decode(webp.stream_of(media)[0][:-40])


def test_repeating_tiles_are_stored_tightly():
    texts = [b"again " * 3000, bytes(range(256)) * 60, b"again " * 2000 + RNG.integers(0, 256, 9000, dtype=np.uint8).tobytes(), b"ab" * 4000, b"seven! " * 2500 + b"x"]
    data = [payload(x) for x in texts]
    stored = store(data)
    assert [x.tobytes() for x in load(stored)] == data
    assert len(stored[0]) < len(data[0]) / 20 and len(stored[4]) < len(data[4]) / 20


def test_transforms_are_chosen_by_entropy():
    ramp = (np.arange(64)[None, :, None] + np.arange(64)[:, None, None] * 3 + RNG.integers(0, 2, (64, 64, 3))).astype(np.uint8)
    grey = np.repeat(RNG.integers(0, 256, (64, 64, 1), dtype=np.uint8), 3, axis=2)
    lines = np.tile(RNG.integers(0, 256, (1, 64, 3), dtype=np.uint8), (64, 1, 1)) + RNG.integers(0, 2, (64, 64, 3), dtype=np.uint8)
    noise = RNG.integers(0, 256, (64, 64, 3), dtype=np.uint8)
    chosen = [transforms(x.reshape(-1, 3)) for x in (ramp, grey, lines, noise)]
    assert "predictor" in chosen[0] and chosen[1] == {"cross": (32, 32, 0)} and chosen[2] == {"predictor": 2} and chosen[3] == {}
    for x in (ramp, grey, lines):
        data = x.tobytes()
        file = tight(data)
        assert len(file) < len(webp.encode_literals([data], 64)[0]) * 0.8
        assert load([file])[0].tobytes() == data
    assert tight(noise.tobytes()) is None


def test_other_files_are_read_too():
    p = picture(30, 64) | 0xFF000000
    media = b"".join(webp.file_of(webp.encode(p, **how)) for how in ({}, {"matches": True}, {"predictor": 5, "cached": 3}))
    assert load([media])[0].shape == (90, 64, 3)


def test_query(spark, tmp_path):
    texts = [None, "", "é" * 100, "a" * 192, "b" * 193, "long ü " * 9000, "twice", "twice"]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op2_media(spark, str(tmp_path)).collect())
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        p = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    m = media_column(spark.createDataFrame([(1, "x")], "doc_id int, text string"), with_media=True).first()
    assert hashlib.sha256(bytes(m.media)).hexdigest() == m.media_sha256 and len(m.media) == m.media_bytes


def test_repeating_tiles_take_few_steps(monkeypatch):
    syllables = ["th", "he", "an", "nd ", "on", "ti", "es ", "ha", "ou", "in"]
    tile = "".join(syllables[i * i * 7 // 5 % 10] + syllables[i // 3 % 10] for i in range(5000)).encode()[:12288]
    pixels = np.frombuffer(tile, np.uint8).reshape(64, 64, 3).astype(np.uint32)
    pixels = pixels[..., 0] << 16 | pixels[..., 1] << 8 | pixels[..., 2] | 0xFF000000
    wide = np.random.default_rng(3).choice(pixels.ravel(), (64, 64))
    steps = Counter()
    for kind, name in ((webp.Writer, "put"), (webp.Prefix, "read")):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), name=name: (steps.update([name]), f(self, *a))[1])
    stream = webp.encode(wide, cached=6, matches=True)
    assert (webp.decode(stream) == wide).all()
    assert steps["put"] < 2000 and steps["read"] < 2000  # not one for each field of 4096 pixels
    assert hashlib.sha256(stream).hexdigest() == "5a3476f398222a162f5093eda6559c906f5c5ee5d61da48073a1974b2ce3cfa2"  # as when each field was written by itself
