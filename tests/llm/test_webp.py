import base64
import itertools

import numpy as np
import pytest

from sparkseek.llm import webp as W


def image(h, w, colours=None, seed=0):
    r = np.random.default_rng(seed)
    px = r.integers(0, 2**32, (h, w), dtype=np.uint32)
    if colours:
        px = px.ravel()[r.integers(0, min(colours, px.size), (h, w))]
    return px


def back(data):
    return next(W.images(data))


@pytest.mark.parametrize("how", [
    {}, {"cache_bits": 4}, {"copies": True}, {"copies": True, "cache_bits": 3}, {"group_bits": 2}, {"group_bits": 2, "cache_bits": 2, "copies": True},
    {"green": True}, {"cross": (17, 200, 130)}, {"palette": True}, {"palette": True, "copies": True}, {"green": True, "cross": (1, 2, 3), "predictor": -1},
])
@pytest.mark.parametrize("shape,colours", [((7, 9), 40), ((1, 1), None), ((13, 21), 2), ((6, 33), 4), ((9, 16), 16), ((16, 5), 60)])
def test_round_trip(how, shape, colours):
    px = image(*shape, colours)
    assert np.array_equal(back(W.encode_image(px, **how)), px)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    px = image(11, 10, None, mode)
    assert np.array_equal(back(W.encode_image(px, predictor=mode)), px)


def test_known_file():
    # A widely published smallest lossless file: one transparent pixel.
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert back(data).tolist() == [[0]]


def test_near_distances():
    assert len(W.NEAR) == 120 and W.NEAR[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and W.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("data", [b"", b"a", b"\0" * 64, b"ab" * 32, bytes(range(256)) * 3, b"x" * 100_000, "Größe é 日本".encode() * 50])
def test_bytes(data):
    got = W.decode_bytes(W.encode_bytes(data))
    assert got[: len(data)] == data and len(got) % 64 == 0 and not any(got[len(data) :])


def test_many_images():
    data = np.random.default_rng(1).integers(0, 256, W.IMAGE_BYTES + 64, dtype=np.uint8).tobytes()
    assert W.decode_bytes(W.encode_bytes(data)) == data


def test_damaged():
    data = W.encode_bytes(b"some text that is stored as an image, for the test" * 9)
    for k, cut in itertools.product((30, 60), (True, False)):
        bad = data[:k] if cut else data[:k] + b"\xff\x00\xff" + data[k + 3 :]
        try:
            got = W.decode_bytes(bad)
        except ValueError:
            continue
        assert not cut and len(got) % 64 == 0  # what can't be told is an image at least


PAYLOADS = {
    "grey": b"Words that make a sentence, and a few more of them. " * 3 + bytes(range(97, 123)) * 2 + b"\0" * 48,
    "few": (np.random.default_rng(2).random(4096) < 0.04).astype(np.uint8).tobytes(),
    "palette": np.random.default_rng(3).integers(0, 2**32, 40, dtype=np.uint32)[np.random.default_rng(4).integers(0, 40, 1024)].tobytes(),
    "cache": np.random.default_rng(5).integers(0, 2**32, 300, dtype=np.uint32)[np.random.default_rng(6).integers(0, 300, 1024)].tobytes(),
    "smooth": (np.add.outer(np.arange(64) * 3, np.arange(64)) + np.random.default_rng(7).integers(0, 2, (64, 64))).astype(np.uint8).tobytes(),
}


@pytest.mark.parametrize("name", PAYLOADS)
def test_plans(name):
    """The plan that pays is taken, its parts are met by the decoder, and the bytes come back."""
    data, told = W.decode_columns(W.encode_columns([PAYLOADS[name]]))[0]
    assert data == PAYLOADS[name]
    met = {"grey": ("green", "copies"), "few": ("palette",), "palette": ("palette",), "cache": ("cached",), "smooth": ("predictor",)}[name]
    assert all(told[k] for k in met), told


def test_cross_colour_pays():
    r = np.random.default_rng(8)
    g = np.cumsum(r.integers(-9, 10, (64, 16)), 1)
    px = np.stack([g * 0.5 + r.integers(0, 2, g.shape), g, -g * 0.75 + r.integers(0, 2, g.shape), np.full(g.shape, 255)], -1).astype(np.int64).astype(np.uint8)
    data, told = W.decode_columns(W.encode_columns([px.tobytes()]))[0]
    assert data == px.tobytes() and told["cross"] and told["predictor"]


def test_alone_or_beside_others():
    r = np.random.default_rng(9)
    values = [*PAYLOADS.values(), *(r.integers(97, 105, 64 * k, dtype=np.uint8).tobytes() for k in range(1, 40)), b"ab" * 20_000]
    together = W.encode_columns(values)
    assert together == [W.encode_columns([v])[0] for v in values] and together[::-1] == W.encode_columns(values[::-1])
    assert [d for d, _ in W.decode_columns(together)] == [v + b"\0" * (-len(v) % 64) for v in values]


def test_complete_codes():
    r = np.random.default_rng(10)
    hist = np.where(r.random((200, 300)) < 0.3, r.integers(0, 3000, (200, 300)) ** 2, 0)
    hist[0], hist[1], hist[2] = 0, 0, 0
    hist[1, 7], hist[2, [3, 9]] = 5, (1, 10**6)
    n = W.lengths_of(hist)
    assert (n[0] == 0).all() and (n[1] == 0).all() and n[2, [3, 9]].tolist() == [1, 1]
    assert n.max() <= 11 and (np.where(n > 0, 1 << (11 - n), 0).sum(1)[2:] == 1 << 11).all() and ((n > 0) == (hist > 0))[2:].all()


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, b"abc", b"old"), (2, None, b"x"), (3, b"", None)], "media_id long, data binary, media binary")
    got = {r.media_id: r for r in W.read_media(W.store_media(df, "data"), to="data").collect()}
    assert bytes(got[1].data[:3]) == b"abc" and len(got[1].data) == 64 and got[2].data is None and got[2].media is None and got[3].data == b""
    assert W.digest_media(W.store_media(df.where("false"), "data")).count() == 0
    assert W.read_media(W.store_media(df.where("false"), "data")).columns == ["media_id", "data", "media", "samples"]


def test_columns(spark):
    import hashlib
    import zlib

    rows = [(1, "a"), (2, None), (3, ""), (4, "é" * 5000), (5, "a")]
    import os
    import tempfile

    d = tempfile.mkdtemp()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(os.path.join(d, "documents.parquet"))
    got = {r.doc_id: r for r in W.op9_webp(spark, d).collect()}
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(b), len(p), hashlib.sha256(p).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(p[-64:])
    assert got[1].media_sha256 == got[5].media_sha256 and got[2].feature == got[3].feature
    assert W.op9_webp(spark, d).where("false").count() == 0


def test_much_is_coded_at_once(monkeypatch):
    """Half a megabyte goes to the encoder at once, and the bytes don't depend on how much does."""
    import random

    from sparkseek.llm import webp

    r = random.Random(3)
    values = ["".join(r.choices("abcdefgh ", k=16_384)).encode() for _ in range(32)]
    sizes, encode = [], webp.encode_many
    monkeypatch.setattr(webp, "encode_many", lambda parts: sizes.append(sum(map(len, parts))) or encode(parts))
    whole = webp.encode_columns(values)
    assert sizes == [32 * 16_384]
    monkeypatch.setattr(webp, "ENCODE", 1 << 16)
    assert webp.encode_columns(values) == whole and [x for x, _ in webp.decode_columns(whole)] == values
