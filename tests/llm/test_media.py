"""Images of each kind, resizing against a plain mean, and exact round trips of stored texts."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from vicinity.llm import media

RNG = np.random.default_rng(0)


def test_payloads_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.pad(bytes(RNG.integers(0, 256, n, np.uint8)))
        assert len(payload) % 192 == 0 and len(payload) >= 192 and len(payload) - n <= 192
        assert media.decode(media.wrap(payload)).tobytes() == payload
    assert media.pad(b"a") == b"a" + b" " * 191
    with pytest.raises(ValueError):
        media.wrap(b"")


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (16, 7)])
def test_formats(shape):
    h, w = shape
    rgb = RNG.integers(0, 256, (h, w, 3), np.uint8)
    grey = RNG.integers(0, 256, (h, w), np.uint8)
    bits = RNG.integers(0, 2, (h, w), np.uint8)
    assert (media.decode(b"P6 # note\n%d %d\n255\n" % (w, h) + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P5\n%d\n%d 255 " % (w, h) + grey.tobytes())[:, :, 0] == grey).all()
    assert (media.decode(b"P3 %d %d 255\n" % (w, h) + " ".join(map(str, rgb.ravel())).encode())== rgb).all()
    assert (media.decode(b"P2 %d %d 255\n" % (w, h) + "\n".join(map(str, grey.ravel())).encode())[:, :, 0] == grey).all()
    assert (media.decode(b"P1 %d %d\n" % (w, h) + "".join(map(str, bits.ravel())).encode())[:, :, 0] == 255 * (1 - bits)).all()
    assert (media.decode(b"P4 %d %d\n" % (w, h) + np.packbits(bits, axis=1).tobytes())[:, :, 0] == 255 * (1 - bits)).all()
    wide = grey.astype(np.uint16) * 257
    assert (media.decode(b"P5 %d %d 65535\n" % (w, h) + wide.astype(">u2").tobytes())[:, :, 0] == grey).all()
    assert (media.decode(media.wrap_bmp(rgb)) == rgb).all()


@pytest.mark.parametrize("shape", [(1, 1, 3), (4, 6, 3), (37, 64, 1), (8, 9, 1)])
def test_resize_is_the_mean_of_areas(shape):
    pixels = RNG.integers(0, 256, shape, np.uint8)
    h, w, k = shape
    fine = np.repeat(np.repeat(pixels.astype(float), 8, 0), 9, 1)  # whole cells of an 8 by 9 grid
    expected = fine.reshape(8, h, 9, w, k).mean((1, 3))
    assert np.allclose(media.resize(pixels, 8, 9), expected)


def test_difference_hash_and_tile():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))[:, :, None]
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    assert np.load(io.BytesIO(media.npy(media.tile(ramp)))).shape == (media.TILE, media.TILE, 1)


def test_operators(spark):
    rows = [(1, "héllo", "x"), (2, None, "x"), (None, "", "x"), (3, "a" * 100_000, "x"), (1, "héllo", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    out = media.read_back(media.store(docs)).collect()
    assert len(out) == 5
    for r, (doc_id, text, _) in zip(out, rows, strict=True):
        payload = media.pad((text or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, len((text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(media.wrap(payload)).hexdigest() and r.media_bytes == len(media.wrap(payload))
    assert out[1].feature == out[2].feature and out[0] == out[4]
    assert media.read_back(media.store(docs.where("false"))).count() == 0


def test_broken_images_are_reported(spark):
    images = spark.createDataFrame([(1, None), (2, bytearray(b"P6 2 2 255\nxx")), (3, bytearray(b"GIF")), (4, bytearray(media.wrap(b" " * 192))), (5, bytearray(b"BM"))], "doc_id long, media binary")
    out = {r.doc_id: r for r in media.features(images).collect()}
    assert out[1].error is None and out[1].tile is None
    assert out[2].error and out[3].error and out[5].error and out[4].error is None
    assert (out[4].height, out[4].width, out[4].channels) == (1, 64, 3)


def test_tall_pictures_are_summed_in_bands(monkeypatch):
    pixels = RNG.integers(0, 256, (997, 5, 3), np.uint8)
    whole = media.resize(pixels, 16, 3)
    monkeypatch.setattr(media, "BAND", 10)
    assert np.allclose(media.resize(pixels, 16, 3), whole) and np.allclose(whole.mean((0, 1)), pixels.mean((0, 1)))
