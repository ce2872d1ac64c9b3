import numpy as np
import pytest

from quire.llm import webp
from quire.llm.media import load, padded, store
from quire.llm.webp import NEAR, Code, code_lengths, decode, encode, encode_stored
from tests.llm.helpers import prose


def picture(height, width, colours=None, seed=0):
    r = np.random.default_rng(seed)
    if colours:
        table = r.integers(0, 256, (colours, 4), dtype=np.uint8)
        return table[r.integers(0, colours, (height, width))]
    return r.integers(0, 256, (height, width, 4), dtype=np.uint8)


def same(x, **how):
    assert (decode(encode(x, **how)) == x).all()


@pytest.mark.parametrize("height,width", [(1, 1), (1, 7), (9, 1), (13, 17)])
def test_literals(height, width):
    same(picture(height, width))


@pytest.mark.parametrize("mode", [-1, *range(14)])
def test_predictors(mode):
    same(picture(13, 18, seed=mode + 1), predictor=mode)


def test_cross_colour_and_green():
    same(picture(11, 14), cross=(37, -90, 120))
    same(picture(11, 14), green=True)
    same(picture(11, 14), green=True, predictor=-1, cross=(-128, 127, 5))


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    same(picture(7, 23, colours), palette=True)


def test_palette_then_predictor():
    same(picture(9, 21, 5), palette=True, predictor=2)


@pytest.mark.parametrize("bits", [1, 4, 11])
def test_colour_cache(bits):
    same(picture(20, 20, 30), cache_bits=bits)


def test_back_references():
    x = np.tile(picture(4, 9, 6), (30, 3, 1))
    small = encode(x, references=True)
    assert (decode(small) == x).all()
    assert len(small) < len(encode(x))
    same(x, references=True, cache_bits=6, split=2)


def test_entropy_image():
    same(picture(19, 22, 40), split=2, references=True)


def test_all_together():
    same(np.tile(picture(6, 8, 20, 3), (3, 3, 1)), green=True, predictor=11, cross=(1, 2, 3), cache_bits=5, references=True, split=3)


def used(monkeypatch, x):
    """What reading the stored form of x goes through, and its bytes."""
    seen = set()
    for name in ("_add_predictions", "_cross_colour", "_add_green", "_unpalette", "_expand"):
        f = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, f=f, name=name: (seen.add(name), f(*a))[1])
    data = encode_stored(x)
    seen.clear()
    assert (decode(data) == x).all()
    return seen, data


def test_stored_text(monkeypatch):
    raw = padded(prose(3000, 1).encode())
    seen, data = used(monkeypatch, np.frombuffer(raw, np.uint8).reshape(-1, 144, 4))
    assert "_expand" in seen and len(data) < 0.8 * len(raw)


def test_stored_slopes(monkeypatch):
    i, j = np.mgrid[0:40, 0:144]
    r = np.random.default_rng(1)
    for make in (lambda k: 3 * i + j * (k + 1), lambda k: 5 * i + r.integers(0, 3, i.shape)):
        x = np.stack([make(k) for k in range(4)], axis=2).astype(np.uint8)
        seen, data = used(monkeypatch, x)
        assert "_add_predictions" in seen and len(data) < x.size // 2


def test_stored_colours(monkeypatch):
    r = np.random.default_rng(2)
    steps = np.cumsum(r.integers(-20, 21, (40, 144)), axis=0)
    seen, _ = used(monkeypatch, np.stack([np.full_like(steps, 255), steps, steps, steps], axis=2).astype(np.uint8))
    assert {"_add_predictions"} < seen and seen & {"_cross_colour", "_add_green"}
    seen, data = used(monkeypatch, picture(30, 144, 9))
    assert "_unpalette" in seen and len(data) < 30 * 144


@pytest.mark.parametrize("height", [1, 2, 40, 700])
@pytest.mark.parametrize("colours", [None, 1, 2, 5, 16, 17, 300])
def test_stored(height, colours):
    x = picture(height, 144, colours, height)
    assert (decode(encode_stored(x)) == x).all()


def test_cut_files():
    data = encode_stored(picture(3, 144))
    for n in (60, len(data) // 2, len(data) - 30):
        with pytest.raises(ValueError):
            decode(data[:n])


def test_distance_order():
    assert len(NEAR) == 120
    assert NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_codes():
    assert code_lengths([0, 0, 0])[0] == 1
    assert max(code_lengths([2**i for i in range(30)])) <= 15
    with pytest.raises(ValueError):
        Code([1, 2, 0])


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 3000])
def test_payloads(n):
    raw = bytes(i * 7 % 251 for i in range(n))
    whole = padded(raw)
    assert len(whole) % 576 == 0 and len(whole) >= 576 and whole[:n] == raw and set(whole[n:]) <= {255}
    assert load(store(whole)).tobytes() == whole


def test_texts_of_all_kinds():
    texts = ["", "a", "a" * 5000, prose(2000, 3), prose(400, 4) * 6, "ж" * 700 + prose(50, 5), "".join(chr(0x4E00 + i % 3000) for i in range(2500)), "\n".join(["one line again"] * 300)]
    for t in texts:
        whole = padded(t.encode())
        assert load(store(whole)).tobytes() == whole


def test_more_rows_than_an_image_may_have():
    whole = padded(bytes(16384 * 576 + 5))
    assert load(store(whole)).tobytes() == whole


def test_bad_files():
    with pytest.raises(ValueError):
        decode(b"RIFF\0\0\0\0WEBPVP8 " + bytes(20))


def test_cache_and_copies_of_all_kinds():
    # copied pixels enter the cache, literals and copies take each other's places, copies overlap themselves
    r = np.random.default_rng(7)
    for bits in (1, 2, 6, 10):
        for k in range(6):
            few = picture(12, 24, 5 + 9 * k, seed=10 * bits + k)
            x = np.concatenate([few, few[r.permutation(12)], np.repeat(few[:, :3], 8, axis=1), picture(4, 24, seed=k), few[::-1]])
            same(x, cache_bits=bits, references=True)
            assert (decode(encode(x, cache_bits=bits, references=True, split=2)) == x).all()


def test_writing_holds_no_number_for_each_bit():
    import tracemalloc

    raw = padded(prose(170000, 5).encode())
    x = np.frombuffer(raw, np.uint8).reshape(-1, 144, 4)
    encode_stored(x[:4])
    tracemalloc.start()
    data = encode_stored(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (decode(data) == x).all() and peak < 40 * len(raw)
