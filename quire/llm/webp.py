"""Lossless WebP (VP8L): a complete decoder to pixel arrays, and an encoder of what it can decode.

Decoding covers prefix codes (simple and normal, in groups chosen by an entropy image), back-references with the
two-dimensional distance codes, the colour cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms. Where one group of codes holds for the whole image, array operations read at every bit what pixel would begin
there and how long it is, and the pixels are the chain from the first bit on; images with several groups are decoded
symbol by symbol. Pixels are rows of (alpha, red, green, blue).

`encode_stored` writes the files of the media column: of several transforms the one that the data make cheapest, colour
cache, back-references and prefix codes of unequal length, which are two fixed sets (of bytes of text, and of small
differences), so that no codes need be made or read for each of many small images.
"""

from __future__ import annotations

import heapq
import struct
from functools import cached_property, lru_cache

import numpy as np

MAX_SIDE = 1 << 14
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
#: Short distances in order of nearness: pixels of the same and the seven earlier rows.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


class Reader:
    """Bits of a byte string, least significant first; beyond the end come zeros."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def peek(self, n: int) -> int:
        at, shift = self.pos >> 3, self.pos & 7
        return (int.from_bytes(self.data[at : at + (shift + n + 7 >> 3)], "little") >> shift) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.pos += n
        return value


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code without symbols")
        self.lengths = [0] * len(lengths) if self.single is not None else list(lengths)
        self.codes: dict[int, int] = {}
        self.table: dict[tuple[int, int], int] = {}
        if self.single is None:
            if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
                raise ValueError("an incomplete prefix code")
            code = last = 0
            for s in sorted(used, key=lambda s: (lengths[s], s)):
                code <<= lengths[s] - last
                last = lengths[s]
                self.codes[s] = code
                self.table[last, code] = s
                code += 1

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length by the next 15 bits, least significant first."""
        symbols, lengths = np.zeros(1 << 15, np.uint16), np.zeros(1 << 15, np.uint8)
        if self.single is not None:
            symbols[:] = self.single
        for (n, code), s in self.table.items():
            at = int(f"{code:0{n}b}"[::-1], 2)
            symbols[at :: 1 << n] = s
            lengths[at :: 1 << n] = n
        return symbols, lengths

    @cached_property
    def steps(self) -> np.ndarray:
        """For the code of greens: the code length by the next 15 bits, and whether a copy or a place of the cache begins there."""
        symbols, lengths = self.tables
        marks = np.where(symbols < LITERALS, 0, np.where(symbols < LITERALS + LENGTHS, _COPY, _CACHED))
        return (lengths | marks).astype(np.uint8)

    @cached_property
    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Bits to write by symbol, least significant first, and their number."""
        bits = np.zeros(len(self.lengths), np.int64)
        for s, code in self.codes.items():
            bits[s] = int(f"{code:0{self.lengths[s]}b}"[::-1], 2)
        return bits, np.array(self.lengths, np.int64)

    def read(self, r: Reader) -> int:
        if self.single is not None:
            return self.single
        code = 0
        for n in range(1, 16):
            code = code << 1 | r.read(1)
            if (s := self.table.get((n, code))) is not None:
                return s
        raise ValueError("a code that is not in the table")


def _read_lengths(r: Reader, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in range(r.read(4) + 4):
        own[LENGTH_ORDER[k]] = r.read(3)
    code = Code(own)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        value, times = {16: (last, 3), 17: (0, 3), 18: (0, 11)}[s]
        times += r.read({16: 2, 17: 3, 18: 7}[s])
        if at + times > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + times] = [value] * times
        at += times
    return lengths


_GROUPS: dict[int, list[tuple[int, int, list[Code]]]] = {}


def _read_group(r: Reader, cache_bits: int) -> list[Code]:
    """The five codes of a group. Groups read before are known again by their bits."""
    for bits, value, codes in _GROUPS.get(cache_bits, ()):
        if r.peek(bits) == value:
            r.pos += bits
            return codes
    start = r.pos
    codes = [Code(_read_lengths(r, n)) for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    if len(_GROUPS.setdefault(cache_bits, [])) < 4:
        bits = r.pos - start
        r.pos = start
        _GROUPS[cache_bits].append((bits, r.read(bits), codes))
    return codes


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + r.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _decode_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    groups, block = None, 0
    if main and r.read(1):
        block = r.read(3) + 2
        entropy = _decode_pixels(r, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        groups = (entropy[..., 1].astype(int) << 8) | entropy[..., 2]
    codes = [_read_group(r, cache_bits) for _ in range(1 if groups is None else int(groups.max()) + 1)]
    n = width * height
    if groups is None:
        return _decode_chain(r, n, width, codes[0], cache_bits).astype(">u4").view(np.uint8).reshape(height, width, 4)
    out = np.zeros((n, 4), np.uint8)
    cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None

    def remember(i: int, j: int) -> None:
        for k in range(i, j):
            a = int.from_bytes(out[k].tobytes(), "big")
            cache[(a * CACHE_MULTIPLIER & 0xFFFFFFFF) >> 32 - cache_bits] = a

    i = 0
    while i < n:
        group = codes[0 if groups is None else groups[(i // width) >> block, (i % width) >> block]]
        s = group[0].read(r)
        if s < LITERALS:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            out[i] = alpha, red, s, blue
            j = i + 1
        elif s < LITERALS + LENGTHS:
            length = _value(r, s - LITERALS)
            back = _distance(_value(r, group[4].read(r)), width)
            j = min(i + length, n)
            if back > i:
                raise ValueError("a back-reference before the first pixel")
            for k in range(i, j):
                out[k] = out[k - back]
        else:
            out[i] = np.frombuffer(int(cache[s - LITERALS - LENGTHS]).to_bytes(4, "big"), np.uint8)
            j = i + 1
        if cache is not None:
            remember(i, j)
        i = j
    return out.reshape(height, width, 4)


#: Bytes that array operations of the decoder work on at a time, and bits that one pixel or copy can take at most.
SLAB, LONGEST = 1 << 13, 96
#: Marks beside the length in a code's steps, and what stands for the bit after a copy.
_COPY, _CACHED, _COPIED = 16, 32, 1 << 40


def _decode_chain(r: Reader, n: int, width: int, codes: list[Code], cache_bits: int) -> np.ndarray:
    """n pixels as numbers, read with one group of codes. Copies, which are few, are read one by one where the chain meets them."""
    whole = np.frombuffer(r.data, np.uint8)
    (gs, _), (rs, rl), (bs, bl), (as_, al), (ds, dl) = (c.tables for c in codes)
    steps = codes[0].steps
    alike = codes[1].lengths == codes[2].lengths == codes[3].lengths
    parts, copies, i, events = [], [], 0, 0
    while i < n:
        base = r.pos >> 3
        raw = whole[base : base + SLAB]
        if base + SLAB >= len(whole):
            raw = np.concatenate([raw, np.zeros(2 * LONGEST // 8, np.uint8)])
        wide = raw.astype(np.int64)
        wide[:-1] |= wide[1:] << 8
        wide[:-2] |= (wide[2:] & 255) << 16
        # what begins at the last bits is not read from this slab; zeros stand for what those would look up
        bits = 8 * len(wide)
        peek = np.zeros(bits + LONGEST, np.int64)
        by_shift = peek[:bits].reshape(-1, 8)
        for k in range(8):
            np.right_shift(wide, k, out=by_shift[:, k])
        peek &= 0x7FFF
        places = np.arange(len(peek))
        after_red = places + rl.take(peek)
        after_blue, after_alpha = (after_red, after_red) if alike else (places + bl.take(peek), places + al.take(peek))
        step = steps.take(peek[:bits])
        p1 = places[:bits] + (step & 15)
        then = after_alpha.take(after_blue.take(after_red.take(p1)))
        if cache_bits:
            np.copyto(then, p1, where=step >= _CACHED)
        np.copyto(then, _COPIED, where=step & _COPY != 0)
        nexts = memoryview(then)
        p, stop, spots = r.pos & 7, bits - LONGEST, []
        add = spots.append
        while i < n:
            before = len(spots)
            for _ in range(n - i):
                if p >= stop:
                    break
                add(p)
                p = nexts[p]
            i += len(spots) - before
            if p < _COPIED:
                break
            q = spots[-1]
            r.pos = (base << 3) + int(p1[q])
            run = _value(r, int(gs[peek[q]]) - LITERALS)
            q = r.peek(15)
            r.pos += int(dl[q])
            copies.append((events + len(spots) - 1, run, _distance(_value(r, int(ds[q])), width)))
            p = r.pos - (base << 3)
            i += run - 1
        if not spots or (base << 3) + p > 8 * len(whole):
            raise ValueError("the image data end early")
        r.pos = (base << 3) + p
        events += len(spots)
        at = np.array(spots)
        kind = gs[peek[at]].astype(np.int64)
        at = p1[at]
        blue = after_red[at]
        value = (as_[peek[after_blue[blue]]].astype(np.int64) << 24) | (rs[peek[at]].astype(np.int64) << 16) | ((kind & 255) << 8) | bs[peek[blue]]
        parts.append((kind, value))
    kind, value = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    return value.astype(np.uint32) if len(kind) == n and not (kind >= LITERALS).any() else _expand(n, kind, value, copies, cache_bits)


def _expand(n: int, kind: np.ndarray, value: np.ndarray, copies: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray:
    """Pixels from literals, copies (place among all, pixels, distance) and places of the colour cache.

    A place of the cache holds the later of the last literal and the last copied pixel of its hash; literals are found by
    array operations, copied pixels are kept from the first copy on.
    """
    run = np.ones(len(kind), np.int64)
    for e, m, _ in copies:
        run[e] = m
    ends = np.cumsum(run)
    place = ends - run
    out = np.zeros(max(n, int(ends[-1])), np.uint32)
    literal = kind < LITERALS
    out[place[literal]] = value[literal]
    shift = 32 - cache_bits
    slot_of = lambda v: v * CACHE_MULTIPLIER >> shift & (1 << cache_bits) - 1
    hits = np.flatnonzero(kind >= LITERALS + LENGTHS)
    if len(hits):
        which = np.flatnonzero(literal | (kind >= LITERALS + LENGTHS))
        slot = np.where(literal[which], slot_of(value[which]), kind[which] - LITERALS - LENGTHS).astype(np.uint8 if cache_bits <= 8 else np.uint16)
        order = np.argsort(slot, kind="stable")
        which, slot = which[order], slot[order]
        told = literal[which]
        last = np.maximum.accumulate(np.where(told, np.arange(len(which)), 0))
        known = ~told & told[last] & (slot[last] == slot)
        source = np.full(len(kind), -1)
        source[which[known]] = which[last[known]]
        from_literals = source[hits]
        out[place[hits]] = np.where(from_literals < 0, 0, value[from_literals])
    if not copies:
        return out[:n]
    later = [(int(h), -1, 0) for h in hits[np.searchsorted(hits, copies[0][0]) :]]
    when: dict[int, int] = {}
    what: dict[int, int] = {}
    for e, m, back in sorted(copies + later) if later else copies:
        at = int(place[e])
        if m < 0:
            slot = int(kind[e]) - LITERALS - LENGTHS
            if when.get(slot, -1) > source[e]:
                out[at] = what[slot]
            continue
        if back > at:
            raise ValueError("a back-reference before the first pixel")
        if back >= m:
            out[at : at + m] = out[at - back : at - back + m]
        else:
            out[at : at + m] = np.resize(out[at - back : at], m)
        if later:
            new = out[at + max(0, m - back) : at + m].astype(np.int64)
            slots = slot_of(new).tolist()
            when.update(dict.fromkeys(slots, e))
            what.update(zip(slots, new.tolist(), strict=True))
    return out[:n]


def _average(a, b):
    return ((a.astype(np.int16) + b) >> 1).astype(np.uint8)


def _select(left, top, corner):
    a, t, c = (x.astype(int) for x in (left, top, corner))
    return left if np.abs(t - c).sum() < np.abs(a - c).sum() else top


def _clamped(a, b, c):
    return np.clip(a.astype(int) + b - c, 0, 255).astype(np.uint8)


def _clamped_half(a, b):
    # the format divides towards zero
    half = (a.astype(int) - b) / 2
    return np.clip(a.astype(int) + np.trunc(half).astype(int), 0, 255).astype(np.uint8)


def _predicted(mode: int, left, top, corner, right) -> np.ndarray:
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], np.uint8)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner), 7: lambda: _average(left, top),
        8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
        11: lambda: _select(left, top, corner), 12: lambda: _clamped(left, top, corner), 13: lambda: _clamped_half(_average(left, top), corner),
    }[mode]()


def _neighbours(x: np.ndarray, i: int, j: int):
    """Left, top, top-left and top-right of a pixel off the first row and column; beyond the right edge lies this row's first pixel."""
    width = x.shape[1]
    return x[i, j - 1], x[i - 1, j], x[i - 1, j - 1], x[i - 1, j + 1] if j + 1 < width else x[i, 0]


#: Modes that predict a pixel by the row above alone, or by the pixel on its left alone.
BY_ROWS = (1, 2, 3, 4, 8, 9)


def _row_prediction(mode: int, above: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Predictions of a row, or of many at once, from the second pixel on. first: the row's first pixel, which stands for what is beyond the right edge."""
    top, corner = above[..., 1:, :], above[..., :-1, :]
    if mode in (2, 4):
        return top if mode == 2 else corner
    if mode == 8:
        return _average(corner, top)
    right = np.concatenate([above[..., 2:, :], first[..., None, :]], axis=-2)
    return right if mode == 3 else _average(top, right)


def _add_predictions(x: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Invert the predictor transform."""
    height, width = x.shape[:2]
    x = x.copy()
    x[0, 0] += np.array([255, 0, 0, 0], np.uint8)
    x[0] = np.cumsum(x[0], axis=0, dtype=np.uint8)
    used = np.unique(modes)
    if len(used) == 1 and used[0] in BY_ROWS:
        for i in range(1, height):
            x[i, 0] += x[i - 1, 0]
            if used[0] == 1:
                x[i] = np.cumsum(x[i], axis=0, dtype=np.uint8)
            else:
                x[i, 1:] += _row_prediction(int(used[0]), x[i - 1], x[i, 0])
        return x
    for i in range(1, height):
        x[i, 0] += x[i - 1, 0]
        for j in range(1, width):
            x[i, j] += _predicted(int(modes[i >> block, j >> block]), *_neighbours(x, i, j))
    return x


def _subtract_predictions(x: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    out = x.copy()
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            if i and j:
                p = _predicted(int(modes[i >> block, j >> block]), *_neighbours(x, i, j))
            else:
                p = x[i - 1, 0] if i else x[0, j - 1] if j else np.array([255, 0, 0, 0], np.uint8)
            out[i, j] -= p
    return out


def _cross_colour(x: np.ndarray, factors: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what green and red tell of red and blue. factors: pixels (255, red to blue, green to blue, green to red)."""
    rows, columns = (np.arange(n) >> block for n in x.shape[:2])
    f = factors.view(np.int8).astype(np.int32)[rows[:, None], columns]
    y = x.astype(np.int32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(y[..., 2])
    red = y[..., 1] + sign * (f[..., 3] * green >> 5)
    y[..., 3] += sign * ((f[..., 2] * green >> 5) + (f[..., 1] * signed(red if sign > 0 else y[..., 1]) >> 5))
    y[..., 1] = red
    return y.astype(np.uint8)


def _add_green(x: np.ndarray, sign: int) -> np.ndarray:
    x = x.copy()
    for c in (1, 3):
        x[..., c] = x[..., c] + x[..., 2] if sign > 0 else x[..., c] - x[..., 2]
    return x


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(x: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _packing(len(table))
    per = 8 >> bits
    index = x[..., 2]
    if bits:
        shifts = np.arange(1 << bits, dtype=np.uint8) * per
        index = ((index[..., None] >> shifts) & ((1 << per) - 1)).reshape(x.shape[0], -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, as (height, width, 4) bytes in the order alpha, red, green, blue."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a simple lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    r = Reader(data[21 : 20 + size])
    width, height, has_alpha = r.read(14) + 1, r.read(14) + 1, r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, full = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS):
            block = r.read(3) + 2
            side = 1 << block
            undo.append((kind, block, _decode_pixels(r, (width + side - 1) >> block, (height + side - 1) >> block, False)))
        elif kind == GREEN:
            undo.append((kind, 0, None))
        else:
            colours = r.read(8) + 1
            table = np.cumsum(_decode_pixels(r, colours, 1, False)[0], axis=0, dtype=np.uint8)
            undo.append((kind, width, table))
            bits = _packing(colours)
            width = (width + (1 << bits) - 1) >> bits
    x = _decode_pixels(r, width, height, True)
    for kind, block, more in reversed(undo):
        if kind == PREDICTOR:
            x = _add_predictions(x, more[..., 2] & 15, block)
        elif kind == CROSS:
            x = _cross_colour(x, more, block, 1)
        elif kind == GREEN:
            x = _add_green(x, 1)
        else:
            x = _unpalette(x, more, block)
    if not has_alpha:
        x = x.copy()
        x[..., 0] = 255
    assert x.shape[1] == full
    return x


# --- encoding ---------------------------------------------------------------------------------------


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, code: Code, symbol: int) -> None:
        n = code.lengths[symbol]
        if n:
            self.bits(int(f"{code.codes[symbol]:0{n}b}"[::-1], 2), n)


def code_lengths(counts) -> list[int]:
    """Huffman code lengths, at most 15; one symbol at least."""
    counts = list(counts)
    while True:
        heap = [(c, s, (s,)) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) < 2:
            lengths[heap[0][1] if heap else 0] = 1
            return lengths
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(lengths) <= 15:
            return lengths
        counts = [c + 1 >> 1 if c else 0 for c in counts]


def _write_lengths(w: Writer, lengths: list[int]) -> Code:
    """A prefix code's lengths, runs shortened by the repeat codes."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used) < 256:
        w.bits(1, 1)
        w.bits(len(used) - 1, 1)
        w.bits(1, 1)
        for s in used:
            w.bits(s, 8)
        return Code([int(n > 0) for n in lengths])
    w.bits(0, 1)
    runs, i = [], 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n, value = j - i, lengths[i]
        if value:
            runs.append((value, 0, 0))
            n -= 1
        while n:
            if value and n >= 3:
                m = min(n, 6)
                runs.append((16, m - 3, 2))
            elif not value and n >= 11:
                m = min(n, 138)
                runs.append((18, m - 11, 7))
            elif not value and n >= 3:
                m = min(n, 10)
                runs.append((17, m - 3, 3))
            else:
                m = 1
                runs.append((value, 0, 0))
            n -= m
        i = j
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(counts)
    if max(own) > 7:
        own = code_lengths([c and 1 for c in counts])
    if sum(n > 0 for n in own) == 1:  # the code of lengths itself is written as complete
        own[next(s for s in range(19) if not own[s])] = 1
    last = max(k for k in range(19) if own[LENGTH_ORDER[k]])
    w.bits(max(last + 1, 4) - 4, 4)
    for k in range(max(last + 1, 4)):
        w.bits(own[LENGTH_ORDER[k]], 3)
    w.bits(0, 1)
    code = Code(own)
    for s, extra, n in runs:
        w.code(code, s)
        w.bits(extra, n)
    return Code(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and its bits of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), v & (1 << extra) - 1, extra


def _write_pixels(w: Writer, x: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, split: int = 0) -> None:
    """Literals, cache hits and back-references with Huffman codes. split: bits of the blocks of an entropy image, two groups by turns."""
    height, width = x.shape[:2]
    flat = [tuple(map(int, p)) for p in x.reshape(-1, 4)]
    n = len(flat)
    symbols: list[tuple] = []
    cache: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    i = 0
    while i < n:
        run = 0
        if references and i + 3 <= n and (back := seen.get(tuple(flat[i : i + 3]))) is not None:
            while i + run < n and run < 4096 and flat[back + run] == flat[i + run]:
                run += 1
        packed = int.from_bytes(bytes(flat[i]), "big")
        slot = (packed * CACHE_MULTIPLIER & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else 0
        if run >= 3:
            symbols.append((i, "copy", run, i - back))
        elif cache_bits and cache.get(slot) == packed:
            symbols.append((i, "cache", slot, 0))
        else:
            symbols.append((i, "literal", flat[i], 0))
        for k in range(i, i + max(run if run >= 3 else 1, 1)):
            seen[tuple(flat[k : k + 3])] = k
            if cache_bits:
                packed = int.from_bytes(bytes(flat[k]), "big")
                cache[(packed * CACHE_MULTIPLIER & 0xFFFFFFFF) >> 32 - cache_bits] = packed
        i += run if run >= 3 else 1
    near = {_distance(c + 1, width): c + 1 for c in reversed(range(len(NEAR)))}
    w.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    pick = lambda i: 0
    if main:
        w.bits(1 if split else 0, 1)
        if split:
            w.bits(split - 2, 3)
            side = 1 << split
            entropy = np.zeros(((height + side - 1) >> split, (width + side - 1) >> split, 4), np.uint8)
            entropy[..., 2] = np.add.outer(np.arange(entropy.shape[0]), np.arange(entropy.shape[1])) % 2
            entropy[..., 0] = 255
            _write_pixels(w, entropy, False)
            pick = lambda i: ((i // width >> split) + (i % width >> split)) % 2 if entropy[..., 2].max() else 0
            count = int(entropy[..., 2].max()) + 1
    groups = count if main and split else 1
    tallies = [[[0] * (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * DISTANCES] for _ in range(groups)]
    written = []
    for i, kind, a, b in symbols:
        t = tallies[pick(i)]
        if kind == "literal":
            out = [(0, a[2], 0, 0), (1, a[1], 0, 0), (2, a[3], 0, 0), (3, a[0], 0, 0)]
        elif kind == "cache":
            out = [(0, LITERALS + LENGTHS + a, 0, 0)]
        else:
            p, extra, m = _prefix(a)
            q, more, k = _prefix(near.get(b, b + len(NEAR)))
            out = [(0, LITERALS + p, extra, m), (4, q, more, k)]
        for c, s, _, _ in out:
            t[c][s] += 1
        written.append((pick(i), out))
    codes = [[_write_lengths(w, code_lengths(c)) for c in t] for t in tallies]
    for group, out in written:
        for c, s, extra, m in out:
            w.code(codes[group][c], s)
            w.bits(extra, m)


def _file(body: bytes) -> bytes:
    body = b"\x2f" + body
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _start(width: int, height: int) -> Writer:
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise ValueError("an image side is out of range")
    w = Writer()
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)
    return w


def encode(x: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = False, split: int = 0) -> bytes:
    """A file that uses the features asked for. predictor: a mode for all blocks, or -1 for all modes by turns."""
    height, width = x.shape[:2]
    w = _start(width, height)
    x = x.copy()
    block = 2
    shape = ((height + 3) >> block, (width + 3) >> block, 4)
    if palette:
        colours, index = np.unique(x.reshape(-1, 4), axis=0, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        w.bits(1 | PALETTE << 1, 3)
        w.bits(len(colours) - 1, 8)
        _write_pixels(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)[None], False)
        bits = _packing(len(colours))
        per, side = 8 >> bits, 1 << bits
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % side))).reshape(height, -1, side)
        x = np.zeros((height, index.shape[1], 4), np.uint8)
        x[..., 0] = 255
        x[..., 2] = (index << np.arange(side) * per).sum(axis=2)
        shape = ((height + 3) >> block, (x.shape[1] + 3) >> block, 4)
    if green:
        w.bits(1 | GREEN << 1, 3)
        x = _add_green(x, -1)
    if predictor is not None:
        modes = np.zeros(shape, np.uint8)
        modes[..., 0] = 255
        modes[..., 2] = np.arange(shape[0] * shape[1]).reshape(shape[:2]) % 14 if predictor < 0 else predictor
        w.bits(1 | PREDICTOR << 1, 3)
        w.bits(block - 2, 3)
        _write_pixels(w, modes, False)
        x = _subtract_predictions(x, modes[..., 2], block)
    if cross is not None:
        factors = np.zeros(shape, np.uint8)
        factors[...] = np.array([255, *(f & 255 for f in cross)], np.uint8)
        w.bits(1 | CROSS << 1, 3)
        w.bits(block - 2, 3)
        _write_pixels(w, factors, False)
        x = _cross_colour(x, factors, block, -1)
    w.bits(0, 1)
    _write_pixels(w, x, True, cache_bits, references, split)
    return _file(w.value.to_bytes((w.n + 7) // 8, "little"))


# --- files of the media column ----------------------------------------------------------------------

CACHE_BITS = 6
#: Letters from the most to the least frequent, by which the codes of text are made.
_FREQUENT = " etaonirsdlhucmfpgywbvkxjqz"


def _weights_of_text() -> list[int]:
    out = [1] * 256
    out[128:192] = [24] * 64
    out[192:245] = [6] * 53
    for k, c in enumerate(_FREQUENT):
        out[ord(c)] = 4000 >> k // 4
        out[ord(c.upper())] = max(out[ord(c.upper())], 160 >> k // 4)
    for c in "\n.,0123456789-'\"()&;:?!#$%*/<>=_@":
        out[ord(c)] = 48
    out[255] = 400
    return out


def _weights_of_differences() -> list[int]:
    return [max(1, 20000 // (1 + min(v, 256 - v)) ** 2) for v in range(256)]


class Group:
    """A fixed set of the five codes, as written before the pixels: a colour cache, one group, the code lengths."""

    def __init__(self, weights: list[int]):
        w = Writer()
        w.bits(1 | CACHE_BITS << 1, 5)
        w.bits(0, 1)
        total = sum(weights)
        lengths = [max(1, total // 40 >> k // 2) for k in range(LENGTHS)]
        cached = [max(1, total // 8 >> CACHE_BITS)] * (1 << CACHE_BITS)
        self.codes = [_write_lengths(w, code_lengths(c)) for c in (weights + lengths + cached, weights, weights, weights, [4] * 14 + [3] * 12 + [1] * 14)]
        self.head, self.bits = w.value, w.n
        self.literals = [tuple(v.astype(np.uint64) for v in c.written) for c in self.codes[:4]]
        self.cost = np.array(self.codes[1].lengths, np.uint8)

    def bits_for(self, x: np.ndarray) -> int:
        """Bits of all pixels as literals."""
        return int(self.cost.take(x).sum())


@lru_cache(1)
def groups() -> tuple[Group, Group]:
    return Group(_weights_of_text()), Group(_weights_of_differences())


@lru_cache(64)
def _near(width: int) -> dict[int, int]:
    return {_distance(c + 1, width): c + 1 for c in reversed(range(len(NEAR)))}


def _repeats(px: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references as (place, pixels, distance): greedily, of three pixels or more, each to the latest place that begins alike."""
    if len(px) < 4:
        return []
    p = px.astype(np.uint64)
    key = p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ p[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    here, earlier = order[same + 1], order[same]
    by_place = np.argsort(here)
    out, at = [], 0
    for c, j in zip(here[by_place].tolist(), earlier[by_place].tolist(), strict=True):
        if c < at:
            continue
        n, step = 0, 16
        while n < 4096 and c + n < len(px):
            m = min(step, 4096 - n, len(px) - c - n)
            differ = np.flatnonzero(px[c + n : c + n + m] != px[j + n : j + n + m])
            if len(differ):
                n += int(differ[0])
                break
            n, step = n + m, step * 4
        if n >= 3:
            out.append((c, n, c - j))
            at = c + n
    return out


def _stream(px: np.ndarray, width: int, group: Group, head: int, at: int) -> bytes:
    """The first `at` bits, which are those of head, and then pixels: copies, places of the colour cache, literals."""
    slot = (px * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - CACHE_BITS)).astype(np.uint8)
    order = np.argsort(slot, kind="stable")
    by_slot = px[order]
    again = (slot[order[1:]] == slot[order[:-1]]) & (by_slot[1:] == by_slot[:-1])
    cached = np.zeros(len(px), bool)
    cached[order[1:][again]] = True
    green, red, blue, alpha = group.literals
    # the codes of a pixel follow each other in one number of 60 bits at most
    g = px >> np.uint32(8) & np.uint32(255)
    g[cached] = slot[cached] + np.uint32(LITERALS + LENGTHS)
    word, size = green[0][g], green[1][g]
    plain = np.flatnonzero(~cached)
    for (bits, lengths), shift in ((red, 16), (blue, 0), (alpha, 24)):
        v = px[plain] >> np.uint32(shift) & np.uint32(255)
        word[plain] |= bits[v] << size[plain]
        size[plain] += lengths[v]
    copies = _repeats(px)
    if copies:
        free = np.ones(len(px), bool)
        near = _near(width)
        (gb, gn), (db, dn) = group.codes[0].written, group.codes[4].written
        for c, n, back in copies:
            free[c + 1 : c + n] = False
            s, extra, m = _prefix(n)
            d, more, k = _prefix(near.get(back, back + len(NEAR)))
            parts = ((int(gb[LITERALS + s]), int(gn[LITERALS + s])), (extra, m), (int(db[d]), int(dn[d])), (more, k))
            value = count = 0
            for v, w in parts:
                value |= v << count
                count += w
            word[c], size[c] = value, count
        word, size = word[free], size[free]
    ends = np.cumsum(size, dtype=np.int64) + at
    starts = ends - size.astype(np.int64)
    out = np.zeros((int(ends[-1]) >> 6) + 2, "<u8")
    whole, inside = starts >> 6, (starts & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(whole, prepend=-1))
    out[whole[first]] = np.bitwise_or.reduceat(word << inside, first)
    # only the last pixel that begins in a word reaches into the next
    last = np.append(first[1:], len(whole)) - 1
    out[whole[last] + 1] |= (word[last] >> np.uint64(1)) >> (np.uint64(63) - inside[last])
    begun = np.frombuffer(head.to_bytes((at >> 6) * 8 + 8, "little"), "<u8")
    out[: len(begun)] |= begun
    return out.tobytes()[: int(ends[-1]) + 7 >> 3]


def _differences(x: np.ndarray, mode: int) -> np.ndarray:
    """The predictor transform in one of the modes BY_ROWS."""
    out = x.copy()
    out[0, 0] -= np.array([255, 0, 0, 0], np.uint8)
    out[0, 1:] -= x[0, :-1]
    out[1:, 0] -= x[:-1, 0]
    out[1:, 1:] = _inner_differences(x, mode)
    return out


def _inner_differences(x: np.ndarray, mode: int) -> np.ndarray:
    """The predictor transform but for the first row and column."""
    return x[1:, 1:] - (x[1:, :-1] if mode == 1 else _row_prediction(mode, x[:-1], x[1:, 0]))


def _cross_factors(x: np.ndarray) -> tuple[int, int, int]:
    """Least-squares factors of red to blue, green to blue and green to red, in thirty-seconds."""
    v = x.view(np.int8).astype(float)
    green, red, blue = v[..., 2].ravel(), v[..., 1].ravel(), v[..., 3].ravel()
    power = max(1.0, float(green @ green))
    clip = lambda f: int(np.clip(np.rint(32 * f), -128, 127))
    to_red, to_blue = clip(green @ red / power), clip(green @ blue / power)
    rest = blue - to_blue * green / 32
    return clip(red @ rest / max(1.0, float(red @ red))), to_blue, to_red


def encode_stored(x: np.ndarray) -> bytes:
    """A lossless file of the pixels, with the transforms, cache hits, back-references and codes that suit them.

    Up to 16 colours become a palette. Else the cheapest, counted as literals, of the pixels themselves in the codes of
    text, and of the predictor transform in each mode BY_ROWS in the codes of differences, then with cross-colour or
    subtract-green if these make it cheaper still.
    """
    height, width = x.shape[:2]
    text, small = groups()
    w = _start(width, height)
    x = np.ascontiguousarray(x)
    px = x.reshape(-1, 4).view(">u4").ravel().astype(np.uint32)
    side = 9
    sub = lambda pixel: np.broadcast_to(np.array(pixel, np.uint8), ((height + 511) >> side, (width + 511) >> side, 4))
    chosen = text
    colours = np.unique(px[:64])
    if len(colours) <= 16 and len(colours := np.unique(px)) <= 16:
        table = colours.astype(">u4").view(np.uint8).reshape(-1, 4)
        w.bits(1 | PALETTE << 1, 3)
        w.bits(len(colours) - 1, 8)
        _write_pixels(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)[None], False)
        bits = _packing(len(colours))
        per, count = 8 >> bits, 1 << bits
        index = np.searchsorted(colours, px).reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % count))).reshape(height, -1, count)
        x = np.zeros((height, index.shape[1], 4), np.uint8)
        x[..., 0] = 255
        x[..., 2] = (index << np.arange(count) * per).sum(axis=2)
        chosen = small
    else:
        cost = text.bits_for(x)
        # the first row and column are the same in all modes
        edge = small.bits_for(_differences(x[:1], 1)) + small.bits_for(x[1:, 0] - x[:-1, 0])
        best, mode = min((small.bits_for(_inner_differences(x, mode)), mode) for mode in BY_ROWS)
        if edge + best < cost:
            x = _differences(x, mode)
            chosen = small
            w.bits(1 | PREDICTOR << 1, 3)
            w.bits(side - 2, 3)
            _write_pixels(w, sub((255, 0, mode, 0)), False)
            factors = _cross_factors(x)
            crossed = _cross_colour(x, np.array([[[255, *(f & 255 for f in factors)]]], np.uint8), 14, -1)
            greened = _add_green(x, -1)
            costs = [small.bits_for(y) for y in (x, crossed, greened)]
            if costs[1] < min(costs[0], costs[2] + 1):
                w.bits(1 | CROSS << 1, 3)
                w.bits(side - 2, 3)
                _write_pixels(w, sub((255, *(f & 255 for f in factors))), False)
                x = crossed
            elif costs[2] < costs[0]:
                w.bits(1 | GREEN << 1, 3)
                x = greened
    w.bits(0, 1)
    w.bits(chosen.head, chosen.bits)
    px = np.ascontiguousarray(x).reshape(-1, 4).view(">u4").ravel().astype(np.uint32)
    return _file(_stream(px, x.shape[1], chosen, w.value, w.n))
