"""Bit-level codecs of the image formats: difference slices (least bit first) and Rice blocks (most bit first)."""

from __future__ import annotations

import numpy as np

#: bytes of a value, bits of a long difference, whether runs of one difference are marked
SLICE_KINDS = {0: (2, 17, False), 1: (1, 9, False), 2: (2, 17, True), 3: (1, 9, True), 4: (4, 33, False)}
LONG, LONGEST_RUN, LONGEST_LITERAL = 32, 129, 127


class _Bits:
    """A cursor over bits, least bit of each byte first."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        self.at = 0

    def take(self, n: int, signed: bool = False) -> int:
        v = int.from_bytes(np.packbits(self.bits[self.at : self.at + n], bitorder="little").tobytes(), "little")
        self.at += n
        return v - (1 << n) if signed and v >> (n - 1) else v

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _chain(jump: np.ndarray, count: int) -> np.ndarray:
    """0, jump[0], jump[jump[0]] ...: each round doubles the places known and the length of a jump."""
    places = np.zeros(1, np.int64)
    while len(places) < count:
        places = np.concatenate((places, jump[places]))
        jump = jump[jump]
    return places[:count]


def _differences(bits: np.ndarray, count: int, low_bits: int, long_bits: int) -> tuple[np.ndarray, int]:
    """``count`` differences from the start of bits, and the number of bits that they take."""
    window = min(len(bits), count * (low_bits + 6) + 64)
    while True:
        own = bits[:window]
        place = np.arange(window + 1)
        end = np.full(window + 1, window)  # the set bit at or after each place
        end[:window] = np.minimum.accumulate(np.where(own > 0, place[:window], window)[::-1])[::-1]
        one = end[np.minimum(place + low_bits, window)]
        k = one - place - low_bits + 1
        jump = np.minimum(one + 1 + np.where(k == LONG, long_bits, 0), window)
        starts = _chain(jump, count)
        used = int(one[starts[-1]]) + 1 + (long_bits if k[starts[-1]] == LONG else 0)
        if used <= window and int(one[starts].max(initial=0)) < window:
            break
        if window == len(bits):
            raise ValueError("difference slices are cut short")
        window = min(len(bits), 2 * window)

    def number(at: np.ndarray, n: int) -> np.ndarray:
        return sum((own[at + j].astype(np.int64) << j for j in range(n)), np.zeros(len(at), np.int64))

    k = k[starts]
    out = number(starts, low_bits) + (np.where(k & 1, k // 2, -(k // 2)) << low_bits)
    raw = np.flatnonzero(k == LONG)
    v = number(starts[raw] + low_bits + LONG, long_bits)
    out[raw] = v - ((v >> (long_bits - 1)) << long_bits)
    return out, used


#: bits that are looked at together at least
WINDOW = 1 << 18


def _plain_rows(data: bytes, h: int, w: int, low_bits: int, size: int, long_bits: int) -> np.ndarray:
    """First values and differences of rows without runs: where a difference ends is found for all places of a window at once, rows are walked from place to place."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    out = np.zeros((h, w), np.int64)
    y, base, span, low, far = 0, 0, WINDOW, np.arange(low_bits), np.arange(long_bits)
    while y < h:
        own = bits[base : base + span]
        n = len(own)
        place = np.arange(n + 1)
        end = np.full(n + 1, n)  # the set bit at or after each place
        end[:n] = np.minimum.accumulate(np.where(own > 0, place[:n], n)[::-1])[::-1]
        one = end[np.minimum(place + low_bits, n)]
        count = one - place - low_bits + 1
        jump = np.full(n + 2, n + 1)  # n + 1: beyond the window
        jump[: n + 1] = np.where(one < n, np.minimum(one + 1 + np.where(count == LONG, long_bits, 0), n + 1), n + 1)
        step = memoryview(jump)
        at, first, places, values = 0, y, [], []
        while y < h:
            p, row = at + 8 * size, []
            if p <= n:
                for _ in range(w - 1):
                    row.append(p)
                    p = step[p]
            if p > n:
                break
            a = (base + at) // 8
            values.append(int.from_bytes(data[a : a + size], "little", signed=size > 1))
            places += row
            y, at = y + 1, min(-(-p // 8) * 8, n)
        if y == first:
            if base + n == len(bits):
                raise ValueError("difference slices are cut short")
            span *= 2
            continue
        starts = np.array(places, np.int64)
        k = count[starts]
        d = (own[starts[:, None] + low].astype(np.int64) << low).sum(axis=1) + (np.where(k & 1, k // 2, -(k // 2)) << low_bits)
        raw = np.flatnonzero(k == LONG)
        v = (own[starts[raw][:, None] + low_bits + LONG + far].astype(np.int64) << far).sum(axis=1)
        d[raw] = v - ((v >> (long_bits - 1)) << long_bits)
        out[first:y, 0], out[first:y, 1:] = values, d.reshape(y - first, w - 1)
        base += at
    return out


def slice_decode(data: bytes, h: int, w: int, low_bits: int, kind: int = 0) -> np.ndarray:
    """Rows of differences: a raw first value, then for each pixel ``low_bits`` bits and a unary count k.

    Odd k adds (k div 2) * 2**low_bits, even k takes k/2 of it off, k = 32 announces a raw difference; rows begin on bytes.
    Kinds with runs put a byte before each stretch: n < 128 for n differences, 257 - n for n pixels of one 16-bit difference."""
    size, long_bits, runs = SLICE_KINDS[kind]
    if not runs and w:
        return np.cumsum(_plain_rows(data, h, w, low_bits, size, long_bits), axis=1).astype({1: np.uint8, 2: np.int16, 4: np.int32}[size])
    cursor = _Bits(data)
    out = np.zeros((h, w), np.int64)
    for y in range(h):
        parts, left = [np.array([cursor.take(8 * size, size > 1)])], w - 1
        while left > 0:
            n = left
            if runs:
                code = cursor.take(8)
                if code > LONGEST_LITERAL:
                    parts.append(np.full(257 - code, cursor.take(16, True)))
                    left -= 257 - code
                    continue
                n = code
            d, used = _differences(cursor.bits[cursor.at :], n, low_bits, long_bits) if n else (np.zeros(0, np.int64), 0)
            parts.append(d)
            cursor.at += used
            left -= n
            if runs:
                cursor.align()
        out[y] = np.cumsum(np.concatenate(parts)[:w])
        cursor.align()
    return out.astype({1: np.uint8, 2: np.int16, 4: np.int32}[size])


def _packed_rows(image: np.ndarray, low_bits: int, size: int, long_bits: int) -> bytes:
    """Rows without runs, all at once."""
    d = np.diff(image, axis=1)
    q = d >> low_bits
    k = np.minimum(np.where(q >= 0, 2 * q + 1, -2 * q), LONG)
    n = low_bits + k + np.where(k == LONG, long_bits, 0)
    ends = np.cumsum(n, axis=1) + 8 * size
    total = -(-np.concatenate((np.full((len(image), 1), 8 * size), ends), axis=1)[:, -1] // 8) * 8
    first = np.cumsum(total) - total
    at = ends - n + first[:, None]
    bits = np.zeros(int(total.sum()), np.uint8)
    put = lambda where, values, width: bits.__setitem__(where[:, None] + np.arange(width), (values[:, None] >> np.arange(width)) & 1)
    put(first, image[:, 0], 8 * size)
    bits[at + low_bits + k - 1] = 1
    short = k < LONG
    put(at[short], d[short], low_bits)
    put(at[~short] + low_bits + LONG, d[~short], long_bits)
    return np.packbits(bits, bitorder="little").tobytes()


def slice_encode(image: np.ndarray, low_bits: int, kind: int = 0) -> bytes:
    """The inverse of ``slice_decode``."""
    size, long_bits, runs = SLICE_KINDS[kind]
    if not runs and image.size:
        return _packed_rows(image.astype(np.int64), low_bits, size, long_bits)
    out = bytearray()

    def literal(differences: list[int]) -> bytes:
        d = np.array(differences, np.int64)
        q = d >> low_bits
        k = np.minimum(np.where(q >= 0, 2 * q + 1, -2 * q), LONG)
        raw = np.flatnonzero(k == LONG)
        n = low_bits + k
        n[raw] += long_bits
        at = np.cumsum(n) - n
        bits = np.zeros(int(n.sum()), np.uint8)
        bits[at + low_bits + k - 1] = 1
        short = np.flatnonzero(k < LONG)
        for j in range(low_bits):
            bits[at[short] + j] = (d[short] >> j) & 1
        for j in range(long_bits):
            bits[at[raw] + low_bits + LONG + j] = (d[raw] >> j) & 1
        return np.packbits(bits, bitorder="little").tobytes()

    for row in image.astype(np.int64):
        out += (int(row[0]) & ((1 << 8 * size) - 1)).to_bytes(size, "little")
        d = np.diff(row).tolist()
        i = 0
        while i < len(d):
            n = 1
            while i + n < len(d) and n < LONGEST_RUN and d[i + n] == d[i]:
                n += 1
            if n > 2 and -32768 <= d[i] < 32768:
                out += bytes([257 - n]) + (d[i] & 0xFFFF).to_bytes(2, "little")
            else:
                n = 1
                while i + n < len(d) and n < LONGEST_LITERAL and not (i + n + 2 < len(d) and d[i + n] == d[i + n + 1] == d[i + n + 2]):
                    n += 1
                out += bytes([n]) + literal(d[i : i + n])
            i += n
    return bytes(out)


def rice_decode(data: bytes, count: int, block: int = 32) -> np.ndarray:
    """16-bit Rice blocks: a raw first value, then for each block 4 bits s: 0 for no change, 15 for raw differences, else differences of s - 1 low bits."""
    text = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else ""
    number = lambda a, n: int(text[a : a + n], 2) if n else 0
    value = number(0, 16)
    out, at = np.empty(count, np.int64), 16
    for first in range(0, count, block):
        n = min(block, count - first)
        s = number(at, 4)
        at += 4
        for i in range(n):
            if s == 0:
                d = 0
            elif s == 15:
                d, at = number(at, 16), at + 16
            else:
                one = text.index("1", at)
                high = one - at
                at = one + 1
                d = (high << (s - 1)) | number(at, s - 1)
                at += s - 1
            value += ~(d >> 1) if d & 1 else d >> 1
            out[first + i] = value
    return ((out + 32768) % 65536 - 32768).astype(np.int16)


def rice_encode(values: np.ndarray, block: int = 32) -> bytes:
    """The inverse of ``rice_decode``; each block takes the split that makes it shortest."""
    v = values.astype(np.int64)
    d = np.diff(v, prepend=v[:1])
    d = (d + 32768) % 65536 - 32768
    z = np.where(d < 0, -2 * d - 1, 2 * d)
    parts, splits = [f"{int(v[0]) & 0xFFFF:016b}"] if len(v) else [], np.arange(14)
    for first in range(0, len(v), block):
        own = z[first : first + block]
        if not own.any():
            parts.append("0000")
            continue
        cost = (own[:, None] >> splits).sum(axis=0) + len(own) * (splits + 1)
        s = int(cost.argmin())
        if cost[s] >= 16 * len(own):
            parts.append("1111" + "".join(f"{int(x):016b}" for x in own))
        else:
            parts.append(f"{s + 1:04b}" + "".join("0" * (x >> s) + "1" + (f"{x & ((1 << s) - 1):0{s}b}" if s else "") for x in own.tolist()))
    text = "".join(parts)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
