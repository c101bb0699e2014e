"""FITS: header units of 80-character cards, image and table units, Rice tiles of 16-bit images."""

from __future__ import annotations

import math
import re

import numpy as np

from .bits import rice_decode, rice_encode

# Fixed values of the format.
BLOCK, CARD = 2880, 80
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
UNSIGNED = {16: 32768, 32: 2147483648, 64: 9223372036854775808}


def value_of(text: str) -> bool | int | float | str:
    """Typed value of a card's text."""
    t = text.strip()
    if t.startswith("'"):
        return t[1:-1].replace("''", "'").rstrip()
    if t in ("T", "F"):
        return t == "T"
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    try:
        return float(t.replace("D", "E"))
    except ValueError:
        return t


def split_card(card: str) -> tuple[str, str, str]:
    key, rest = card[:8].strip(), card[10:] if card[8:10] == "= " else card[8:]
    if card[8:10] != "= " and key != "CONTINUE":
        return key, rest.strip(), ""
    m = re.match(r"\s*('(?:[^']|'')*'|[^/]*)\s*(?:/\s?(.*))?$", rest.rstrip())
    return (key, m[1].strip(), (m[2] or "").strip()) if m else (key, rest.strip(), "")


def value_text(v: bool | int | float | str) -> str:
    if isinstance(v, bool):
        return f"{'T' if v else 'F':>20}"
    if isinstance(v, int):
        return f"{v:>20}"
    if isinstance(v, float):
        text = repr(v).upper()
        return f"{text if '.' in text or 'E' in text else text + '.0':>20}"
    return "'" + f"{v.replace(chr(39), chr(39) * 2):<8}" + "'"


def make_cards(key: str, v: bool | int | float | str, comment: str = "", long: bool = True) -> list[str]:
    """A card, or with CONTINUE several for a long string; keys of other characters than A-Z, 0-9, - and _ are an error."""
    name = key[:8].upper()
    if not key.isascii() or not re.fullmatch(r"[A-Z0-9_-]+", name):
        raise ValueError(f"bad card key {key!r}")
    text = value_text(v)
    if len(text) > CARD - 10 and isinstance(v, str):
        if not long:
            raise ValueError("value is too long for a card")
        inner, parts = text[1:-1].rstrip(), []
        while inner:
            n = 67 if not inner[:67].endswith("'") or inner[:67].count("'") % 2 == 0 else 66
            parts.append(inner[:n])
            inner = inner[n:]
        return [f"{name:<8}= '{p}{'&' if i < len(parts) - 1 else ''}'"[:CARD].ljust(CARD) if i == 0 else f"CONTINUE  '{p}{'&' if i < len(parts) - 1 else ''}'"[:CARD].ljust(CARD) for i, p in enumerate(parts)]
    return [f"{name:<8}= {text}{' / ' + comment if comment else ''}"[:CARD].ljust(CARD)]


def merged(cards: list[str]) -> dict[str, bool | int | float | str]:
    """First value of every key, long strings put together."""
    out: dict = {}
    last = None
    for card in cards:
        key, text, _ = split_card(card)
        if key == "CONTINUE" and last is not None and isinstance(out[last], str) and out[last].endswith("&"):
            out[last] = out[last][:-1] + str(value_of(text))
        elif card[8:10] == "= " and key not in out:
            out[key], last = value_of(text), key
    return out


def units(data: bytes) -> list[tuple[list[str], bytes]]:
    """Cards and data of every header unit."""
    out, at = [], 0
    while at + BLOCK <= len(data):
        cards, done = [], False
        while not done and at + BLOCK <= len(data):
            block = data[at : at + BLOCK].decode("latin-1")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD]
                if card.startswith("END") and not card[3:].strip():
                    done = True
                    break
                if card.strip():
                    cards.append(card)
        if not done:
            raise ValueError("FITS header without END")
        h = merged(cards)
        dims = [int(h.get(f"NAXIS{i + 1}", 0)) for i in range(int(h.get("NAXIS", 0)))]
        size = abs(int(h.get("BITPIX", 8))) // 8 * int(h.get("GCOUNT", 1)) * (int(h.get("PCOUNT", 0)) + math.prod(dims)) if dims else 0
        if at + size > len(data):
            raise ValueError("FITS data are cut short")
        out.append((cards, data[at : at + size]))
        at += -(-size // BLOCK) * BLOCK
    if not out:
        raise ValueError("not a FITS file")
    return out


def tables(data: bytes) -> list[dict[str, list]]:
    """Columns of every ASCII table unit, typed by their formats (A text, I integers, others numbers)."""
    out = []
    for cards, body in units(data):
        h = merged(cards)
        if h.get("XTENSION") != "TABLE":
            continue
        width, rows = int(h["NAXIS1"]), int(h["NAXIS2"])
        columns: dict[str, list] = {}
        for i in range(1, int(h.get("TFIELDS", 0)) + 1):
            m = re.match(r"([AIFED])(\d+)", str(h[f"TFORM{i}"]))
            start = int(h[f"TBCOL{i}"]) - 1
            texts = [body[r * width + start : r * width + start + int(m[2])].decode("latin-1").rstrip() for r in range(rows)]
            kind = {"A": str, "I": int}.get(m[1], lambda t: float(t.replace("D", "E")))
            columns[str(h.get(f"TTYPE{i}", f"COL{i}"))] = [kind(t) if t.strip() else None for t in texts]
        out.append(columns)
    return out


def encode_table(columns: dict[str, list[str]]) -> bytes:
    """An ASCII table unit of text columns, to follow a primary unit."""
    widths = {k: max([1, *map(len, v)]) for k, v in columns.items()}
    n = len(next(iter(columns.values()), []))
    body = "".join("".join(v[r].ljust(widths[k]) for k, v in columns.items()) for r in range(n)).encode("latin-1")
    head = [make_cards(k, v)[0] for k, v in (("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", sum(widths.values())), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)))]
    at = 1
    for i, (k, w) in enumerate(widths.items(), 1):
        head += [make_cards(f"TTYPE{i}", k)[0], make_cards(f"TBCOL{i}", at)[0], make_cards(f"TFORM{i}", f"A{w}")[0]]
        at += w
    text = "".join([*head, "END".ljust(CARD)])
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("latin-1") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b" ")


def decode(data: bytes) -> tuple[np.ndarray | None, list[str]]:
    """First image (raw, or Rice tiles of the first extension) and the cards of the primary header (those of the tiles beside)."""
    if not data.startswith(b"SIMPLE"):
        raise ValueError("not a FITS file")
    found = units(data)
    for cards, body in found:
        h = merged(cards)
        if h.get("ZIMAGE"):
            return _tiles(h, body), found[0][0] + cards
        dims = [int(h[f"NAXIS{i + 1}"]) for i in range(int(h.get("NAXIS", 0)))]
        if dims and h.get("XTENSION", "IMAGE") == "IMAGE":
            px = np.frombuffer(body, PIXELS[int(h["BITPIX"])], math.prod(dims)).reshape(dims[::-1])
            return _scaled(px.astype(px.dtype.newbyteorder("=")), h), cards
    return None, found[0][0]


def describe(data: bytes) -> tuple[list[int], str | None, list[str]]:
    """Dimensions (slowest first), element type and cards of the first image, from the headers alone."""
    if not data.startswith(b"SIMPLE"):
        raise ValueError("not a FITS file")
    found = units(data)
    for cards, _ in found:
        h = merged(cards)
        z = "Z" if h.get("ZIMAGE") else ""
        dims = [int(h[f"{z}NAXIS{i + 1}"]) for i in range(int(h.get(f"{z}NAXIS", 0)))][::-1]
        if dims and (z or h.get("XTENSION", "IMAGE") == "IMAGE"):
            one = np.zeros(1, PIXELS[int(h[f"{z}BITPIX"])])
            return dims, str(_scaled(one.astype(one.dtype.newbyteorder("=")), h).dtype), found[0][0] + cards if z else cards
    return [], None, found[0][0]


def _scaled(px: np.ndarray, h: dict) -> np.ndarray:
    zero, scale = h.get("BZERO", 0), h.get("BSCALE", 1)
    if scale == 1 and zero == 0:
        return px
    bits = int(h.get("ZBITPIX", h.get("BITPIX")))
    if scale == 1 and UNSIGNED.get(bits) == zero:
        return (px.astype(object) + int(zero)).astype(f"u{bits // 8}") if bits == 64 else (px.astype(np.int64) + int(zero)).astype(f"u{bits // 8}")
    return px * float(scale) + float(zero)


def _tiles(h: dict, body: bytes) -> np.ndarray:
    if h.get("ZCMPTYPE") not in ("RICE_1", "RICE_ONE") or h.get("ZBITPIX") != 16:
        raise ValueError("only 16-bit Rice tiles are supported")
    dims = [int(h[f"ZNAXIS{i + 1}"]) for i in range(int(h["ZNAXIS"]))][::-1]
    rows, width, per = int(h["NAXIS2"]), int(h["NAXIS1"]), int(h.get("ZTILE1", dims[-1]))
    block = next((int(h[f"ZVAL{i}"]) for i in range(1, 9) if h.get(f"ZNAME{i}") == "BLOCKSIZE"), 32)
    heap = int(h.get("THEAP", rows * width))
    index = np.frombuffer(body, ">i4", rows * width // 4).reshape(rows, -1)
    out = [rice_decode(body[heap + o : heap + o + n], per, block) for n, o in index[:, :2].tolist()]
    return _scaled(np.concatenate(out).reshape(dims), h)


def encode(px: np.ndarray | None, cards: list[str] | None = None, rice: bool = False) -> bytes:
    """A primary image, or an empty primary unit and Rice tiles by row; extra cards follow the structural ones."""
    extra = list(cards or [])

    def unit(head: list[str], body: bytes) -> bytes:
        text = "".join([*head, "END".ljust(CARD)])
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("latin-1") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")

    one = lambda k, v: make_cards(k, v)[0]
    if px is None:
        return unit([one("SIMPLE", True), one("BITPIX", 8), one("NAXIS", 0), *extra], b"")
    if px.dtype == np.int8:
        px = px.astype(np.int16)
    unsigned = px.dtype.kind == "u" and px.itemsize > 1
    bits = {"u": 8 * px.itemsize, "i": 8 * px.itemsize, "f": -8 * px.itemsize}[px.dtype.kind]
    stored = (px.astype(np.int64 if px.itemsize < 8 else object) - UNSIGNED[bits]).astype(f"i{px.itemsize}") if unsigned else px
    scale = [one("BZERO", UNSIGNED[bits]), one("BSCALE", 1)] if unsigned else []
    if rice:
        if abs(bits) != 16:
            raise ValueError("Rice tiles need 16-bit pixels")
        rows = stored.reshape(-1, px.shape[-1])
        coded = [rice_encode(r) for r in rows]
        at = np.cumsum([0, *map(len, coded)])
        index = np.array([[len(c), o] for c, o in zip(coded, at[:-1], strict=True)], ">i4").tobytes()
        head = [one("XTENSION", "BINTABLE"), one("BITPIX", 8), one("NAXIS", 2), one("NAXIS1", 8), one("NAXIS2", len(rows)), one("PCOUNT", int(at[-1])), one("GCOUNT", 1), one("TFIELDS", 1),
                one("TTYPE1", "COMPRESSED_DATA"), one("TFORM1", "1PB"), one("ZIMAGE", True), one("ZBITPIX", 16), one("ZNAXIS", px.ndim), *[one(f"ZNAXIS{i + 1}", n) for i, n in enumerate(px.shape[::-1])],
                one("ZTILE1", px.shape[-1]), one("ZCMPTYPE", "RICE_1"), one("ZNAME1", "BLOCKSIZE"), one("ZVAL1", 32), *scale, *extra]
        return unit([one("SIMPLE", True), one("BITPIX", 8), one("NAXIS", 0), one("EXTEND", True)], b"") + unit(head, index + b"".join(coded))
    head = [one("SIMPLE", True), one("BITPIX", bits), one("NAXIS", px.ndim), *[one(f"NAXIS{i + 1}", n) for i, n in enumerate(px.shape[::-1])], *scale, *extra]
    return unit(head, stored.astype(PIXELS[bits]).tobytes())
