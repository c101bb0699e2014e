"""ANA images: a 512-byte header (and blocks of text), then raw or difference-sliced pixels."""

from __future__ import annotations

import struct

import numpy as np

from .bits import SLICE_KINDS, slice_decode, slice_encode

# Fixed values of the format.
MAGIC, MAGIC_SWAPPED = 0x5555AAAA, 0xAAAA5555
TYPES = {0: "u1", 1: "i2", 2: "i4", 3: "f4", 4: "f8", 5: "i8", 8: "c16"}
BLOCK, TEXT, COMPRESSED_HEADER = 512, 256, struct.Struct("<iiiBB")


def read_header(data: bytes) -> dict:
    """dims (slowest first), type, byte order, compression, header text and where pixels begin."""
    if len(data) < BLOCK:
        raise ValueError("shorter than an ANA header")
    (magic,) = struct.unpack_from("<I", data)
    if magic not in (MAGIC, MAGIC_SWAPPED):
        raise ValueError("not an ANA file")
    subf, _, blocks, kind, n_dim = data[4], data[5], data[6], data[7], data[8]
    if kind not in TYPES or not 1 <= n_dim <= 16 or not 1 <= blocks <= 16:
        raise ValueError("bad ANA header")
    dims = struct.unpack_from(f"<{n_dim}i", data, 192)
    text = (data[BLOCK - TEXT : BLOCK] + data[BLOCK : blocks * BLOCK]).replace(b"\0", b"").decode("latin-1").rstrip()
    # The magic tells the byte order of the writer; sub-format bit 7 marks swapped pixels in old files.
    return {"dims": tuple(reversed(dims)), "kind": kind, "big": magic == MAGIC_SWAPPED or bool(subf & 128), "compressed": bool(subf & 1), "text": text, "start": blocks * BLOCK}


def describe(data: bytes) -> tuple[list[int], str, str]:
    """Dimensions (slowest first), element type and header text, from the header alone."""
    head = read_header(data)
    kind = TYPES[head["kind"]]
    if head["compressed"]:
        codec = COMPRESSED_HEADER.unpack_from(data, head["start"])[4]
        if codec not in SLICE_KINDS:
            raise ValueError(f"ANA compression {codec} isn't supported")
        kind = {1: "u1", 2: "i2", 4: "i4"}[SLICE_KINDS[codec][0]]
    return list(head["dims"]), str(np.dtype(kind)), head["text"]


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """Pixels (in the machine's byte order) and header."""
    head = read_header(data)
    dims, start = head["dims"], head["start"]
    if head["compressed"]:
        _, rows, width, low_bits, kind = COMPRESSED_HEADER.unpack_from(data, start)
        if kind not in SLICE_KINDS:
            raise ValueError(f"ANA compression {kind} isn't supported")
        px = slice_decode(data[start + COMPRESSED_HEADER.size :], rows, width, low_bits, kind).reshape(dims)
    else:
        kind = np.dtype(TYPES[head["kind"]]).newbyteorder(">" if head["big"] else "<")
        n = int(np.prod(dims))
        if len(data) < start + n * kind.itemsize:
            raise ValueError("ANA pixels are cut short")
        px = np.frombuffer(data, kind, n, start).reshape(dims)
    return px.astype(px.dtype.newbyteorder("=")), head


def encode(px: np.ndarray, text: str = "", low_bits: int | None = None, big: bool = False, runs: bool = False) -> bytes:
    """A file of an array: raw, or difference-sliced with ``low_bits`` for 8, 16 and 32-bit integers (with marked runs for 8 and 16 bits)."""
    kind = next((k for k, t in TYPES.items() if np.dtype(t) == px.dtype.newbyteorder("=")), None)
    if kind is None:
        raise ValueError(f"ANA has no type for {px.dtype}")
    raw = text.encode("latin-1", "replace")
    blocks = 1 + -(-max(0, len(raw) - TEXT + 1) // BLOCK)
    if blocks > 16:
        raise ValueError("header text is too long")
    head = bytearray(blocks * BLOCK)
    struct.pack_into("<I5B", head, 0, MAGIC_SWAPPED if big else MAGIC, (low_bits is not None) | (128 if big else 0), 0, blocks, kind, px.ndim)
    struct.pack_into(f"<{px.ndim}i", head, 192, *reversed(px.shape))
    head[BLOCK - TEXT : BLOCK - TEXT + len(raw)] = raw
    if low_bits is None:
        return bytes(head) + px.astype(px.dtype.newbyteorder(">" if big else "<")).tobytes()
    codec = ({0: 3, 1: 2} if runs else {0: 1, 1: 0, 2: 4}).get(kind)
    if codec is None:
        raise ValueError("only integers of up to 32 bits (16 with runs) can be compressed")
    body = slice_encode(px.reshape(-1, px.shape[-1]), low_bits, codec)
    return bytes(head) + COMPRESSED_HEADER.pack(COMPRESSED_HEADER.size + len(body), px.size // px.shape[-1], px.shape[-1], low_bits, codec) + body
