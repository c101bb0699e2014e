"""Count-min prefilter over content-defined anchors.

An anchor of a window is the smallest hash among the shorter runs ("grams") inside
it, so equal windows have equal anchors and consecutive windows mostly share one.
Every task adds its anchors to a count-min sketch of ``depth`` rows and 2**``width``
cells and sends the cells that it touched; the sketches are merged cell by cell, and
what is kept is one bit for each cell: counted at least twice. A window all of whose
cells have the bit is estimated repeated. Counts only overestimate, so no repeated
window is lost whatever the load; a full sketch merely lets more windows through.

The merged bits have a fixed size, depth * 2**width / 8 bytes, and are all that is
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import text as T

WIDTH, DEPTH, CHUNK = 26, 3, 20
CELLS = "chunk int, once binary, more binary"  # cells of a chunk touched once, more often
BITS = "chunk int, bits binary"


def anchors(grams: np.ndarray, inside: int, valid: np.ndarray) -> np.ndarray:
    """The anchor of every window of ``inside`` consecutive grams; valid marks windows within one document."""
    return T.sliding_min(grams, inside)[: len(valid)]


def distinct_runs(anchor: np.ndarray, valid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One entry for each run of equal anchors in a document."""
    a, d = anchor[valid], doc[valid]
    if not len(a):
        return a
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return a[new]


def cells(anchor: np.ndarray, width: int, depth: int) -> Iterator[np.ndarray]:
    """Cell of each anchor in every row of the sketch."""
    for r in range(depth):
        yield (T.mix(anchor, 11 + r) >> T.U64(64 - width)).astype(np.int64)


def _pack(cell: np.ndarray, chunk: int) -> bytes:
    """Sorted cells of a chunk as 16-bit rests after the number of cells of each 2**16."""
    counts = np.diff(np.searchsorted(cell >> 16, np.arange((1 << max(0, chunk - 16)) + 1)))
    return counts.astype(np.uint32).tobytes() + (cell & 0xFFFF).astype(np.uint16).tobytes()


def _unpack(packed: bytes, chunk: int) -> np.ndarray:
    n = 1 << max(0, chunk - 16)
    counts = np.frombuffer(packed, np.uint32, n)
    return (np.repeat(np.arange(n), counts) << 16) | np.frombuffer(packed, np.uint16, offset=4 * n).astype(np.int64)


def build(rows: DataFrame, of_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """Merged sketch of the anchors that ``of_batches`` finds in the batches of a task of rows: rows (chunk, bits)."""
    chunk = min(CHUNK, width)
    per_row = 1 << (width - chunk)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(of_batches(batches))
        every = np.concatenate(found) if found else np.zeros(0, T.U64)
        for r, own in enumerate(cells(every, width, depth)):
            cell, n = np.unique(own, return_counts=True)
            cuts = np.searchsorted(cell, np.arange(per_row + 1) << chunk)
            for k in range(per_row):
                c, m = cell[cuts[k] : cuts[k + 1]] & ((1 << chunk) - 1), n[cuts[k] : cuts[k + 1]]
                if len(c):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r * per_row + k], pa.int32()), pa.array([_pack(c[m == 1], chunk)], pa.binary()), pa.array([_pack(c[m > 1], chunk)], pa.binary())],
                        names=["chunk", "once", "more"],
                    )
        T.release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for k, once, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if now is not None:
                        yield out()
                    now, seen, twice = k, np.zeros(1 << chunk, bool), np.zeros(1 << chunk, bool)
                one, two = _unpack(once, chunk), _unpack(more, chunk)
                twice[one[seen[one]]] = True
                twice[two] = True
                seen[one] = seen[two] = True
        if now is not None:
            yield out()

    return rows.mapInArrow(partial, CELLS).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, BITS)


def share(sketch: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> Broadcast:
    """The merged bits as a broadcast of depth * 2**width / 8 bytes."""
    size = depth << (width - 3)
    chunk = 1 << (min(CHUNK, width) - 3)
    bits = np.zeros(size, np.uint8)
    for row in sketch.toLocalIterator():
        bits[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["bits"], np.uint8)
    return sketch.sparkSession.sparkContext.broadcast(bits)


def repeated(anchor: np.ndarray, bits: np.ndarray, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """True where every cell of an anchor was counted at least twice."""
    ok = np.ones(len(anchor), bool)
    for r, own in enumerate(cells(anchor, width, depth)):
        at = own + (r << width)
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def repeated_runs(anchor: np.ndarray, bits: np.ndarray, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """``repeated`` for anchors of which many stand side by side: each run is looked up once."""
    head = np.flatnonzero(np.append(np.ones(min(1, len(anchor)), bool), anchor[1:] != anchor[:-1]))
    return np.repeat(repeated(anchor[head], bits, width, depth), np.diff(np.append(head, len(anchor))))
