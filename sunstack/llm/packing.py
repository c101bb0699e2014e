"""Best-fit packing: bounded-space online best-fit over tokenised documents.

Documents are tokenised once, in Arrow batches; only (doc_id, piece, start, length,
checksum) goes on, never the ids. Pieces are then dealt by hash to a number of
packing tasks that grows with the number of pieces. Each task packs its pieces in
order of (doc_id, piece) with at most ``open_bins`` open sequences, found by a
bitset with one bit for each amount of free space: a piece goes to the open
sequence with the least space that holds it, and where none does and all places are
taken, the fullest open sequence closes first. Full sequences close at once.

The tokenizer works on words of the text: its normaliser and splitter never look
across ASCII white space, so the ids of a text are the ids of its words in order.
Ids of the commonest words are kept in a memo of at most ``MEMO`` words; a batch's other words
are encoded by the run, and what a task has used is given back to the machine when it ends.

Cases: a null or empty text is the end id alone; repeated rows are packed as
documents of their own; very long texts are cut into full pieces and a rest; an
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table
from .text import SPACE, Words, release, slices, utf8

CAPACITY, OPEN_BINS, END_ID, MEMO, PIECES_A_TASK = 2048, 512, 0, 500_000, 500_000
MARK, MARK_BYTE, RUN, SLICE = "\x01", b"\x01", 100, 4 << 20
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id bigint, offset bigint"


class Packer:
    """Online best-fit with a fixed number of open bins; ``add`` gives (bin number, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.places = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        self._take(free)
        self.open -= 1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return number

    def add(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.places:
                self._close_fullest()
            free, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free


class WordIds:
    """Token ids of words, with a bounded memo; when it is full, the words met in one batch only are dropped.

    A batch's distinct words are found by Arrow's dictionary encoding, and the new ones are encoded many at a time: joined
    by a control byte that is a token of its own, so one call encodes a run of words and the ids are cut at that token."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.young, self.most = Tokenizer.from_file(path), {}, set(), memo
        self.mark = np.array(self._encode([MARK])[0], np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of every word as little-endian 32-bit bytes."""
        for a in range(0, len(words), RUN):
            part = words[a : a + RUN]
            if len(self.mark) == 1:
                ids = np.array(self._encode([f" {MARK} ".join([w.decode("utf-8", "replace") for w in part])])[0], np.uint32)
                cuts = np.flatnonzero(ids == self.mark[0]).tolist()
                if len(cuts) == len(part) - 1 and not any(MARK_BYTE in w for w in part):
                    raw = ids.tobytes()
                    yield from (raw[4 * i : 4 * j] for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True))
                    continue
            yield from (array("I", ids).tobytes() for ids in self._encode([w.decode("utf-8", "replace") for w in part]))

    def column(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text of a column; null texts have none."""
        memo = self.memo
        found = Words(*utf8(texts))
        lengths = found.ends - found.starts
        ends = np.concatenate(([0], np.cumsum(lengths)))
        own = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(found.buf[~SPACE[found.buf]])]).dictionary_encode()
        words = own.dictionary.to_pylist()
        new = [w for w in words if w not in memo]
        self.young.difference_update(words)
        memo.update(zip(new, self._new(new), strict=True))
        self.young.update(new)
        coded = [memo[w] for w in words]
        flat, size = np.frombuffer(b"".join(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        if len(memo) > self.most:
            for w in self.young:
                del memo[w]
            self.young = set()
            if len(memo) > self.most // 2:
                memo.clear()
        number = own.indices.to_numpy().astype(np.int64)
        n = size[number]
        at = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(at[-1]) + np.repeat((np.cumsum(size) - size)[number] - at[:-1], n)].tobytes()
        cuts = (4 * at[found.first]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of every text of a list."""
        return self.column(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))


@lru_cache(maxsize=1)
def coder_of(path: str) -> WordIds:
    """One coder for each Python worker: the tokenizer and the memo of common words outlive the task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = coder_of(tokenizer), END_ID.to_bytes(4, "little")
        for batch in slices(batches, "text", SLICE):
            out: list[list] = [[], [], [], [], []]
            coded = coder.column(batch.column("text"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Give every piece (a table with doc_id, piece, length) its sequence_id and offset."""
    tasks = max(1, math.ceil(cut.count() / pieces_a_task))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.add(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    dealt = cut.repartition(tasks, F.xxhash64("doc_id", "piece")).sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInArrow(fill, PACKED_SCHEMA)


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(table(pieces(docs, tokenizer, id_col, text_col), "pieces"))
