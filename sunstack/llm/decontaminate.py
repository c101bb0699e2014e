"""Benchmark decontamination: Wu-Manber multi-pattern search for benchmark windows.

Texts are folded to their words (A-Z lower-cased; digits, letters and every byte
from 0x80 up are word bytes) joined by single spaces, with a space at either end.
A pattern is a window of ``WINDOW`` consecutive item words (an item of fewer, but
not none, is one window), with its spaces, so it can only match whole words. The
search looks at the block of ``block`` bytes that ends where the shortest pattern
would end: a shift table tells how far no pattern can end, a shift of 0 selects the
bucket of test strings by that block, and direct comparison confirms each.

Short patterns would make every shift short, so patterns are searched in classes
by length. Pattern blocks of at most ``PATTERNS_AT_ONCE`` windows are broadcast one
after another (a longer item goes in overlapping parts), and each row carries what the blocks
so far have found, so the broadcast and what the driver holds have a fixed bound and no pattern is left out.

Cases: null and empty texts have no words and no hits; items without words match
nothing; items with null id are named "null"; repeated item rows count once and
repeated documents are rows of their own; without items nothing is hit. Only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .scratch import table

WINDOW, PATTERNS_AT_ONCE = 8, 200_000
CLASSES = (24, 12, 0)  # least pattern bytes of each class, the spaces at both ends included
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
FOUND = "doc_id bigint, text string, n_words bigint, spans array<int>, items array<string>"

_FOLD = bytearray(range(256))
for _c in (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)):
    _FOLD[_c] = 0x20
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32
FOLD = bytes(_FOLD)


def fold(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased (A-Z only)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class WuManber:
    """Search for byte strings; ``search`` gives (start, pattern number) of every occurrence."""

    def __init__(self, patterns: list[bytes], block: int | None = None) -> None:
        self.patterns = patterns
        self.least = min(map(len, patterns))
        #: A block long enough that a random one is rarely in a pattern keeps shifts long.
        self.block = min(self.least, block or 6)
        b, m = self.block, self.least
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[int]] = defaultdict(list)
        for number, p in enumerate(patterns):
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket[p[m - b : m]].append(number)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        b, m, far, shift, bucket, patterns = self.block, self.least, self.far, self.shift, self.bucket, self.patterns
        at, last, get = m, len(text), self.shift.get
        while at <= last:
            step = get(text[at - b : at], far)
            if step:
                at += step
                continue
            start = at - m
            for number in bucket[text[at - b : at]]:
                if text.startswith(patterns[number], start):
                    yield start, number
            at += 1


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))}


def searchers(items: list[tuple[str, str | None]], size: int = WINDOW) -> tuple[list[WuManber], list[list[list[str]]]]:
    """Searchers by length class, and the items of every pattern of each."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for w in windows(fold(text), size):
            owners[w].add(item)
    left, out, names = sorted(owners), [], []
    for least in CLASSES:
        own = [p for p in left if len(p) >= least]
        left = [p for p in left if len(p) < least]
        if own:
            out.append(WuManber(own))
            names.append([sorted(owners[p]) for p in own])
    return out, names


def hits(text: str | None, found: tuple[list[WuManber], list[list[list[str]]]]) -> tuple[int, list[int], set[str]]:
    """Number of words, the hit word spans as a flat list first, end, first, end ... and the items found."""
    words = fold(text)
    line = b" " + b" ".join(words) + b" " if words else b""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    spaces: list[int] | None = None
    for searcher, names in zip(*found, strict=True):
        for start, number in searcher.search(line):
            if spaces is None:
                spaces = [i for i, c in enumerate(line) if c == 0x20]
            first = bisect_right(spaces, start) - 1
            spans.append((first, first + searcher.patterns[number].count(b" ") - 1))
            items.update(names[number])
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return len(words), flat, items


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = PATTERNS_AT_ONCE) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most about ``most`` windows (a window has at most one for each word, so words bound them)."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in rows.where(F.col("t").isNotNull()).toLocalIterator():  # one partition in the driver at a time
        words = fold(row["t"])
        for at in range(0, max(1, len(words) - WINDOW + 1), most):
            part = words[at : at + most + WINDOW - 1]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((row["i"], b" ".join(part).decode("utf-8", "replace")))
            size += len(part)
    if block:
        yield block


def _scan(rows: DataFrame, block: list[tuple[str, str | None]], out: Callable[[pa.RecordBatch, list, list, list], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """Search one block of items in every row of ``FOUND`` (and a column ``whole`` if there is one); out makes a batch of rows, numbers of words, spans and items."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searchers(shared.value)
        for batch in batches:
            own = [hits(t.as_py(), found) for t in batch.column("text")]
            spans = [[*a, *b] for a, (_, b, _) in zip(batch.column("spans").to_pylist(), own, strict=True)]
            items = [sorted({*a, *b}) for a, (_, _, b) in zip(batch.column("items").to_pylist(), own, strict=True)]
            yield out(batch, [n for n, _, _ in own], spans, items)
        T.release()

    return rows.mapInArrow(scan, schema)


def find(rows: DataFrame, block: list[tuple[str, str | None]]) -> DataFrame:
    """Rows with what one block of items adds."""

    def out(batch: pa.RecordBatch, n_words: list[int], spans: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
        new = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
        return pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return _scan(rows, block, out, rows.schema)


def _merged(spans: list[int]) -> int:
    total, end = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs, and its whole row as a struct if asked for."""
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("whole")] * whole
    none = lambda kind: F.array().cast(kind)
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), none("array<int>").alias("spans"), none("array<string>").alias("items"), *own)
    last: list[tuple[str, str | None]] = []
    for block in item_blocks(benchmark):
        if last:
            found = table(find(found, last), "found")
        last = block

    def out(batch: pa.RecordBatch, n_words: list[int], spans: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
        arrays = [
            batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([_merged(s) for s in spans], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([len(x) >= least_items for x in items], pa.bool_()),
        ]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        return pa.RecordBatch.from_arrays([*arrays, *([batch.column("whole")] if whole else [])], names=[*names, *["whole"] * whole])

    # The last block's search makes the result: one Python worker a task.
    return _scan(found, last, out, StructType([*StructType.fromDDL(SCHEMA).fields, *(f for f in found.schema.fields if f.name == "whole")]))
