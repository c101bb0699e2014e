"""Substring dedup: every run of ``SIZE`` words that also starts in an earlier document goes.

1. The count-min prefilter (``sketch``) has two steps. The first counts the anchors of all windows:
   equal windows have equal anchors and an anchor is counted once for each run of windows that
   has it, so its count is that of each of its windows or more. The second counts the windows left,
   so the many windows that only touch a common passage stop here.
2. Windows estimated repeated by both go on as runs of consecutive windows with one anchor, with
   their words. A task sends one of equal runs for the smallest id; the others are covered.
3. Runs are dealt by anchor and read in order of (anchor, id): windows are grouped exactly,
   by their words, and one seen in an earlier document of its group is covered.
4. Covered positions are collected by document, and a last pass cuts the texts.

A passage shared by any number of documents sends at most one run for each task and
spelling, so a common passage doesn't fill one task.

Cases: null and empty texts have no words; texts shorter than a window lose nothing;
rows that repeat an id belong to one document, so they don't remove each other's
words; rows of null id count as before all others; texts of over ``SLICE`` bytes are read in
overlapping parts; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from . import text as T
from .scratch import table

SIZE, GRAM, SLICE, HELD = 50, 12, 2 << 20, 24 << 20
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
RUNS = "anchor bigint, doc_id bigint, row_key bigint, pos int, n int, piece binary"
NULL_ID = -(1 << 63)
_SPACE, _BLANK = re.compile(b" "), re.compile(rb"[ \t-\r]")
_FEW_WORDS = re.compile(rb"(?:[ \t-\r]+[^ \t-\r]+){0,%d}" % (SIZE - 1))


def parts(batches: Iterator[pa.RecordBatch], most: int | None = None, overlap: int = SIZE - 1) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches of whole texts with 0; a longer text comes in parts of about ``most`` bytes and the next ``overlap`` words, with the number of words before."""
    most = most or SLICE
    for batch in T.slices(batches, "text", most):
        if batch.num_rows > 1 or (pc.binary_length(batch.column("text"))[0].as_py() or 0) <= 2 * most:
            yield batch, 0
            continue
        raw, at, base = batch.column("text")[0].as_py().encode("utf-8", "surrogatepass"), 0, 0
        while at < len(raw):
            blank = _BLANK.search(raw, min(at + most, len(raw)))
            end = blank.start() if blank else len(raw)
            tail = _FEW_WORDS.match(raw, end)[0] if overlap == SIZE - 1 else b""
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array([raw[at:end] + tail], pa.large_binary())], names=["doc_id", "row_key", "text"]), base
            base += len(raw[at:end].split())
            at = end


class Windows:
    """Anchors of all windows of a batch of texts, by position of the first word."""

    def __init__(self, batch: pa.RecordBatch, size: int = SIZE, gram: int = GRAM) -> None:
        buf, offs = T.utf8(batch.column("text"))
        self.words = w = T.Words(buf, offs)
        h = w.hashes()
        self.first = w.first
        self.valid = T.window_starts(w.first, size, len(h))
        self.doc = w.doc[: len(self.valid)]
        self.anchor = sketch.anchors(T.window_hashes(h, gram), size - gram + 1, self.valid) if len(self.valid) else h[:0]
        self.hashes = T.window_hashes(h, size)

    def repeated(self, bits: np.ndarray, width: int) -> np.ndarray:
        """Starts of windows whose anchors the first sketch estimates repeated."""
        at = np.flatnonzero(self.valid)
        return at[sketch.repeated_runs(self.anchor[at], bits, width)]

    def pieces(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """Words first to last - 1 of each range, joined by single spaces."""
        w = self.words
        length = w.ends - w.starts + 1
        base = np.cumsum(length) - length
        joined = np.full(int(length.sum()), 0x20, np.uint8)
        # Bytes of words stand one after another with one space after each.
        word = ~T.SPACE[w.buf]
        joined[np.arange(int(word.sum())) + np.repeat(np.arange(len(length)), length - 1)] = w.buf[word]
        data = joined.tobytes()
        return pa.array([data[a:b] for a, b in zip(base[first].tolist(), (base[last - 1] + length[last - 1] - 1).tolist(), strict=True)], pa.binary())


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch, _ in parts(batches):
        w = Windows(batch)
        yield sketch.distinct_runs(w.anchor, w.valid, w.doc)


def candidates(docs: DataFrame, width: int = sketch.WIDTH) -> DataFrame:
    """Runs of windows estimated repeated (anchor and piece set), and runs equal to one of a smaller id in their task (both null)."""
    bits = sketch.share(sketch.build(docs, anchors_of, width), width)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch, _ in parts(batches):
            w = Windows(batch)
            yield w.hashes[w.repeated(bits.value, width)]

    counted = sketch.share(sketch.build(docs, windows_of, width), width)
    names = [x.split()[0] for x in RUNS.split(", ")]

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, doc, key, pos, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:5])
        piece = pa.concat_arrays([x[5] for x in held])
        number = piece.dictionary_encode().indices.to_numpy()  # equal by their bytes
        least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, doc)
        go = doc == least[number]
        for some in (go, ~go):
            k = int(some.sum())
            if k:
                anchors, pieces = (pa.array(anchor[some].view(np.int64)), piece.filter(pa.array(some))) if some is go else (pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()))
                yield pa.RecordBatch.from_arrays([anchors, pa.array(doc[some]), pa.array(key[some]), pa.array(pos[some].astype(np.int32)), pa.array(n[some].astype(np.int32)), pieces], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, base in parts(batches):
            w = Windows(batch)
            at = w.repeated(bits.value, width)
            at = at[sketch.repeated(w.hashes[at], counted.value, width)]
            if not len(at):
                continue
            row, anchor = w.doc[at], w.anchor[at]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
            head = np.flatnonzero(new)
            n, r = np.diff(np.append(head, len(at))), row[head]
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            piece = w.pieces(at[head], at[head] + n - 1 + SIZE)
            held.append((anchor[head], ids[r], keys[r], base + at[head] - w.first[r], n, piece))
            size += piece.nbytes
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        T.release()

    return docs.mapInArrow(run, RUNS)


def covered(found: DataFrame) -> DataFrame:
    """doc_id, row_key, pos, n: runs of windows that also start in a document with a smaller id."""
    local = found.where(F.col("anchor").isNull()).select("doc_id", "row_key", "pos", "n")
    shared = found.where(F.col("anchor").isNotNull())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, whole = None, {}, {}  # words of a window, of a run -> smallest id, within one anchor
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for anchor, doc, key, pos, n, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "row_key", "pos", "n", "piece")), strict=True):
                if anchor != now:
                    now, seen, whole = anchor, {}, {}
                if whole.setdefault(piece, doc) != doc:  # the run itself came before
                    for c, v in zip(out, (doc, key, pos, n), strict=True):
                        c.append(v)
                    continue
                starts = [0, *(m.end() for m in _SPACE.finditer(piece))]
                ends = [*(s - 1 for s in starts[1:]), len(piece)]
                start = None
                for i in range(n):
                    if seen.setdefault(piece[starts[i] : ends[i + SIZE - 1]], doc) != doc:
                        start = i if start is None else start
                    elif start is not None:
                        for c, v in zip(out, (doc, key, pos + start, i - start), strict=True):
                            c.append(v)
                        start = None
                if start is not None:
                    for c, v in zip(out, (doc, key, pos + start, n - start), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "row_key", "pos", "n"])
        T.release()

    dealt = shared.repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return local.unionAll(dealt.mapInArrow(judge, "doc_id bigint, row_key bigint, pos int, n int"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and row_key, which tells rows of one id apart by their text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def left_over(length: int, spans: list[dict] | None, size: int) -> np.ndarray:
    """Which of ``length`` positions no window of ``size`` covers; spans: runs of window starts."""
    gone = np.zeros(length + 1, np.int32)
    for s in spans or ():
        gone[s["pos"]] += 1
        gone[min(s["pos"] + s["n"] - 1 + size, length)] -= 1
    return np.cumsum(gone[:-1]) == 0


def cut_words(text: bytes, spans: list[dict] | None, size: int = SIZE) -> tuple[int, list[bytes]]:
    """Number of words of a text and the words left once the given runs of windows are taken out."""
    words = text.split()
    if not spans:
        return len(words), words
    return len(words), [words[i] for i in np.flatnonzero(left_over(len(words), spans, size))]


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, row_key, text) with the covered runs of each, as a list of (pos, n) or null."""
    spans = found.groupBy(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k")).agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
    return rows.join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("row_key") == F.col("_k")), "left").select("doc_id", "row_key", "text", "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = sketch.WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with_text adds row_key and kept_text (null where nothing went)."""
    rows = keyed(docs, id_col, text_col)
    marked = with_spans(rows, covered(table(candidates(rows, width=width), "windows")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                n, left = cut_words((text.as_py() or "").encode("utf-8", "surrogatepass"), spans)
                kept = b" ".join(left)
                for c, v in zip(out, (n, n - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text and spans else None), strict=True):
                    c.append(v)
            arrays = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, batch.column("row_key"), pa.array(out[3], pa.string())], [*names, "row_key", "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    done = marked.mapInArrow(cut, SCHEMA + ", row_key bigint, kept_text string" * with_text)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
