"""Chat formatting: one rendering, one encoding with offsets, masks by binary search.

A conversation is rendered as, for each turn, MARK role MARK text MARK, where MARK
is the tokenizer's special token. In roles and texts a backslash becomes ``\\\\\\\\``
and the first bar of a MARK inside a text becomes ``\\\\|``, so no text can hold a
mark and unescaping gives back every text. The whole conversation is encoded once
with character offsets; marks are tokens of their own, so turns begin and end on
token borders. A token is under the loss mask if its span meets the span of an
assistant text, found by binary search in the sorted spans.

Rows are dealt by conversation and sorted by turn inside Spark; a task then reads
them in a stream and holds one conversation at a time.

Cases: null text and null role count as empty; rows of a null conv_id form one
conversation; null turns come first, equal turns are ordered by role and text, and
repeated rows stay separate turns; an empty table gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "<|endoftext|>"
LEARNED = "assistant"
SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of every text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{MARK}{escape(role)}{MARK}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, MARK]
        at += len(head) + len(body) + len(MARK)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of ``render``."""
    parts = formatted.split(MARK)
    return [(unescape(parts[i]), unescape(parts[i + 1])) for i in range(1, len(parts) - 1, 3)]


def loss_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token its span's number, or -1: both lists are sorted, so a binary search by end finds the first span that can meet it."""
    wanted = np.array([s for s in spans if s[1] > s[0]], np.int64).reshape(-1, 2)
    if not len(offsets) or not len(wanted):
        return np.full(len(offsets), -1)
    at = np.searchsorted(wanted[:, 1], offsets[:, 0], side="right")
    inside = at < len(wanted)
    meets = inside & (offsets[:, 1] > wanted[np.minimum(at, len(wanted) - 1), 0]) & (offsets[:, 1] > offsets[:, 0])
    return np.where(meets, at, -1)


class Formatter:
    """Encodes whole conversations; offsets keep leading blanks, so spans of tokens tile the text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, formatted: str) -> tuple[list[int], np.ndarray]:
        coded = self.tokenizer.encode(formatted, add_special_tokens=False)
        return coded.ids, np.array(coded.offsets, np.int64).reshape(-1, 2)

    def row(self, conv: int | None, turns: list[tuple[str, str]]) -> tuple:
        formatted, spans = render(turns)
        learned = [s for s, (role, _) in zip(spans, turns, strict=True) if role == LEARNED]
        ids, offsets = self.encode(formatted)
        number = loss_tokens(offsets, learned)
        # Read back from the output alone: formatted text, offsets and mask.
        told = hashlib.sha256()
        for role, text in parse(formatted):
            told.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        taken, hit = [], np.flatnonzero(number >= 0)
        for k in np.unique(number[hit]):
            own = offsets[hit[number[hit] == k]]
            taken.append(unescape(formatted[int(own[0, 0]) : int(own[:, 1].max())]))
        loss = "".join(taken)
        return (conv, len(parse(formatted)), told.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(),
                len(formatted), len(ids), len(hit))


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each conversation: counts and digests read back from its formatted, encoded and masked form."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Formatter(tokenizer)
        stream = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        names, ready = [x.split()[0] for x in SCHEMA.split(", ")], []

        def out() -> pa.RecordBatch:
            kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*ready, strict=True), strict=True)], names=names)

        for conv, turns in groupby(stream, key=lambda r: r[0]):
            ready.append(maker.row(conv, [(role, text) for _, role, text in turns]))
            if len(ready) >= 1000:
                yield out()
                ready = []
        if ready:
            yield out()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def sorted_span_of(spans: list[tuple[int, int]], position: int) -> int:
    """Number of the sorted span that holds a position, or -1."""
    at = bisect_left(spans, position + 1, key=lambda s: s[1])
    return at if at < len(spans) and spans[at][0] <= position else -1
