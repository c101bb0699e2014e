"""Substring dedup in small parts, with hash collisions, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from sunstack.llm import sketch, substring


def rows() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    passages = [" ".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(n)) for n in (50, 51, 60, 120, 400)] + ["x " * 300]
    blank = lambda: rng.choice([" ", "\n", "\t ", "  "])
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n")]
    for d in range(3, 90):
        body = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(9)}é" for _ in range(rng.randrange(60))) for _ in range(rng.randrange(5))]
        out.append((d, blank().join(w for p in body for w in p.split() for w in (w, blank()[:0] or w)[:1])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("slice_", "held", "width"), [(300, 500, 14), (4 << 20, 24 << 20, 4)])
def test_parts_and_small_tasks(spark, monkeypatch, slice_, held, width):
    monkeypatch.setattr(substring, "SLICE", slice_)
    monkeypatch.setattr(substring, "HELD", held)
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1, b"y", 2) for d, t in data], "doc_id bigint, text string, kept_text string, anchor int, piece binary, row_key int").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.substring_dedup(df, width=width).collect()}
    assert got == brute.op10(data)


def test_equal_hashes_of_unlike_windows_lose_nothing(spark, monkeypatch):
    """With every anchor equal, all windows meet in one group; only equal words count."""
    monkeypatch.setattr(sketch, "anchors", lambda grams, inside, valid: np.zeros(len(valid), np.uint64))
    data = rows()
    found = substring.covered(spark.createDataFrame(
        [(1, d, 0, 0, len(w) - 49, " ".join(w).encode()) for d, t in data if len(w := brute.words(t)) >= 50], substring.RUNS))
    gone: dict[int, set[int]] = {}
    for r in found.collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["pos"], r["pos"] + r["n"] + 49))
    assert {d: len(s) for d, s in gone.items()} == {d: x[1] for d, x in brute.op10(data).items() if x[1]}


def test_parts_of_a_long_text():
    words = [f"w{i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([8]), pa.array(["  ".join(words)])], names=["doc_id", "row_key", "text"])
    seen = []
    for part, base in substring.parts(iter([batch]), 500):
        own = part.column("text")[0].as_py().split()
        assert [w.decode() for w in own] == words[base : base + len(own)]
        seen += range(base, base + len(own) - 49)
    assert seen == list(range(951))
