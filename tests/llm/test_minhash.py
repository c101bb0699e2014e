"""Near duplicates: repeated ids, small sets, large groups in blocks, and recall against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import brute
from sunstack.llm import minhash

SCHEMA = "doc_id bigint, text string, key string, u int, sig string, fa int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA).repartition(3)


def test_a_repeated_id_is_one_vertex(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(2, a), (3, b), (5, a), (5, b), (5, ""), (5, None), (7, None), (8, c), (None, c), (None, c), (9, c + " one more"), (11, "x y z"), (11, "x y z")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = [(2, 28, 2, True), (3, 28, 2, False), (5, 28, 2, False), (5, 28, 2, False), (5, 0, 2, False), (5, 0, 2, False), (7, 0, 7, True), (8, 28, None, False),
            (None, 28, None, True), (None, 28, None, True), (9, 30, None, False), (11, 1, 11, True), (11, 1, 11, True)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want, key=str)]
    assert {x[:3]: x[3] for x in got if x[0] is not None} == {x[:3]: x[3] for x in want if x[0] is not None}


def near_rows(rng: random.Random, sizes, families: int, members: int) -> list[tuple[int, str]]:
    out = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(rng.choice(sizes))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**9)}"]
            out.append((len(out) * 7 % 100_003, " ".join(w)))
    return out


@pytest.mark.parametrize("sizes", [(8, 9, 12, 20), (30, 60), (200, 700)])
def test_recall_against_all_pairs(spark, sizes):
    """The ids of every component are those that all pairs of full sets give, also for sets much smaller than the bins."""
    rows = near_rows(random.Random(sum(sizes)), sizes, 40, 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.op8(rows)


@pytest.mark.parametrize(("block", "shingles"), [(5, 2_000_000), (1000, 40)])
def test_large_groups_in_blocks(spark, monkeypatch, block, shingles):
    """A chain whose ends are far from the centre: what the centre doesn't reach meets all blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        if i % 3 == 0:
            base = [*base[2:], f"x{i}", f"y{i}"]
        rows.append((rng.randrange(10**6), " ".join(base)))
    rows = list({d: (d, t) for d, t in rows}.values())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.op8(rows)


def test_agreement_asked_for_falls_with_the_set():
    least = minhash.least_agreeing(85, np.array([1, 6, 20, 100, 1000, 100_000]))
    assert (np.diff(least) >= 0).all() and least[0] == 0 and least[-1] > 75
