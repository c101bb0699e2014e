"""Components against a plain search, on chains, stars, cycles and random edges in any number of tasks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sunstack.llm import components


def plain(edges: list[tuple[int, int]]) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


def cases() -> list[list[tuple[int, int]]]:
    rng = random.Random(5)
    chain = list(range(60))
    rng.shuffle(chain)
    return [
        [], [(1, 1)], list(zip(chain, chain[1:])), [(7, i) for i in range(30)], [(i, (i + 1) % 20) for i in range(20)], [(i, i + 1) for i in range(300)],
        [(rng.randrange(-40, 80), rng.randrange(-40, 80)) for _ in range(60)], [(rng.randrange(500), rng.randrange(500)) for _ in range(300)] * 2,
    ]


def test_local_stars():
    for edges in cases():
        u, v = components.local_stars(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == plain(edges)


@pytest.mark.parametrize("at_once", [1, 7, 1_000_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    for edges in cases()[2:]:
        df = spark.createDataFrame([*edges, (None, 3), (4, None)], "u bigint, v bigint").repartition(5)
        got = [(r["u"], r["v"]) for r in components.components(df).collect()]
        assert len(got) == len(set(got)) and dict(got) == plain(edges)
