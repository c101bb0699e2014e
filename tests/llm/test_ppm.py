"""PPM scores against a plain byte-by-byte model, by both ways of looking runs up, and odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

import brute
from sunstack.llm import ppm

SYMBOLS, END = range(256), 0xFF


class PlainPPM:
    """Counts by context in dictionaries; one symbol at a time, escape C, exclusion, every context of up to ``depth`` bytes."""

    def __init__(self, depth: int) -> None:
        self.depth, self.seen = depth, defaultdict(Counter)

    def symbols(self, text: str | None):
        raw = brute.lower(text or "").encode()
        line = bytes([END] * self.depth) + raw + bytes([END])
        return ((line[i - self.depth : i], line[i]) for i in range(self.depth, len(line)))

    def train(self, text: str | None) -> None:
        for context, symbol in self.symbols(text):
            for k in range(self.depth + 1):
                self.seen[context[self.depth - k :]][symbol] += 1

    def probability(self, context: bytes, symbol: int) -> float:
        p, out = 1.0, set()
        for k in range(self.depth, -1, -1):
            own = self.seen.get(context[self.depth - k :])
            if not own:
                continue
            # Method C: the escape counts as many times as there are symbols; symbols of longer contexts don't come up again.
            counts = {s: n for s, n in own.items() if s not in out}
            escape = 0 if len(own) == 256 else len(counts)
            total = sum(counts.values()) + escape
            if symbol in counts:
                return p * counts[symbol] / total
            if total:
                p *= escape / total
            out |= own.keys()
        return p / (256 - len(out))

    def score(self, text: str | None) -> float:
        return sum(math.log10(self.probability(c, s)) for c, s in self.symbols(text))


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(2)
    letters = "ab cd\0éA"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(40)]
    return rows + [(40, None), (41, ""), (None, "ab ab"), (3, "repeated id"), (3, "repeated id"), (42, "\0"), (43, "\0\0 b"), (44, "ab" * 2000), (None, None)]


@pytest.mark.parametrize("shared", [ppm.SHARED, 0])
def test_scores_are_those_of_the_plain_model(spark, shared):
    rows = corpus()
    plain = PlainPPM(ppm.DEPTH)
    for d, t in rows:
        if not ppm.held_out(d):
            plain.train(t)
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id bigint, text string, block string, code int, ids string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in ppm.score(df, shared=shared).collect()), key=lambda r: (*r[:3], -r[3]))
    want = sorted(((d is None, d or 0, len(brute.words(brute.lower(t or ""))) + 1, plain.score(t)) for d, t in rows), key=lambda r: (*r[:3], -r[3]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-5), (g, w)


def test_an_end_is_not_a_zero_byte():
    import pyarrow as pa

    buf, offs = ppm.texts_of(pa.array(["\0", None]))
    assert buf.tolist() == [0, ppm.MARK, ppm.MARK] and offs.tolist() == [0, 2, 3]
