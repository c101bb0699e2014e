"""The licence scan against a plain cosine on one machine, and its odd rows."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from sunstack.llm import licenses

WORD = re.compile("[a-z0-9]+")


def plain_scan(texts: list[str], threshold: float = licenses.THRESHOLD) -> list[tuple[str | None, float]]:
    """Best licence and cosine of every text of lines, with no bound and no join."""
    bags = [set(WORD.findall(t.lower())) for t in texts]
    idf = lambda t: math.log((1 + len(texts)) / (1 + sum(t in b for b in bags))) + 1
    known = {t: idf(t) for _, own in licenses.book() for t in own}
    rows = licenses.weigh(licenses.book(), known, threshold)
    out = []
    for text in texts:
        best: tuple[float, str] | None = None
        for line in text.split("\n"):
            words = WORD.findall(line.lower())
            for row in rows:
                tf = {t["term"]: t["tf"] for t in row["terms"]}
                at = {t["term"]: t["at"] for t in row["terms"]}
                norm = math.sqrt(sum((n * known[t]) ** 2 for t, n in tf.items()))
                for i, w in enumerate(words):
                    for p in at.get(w, []):
                        for start, width in ((i - p, row["length"]), (i - 2 * p, 2 * row["length"])):
                            inside = words[max(0, start) : start + width]
                            own = {t: inside.count(t) for t in inside if t in tf}
                            if len(own) < licenses.LEAST_TERMS or not set(row["need"]) <= own.keys():
                                continue
                            others = len(inside) - sum(own.values())
                            dot = sum(n * tf[t] * known[t] ** 2 for t, n in own.items())
                            score = dot / (norm * math.sqrt(sum((n * known[t]) ** 2 for t, n in own.items()) + others * licenses.OTHER**2))
                            if score >= threshold * (1 - 1e-9) and (best is None or (-score, row["license"]) < (-best[0], best[1])):
                                best = (score, row["license"])
        out.append((best[1], best[0]) if best else (None, 0.0))
    return out


def texts() -> list[str]:
    rng = random.Random(4)
    sentences = [(name, s) for name, all_ in licenses.TEMPLATES.items() for s in all_]
    common = "the of and to this work is under a license software public version free source use with or in terms 2 3 4".split()
    out = []
    for name, s in sentences:
        words = s.split()
        for _ in range(2):
            w = list(words)
            for _ in range(rng.randrange(1 + len(w) // 4)):
                w[rng.randrange(len(w))] = rng.choice([f"x{rng.randrange(99)}", *common])
            w[rng.randrange(len(w)) : 0] = rng.choices(common, k=rng.randrange(4))
            out.append(" ".join(rng.choices(common, k=rng.randrange(6))) + " " + " ".join(w) + " " + " ".join(rng.choices(common, k=rng.randrange(12))))
    out += [" ".join(rng.choices(common, k=40)) + "\n" + " ".join(rng.choices(common, k=5)) for _ in range(40)] + ["", "\n\n"]
    return out


def test_scan_is_the_plain_cosine(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["license"], r["score"]) for r in licenses.scan(df, "doc_id", F.lit(None).cast("string"), F.col("text")).collect()}
    want = plain_scan(rows)
    for i, (name, score) in enumerate(want):
        assert got[i][0] == name, (rows[i], got[i], want[i])
        assert name is None or math.isclose(got[i][1], score, abs_tol=1e-4)
    assert sum(name is not None for name, _ in want) > len(rows) // 2


def test_every_template_is_its_own_licence(spark):
    rows = [(name, s) for name, all_ in licenses.TEMPLATES.items() for s in all_]
    assert len(licenses.TEMPLATES) >= 30
    filler = [(-i, f"plain words number {i} of the work") for i in range(1, 300)]
    df = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)] + filler, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["license"], r["score"]) for r in licenses.scan(df, "doc_id", F.lit(None).cast("string"), F.col("text")).collect()}
    for i, (name, s) in enumerate(rows):
        assert got[i] == (name, 1.0), (s, got[i])
    assert all(got[d] == (None, None) for d, _ in filler)


def test_rows_of_one_id_and_path_are_judged_apart(spark):
    mit = "<p>Released under the MIT License.</p>"
    rows = [(1, "https://a.example/x", mit), (1, "https://a.example/x", "<p>nothing</p>"), (1, "https://a.example/x", mit), (None, None, mit), (None, None, None),
            (2, "https://b.example/x", "/*\n * Licensed under the Apache\n * License, Version 2.0\n */"), (3, "https://b.example/y", "word " * 200_000 + "Released under the MIT License.")]
    clashing = "page_id bigint, url string, html string, row int, text string, path string, license string, present int, salt int, sentence int"
    df = spark.createDataFrame([(*r, 1, "x", "y", "z", 2, 3, 4) for r in rows], clashing)
    got = sorted(((r["doc_id"], r["license"], r["origin"]) for r in licenses.scan_pages(df).collect()), key=str)
    want = [(1, "MIT", "own"), (1, None, "none"), (1, "MIT", "own"), (None, "MIT", "own"), (None, None, "none"), (2, "Apache-2.0", "own"), (3, "MIT", "own")]
    assert got == sorted(want, key=str)
