"""Each stage of the pipeline on its own input, against plain versions; then the whole run."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
import brute
from sunstack.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, kinds: int = 300) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with copies, near copies, a shared passage, a leaked item, junk, short texts, nulls."""
    rng = random.Random(3)
    base, passage, item = words(rng, 200), words(rng, 60), words(rng, 20, 10**6)
    near = base.split()
    near[7] = "other"
    texts = [base, base, " ".join(near), f"{words(rng, 50)} {passage} {words(rng, 50)}", f"{words(rng, 30)} {passage}", f"{words(rng, 40)} {item.upper()} {words(rng, 10)}", None, "", "too short",
             " ".join(f"zz{rng.randrange(10**6)}***" for _ in range(60))]
    texts += [words(rng, 80) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 9), 0) for i in range(len(rows)) if i != 12], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    one = stages["quality_rules"](spark, docs, folder)
    judged = quality.quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(text(one)) == {r["doc_id"] for r in judged.collect() if r["kept"]}
    assert {6, 7, 8, 9}.isdisjoint(text(one)) and len(text(one)) == docs.count() - 4

    two = stages["minhash_near_dedup"](spark, one, folder)
    want = brute.op8(sorted(text(one).items()), 80, 5)
    assert set(text(two)) == {d for d, (_, c) in want.items() if d == c} and {1, 2}.isdisjoint(text(two))

    three = stages["substring_dedup"](spark, two, folder)
    cut = brute.op10(sorted(text(two).items()))
    import hashlib

    for d, t in text(three).items():
        if cut[d][1]:
            assert hashlib.sha256(t.encode()).hexdigest() == cut[d][2]
        else:
            assert t == text(two)[d]
    assert cut[4][1] == 60 and {d for d, t in text(two).items() if cut[d][0] > cut[d][1]} == set(text(three))
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())

    four = stages["benchmark_decontamination"](spark, three, folder)
    hit = brute.op5(sorted(text(three).items()), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert set(text(four)) == {d for d, x in hit.items() if x[1] < 8} and 5 not in text(four)
    assert all(s.columns == docs.columns for s in (one, two, three, four))

    assert {r["doc_id"] for r in stages["best_fit_packing"](spark, four, folder).collect()} == set(text(four))


def test_repeated_rows_leave_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (0, 3)")
    twice = docs.unionAll(docs)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, twice, folder).collect()) == [0, 3]
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), folder).count() == 0


def test_rows_of_one_id_are_judged_apart(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    rows = [(None, a), (None, b), (None, "too short"), (2, a), (3, c), (7, d), (7, c), (7, "too short"), (9, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    found = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    good = [x for x in rows if x[1] != "too short"]
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert found(one) == sorted(good, key=str)
    two = corpus_pipeline.near_dedup_stage(spark, one, str(tmp_path))
    assert found(two) == sorted([(None, a), (None, b), (3, c), (7, d)], key=str) and two.columns == docs.columns
    item = words(rng, 20, 10**6)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(None, a), (None, item), (7, b), (7, item)]], SCHEMA)
    assert found(corpus_pipeline.decontamination_stage(spark, leaked, str(tmp_path))) == sorted([(None, a), (7, b)], key=str)


def test_short_items_are_leaks(spark, tmp_path):
    rows = [(1, "six words of a short item"), (2, "one two three"), (3, "four five six"), (4, " ".join(f"x{i}" for i in range(10)))]
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["a b Six words, of a short ITEM c", "one two three a four five six", "six words of a short", "x0 x1 x2 x3 x4 x5 x6", "a x1 x2 x3 x4 x5 x6 x7 x8 b", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()) == [2, 3, 5]


def test_the_whole_run(spark, tmp_path):
    """run() against a chain of plain versions, with null and repeated ids, clashing columns and awkward texts."""
    import math
    import re
    import zlib

    import numpy as np
    import xxhash
    from tokenizers import Tokenizer

    from sunstack.llm import queries, scratch

    rng = random.Random(12)
    base, passage, item = words(rng, 200), words(rng, 70), words(rng, 20, 10**6)
    near = base.split()
    near[100] = "other"
    rows: list[tuple[int | None, str | None]] = [(None, base), (None, words(rng, 90)), (1, " ".join(near)), (1, words(rng, 60)), (2, f"{words(rng, 40)} {passage}"), (3, f"{passage} {words(rng, 40)}"),
            (4, f"{words(rng, 40)} {item} x"), (5, None), (6, ""), (7, "too short"), (8, " ".join(f"zz{rng.randrange(10**6)}***" for _ in range(60))), (8, base), (9, words(rng, 3000))]
    rows += [(20 + i, words(rng, 60 + i)) for i in range(20)]
    made = "doc_id bigint, text string, kept_text string, _row int, row_key int, component_id int, n_chars bigint"
    spark.createDataFrame([(d, t, "k", i, 1, 2, len(t or "")) for i, (d, t) in enumerate(rows)], made).write.parquet(f"{tmp_path}/documents.parquet")
    trusted = {d for d, _ in rows if d is not None and d != 8}
    spark.createDataFrame([(d, 1, 0) for d in trusted], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Quality.
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long_ = lambda x, seed: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed)
    buckets = quality.PRODUCTION["buckets"]

    def grams(t):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in brute.words(t)]
        return [x % buckets for x in h] + [long_(b, long_(a, 42)) % buckets + buckets for a, b in zip(h, h[1:])]

    smooth = np.repeat([1.0, quality.PAIR_ALPHA], buckets)
    raw, target = smooth.copy(), smooth.copy()
    for d, t in rows:
        for x in grams(t):
            raw[x] += 1
            target[x] += d in trusted
    share = lambda x: np.log(x) - np.repeat(np.log(x.reshape(2, -1).sum(axis=1)), buckets)
    weight = np.round(share(target) - share(raw), quality.PRODUCTION["digits"])

    def good(t):
        w = brute.words(t)
        seen = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {j for i, x in enumerate(seen) if seen.count(x) > 1 for j in range(i, i + 8)} if len(w) < 1000 else set()
        return len(w) >= 20 and 100 * len(many) <= 30 * len(w) and np.mean([weight[x] for x in grams(t)]) >= quality.THRESHOLD

    left = [(d, t) for d, t in rows if good(t)]
    assert (8, base) in left and len(left) == len(rows) - 4 and not any(math.isnan(x) for x in weight)
    # Near duplicates: rows are vertices; the smallest id stays, null first.
    groups = brute.op8(list(enumerate(t for _, t in left)), 80, 5)
    rank = lambda i: (left[i][0] is not None, left[i][0] or 0)
    first = {}
    for i, (_, c) in groups.items():
        first[c] = min(first.get(c, i), i, key=rank)
    left = [left[i] for i in sorted(first.values())]
    assert (None, base) in left and sum(d == 1 for d, _ in left) == 1
    # Substrings: a window's first document is that of the smallest id.
    key = lambda d: -(1 << 63) if d is None else d
    owner: dict[tuple, int] = {}
    for d, t in left:
        w = brute.words(t)
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            owner[x] = min(owner.get(x, key(d)), key(d))
    cut = []
    for d, t in left:
        w = brute.words(t)
        gone = {j for i in range(len(w) - 49) if owner[tuple(w[i : i + 50])] < key(d) for j in range(i, i + 50)}
        if len(gone) < len(w):
            cut.append((d, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    # Leaks.
    hit = brute.op5(list(enumerate(t for _, t in cut)), [(1, item)])
    clean = [x for i, x in enumerate(cut) if not hit[i][1]]
    assert len(clean) == len(cut) - 1

    before = list(scratch._made)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(scratch._made) == len(before) + len(corpus_pipeline.STAGES)
    coder = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = []
    for d, t in clean:
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert re.search("_row", " ".join(spark.read.parquet(f"{tmp_path}/documents.parquet").columns))


def test_an_empty_corpus(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from sunstack.llm import scratch

    class Session:
        class conf:  # noqa: N801
            settings = {"spark.master": "spark://host:7077", "spark.app.id": "a"}

            @classmethod
            def get(cls, key, default=""):
                return cls.settings.get(key, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(Session)
    Session.conf.settings["spark.checkpoint.dir"] = "hdfs://store/x/"
    assert scratch.folder(Session) == "hdfs://store/x"
