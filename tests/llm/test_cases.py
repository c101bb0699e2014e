"""Null, repeated and equal rows in the operators whose other tests have none."""

from __future__ import annotations

import hashlib
import random
import zlib

from sunstack.llm import chat, packing, quality, queries, sharding


def test_quality_rows_of_one_id_are_judged_apart(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    rows = [(1, text), (1, "short"), (1, text), (None, text), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, 0, 1, "k") for d, t in rows], "doc_id bigint, text string, kept int, llr int, bucket string")
    docs = docs.unionAll(spark.createDataFrame([(100 + i, text, 0, 1, "k") for i in range(20)], docs.schema))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0)] + [(100 + i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for how in ({}, quality.PRODUCTION):
        got = sorted(((r["doc_id"], r["n_words"], r["kept"]) for r in quality.quality_rules(docs, labels, **how).where("doc_id < 100 OR doc_id IS NULL").collect()), key=str)
        assert got == sorted([(1, 60, True), (1, 1, False), (1, 60, True), (None, 60, True), (None, 0, False), (None, 0, False)], key=str)
    weight = quality.weights(docs, quality.trusted_ids(labels, "doc_id", labels["quality"] == 1))
    kept = quality.kept_rows(docs, weight)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("length(text) > 9").collect()))


def test_chats_with_repeated_rows_and_equal_turns(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    talks = {1: [(0, "user", "a"), (0, "user", "a"), (1, "assistant", "b"), (1, "assistant", "b"), (1, "assistant", None)], 2: [(None, "user", "x"), (5, "assistant", "y"), (5, "system", "z")], None: [(0, "assistant", "p"), (1, "assistant", "")]}
    rows = [(c, *t) for c, turns in talks.items() for t in turns]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3), path).collect()}
    for conv, turns in talks.items():
        # Rows of one turn stand in order of role and text; a null turn comes first.
        plain = sorted(((-1 if t is None else t, r or "", x or "") for t, r, x in turns))
        loss = "".join(x for _, r, x in plain if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(plain), len(loss))
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in plain).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_slots_of_null_and_repeated_keys(spark):
    rows = [(None, None)] * 3 + [(None, "a")] * 2 + [(5, "a"), (5, "a"), (5, None)] + [(i, "t") for i in range(40)]
    got = sharding.shard(spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id bigint, text string, shard int, slot string"), [1.0] * 3).collect()
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1 == len({r["shard"] for r in got if r["doc_id"] == 5})
    assert sorted(r["text_crc32"] for r in got if r["doc_id"] is None) == [0, 0, 0, zlib.crc32(b"a"), zlib.crc32(b"a")]


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, None), (None, "some words"), (7, "more words here"), (7, "more words here"), (7, "other"), (8, "word " * 5000)]
    docs = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id bigint, text string, piece int, offset string")
    got = packing.best_fit_packing(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    assert len([r for r in got if r["doc_id"] is None]) == 2 and len([r for r in got if r["doc_id"] == 7]) == 3
    assert [r["length"] for r in sorted((r for r in got if r["doc_id"] == 8), key=lambda r: r["piece"])] == [2048, 2048, 905]
    taken: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in taken.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
