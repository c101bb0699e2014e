"""Every text operator against a plain version, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from sunstack.llm import chat, decontaminate, licenses, minhash, packing, ppm, quality, queries, sharding, substring, suffix

DOCS = "doc_id bigint, text string, _text string, anchor long, sig string, n_words int"


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, nulls, empties, blanks, long and non-ASCII texts."""
    rng = random.Random(5)
    base, passage = words(rng, 300), words(rng, 70)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n "), (3, base), (4, base), (5, base.upper()), (6, "one"), (7, "one two"), (8, "ONE two")]
    for i in range(20):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((20 - i + 20, " ".join(w)))
    out += [(100 + i, f"{words(rng, 30)}\n{passage} {words(rng, 40 + i)}") for i in range(6)]
    out += [(200, "é̈ \x00\x1f ü " * 60), (201, "ab" * 300), (202, "ab" * 250 + " c"), (203, words(rng, 6000, 30)), (204, "z" * 9000)]
    out += [(300 + i, words(rng, 40, 10**6)) for i in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "clash", 1, "clash", 2) for d, t in corpus()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_substring_dedup(docs, none):
    got = by_id(substring.substring_dedup(docs, width=16), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op10(corpus())
    assert substring.substring_dedup(none, width=16).count() == 0


def test_substring_dedup_with_a_full_sketch_loses_nothing(docs):
    assert by_id(substring.substring_dedup(docs, width=4), "n_words", "n_removed", "kept_sha256") == brute.op10(corpus())


def test_suffix_dedup(docs, none):
    got = by_id(suffix.suffix_dedup(docs, width=16), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op9(corpus())
    assert suffix.suffix_dedup(none, width=16).count() == 0


def test_repeated_and_null_ids_are_one_document(spark):
    rng = random.Random(1)
    text = words(rng, 80)
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (9, text)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or -1), r["n_removed"]) for r in substring.substring_dedup(df, width=12).collect())
    assert got == [(-1, 0), (7, 80), (7, 80), (9, 80)]
    got = sorted(((r["doc_id"] or -1), r["n_removed"] > 0) for r in suffix.suffix_dedup(df, width=12).collect())
    assert got == [(-1, False), (7, True), (7, True), (9, True)]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(150):
        b = bytes(rng.choice(b"\0\1ab") for _ in range(rng.randrange(60)))
        order = suffix.suffix_array(np.frombuffer(b, np.uint8))
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = suffix.common_prefixes(np.frombuffer(b, np.uint8), order)
        for i in range(1, len(b)):
            x, y = b[order[i - 1] :], b[order[i] :]
            k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[i] == k


@pytest.mark.parametrize(("num", "size"), [(85, 3), (80, 5)])
def test_near_duplicates(docs, num, size):
    got = by_id(minhash.near_duplicates(docs, num=num, size=size), "n_shingles", "component_id")
    assert got == brute.op8(corpus(), num, size)


def test_near_duplicates_in_blocks(docs, none, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    assert by_id(minhash.near_duplicates(docs), "n_shingles", "component_id") == brute.op8(corpus())
    assert minhash.near_duplicates(none).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n, same in ((8, 7), (40, 34), (900, 780)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate((a[:same], rng.integers(0, 2**63, n - same, dtype=np.uint64) * np.uint64(2)))
        sets = [np.sort(np.unique(a)), np.sort(np.unique(b))]
        sig = minhash.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        expected = same / (2 * n - same)
        assert abs((sig[0] == sig[1]).mean() - expected) < 0.2


def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    items = [(i, words(rng, 30, 10**6)) for i in range(6)] + [(6, "tiny Item"), (7, None), (8, "..."), (None, "zz yy")]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    own = corpus() + [(400, f"a {items[0][1].upper()}. b"), (401, f"x, {items[1][1]} TINY item! {items[2][1][:80]}"), (402, "tiny items"), (403, "Yy zz yY")]
    texts = spark.createDataFrame(own, "doc_id bigint, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    want = brute.op5(own, named)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.decontaminate(texts, df), *columns) == want
    assert decontaminate.decontaminate(none, df).count() == 0
    assert {x[1] for x in by_id(decontaminate.decontaminate(docs, df.limit(0)), *columns).values()} == {0}


def test_decontamination_by_blocks_of_patterns(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, 20, 10**6)) for i in range(9)]
    own = [(i, f"{items[i][1]} and {items[(i + 3) % 9][1]}") for i in range(9)]
    real = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b: real(b, most=30))
    got = decontaminate.decontaminate(spark.createDataFrame(own, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.op5(own, items)


def test_wu_manber_finds_all_occurrences():
    rng = random.Random(4)
    for _ in range(60):
        text = bytes(rng.choice(b"ab ") for _ in range(200))
        patterns = list({bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 9))) for _ in range(5)})
        found = sorted(decontaminate.WuManber(patterns).search(text))
        assert found == sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    rows = packing.best_fit_packing(docs, path).collect()
    total = 0
    for doc, text in corpus():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            part = ids[r["start"] : r["start"] + 2048]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.best_fit_packing(none, path).count() == 0


def test_packer_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.add(n) for n in (6, 3, 1, 4)] == [(0, 0), (0, 6), (0, 9), (1, 0)]
    assert p.add(7) == (2, 0)
    assert p.add(8) == (3, 0)  # bin 2 with 3 free was the fullest and is closed
    assert p.add(2) == (3, 8)
    assert p.add(6) == (1, 4)


def test_word_ids_equal_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    coder, own = Tokenizer.from_file(path), packing.WordIds(path, memo=50)
    rng = random.Random(8)
    letters = "aAÉé̈ñ'sΣς \n\t  　\x1c\x85<|endoftext|>09ß🙂‍"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>x", " it's"])
        assert own.of([text, ""]) == [np.array(coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]


def test_chat_round_trip(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    mark = chat.MARK
    talks = {
        1: [("user", "hi\\"), ("assistant", f"  {mark} é🙂 \\|\\ "), ("assistant", None), ("user", "<|<\\|"), ("assistant", f"{mark}{mark}")],
        2: [("system", None)],
        3: [(None, "x"), ("assistant", "a" * 3000 + "\n\n ")],
        None: [("assistant", "lone")],
    }
    rows = [(c, i, role, text, "x") for c, turns in talks.items() for i, (role, text) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string"), path).collect()}
    for conv, turns in talks.items():
        plain = [(r or "", t or "") for r, t in turns]
        assert chat.parse(chat.render(plain)[0]) == plain
        loss = "".join(t for r, t in plain if r == "assistant")
        told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), told)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"), path).count() == 0


def test_ppm_distributions_sum_to_one_and_beat_uniform():
    rng = random.Random(6)
    import pyarrow as pa

    texts = pa.array([words(rng, 50, 20) for _ in range(30)] + [None, "", "é\x00"])
    code, n = ppm.gram_counts(*ppm.texts_of(texts))
    short = {}
    for c, k in zip(code & 0xFFFFFF, n):
        short[int(c)] = short.get(int(c), 0) + int(k)
    keep = np.unique(code >> 8)[:40]
    trie = ppm.Trie(np.array(sorted(short)), np.array([short[c] for c in sorted(short)], float), keep, code, n)
    assert np.allclose((10.0 ** trie.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    held = pa.array([words(rng, 50, 20)])
    assert trie.score(*ppm.texts_of(held))[0] > -len(held[0].as_py()) * math.log10(256) / 2
    empty = ppm.Trie(*(np.zeros(0, np.int64) for _ in range(5)))
    assert math.isclose(empty.score(*ppm.texts_of(pa.array(["abc"])))[0], -4 * math.log10(256), rel_tol=1e-6)


def test_ppm_scoring(spark, docs, none):
    from collections import Counter

    rows = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    tokens = {d: [*(w.encode() for w in brute.words(brute.lower(t or ""))), b""] for d, t in corpus()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    seen = Counter(w for d, own in tokens.items() if not out[d] for w in own)
    n, v = sum(seen.values()), len(seen)
    for d, own in tokens.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(own), sum(seen[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert ppm.score(none).count() == 0


def test_ppm_keeps_every_context(spark):
    rng = random.Random(9)
    import pyarrow as pa

    # More than 16,384 contexts of order 3, among them those of one text only and of several bytes.
    texts = ["".join(chr(rng.choice((97, 98, 0xE9, 0x4E00)) + rng.randrange(60)) for _ in range(3000)) for _ in range(30)] + [None, "", "é\x00"]
    buf, offs = ppm.texts_of(pa.array(texts))
    code, n = ppm.gram_counts(buf, offs)
    assert len(np.unique(code >> 8)) > 16_384
    pairs = np.zeros((256, 256))
    np.add.at(pairs.ravel(), code & 0xFFFF, n)
    low, at = np.unique(code & 0xFFFFFF, return_inverse=True)
    trie = ppm.Trie(low, np.bincount(at, weights=n), np.unique(code >> 8), code, n)
    held, held_offs = ppm.texts_of(pa.array(["".join(chr(97 + rng.randrange(90)) for _ in range(200)), "é一" * 50]))
    more = np.setdiff1d(ppm.gram_counts(held, held_offs)[0], code)
    every = np.concatenate((code, more))
    logs = dict(zip(every.tolist(), ppm.log_probabilities(every, np.concatenate((n, np.zeros(len(more), int))), pairs, 3), strict=True))
    for b, o in ((buf, offs), (held, held_offs)):
        own = np.array([logs[g] for g in ppm.grams(b, o, 3).tolist()])
        sums = np.concatenate(([0.0], np.cumsum(own)))
        assert np.allclose(sums[o[1:]] - sums[o[:-1]], trie.score(b, o), rtol=1e-5)

    # The tables give what one call over all training texts gives, at full depth.
    rows = ppm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    out = np.array([ppm.held_out(d) for d in range(len(texts))])
    code = ppm.grams(buf, offs, ppm.DEPTH)
    own, first = np.unique(code, return_inverse=True)
    count = np.bincount(first, weights=np.repeat(~out, np.diff(offs)))
    pairs = np.zeros((256, 256))
    np.add.at(pairs.ravel(), own & 0xFFFF, count)
    sums = np.concatenate(([0.0], np.cumsum(ppm.log_probabilities(own, count, pairs)[first])))
    for r in rows:
        assert math.isclose(r["score"], sums[offs[r["doc_id"] + 1]] - sums[offs[r["doc_id"]]], rel_tol=1e-5)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(d, int(d != 203), 0) for d, _ in corpus() if d % 2] + [(None, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    import xxhash

    trusted = {d for d, _ in corpus() if d % 2 and d != 203}
    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42) % quality.BUCKETS
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for d, t in corpus():
        for w in brute.words(t):
            raw[bucket(w)] += 1
            target[bucket(w)] += d in trusted
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    for d, t in corpus():
        w, t = brute.words(t), t or ""
        lines = [x for x in t.split("\n") if brute.words(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in windows if windows.count(x) > 1} if len(windows) < 2000 else {x for x in set(windows) if windows.count(x) > 1}
        covered = {j for i, x in enumerate(windows) if x in many for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        llr = float(np.mean([weight[bucket(x)] for x in w])) if w else 0.0
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert math.isclose(r["llr"], llr, abs_tol=1e-9)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and llr >= quality.THRESHOLD)
    assert quality.quality_rules(none, labels).count() == 0
    assert {r["llr"] for r in quality.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def test_sharding(spark, docs, none):
    rows = sharding.shard(docs, [1.0] * 24).collect()
    slots: dict = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
        text = dict(corpus())[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    load = {r["shard"]: r["count"] for r in sharding.shard(many, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(load[1] / 20000 - 0.5) < 0.02 and abs(load[0] / 20000 - 0.25) < 0.02
    again = sharding.shard(spark.createDataFrame([(None, None), (None, "a"), (5, "a"), (5, "a")], "doc_id bigint, text string"), [1.0] * 3)
    assert again.count() == 4
    assert sharding.shard(none, [1.0] * 3).count() == 0


def test_licences(spark):
    rows = [
        (1, "https://a.example/docs/", "<p>Released under the MIT License.</p>"),
        (2, "https://a.example/docs/deep/x.html?q=1", "<p>plain words here</p>"),
        (3, "https://a.example/docs/deep/LICENSE.txt", "Licensed under the Apache License,&nbsp;Version 2.0."),
        (4, "https://a.example/docs/deep/er/y#top", "other"),
        (5, "https://a.example/z", "This work is licensed under the GNU General Public License, version 3."),
        (6, "https://b.example/docs/x", None),
        (7, None, "the of and to this work is under"),
        (7, None, "the of and to this work is under"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["directory"]) for r in licenses.scan_pages(df).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "a.example/docs/deep/"), 3: ("Apache-2.0", "own", None),
        4: ("Apache-2.0", "inherited", "a.example/docs/deep/"), 5: ("GPL-3.0", "own", None), 6: (None, "none", None), 7: (None, "none", None),
    }
    assert licenses.scan_pages(df.limit(0)).count() == 0


def test_licences_in_longer_lines(spark):
    rows = [
        ("Released under the MIT License by Jane Doe.", "MIT"), ("Copyright 2020 Acme. Released under the MIT License.", "MIT"),
        ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
        ('Licensed by Acme Ltd. under the <a href="https://x.example/">Apache\nLicense</a>, Version <b>2.0</b>, in 2021, see https://x.example/LICENSE', "Apache-2.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
         "Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
        ("MIT</p><p>License", None), ("You need a license and permission of the owner to sell this work", None),
    ]
    for fillers in (1000, 5000):
        filler = spark.range(fillers).select(F.col("id"), F.lit("https://b.example/x"), F.concat(F.lit("<p>this is the work of and to in "), F.col("id").cast("string")))
        df = filler.unionAll(spark.createDataFrame([(-i, f"https://a{i}.example/x", f"<div><p>{t}</p></div>") for i, (t, _) in enumerate(rows, 1)], "id bigint, url string, html string"))
        got = {r["doc_id"]: (r["license"], r["score"]) for r in licenses.scan_pages(df.toDF("page_id", "url", "html")).where("doc_id < 0 OR license IS NOT NULL").collect()}
        assert {d: x for d, (x, _) in got.items()} == {-i: x for i, (_, x) in enumerate(rows, 1)}, got


def test_quality_rules_of_pairs(spark, docs, none):
    """Order 2 counts neighbouring words: the ratio is that of plain hashes, and shuffling a text changes it."""
    labels = spark.createDataFrame([(d, int(d != 203), 0) for d, _ in corpus() if d % 2], "doc_id bigint, quality int, toxic int")
    import xxhash

    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    one = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
    buckets = quality.PRODUCTION["buckets"]

    def grams(t: str | None) -> list[int]:
        h = [one(w) for w in brute.words(t)]
        # Spark hashes a row of longs by feeding the hash of one as the seed of the next.
        two = [xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), seed=xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), seed=42)) for a, b in zip(h, h[1:])]
        return [x % buckets for x in h] + [x % buckets + buckets for x in two]

    smooth = np.repeat([1.0, quality.PAIR_ALPHA], buckets)
    raw, target = smooth.copy(), smooth.copy()
    for d, t in corpus():
        for x in grams(t):
            raw[x] += 1
            target[x] += d % 2 and d != 203
    share = lambda x: np.log(x) - np.repeat(np.log(x.reshape(2, -1).sum(axis=1)), buckets)
    weight = np.round(share(target) - share(raw), quality.PRODUCTION["digits"])
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels, **quality.PRODUCTION).collect()}
    for d, t in corpus():
        llr = float(np.mean([weight[x] for x in grams(t)])) if brute.words(t) else 0.0
        assert math.isclose(got[d]["llr"], llr, abs_tol=1e-9)
        assert got[d]["kept"] == (not got[d]["base_failed"] and llr >= quality.THRESHOLD)
    assert quality.quality_rules(none, labels, **quality.PRODUCTION).count() == 0
    text = corpus()[3][1]
    pair = spark.createDataFrame([(1, text), (2, " ".join(sorted(text.split()))), (None, text), (1, text)], "doc_id bigint, text string")
    scores = [(r["doc_id"], round(r["llr"], 9)) for r in quality.score(pair, weight.tolist(), orders=(1, 2)).collect()]
    assert scores.count((1, scores[0][1])) == 2 and (None, scores[0][1]) in scores and dict(scores)[2] != scores[0][1]


def test_decontamination_of_long_items_and_odd_rows(spark, monkeypatch):
    """An item longer than a block goes in overlapping parts; null and repeated documents are rows of their own; the whole row can come along."""
    rng = random.Random(3)
    items = [(1, words(rng, 95, 10**6)), (2, words(rng, 9, 10**6)), (None, words(rng, 30, 10**6)), (4, "two words")]
    w = items[0][1].split()
    own = [(i, " ".join(["x", *w[i : i + 9], "y"])) for i in range(0, 87)] + [(None, None), (None, items[1][1]), (90, items[1][1]), (90, items[1][1]), (91, "a two words b"), (92, "")]
    real = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b: real(b, most=20))
    docs = spark.createDataFrame([(d, t, "s", 7) for d, t in own], "doc_id bigint, text string, spans string, items int")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), whole=True).collect()
    named = [("null" if i is None else i, t) for i, t in items]
    want = sorted((str(d), *brute.op5([(0, t)], named)[0]) for d, t in own)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    assert sorted(map(str, ((r["whole"]["doc_id"], r["whole"]["text"], r["whole"]["spans"], r["whole"]["items"]) for r in got))) == sorted(str((d, t, "s", 7)) for d, t in own)
