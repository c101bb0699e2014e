"""Plain single-machine versions of the operators that SQL doesn't express; the tests hold results against them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def op10(docs: list[tuple[int, str | None]], size: int = 50) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), doc)
    out = {}
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def op9(docs: list[tuple[int, str | None]], size: int = 50) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, int] = {}
    data = {doc: (text or "").encode() for doc, text in docs}
    for doc in sorted(data):
        b = data[doc]
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], doc)
    out = {}
    for doc, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < doc:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def op8(docs: list[tuple[int, str | None]], num: int = 85, size: int = 3) -> dict[int, tuple[int, int]]:
    sets = {}
    for doc, text in docs:
        w = words(lower(text or ""))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both: Counter = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def op5(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = 8) -> dict[int, tuple[int, int, int, str, bool]]:
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = lambda t: word.findall(lower(t or ""))
    owners = defaultdict(set)
    for item, text in items:
        w = fold(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            owners[tuple(w[i : i + size])].add(str(item))
    sizes = {len(k) for k in owners}
    out = {}
    for doc, text in docs:
        w, hit, found = fold(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[k]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out
