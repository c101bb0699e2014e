"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped edges.

1. A text's set is its distinct shingles (64-bit hashes). One permutation deals them
   into ``BINS`` bins; each bin keeps its least value, and an empty bin copies a bin
   that isn't, found by a hash sequence of its own (optimal densification).
2. Texts of one set form a class with the smallest id as representative; only
   representatives go on.
3. ``BANDS`` keys of ``BINS / BANDS`` bins each make buckets. Inside a bucket, texts
   whose signatures agree in ``least_agreeing`` bins or more are chained, and each chain gives
   a star: every text with the chain's smallest id. Chains of all buckets make
   families, found by connected components.
4. Inside each family the full sets are intersected exactly, and again only stars of
   confirmed links go on. So the rows sent grow with texts, not with pairs, and a
   link is only lost if its texts share none of 32 bands (about 6e-11 at 0.85) or
   their signatures agree in fewer bins than seven deviations below expectation, with
   as many bins as the smaller set can fill on its own counted as independent.
5. Components of the confirmed stars, and of ids that have several sets, name each text's
   smallest reachable id.

Large buckets and families are dealt in blocks, each with the group's centre (the smallest id). What a
block links with the centre is done: it is in one component. Only the texts left over meet all
blocks, in blocks of their own. So copies grow with the group and, times the blocks, with what its
centre doesn't reach; no pair is left out, and a task holds two blocks at most.

Cases: null and empty texts have the empty set and link with nothing; texts of one or
two words have their whole sequence as the one shingle; a repeated id is one vertex, whatever its texts;
null ids are one vertex that counts as the smallest; an empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .scratch import table

BINS, BANDS, BLOCK, SHINGLES = 128, 32, 1000, 2_000_000  # texts and shingles of a block
SIGNED = "doc_id bigint, n_shingles bigint, fa bigint, fb bigint, bands array<bigint>, sig binary"
NULL_ID = -(1 << 63)


def shingle_sets(column: pa.Array, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the n + 1 offsets of the texts."""
    buf, offs = T.utf8(column)
    w = T.Words(T.LOWER[buf], offs)
    h = w.hashes()
    parts, docs = [], []
    ok = T.window_starts(w.first, size, len(h))
    parts.append(T.window_hashes(h, size)[ok])
    docs.append(w.doc[: len(ok)][ok])
    for n in range(1, size):  # the whole sequence of a shorter text
        own = np.flatnonzero(w.counts == n)
        at = w.first[own]
        acc = np.zeros(len(own), T.U64)
        for i in range(n):
            acc = T.mix(acc ^ h[at + i], 31 + n)
        parts.append(acc)
        docs.append(own)
    doc, x = np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
    doc, x = doc[new], x[new]
    return x, np.searchsorted(doc, np.arange(len(w.counts) + 1))


def signatures(x: np.ndarray, offs: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures (texts x bins) of sorted sets, densified; rows of empty sets are 0."""
    n, shift = len(offs) - 1, 64 - int(bins).bit_length() + 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    place = doc * bins + (x >> T.U64(shift)).astype(np.int64)
    first = np.ones(len(x), bool)
    first[1:] = place[1:] != place[:-1]
    sig, full = np.zeros(n * bins, T.U64), np.zeros(n * bins, bool)
    sig[place[first]], full[place[first]] = x[first], True
    sig, full = sig.reshape(n, bins), full.reshape(n, bins)
    out, todo = sig.copy(), ~full
    rows = np.flatnonzero(full.any(axis=1) & todo.any(axis=1))
    attempt = 0
    while len(rows):
        attempt += 1
        source = (T.mix(np.arange(bins, dtype=T.U64), 1000 + attempt) % T.U64(bins)).astype(np.int64)
        fill = todo[rows] & full[np.ix_(rows, source)]
        r, c = np.nonzero(fill)
        out[rows[r], c] = sig[rows[r], source[c]]
        todo[rows[r], c] = False
        rows = rows[todo[rows].any(axis=1)]
    return out


def sign(rows: DataFrame, size: int = 3) -> DataFrame:
    """Sets reduced to size, fingerprint, band keys and one byte for each bin. rows: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            x, offs = shingle_sets(batch.column("text"), size)
            n = np.diff(offs)
            sums = [np.concatenate((np.zeros(1, T.U64), np.cumsum(T.mix(x, s), dtype=T.U64))) for s in (41, 42)]
            with np.errstate(over="ignore"):
                fa, fb = (s[offs[1:]] - s[offs[:-1]] for s in sums)
            sig = signatures(x, offs)
            r = BINS // BANDS
            keys = T.mix(np.broadcast_to(np.arange(BANDS, dtype=T.U64), (len(n), BANDS)), 51)
            for k in range(r):
                keys = T.mix(keys ^ sig[:, k::r], 52 + k)
            small = (T.mix(sig, 61) & T.U64(255)).astype(np.uint8)
            some = n > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))), pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), bands, pa.array([s.tobytes() for s in small], pa.binary())],
                names=["doc_id", "n_shingles", "fa", "fb", "bands", "sig"],
            )
        T.release()

    return rows.mapInArrow(run, SIGNED)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first columns, from a stream sorted by them."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != now:
                if held:
                    yield held
                now, held = row[:n_keys], []
            held.append(row)
    if held:
        yield held


def _stars(batches: Iterator[pa.RecordBatch], n_keys: int, chains, leave: bool) -> Iterator[pa.RecordBatch]:
    """Star edges (u, v): every id of a chain with its smallest id; chains gives index lists of one group's rows.

    Rows are keys, id, payload; the last key tells whether the group has more blocks. If it has, and leave is set, ids outside the chain
    of the first row (the centre) come out as (key, id, null)."""
    keys: list[int] = []
    u: list[int] = []
    v: list[int | None] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["key", "u", "v"])

    for rows in _groups(batches, n_keys):
        left = {r[n_keys] for r in rows} if leave and rows[0][n_keys - 1] else set()
        if len(rows) > 1:
            for chain in chains(rows):
                ids = sorted({rows[i][n_keys] for i in chain})
                u += ids[1:]
                v += [ids[0]] * (len(ids) - 1)
                if rows[0][n_keys] in ids:
                    left.difference_update(ids)
        keys += [rows[0][0]] * (len(u) - len(keys) + len(left))
        u += left
        v += [None] * len(left)
        if len(u) > 50_000:
            yield out()
            keys, u, v = [], [], []
    if u:
        yield out()


def _chained(n: int, near) -> Iterator[list[int]]:
    """Connected components of 0 .. n - 1, where near(i, candidates) gives those linked with i."""
    left = np.arange(n)
    while len(left):
        seed, left = int(left[0]), left[1:]
        chain, front = [seed], [seed]
        while front and len(left):
            i = front.pop()
            hit = near(i, left)
            if hit.any():
                more = left[hit].tolist()
                chain += more
                front += more
                left = left[~hit]
        yield chain


def least_agreeing(num: int, n: np.ndarray) -> np.ndarray:
    """Bins in which signatures of linked texts agree at least, by the number of shingles: seven deviations below the number expected.

    A set of n fills BINS * (1 - exp(-n / BINS)) bins by itself; the others repeat them."""
    p = num / 100
    filled = np.maximum(BINS * -np.expm1(-np.asarray(n, float) / BINS), 1)
    return np.maximum(BINS * (p - 7 * (p * (1 - p) / filled) ** 0.5), 0).astype(np.int64)


def _bucket_chains(num: int):
    def chains(rows: list[tuple]) -> Iterator[list[int]]:
        sig = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8).reshape(len(rows), -1)
        least = least_agreeing(num, np.array([r[-2] for r in rows]))
        return _chained(len(rows), lambda i, left: (sig[left] == sig[i]).sum(axis=1) >= np.minimum(least[left], least[i]))

    return chains


def _exact_chains(num: int, size: int):
    def chains(rows: list[tuple]) -> Iterator[list[int]]:
        x, offs = shingle_sets(pa.array([r[-1] for r in rows], pa.large_string()), size)
        n = np.diff(offs)
        if len(rows) == 2:
            both = len(np.intersect1d(x[: offs[1]], x[offs[1] :], assume_unique=True))
            linked = 100 * both >= num * (n.sum() - both)
            return iter([[0, 1]] if linked else [])
        _, number = np.unique(x, return_inverse=True)
        order = np.argsort(number, kind="stable")
        holders = np.repeat(np.arange(len(n)), n)[order]
        cuts = np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))

        def near(i: int, left: np.ndarray) -> np.ndarray:
            own = number[offs[i] : offs[i + 1]]
            found = np.concatenate([holders[cuts[k] : cuts[k + 1]] for k in own]) if len(own) else holders[:0]
            both = np.bincount(found, minlength=len(n))[left]
            return 100 * both >= num * (n[i] + n[left] - both)

        return _chained(len(rows), near)

    return chains


def _dealt(groups: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    return groups.select(*keys, "doc_id", *payload).repartition(*keys).sortWithinPartitions(*keys, "doc_id")


def linked(members: DataFrame, blocks: Column, payload: list[str], chains, name: str) -> DataFrame:
    """Star edges (u, v) of all groups. members: key, doc_id, payload and the columns of ``blocks``, the number of a group's blocks."""
    edges = "key bigint, u bigint, v bigint"
    placed = members.withColumn("_n", F.greatest(F.ceil(blocks), F.lit(1)).cast("int")).withColumn("_i", F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int"))
    placed = table(placed.select("key", "doc_id", "_n", "_i", *payload), f"{name}_members")  # read several times
    # One row for each task and large group travels to find the centre, never the group.
    centre = placed.where("_n > 1").groupBy("key").agg(F.min(F.struct("doc_id", "_n", "_i", *payload)).alias("_c")).select("key", "_c.*")
    centre = centre.withColumn("_own", F.col("_i")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).where("_i != _own").drop("_own")
    first = placed.unionByName(centre).withColumn("_more", F.col("_n") > 1)
    keys = ["key", "_i", "_more"]
    stars = table(_dealt(first, keys, payload).mapInArrow(lambda it: _stars(it, 3, chains, True), edges), name)
    rest = stars.where(F.col("v").isNull()).select("key", F.col("u").alias("doc_id")).distinct()
    found = stars.where(F.col("v").isNotNull()).select("u", "v")
    if rest.isEmpty():
        return found
    counts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("_r")).withColumn("_r", F.ceil(F.col("_r") / BLOCK).cast("int"))
    # Told to each block of the group, so that a large group is never joined by its key alone.
    blocks_of = placed.where("_n > 1").select("key", "_n").distinct()
    counts = counts.join(blocks_of.hint("merge"), "key").select("key", "_r", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    again = placed.join(counts.hint("merge"), ["key", "_i"])
    over = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every = again.withColumn("_j", over("_r"))
    left = again.join(rest.hint("merge"), ["key", "doc_id"], "left_semi").withColumn("_j", F.pmod(F.xxhash64("doc_id"), F.col("_r")).cast("int")).drop("_i").withColumn("_i", over("_n"))
    met = _dealt(every.unionByName(left), ["key", "_i", "_j"], payload).mapInArrow(lambda it: _stars(it, 3, chains, False), edges)
    return found.unionAll(met.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, size: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; linked: 100 * intersection >= num * union of the shingle sets."""
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = table(sign(base, size), "signed")
    classes = signed.where("n_shingles > 0").groupBy("fa", "fb", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # Merge joins at every size: a side that grows with the corpus is never broadcast, however small it is today.
    members = table(signed.select("doc_id", "n_shingles", "fa", "fb").join(classes.hint("merge"), ["fa", "fb", "n_shingles"], "left"), "members")
    # A row for each representative and set: an id with several sets may stand for several classes.
    alone = members.where(F.col("rep") == F.col("doc_id")).select("doc_id", "fa", "fb").distinct()
    reps = signed.join(alone.hint("merge"), ["doc_id", "fa", "fb"], "left_semi").dropDuplicates(["doc_id", "fa", "fb"])

    keys = reps.select("doc_id", "fa", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Signatures only go to keys that several texts have.
    met = keys.join(crowded.hint("merge"), "key").join(reps.select("doc_id", "fa", "n_shingles", "sig").hint("merge"), ["doc_id", "fa"]).drop("fa")
    rough = linked(met, F.col("n") / BLOCK, ["n_shingles", "sig"], _bucket_chains(num), "rough")

    near = components(rough)
    families = near.select(F.col("u").alias("doc_id"), F.col("v").alias("key")).unionAll(near.select("v", "v").distinct().toDF("doc_id", "key"))
    families = families.join(reps.groupBy("doc_id").agg(F.sum("n_shingles").alias("m")).hint("merge"), "doc_id")
    sizes = families.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("_m"))
    texts = families.join(sizes.hint("merge"), "key").join(base.withColumn("_h", F.xxhash64("text")).hint("merge"), "doc_id").dropDuplicates(["key", "doc_id", "_h"])
    stars = linked(texts, F.greatest(F.col("n") / BLOCK, F.col("_m") / SHINGLES), ["text"], _exact_chains(num, size), "exact")

    own = members.where(F.col("rep").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("_rep"), F.max("rep").alias("_other"))
    several = members.where(F.col("rep").isNotNull()).join(own.where("_rep < _other").select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "rep").distinct()
    roots = components(stars.unionAll(several.toDF("u", "v")))

    told = members.select("doc_id", "n_shingles").join(own.select("doc_id", "_rep").hint("merge"), "doc_id", "left")
    told = told.join(roots.select(F.col("u").alias("_rep"), F.col("v").alias("_root")).hint("merge"), "_rep", "left")
    component = F.coalesce("_root", "_rep", "doc_id")
    back = lambda c: F.when(c != NULL_ID, c)
    return told.select(back(F.col("doc_id")).alias("doc_id"), "n_shingles", back(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))
