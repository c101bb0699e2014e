"""LM scoring: prediction by partial matching over bytes, pretrained on the training documents.

Counting. Every text (A-Z lower-cased), between ``DEPTH`` marks and the one that ends it,
gives the runs of DEPTH + 1 bytes (DEPTH of context, 1 symbol) at all positions. The mark is
byte 0xFF, which UTF-8 never has, so texts with zero bytes are told from their ends. Tasks
count runs with numpy and Spark sums the counts of the training texts, so all contexts of all
training texts are kept, however many they are.

Model. A context's distribution escapes by method C (distinct / (total + distinct)) to
that of the context without its oldest byte, where the symbols seen are excluded; below
order 0 the symbols left share evenly. Only the counts of order 0 and 1 (65,536 at most)
are broadcast. Runs are dealt by the two bytes before their symbol, so a task has
all contexts that end in these, and writes the log-probability of every run once as a table.

Scoring. A text's code length is the sum over its positions. A model of at most ``SHARED``
runs (12 bytes each) is counted first and then broadcast. A larger one stays a table: the distinct
runs of each block of documents are looked up in it by a join. Both give the same scores.

Base. Words are looked up by block of documents: a block's distinct words meet the
corpus counts in a join, so a frequent word travels once for each block, not once
for each document.

Cases: null and empty texts score their end alone (a token in the base, the mark in the model); without
training documents the model is uniform and the counts are 0; repeated ids are rows
of their own; null ids train and are scored like others (their text form is empty).
Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import table

DEPTH, ORDER, BLOCK_BYTES, SHARED, HELD_OUT, FOLDS, MARK = 5, 3, 8 << 20, 6_000_000, 2, 7, 0xFF  # ORDER: of the plain trie
END = b""  # no word is empty
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
ENCODED = "block string, word binary, number int, code bigint, seen bigint, doc_id bigint, held_out boolean, n_tokens bigint, ids binary, bytes binary"
SCORED = "block string, doc_id bigint, held_out boolean, n_tokens bigint, ids binary, score double"


def held_out(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == HELD_OUT


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes of all texts, a mark ending each, and their offsets."""
    buf, offs = T.utf8(column)
    n = len(offs) - 1
    out = np.full(len(buf) + n, MARK, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offs))] = T.LOWER[buf]
    return out, offs + np.arange(n + 1)


def _padded(buf: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``order`` marks before each, and the positions of their own bytes in it."""
    n = len(offs) - 1
    at = np.arange(len(buf)) + order * (np.repeat(np.arange(n), np.diff(offs)) + 1)
    out = np.full(len(buf) + order * n, MARK, np.uint8)
    out[at] = buf
    return out, at


def grams(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """The run of order + 1 bytes (oldest byte first) that ends at each position."""
    text, at = _padded(buf, offs, order)
    n = max(0, len(text) - order)
    code = text[:n].astype(np.uint32 if order < 4 else np.int64)
    for k in range(1, order + 1):  # runs from every place, side by side; those that begin in another text are passed over
        code <<= code.dtype.type(8)
        code |= text[k : n + k]
    return code[at - order]


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs in order and their counts; sorts code in place."""
    code.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return code[first].astype(np.int64), np.diff(np.append(first, len(code)))


def gram_counts(buf: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of order + 1 bytes (oldest byte first) and their counts."""
    return counted(grams(buf, offs, order))


def log_probabilities(code: np.ndarray, count: np.ndarray, pairs: np.ndarray, order: int = DEPTH) -> np.ndarray:
    """log10 probability of the symbol of every run in its context.

    code: distinct runs of order + 1 bytes, with all those that share their last two context bytes; count: in training,
    0 for runs to be scored only; pairs: training counts of (byte, symbol), 256 x 256."""
    single = pairs.sum(axis=0)
    levels = [(np.flatnonzero(single), single[single > 0]), (np.flatnonzero(pairs), pairs[pairs > 0])]
    trained = code[count > 0]
    for k in range(2, order + 1):
        own, inverse = np.unique(trained & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        levels.append((own, np.bincount(inverse, weights=count[count > 0], minlength=len(own)) if len(own) else np.zeros(0)))

    def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    p = escaped = up = up_total = up_kinds = None  # of the context one byte shorter
    for k, (own, n) in enumerate(levels):
        nodes, inverse = np.unique(own >> 8, return_inverse=True)
        summed = lambda x: np.bincount(inverse, weights=x, minlength=len(nodes)) if len(nodes) else np.zeros(0)  # noqa: B023, E731
        wanted = code & ((1 << (8 * (k + 1))) - 1)
        c, total, kinds = look(own, n, wanted), look(nodes, summed(n), wanted >> 8), look(nodes, summed(np.ones(len(own))), wanted >> 8)
        if k == 0:
            below = np.where(c > 0, 0.0, 1.0 / np.maximum(256 - kinds, 1))
        else:
            # The parent without the symbols seen here, which are excluded.
            seen = look(nodes, summed(look(*levels[k - 1], own & ((1 << (8 * k)) - 1))), wanted >> 8)
            t, more = up_total - seen, np.where(up_kinds == 256, 0, up_kinds - kinds)
            out = np.where(up_kinds == 256, 0.0, np.where(t > 0, more / np.maximum(t + more, 1), 1.0))
            below = np.where(up > 0, up / np.maximum(t + more, 1), out * escaped)
        here = np.where(c > 0, c / np.maximum(total + np.where(kinds == 256, 0, kinds), 1), np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) * below)
        if k == 0:
            p = here
        else:
            p = np.where(total > 0, here, p)  # a context that never came up is passed over, and so are all longer ones
        escaped, up, up_total, up_kinds = below, c, total, kinds
    return np.log10(p)


class Trie:
    """The model of order 3 in memory, plainly; the tests hold ``log_probabilities`` against it.

    Nodes by order; ``child[node, older byte]`` is the next longer context or -1, ``logs[node, symbol]`` log10 of its probability."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, contexts: np.ndarray, context_gram: np.ndarray, context_count: np.ndarray) -> None:
        """gram, count: all 3-byte runs (order 2 and its symbol); contexts: kept 3-byte contexts, with their runs (code, count)."""
        levels = []
        for order in range(3):
            code = gram & ((1 << (8 * (order + 1))) - 1)
            own, inverse = np.unique(code, return_inverse=True)
            levels.append((order, own, np.bincount(inverse, weights=count, minlength=len(own)) if len(own) else np.zeros(0)))
        kept = np.isin(context_gram >> 8, contexts)
        levels.append((3, context_gram[kept], context_count[kept].astype(float)))
        tables, nodes, parent, base = [], [], [], 0
        for order, code, n in levels:
            ctx, inverse = np.unique(code >> 8, return_inverse=True) if len(code) else (np.zeros(1 if order == 0 else 0, np.int64), np.zeros(0, np.int64))
            c = np.zeros((len(ctx), 256))
            c[inverse, code & 255] = n
            tables.append(c)
            nodes.append((base, ctx))
            if order == 0:
                parent.append(np.full(len(ctx), -1))
            else:
                up_base, up = nodes[order - 1]
                parent.append(np.searchsorted(up, ctx & ((1 << (8 * (order - 1))) - 1)))
            base += len(ctx)
        inner = base - len(nodes[3][1])
        self.child = np.full((inner, 256), -1, np.int32)
        for order in range(1, 4):
            start, ctx = nodes[order]
            self.child[nodes[order - 1][0] + parent[order], ctx >> (8 * (order - 1))] = start + np.arange(len(ctx))
        self.logs = np.empty((base, 256), np.float32)
        above_p, above_c, above_e = None, None, None
        for order in range(4):
            start, ctx = nodes[order]
            c = tables[order]
            total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            seen = c > 0
            if order == 0:
                rest = 256 - kinds
                escaped = np.where(rest > 0, 1.0 / np.maximum(rest, 1), 0.0) * ~seen
            else:
                p = parent[order]
                up = above_c[p] * ~seen  # symbols seen here are excluded above
                t, k = up.sum(axis=1, keepdims=True), (up > 0).sum(axis=1, keepdims=True)
                # A symbol new to both comes from further up, where the parent's symbols are excluded.
                further = above_e[p]
                all_seen = (above_c[p] > 0).sum(axis=1, keepdims=True) == 256
                out = np.where(all_seen, 0.0, np.where(t > 0, k / np.maximum(t + k, 1), 1.0))
                escaped = np.where(up > 0, up / np.maximum(t + np.where(all_seen, 0, k), 1), out * further) * ~seen
            full = kinds == 256
            p = np.where(seen, c / np.maximum(total + np.where(full, 0, kinds), 1), np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) * escaped)
            with np.errstate(divide="ignore"):
                self.logs[start : start + len(ctx)] = np.log10(p)
            above_c, above_e = c, escaped

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        text, at = _padded(buf, offs, ORDER)
        node = np.zeros(len(at), np.int32)
        alive = np.arange(len(at))
        for back in range(1, ORDER + 1):
            step = self.child[node[alive], text[at[alive] - back]]
            ok = step >= 0
            if not ok.all():
                alive, step = alive[ok], step[ok]
            node[alive] = step
        each = self.logs[node, buf].astype(np.float64)
        sums = np.concatenate(([0.0], np.cumsum(each)))
        return sums[offs[1:]] - sums[offs[:-1]]


def model(coded: DataFrame) -> DataFrame:
    """code, logp of every run of the documents, learnt from those of the training documents. coded: of ``encode``."""
    # Held-out runs are in it too, with a count of 0.
    runs = table(coded.where(F.col("code").isNotNull()).groupBy("code").agg(F.sum("seen").alias("n")), "grams")
    pairs = np.zeros((256, 256))
    low = runs.where("n > 0").groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("n").alias("n")).toPandas()  # at most 65,536 rows
    pairs.ravel()[low["code"].to_numpy(np.int64)] = low["n"].to_numpy(float)
    shared = coded.sparkSession.sparkContext.broadcast(pairs)

    def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(log_probabilities(code, n, shared.value).astype(np.float32))], names=["code", "logp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [], [], 0  # rows come in order of near: the last one's runs may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            codes.append(batch.column("code").to_numpy())
            counts.append(batch.column("n").to_numpy())
            size += batch.num_rows
            if size > 500_000:
                code, n = np.concatenate(codes), np.concatenate(counts)
                near = (code >> 8) & 0xFFFF
                cut = int(np.flatnonzero(near != near[-1])[-1]) + 1 if near[0] != near[-1] else 0
                if cut:
                    yield out(code[:cut], n[:cut])
                codes, counts, size = [code[cut:]], [n[cut:]], len(code) - cut
        if size:
            yield out(np.concatenate(codes), np.concatenate(counts))
        T.release()

    dealt = runs.withColumn("near", F.shiftright("code", 8).bitwiseAND(0xFFFF)).repartition("near").sortWithinPartitions("near")
    return table(dealt.mapInArrow(run, "code bigint, logp float"), "model")


def squeeze(numbers: np.ndarray) -> bytes:
    """A bag of word numbers in few bytes: sorted, as differences, deflated. The base score doesn't depend on order."""
    return zlib.compress(np.diff(np.sort(numbers), prepend=np.int32(0)).astype(np.uint32).tobytes(), 1)


def unsqueeze(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.int64)


def encode(rows: DataFrame) -> DataFrame:
    """Rows (block, word, number, seen in training), (code of a run, seen in training) by task, and the documents by block."""
    names = [x.split()[0] for x in ENCODED.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}

    def made(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(x.split()[0], pa.nulls(n, kinds[x.split()[1]])) for x in ENCODED.split(", ")], names=names)

    def pack(block: str, held: list[pa.RecordBatch], runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {END: 0}
        docs, ids, tokens, out, raws, codes = [], [], [], [], [], ([], [])
        seen = np.zeros(0, np.int64)
        for batch in held:
            own_ids = batch.column("doc_id").to_pylist()
            away = np.array([held_out(d) for d in own_ids], bool)
            buf, offs = texts_of(batch.column("text"))
            code = grams(buf, offs, DEPTH)
            which = np.repeat(away, np.diff(offs))
            codes[0].append(code[~which]), codes[1].append(code[which])
            for doc, raw, gone in zip(own_ids, (buf[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:] - 1, strict=True)), away.tolist(), strict=True):
                own = np.array([number.setdefault(w, len(number)) for w in raw.split()] + [0], np.int32)
                if len(number) > len(seen):
                    seen = np.concatenate((seen, np.zeros(max(len(number), len(seen) or 1024), np.int64)))
                if not gone:
                    np.add.at(seen, own, 1)
                docs.append(doc), ids.append(squeeze(own)), tokens.append(len(own)), out.append(gone), raws.append(raw)
        words = list(number)
        n, m = len(words), len(docs)
        yield made(n, block=pa.array([block] * n), word=pa.array(words, pa.binary()), number=pa.array(np.arange(n, dtype=np.int32)), seen=pa.array(seen[:n]))
        yield made(m, block=pa.array([block] * m), doc_id=pa.array(docs, pa.int64()), held_out=pa.array(out, pa.bool_()), n_tokens=pa.array(tokens, pa.int64()),
                   ids=pa.array(ids, pa.binary()), bytes=pa.array(raws, pa.binary()))
        for parts, some in zip(codes, (True, False), strict=True):
            c, k = counted(np.concatenate(parts))
            runs.append((c, k if some else np.zeros(len(c), np.int64)))

    def summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([c for c, _ in runs]), return_inverse=True)
        return code, np.bincount(at, weights=np.concatenate([k for _, k in runs]), minlength=len(code)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size, runs = TaskContext.get().partitionId(), 0, [], 0, []

        def told() -> Iterator[pa.RecordBatch]:
            code, seen = summed(runs)
            for i in range(0, len(code), 1 << 17):
                c = code[i : i + (1 << 17)]
                yield made(len(c), code=pa.array(c), seen=pa.array(seen[i : i + (1 << 17)]))

        for batch in T.slices(batches, "text"):
            held.append(batch)
            size += batch.nbytes
            if size > BLOCK_BYTES:
                yield from pack(f"{part}-{number}", held, runs)
                number, held, size = number + 1, [], 0
                if len(runs) >= 8:  # a task's runs are summed before they go on, but never held without a bound
                    runs = [summed(runs)]
                    if len(runs[0][0]) > SHARED // 4:
                        yield from told()
                        runs = []
        if held:
            yield from pack(f"{part}-{number}", held, runs)
        if runs:
            yield from told()
        T.release()

    return rows.mapInArrow(run, ENCODED)


def _sums(raws: list[bytes], of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each text; of gives the distinct runs asked for, or more, and their log-probabilities."""
    raws = [r + bytes((MARK,)) for r in raws]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    own = grams(np.frombuffer(b"".join(raws), np.uint8), offs, DEPTH)
    code, logp = of(own)
    sums = np.concatenate(([0.0], np.cumsum(logp[pc.index_in(pa.array(own), value_set=pa.array(code)).to_numpy()].astype(np.float64))))
    return sums[offs[1:]] - sums[offs[:-1]]


def scored(texts: DataFrame, learnt: DataFrame, most: int) -> DataFrame:
    """texts (block, doc_id, held_out, n_tokens, ids, bytes) with their score; learnt: of ``model``."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    if learnt.count() <= most:
        found = learnt.orderBy("code").toArrow()  # at most ``most`` rows of 12 bytes
        shared = texts.sparkSession.sparkContext.broadcast((found.column("code").to_numpy(), found.column("logp").to_numpy()))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, logp = shared.value

            def of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                c = counted(own.copy())[0]
                return c, logp[np.searchsorted(code, c)]

            for batch in T.slices(batches, "bytes", BLOCK_BYTES):
                score = _sums(batch.column("bytes").to_pylist(), of)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(score)], names=names)
            T.release()

        return texts.mapInArrow(each, SCORED)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "bytes", BLOCK_BYTES):
            block = batch.column("block").to_pylist()
            cuts = [0, *(i for i in range(1, len(block)) if block[i] != block[i - 1]), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                raws = [r + bytes((MARK,)) for r in batch.column("bytes").slice(a, b - a).to_pylist()]
                offs = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
                code = counted(grams(np.frombuffer(b"".join(raws), np.uint8), offs, DEPTH))[0]
                yield pa.RecordBatch.from_arrays([pa.array([block[a]] * len(code)), pa.array(code)], names=["block", "code"])

    runs = texts.select("block", "bytes").mapInArrow(distinct, "block string, code bigint").distinct().join(learnt.hint("merge"), "code")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        code, logp = right.column("code").to_numpy(), right.column("logp").to_numpy()
        return pa.table([*(left.column(n) for n in names[:-1]), pa.array(_sums(left.column("bytes").to_pylist(), lambda own: (code, logp)))], names=names)

    return texts.groupBy("block").cogroup(runs.select(F.col("block").alias("of_block"), "code", "logp").groupBy("of_block")).applyInArrow(together, SCORED)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shared: int = SHARED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; shared: runs of a model to be broadcast at most."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = table(encode(rows), "encoded")
    vocabulary = coded.where(F.col("word").isNotNull())
    counts = table(vocabulary.groupBy("word").agg(F.sum("seen").alias("c")).where("c > 0"), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    base = float(np.log10(n + v + 1))
    known = vocabulary.select("block", "word", "number").join(counts.hint("merge"), "word").select(F.col("block").alias("of_block"), "number", "c")
    texts = scored(coded.where(F.col("n_tokens").isNotNull()).select("block", "doc_id", "held_out", "n_tokens", "ids", "bytes"), model(coded), shared)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        c = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        c[number] = right.column("c").to_numpy()
        out: list[list] = [[], []]
        for ids in left.column("ids").to_pylist():
            own = unsqueeze(ids)
            own = c[own[own < len(c)]]
            own = own[own > 0]
            out[0].append(len(own))
            out[1].append(float(np.log10(own + 1.0).sum()))
        tokens = left.column("n_tokens").to_numpy()
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": left.column("n_tokens"), "n_known": pa.array(out[0], pa.int64()),
            "train_tokens": pa.array(np.full(len(tokens), n, np.int64)), "base_score": pa.array(np.array(out[1], float) - tokens * base),
            "score": left.column("score"),
        })

    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(together, SCHEMA)
