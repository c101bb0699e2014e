"""Matching of frames, wavefronts and keypoints: the relational analogues of a reconstruction's set logic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources import tables


def wavefront_ties(images: DataFrame, wavefront: str, order: list[str]) -> DataFrame:
    """Every image with the first image of its wavefront (the pivot); pivots are taken by aggregate, so a common wavefront is no hot window."""
    pivot = images.groupBy(wavefront).agg(F.min(F.struct(*order)).alias("pivot"))
    return images.join(pivot, wavefront).where(F.struct(*order) != F.col("pivot")).select(*images.columns, *[F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in order])


def covers_all(members: DataFrame, owner: str, value: str) -> DataFrame:
    """Owners that hold every value there is (relational division)."""
    every = members.select(value).distinct().agg(F.count(F.lit(1)).alias("_all"))
    return members.groupBy(owner).agg(F.countDistinct(value).alias("n")).join(F.broadcast(every), F.col("n") == F.col("_all")).drop("_all")


def sets(members: DataFrame, owner: str, value: str) -> DataFrame:
    return members.groupBy(owner).agg(F.array_sort(F.collect_set(value)).alias("members"))


def contained_in(sets_of: DataFrame, reference: DataFrame) -> DataFrame:
    """Owners whose set lies inside the reference's one set without being equal to it; one owner (the smallest) for each set.

    Members are matched by joins, so neither the sets nor the reference need to fit anywhere."""
    owner = sets_of.columns[0]
    ref = reference.select(F.explode("members").alias("_v")).distinct()
    size = ref.agg(F.count(F.lit(1))).first()[0]
    strange = sets_of.select(owner, F.explode("members").alias("_v")).join(ref, "_v", "left_anti").select(owner).distinct()
    # Inside the reference, a set of as many members is the reference itself.
    inside = sets_of.join(strange, owner, "left_anti").where(F.size(F.array_distinct("members")) < size)
    return inside.groupBy("members").agg(F.min(owner).alias("owner"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, distance, most: float | None = None) -> DataFrame:
    """For each left row the closest right row that shares its keys (ties: smallest id), by a running minimum, not a window."""
    pairs = left.join(right, keys).withColumn("d", distance)
    if most is not None:
        pairs = pairs.where(F.col("d") <= most)
    best = pairs.groupBy(left_id).agg(F.min(F.struct("d", right_id)).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.d").alias("d"))


#: rows of a block of queries and of a block of what they search; a task holds one of each
QUERY_BLOCK, SEARCH_BLOCK = 1024, 8192
#: pairs of one step of a block, and the sides of ``counts`` that are broadcast
STEP_PAIRS, FEW_KEYS = 1 << 20, 100_000


def nearest_in(ids: np.ndarray, p: np.ndarray, others: np.ndarray, q: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of p the nearest row of q with another id (ties: smallest id): ids, other ids and squared distances, of those with any up to ``most``.

    Products of matrices tell distances to a bound of their rounding errors; all pairs within it of a row's least are summed exactly, term by term."""
    found: list[tuple[np.ndarray, ...]] = []
    size = 4e-16 * (p.shape[1] + 8)
    qq = np.einsum("ij,ij->i", q, q)
    for first in range(0, len(p), step := max(1, STEP_PAIRS // max(1, len(q)))):
        own, mine = p[first : first + step], ids[first : first + step]
        with np.errstate(all="ignore"):
            both = np.einsum("ij,ij->i", own, own)[:, None] + qq
            rough, error = both - 2 * (own @ q.T), size * both
            same = mine[:, None] == others
            bound = np.nanmin(np.where(same | ~np.isfinite(rough), np.inf, rough + error), axis=1, initial=np.inf)
            i, j = np.nonzero(~(rough - error > bound[:, None]) & ~same)  # what isn't a number is looked at, too
            d = np.zeros(len(i))
            for a, b in zip(own.T, q.T, strict=True):
                d += (a[i] - b[j]) ** 2
        good = d <= most
        i, j, d = i[good], j[good], d[good]
        order = np.lexsort((others[j], d, i))
        i, j, d = i[order], j[order], d[order]
        head = np.flatnonzero(np.diff(i, prepend=-1))
        found.append((mine[i[head]], others[j[head]], d[head]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (ids[:0], others[:0], np.zeros(0))


def nearest_vectors(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, a: str, b: str, most: float = 1e300) -> DataFrame:
    """For each left row the right row of its keys and of another id whose vector is nearest (ties: smallest id): left_id, right_id, d (squared distance).

    All pairs are looked at, block by block: the rows of a key are dealt to blocks of bounded size, and every block of queries meets
    every block of the others as two matrices. Rows travel once for each block that they meet, results once for each of theirs."""
    own = [f"_k{i}" for i in range(len(keys))]  # both sides may come from one table, whose columns would be ambiguous
    keyed = lambda df, i, v, x: df.where(F.col(i).isNotNull() & F.col(v).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.size(v).alias("_n"), F.col(i).alias(i), F.col(v).alias(x))
    left, right = keyed(left, left_id, a, "_p"), keyed(right, right_id, b, "_q")
    by = [*own, "_n"]
    blocks = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by)
    blocks = blocks.select(*by, F.ceil(F.col("_l") / QUERY_BLOCK).cast("int").alias("_lb"), F.ceil(F.col("_m") / SEARCH_BLOCK).cast("int").alias("_rb"))
    if blocks.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        blocks = F.broadcast(blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = left.join(blocks, by).withColumn("_i", block(left_id, "_lb")).select(*by, "_i", every("_rb").alias("_j"), left_id, "_p")
    right = right.join(blocks, by).withColumn("_j", block(right_id, "_rb")).select(*by, every("_lb").alias("_i"), "_j", right_id, "_q")
    schema = StructType([StructField(left_id, left.schema[left_id].dataType), StructField(right_id, right.schema[right_id].dataType), StructField("d", DoubleType())])
    to = to_arrow_schema(schema)

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        values = t.column(name).combine_chunks()
        return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return to.empty_table()
        found = nearest_in(x.column(left_id).to_numpy(), matrix(x, "_p"), y.column(right_id).to_numpy(), matrix(y, "_q"), most)
        return pa.table([pa.array(v, f.type) for v, f in zip(found, to, strict=True)], schema=to)

    met = [*by, "_i", "_j"]
    pairs = tables.spread(left, *met).groupBy(*met).cogroup(tables.spread(right, *met).groupBy(*met)).applyInArrow(search, schema)
    best = pairs.groupBy(left_id).agg(F.min(F.struct("d", right_id)).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.d").alias("d"))


def top_k_two_stage(points: DataFrame, keys: list[str], response: str, distance: str, ident: str, k: int) -> DataFrame:
    """The k + 2 of highest response, of those the k nearest to the centre."""
    a = Window.partitionBy(*keys).orderBy(F.desc(response), ident)
    b = Window.partitionBy(*keys).orderBy(distance, ident)
    first = points.withColumn("_a", F.row_number().over(a)).where(F.col("_a") <= k + 2)
    return first.withColumn("rank", F.row_number().over(b)).where(F.col("rank") <= k).drop("_a")


def first_and_last(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n - 1 rows in order and the very last: two bounded top-k, not a global window."""
    flipped = [c.desc() if not isinstance(c, tuple) else c[1] for c in order]
    ahead = [c if not isinstance(c, tuple) else c[0] for c in order]
    return rows.orderBy(*ahead).limit(n - 1).unionByName(rows.orderBy(*flipped).limit(1)).distinct()
