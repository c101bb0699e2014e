"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay distributed; each round is written to the shared folder. Tasks first replace the edges
that they hold, a bounded number at a time, by the stars of their own components, so few
rounds are left. The rounds end when the edges are a forest of stars: every vertex that has an edge
points at the smallest vertex of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table

AT_ONCE = 1_000_000  # edges


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of some edges but the smallest of each component, with that smallest one."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        # Roots of both ends take the lesser label as well, so whole trees move at once.
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            far = np.flatnonzero(label != np.arange(len(ids)))
            return ids[far], ids[label[far]]
        label = new


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            u, v = local_stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).mapInArrow(run, "u bigint, v bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with v < u; every vertex sends some neighbours to its smallest one."""
    near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge up at most, and none of those above has one."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, v: every vertex but the smallest of each component, with that smallest vertex. edges: u, v (any order; repeated and null ones don't count)."""
    now = table(_contracted(edges).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            return now
        now = table(_star(_star(now, True), False), "edges")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
