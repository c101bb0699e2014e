"""Sharding [native]: weighted rendezvous (highest random weight) hashing.

Shard i of weight w gets the score w / -ln(u), u in (0, 1) from the first 52 bits
of md5("key/i"); a key goes to the shard with the highest score (ties: the lowest
number). Key and shard list alone decide, so one more shard takes rows only into
itself. Slots number the rows of a shard without gaps: rows are counted by
(shard, group), 256 groups by key hash, and a running sum of those few counts gives
each group its first slot, so no task ever sees a whole shard.

Cases: a null key hashes as the empty string; null text has 0 bytes (size 8, crc32
0); repeated keys share a shard and take consecutive slots ordered by checksum and
size; an empty table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_DIGITS = 2


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _score(key: Column, shard: int, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.log((bits + 0.5) / float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (int, from 0) of a string key; struct<score, shard> in field order decides."""
    best = reduce(lambda a, b: F.greatest(a, b), [
        F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)
    ])
    return best


def shard(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard once a further one of ``grown_weight`` is added)."""
    n = len(weights)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = key_text(F.col("_key"))
    keyed = docs.select(
        F.col(key_col).alias("_key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    ).withColumn("_best", rendezvous(key, weights)).select(
        "_key", "size", "text_crc32", (-F.col("_best.shard")).alias("shard"),
        F.when(_score(key, n, grown_weight) > F.col("_best.score"), F.lit(n)).otherwise(-F.col("_best.shard")).alias("grown_shard"),
        F.substring(F.md5(key), 1, GROUP_DIGITS).alias("_group"),
    )
    counts = keyed.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_group").orderBy("_key", "text_crc32", "size")
    return (
        keyed.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(first), ["shard", "_group"])  # at most len(weights) * 256 rows
        .select(F.col("_key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("_first") + F.col("_rank") - 1).alias("slot"), "grown_shard")
    )
