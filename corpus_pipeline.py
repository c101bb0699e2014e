"""Corpus pipeline: each stage is one operator of sunstack.llm, written as Parquet and reread by the next.

Filtering stages judge each row by itself, so rows that repeat an id, or
have none, don't share a verdict. All but the last stage return the columns of their input.

Cases. Quality: null, empty and short texts go, as the rules say. Near duplicates: rows of one text, or of
texts linked by any chain, leave one; texts without words are linked with nothing. Substrings: the words left in a
changed text are joined by single spaces, and texts left empty go. Decontamination: texts without words stay.
Packing: a null or empty text is the end id alone. Empty tables give empty tables, other
columns go along unchanged whatever their names, and texts are never cut, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunstack.llm import decontaminate, minhash, packing, quality, substring
from sunstack.llm.queries import tokenizer
from sunstack.llm.scratch import dropping, give_back, table
from sunstack.llm.tables import load

#: Hashed multinomials, tokens and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, written so that every reading finds the same numbers, and the column's name, which docs doesn't have."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return table(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _without(rows: DataFrame, number: str, gone: DataFrame) -> DataFrame:
    """Numbered rows but for those whose number is the doc_id of a row of gone; the numbers are dropped."""
    bad = gone.select(F.col("doc_id").alias(number)).hint("merge")  # it grows with the corpus, so it is never broadcast
    return rows.join(bad, number, "left_anti").drop(number)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    made = quality.PRODUCTION
    give_back(spark)  # this stage's plan is the largest text in the driver
    trusted = quality.trusted_ids(load(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)
    weight = quality.weights(docs, trusted, buckets=made["buckets"], orders=made["orders"], digits=made["digits"])
    return quality.kept_rows(docs, weight, orders=made["orders"])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: five-word shingles, similarity of 0.8 or more, the smallest id stays (null before all others)."""
    rows, number = _numbered(docs)
    with dropping(spark) as kept:
        linked = table(minhash.near_duplicates(rows, number, num=80, size=5).select("doc_id", "component_id"), "linked")
        kept.append(linked)
    groups = linked.where(F.col("doc_id") != F.col("component_id")).select("component_id").distinct()
    members = linked.join(groups.hint("merge"), "component_id", "left_semi")
    # Rows of one id are told apart by their text, then by their number.
    ids = rows.select(F.col(number).alias("doc_id"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h")).join(members.hint("merge"), "doc_id")
    first = ids.groupBy("component_id").agg(F.min(F.struct("_id", "_h", "doc_id"))["doc_id"].alias("_first"))
    return _without(rows, number, members.join(first.hint("merge"), "component_id").where(F.col("doc_id") != F.col("_first")))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word runs of earlier documents (the words left, joined by spaces); texts left empty go."""
    with dropping(spark) as made:
        cut = table(substring.substring_dedup(docs, with_text=True).where("n_removed > 0").select("doc_id", "row_key", "kept_text").distinct(), "cut").hint("merge")
        made.append(cut)
    rows = docs.join(cut, docs["doc_id"].eqNullSafe(cut["doc_id"]) & (F.xxhash64(docs["text"]) == cut["row_key"]), "left")
    kept = cut["kept_text"]
    changed = {"text": F.coalesce(kept, docs["text"])} | ({"n_chars": F.when(kept.isNull(), docs["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.where(kept.isNull() | (kept != "")).select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window: 8 words, or the whole of an item that has fewer."""
    found = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), whole=True)
    return found.where(F.col("n_hit") == 0).select("whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and reread; a stage's own tables go when the next stage's are written."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with dropping(spark) as kept:
            docs = table(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return docs
