"""Quality rules [native]: heuristics and a hashed n-gram log-likelihood ratio.

Every document gets the mean, over its word n-grams (``orders``: unigrams, bigrams or both), of
log(p_target / p_raw), where both multinomials of an order live on ``buckets`` hash
buckets of its own with add-``alpha`` smoothing (``PAIR_ALPHA`` for pairs, which are seen less). The raw multinomial counts every document of the
corpus; the target multinomial counts the trusted documents, a bounded sample
(``most_trusted`` ids, the smallest by hash, so the choice is reproducible) of
those labelled as good. A document is kept when it passes the rules and its mean
is at least ``threshold``; nothing is drawn at random. The production run
(``PRODUCTION``) takes words and pairs of words: on labelled documents outside the
sample it keeps the good ones, and fewer bad ones than words alone. Its weights are rounded
to ``digits`` decimals: they are a constant of the plan, whose text the driver keeps.

Cases: a null or empty text has no words, no n-grams, score 0 and fails the rules
(fewer than ``least_words`` words). Repeated ids are independent rows. Without
trusted documents both multinomials are uniform and the ratio is 0 everywhere, so
the rules alone decide. Only id and text are read; other columns never clash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, ALPHA, MOST_TRUSTED, THRESHOLD, ORDERS = 1 << 14, 1.0, 20_000, -0.2, (1,)
PAIR_ALPHA, PRODUCTION = 10.0, {"orders": (1, 2), "buckets": 1 << 15, "digits": 4}
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
BLANKS, SYMBOLS = " \t\n\u000b\f\r", "#*$%&|<>"


def words(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def _pairs(x: Column, gap: int) -> Column:
    """Hashes of x[i], x[i + gap]: from n-grams to (n + gap)-grams."""
    n = F.greatest(F.size(x) - gap, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(x, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(buckets - 1).cast("int")


def _buckets(grams: Column, buckets: int, table: int) -> Column:
    return F.transform(grams, lambda h: _bucket(h, buckets) + table * buckets)


def trusted_ids(labels: DataFrame, id_col: str, good: Column, most: int = MOST_TRUSTED) -> DataFrame:
    """At most ``most`` distinct ids of good rows, the smallest by hash: small enough to broadcast."""
    return (labels.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_trusted")).distinct()
            .orderBy(F.xxhash64("_trusted"), "_trusted").limit(most))


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            buckets: int = BUCKETS, alpha: float = ALPHA, orders: tuple[int, ...] = ORDERS, digits: int | None = None) -> list[float]:
    """log(p_target / p_raw) of every bucket of every order; counts cover all documents, the result has ``buckets`` numbers for each order."""
    read = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w"))
    read = read.join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"), "left").withColumn("_t", F.col("_trusted").isNotNull().cast("long"))
    if orders == (1,):
        found = read.select("_t", F.explode("_w").alias("_x")).select("_t", _bucket(F.xxhash64("_x"), buckets).alias("bucket"))
    else:
        hashed = read.select("_t", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
        grams = {1: F.col("_h"), 2: _pairs(F.col("_h"), 1)}
        found = hashed.select("_t", F.explode(F.concat(*[_buckets(grams[o], buckets, k) for k, o in enumerate(orders)])).alias("bucket"))
    counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("target"))
    raw, target = [0] * (buckets * len(orders)), [0] * (buckets * len(orders))
    for row in counts.collect():  # a row for each bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * len(raw)
    out = []
    for k, order in enumerate(orders):
        a = alpha if order == 1 else PAIR_ALPHA
        own = range(k * buckets, (k + 1) * buckets)
        n_raw, n_target = (sum(x[i] for i in own) + a * buckets for x in (raw, target))
        out += [math.log((target[i] + a) / n_target) - math.log((raw[i] + a) / n_raw) for i in own]
    return out if digits is None else [round(w, digits) for w in out]


def score(docs: DataFrame, weight: list[float], id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD, orders: tuple[int, ...] = ORDERS, whole: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr (mean log-ratio), and the whole row if asked for."""
    rest = ["_whole"] * whole
    table = F.from_json(F.lit("[" + ",".join(repr(w) for w in weight) + "]"), "array<double>")  # folded to a constant
    text, k = F.coalesce(F.col("_text"), F.lit("")), WINDOW
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("_whole")] * whole
    hashed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *own).withColumn("_h", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)))
    grams = {1: F.col("_h"), 2: F.col("_2")}
    buckets = len(weight) // len(orders)
    total = reduce(lambda acc, x: F.aggregate(grams[x[1]], acc, lambda a, h: a + F.get(table, _bucket(h, buckets) + x[0] * buckets)), enumerate(orders), F.lit(0.0))
    n_grams = reduce(lambda a, b: a + b, [F.size(grams[o]) for o in orders])
    one = (
        hashed.withColumn("_2", _pairs(F.col("_h"), 1)).withColumn("_4", _pairs(F.col("_2"), 2))
        # A window found twice repeats five 4-word runs: few texts go on to the 8-word windows.
        .withColumn("_8", F.when(F.size("_4") - F.size(F.array_distinct("_4")) >= k - 3, _pairs(F.col("_4"), 4)))
        .select(
            "_id", F.size("_h").cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("_lines"),
            total.alias("_sum"), n_grams.alias("_grams"), "_8", *rest,
        )
        # (hash, position) in order of hash: a window is found twice if a neighbour has the same hash.
        .withColumn("_s", F.when(F.size(F.array_distinct("_8")) < F.size("_8"), F.sort_array(F.transform("_8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    m = F.size("_s")
    same = F.zip_with(F.slice("_s", 1, m - 1), F.slice("_s", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    two = one.withColumn("_at", F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    # Positions in order: each window adds the words that the one before it doesn't cover.
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-k).alias("p")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return two.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), (F.col("_sum") / F.greatest("_grams", F.lit(1))).alias("llr"), *rest,
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr", *rest)


def kept_rows(docs: DataFrame, weight: list[float], **how) -> DataFrame:
    """The rows of docs that ``score`` keeps."""
    # A number that isn't a function of the row keeps the filter above the projections, where it can't repeat their expressions.
    judged = score(docs, weight, whole=True, **how).select("_whole", "kept", F.monotonically_increasing_id().alias("_number"))
    return judged.where(F.col("kept") & (F.col("_number") >= 0)).select("_whole.*")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, digits: int | None = None) -> DataFrame:
    """Learn the two multinomials from ``docs`` and label rows (doc_id, quality = 1 trusted), then judge every document.

    Write the result before filtering on ``kept``: pushed below the projections, a filter would repeat their expressions."""
    trusted = trusted_ids(labels, "doc_id", F.col("quality") == 1)
    return score(docs, weights(docs, trusted, id_col, text_col, buckets, orders=orders, digits=digits), id_col, text_col, threshold, orders)
