"""Queries over text: header cards, integer lists, templates, string tests; and over number ranges: windows, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, headers, mathx, strings
from ..sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


_LIST = "concat(o_orderkey % 50, '-', o_orderkey % 50 + o_orderkey % 7, ',', o_custkey % 30, ':3:', o_custkey % 30 + 12, ', ', o_orderkey % 90)"


@query("""SELECT o_orderkey, list_concat(list_concat(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 7 + 1), range(o_custkey % 30, o_custkey % 30 + 13, 3)), [o_orderkey % 90]) AS ints FROM orders""")
def str_to_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", strings.str_to_ints(F.expr(_LIST)).alias("ints"))


@query("""SELECT o_orderkey, list_sort(list_distinct(list_concat(list_concat(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 7 + 1), range(o_custkey % 30, o_custkey % 30 + 13, 3)), [o_orderkey % 90]))) AS ints FROM orders""")
def ints_to_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = strings.ints_to_str(strings.str_to_ints(F.expr(_LIST)))
    return load(spark, sf_dir, "orders").select("o_orderkey", strings.str_to_ints(text).alias("ints"))


@query("""WITH p AS (SELECT o_custkey, unnest(string_split(printf('cam_%02d_%s_%d', o_custkey % 3, CASE WHEN o_orderstatus = 'F' THEN 'dark' ELSE 'flat' END, o_orderkey % 4), '_')) AS part, unnest(range(4)) AS pos FROM orders),
k AS (SELECT pos, list_sort(list(DISTINCT part)) AS kinds FROM p GROUP BY ALL), n AS (SELECT *, sum(CASE WHEN len(kinds) > 1 THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS i FROM k)
SELECT string_agg(CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE '%' || i END, '_' ORDER BY pos) AS template, list(kinds ORDER BY pos) FILTER (len(kinds) > 1) AS values FROM n""")
def file_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "dark").otherwise("flat")
    names = o.select(strings.file_name("cam_%02d_%s_%d", F.col("o_custkey") % 3, kind, F.col("o_orderkey") % 4).alias("name"))
    return strings.template(names, "name")


@query("""SELECT event_id, rpad(rpad('VALUE', 8, ' ') || '= ' || lpad(event_id::VARCHAR, 20, ' ') || ' / ' || event_type, 80, ' ') AS card, 'VALUE' AS key, event_id::VARCHAR AS value, event_type AS comment,
rpad('TYPE    = ''' || rpad(event_type, 8, ' ') || '''', 80, ' ') AS text_card, event_type AS text_value FROM events""")
def header_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    card = headers.make_card(F.lit("value"), headers.value_text(F.col("event_id"), "bigint"), F.col("event_type"))
    text = headers.make_card(F.lit("type"), headers.value_text(F.col("event_type"), "string"))
    cards = e.select("event_id", card.alias("card"), text.alias("text_card"))
    split = headers.split_card(F.col("card"))
    return cards.select("event_id", "card", split["key"].alias("key"), split["value"].alias("value"), split["comment"].alias("comment"), "text_card",
                        headers.lookup(F.array("card", "text_card"), "TYPE").alias("text_value"))


@query("""SELECT c_custkey, c_mktsegment AS seg, regexp_matches(c_mktsegment, '^[A-Za-z]*$') AS alpha, regexp_matches(c_name, '^[A-Za-z0-9]*$') AS alnum, contains(upper(c_name), 'CUSTOMER') AS has, lpad(lower(printf('%X', c_custkey)), 6, '0') AS hex,
lpad(printf('%b', c_custkey), 16, '0') AS bits, repeat('.', ((20 - length(c_mktsegment) + 1) // 2)) || c_mktsegment || repeat('.', ((20 - length(c_mktsegment)) // 2)) AS centred FROM customer""")
def string_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seg, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", seg.alias("seg"), strings.only_alpha(seg).alias("alpha"), strings.only_alnum(name).alias("alnum"), strings.contains(name, "customer", True).alias("has"),
        strings.hex_string(key, 6).alias("hex"), strings.bit_string(key, 16).alias("bits"), strings.align_center(seg, 20, ".").alias("centred"))


@query("""SELECT i::INT AS i, round(0.5 - 0.5 * cos(pi() * i / 63), 6) AS hann, round(exp(-((i - 32) * (i - 32)) / (2 * pow(12 / (2 * sqrt(2 * ln(2))), 2))), 6) AS gauss, round(36 / ((i - 32) * (i - 32) + 36), 6) AS lorentz,
round(0.5 - 0.5 * cos(pi() * (i + 1) / 65), 6) AS ramp FROM (SELECT unnest(range(64)) AS i)""")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    return spark.range(64).select(F.col("id").cast("int").alias("i")).select(
        "i", r(mathx.hann(i, 64)).alias("hann"), r(mathx.gauss(i, 12.0, 32.0)).alias("gauss"), r(mathx.lorentz(i, 12.0, 32.0)).alias("lorentz"), r(mathx.apodize_ramp(i, 64)).alias("ramp"))


@query("""WITH j AS (SELECT unnest(range(1, 201)) AS j), n AS (SELECT j, floor((sqrt(8 * j - 7) - 1) / 2)::INT AS n FROM j), k AS (SELECT j, n, j - n * (n + 1) // 2 AS k FROM n)
SELECT j::INT AS j, n, (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END * (n % 2 + 2 * ((k - 1 + (n + 1) % 2) // 2)))::INT AS m, j::INT AS back FROM k""")
def noll_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = spark.range(1, 201).select(F.col("id").cast("int").alias("j"))
    nm = j.select("j", mathx.noll_n(F.col("j")).alias("n"), mathx.noll_m(F.col("j")).alias("m"))
    return nm.select("j", "n", "m", mathx.noll_j(F.col("n"), F.col("m")).alias("back"))


@query("""SELECT p_partkey, bit_count(p_partkey)::INT AS bits, CASE WHEN p_partkey <= 1 THEN 1 ELSE (1 << ceil(log2(p_partkey))::INT)::INT END AS pow2, CASE WHEN p_partkey = 0 THEN 0 ELSE bit_count(xor(p_partkey, p_partkey - 1)) END::INT AS low, greatest(least(round(p_retailprice), 32767), -32768)::SMALLINT AS short FROM part""")
def bit_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        "p_partkey", arrays.bit_count(k).alias("bits"), arrays.next_power_of_two(k).alias("pow2"), arrays.lowest_set_bit(k).alias("low"), arrays.saturate(F.col("p_retailprice"), "smallint").alias("short"))


@query("""SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS host, list_last(string_split(string_split(string_split(url, '#')[1], '?')[1], '/')) AS name, replace(url, 'example', 'site') AS swapped FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    bare = F.regexp_replace(url, "^[a-z]+://", "")
    return load(spark, sf_dir, "pages").select("page_id", strings.pop_word(bare, "/")["word"].alias("host"), F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1).alias("name"),
                                               strings.replace_n(url, "example", "site").alias("swapped"))


@query("""WITH n AS (SELECT unnest(range(40)) AS n), k AS (SELECT n, unnest(range(n + 1)) AS k FROM n) SELECT n, k, (list_product(list_prepend(1, list_transform(range(1, least(k, n - k) + 1), lambda i: (n - least(k, n - k) + i) / i))))::BIGINT AS choose FROM k""")
def n_choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    nk = spark.range(40).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), "n")).alias("k"))
    return nk.select("n", "k", mathx.n_choose_k(F.col("n"), F.col("k")).alias("choose"))
