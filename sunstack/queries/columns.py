"""Queries over column functions: header cards and times, regions and intervals, array views, parsing, paths, solar angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, dates, geometry, headers, mathx, strings
from ..sources.tables import frames, load

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


_CARD = "rpad(rpad('{}', 8, ' ') || '= ' || lpad(({})::VARCHAR, 20, ' '), 80, ' ')"
_ABC = f"""c AS (SELECT event_id, {_CARD.format('A', 'event_id')} AS a, {_CARD.format('B', 'user_id')} AS b, {_CARD.format('C', 'event_id + 1')} AS c, {_CARD.format('B', 'user_id + 7')} AS b2,
{_CARD.format('D', 'event_id * 2')} AS d FROM events)"""


@query(f"""WITH {_ABC} SELECT event_id, rtrim(a) || '|' || rtrim(b) || '|' || rtrim(c) || '|' || rtrim(d) AS added, rtrim(a) || '|' || rtrim(c) AS removed, 1::INT AS at_b, -1::INT AS at_x,
rtrim(a) || '|' || rtrim(d) || '|' || rtrim(b) || '|' || rtrim(c) AS inserted, rtrim(a) || '|' || rtrim(b) || '|' || rtrim(d) || '|' || rtrim(c) AS after_b, rtrim(d) || '|' || rtrim(a) || '|' || rtrim(b) || '|' || rtrim(c) AS before_a,
rtrim(a) || '|' || rtrim(b2) || '|' || rtrim(c) AS updated, rtrim(a) || '|' || rtrim(b) || '|' || rtrim(c) || '|' || rtrim(d) AS emplaced, length(a || b || c)::INT // 80 AS n_cards FROM c""")
def header_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda key, v: headers.make_card(F.lit(key), headers.value_text(v, "bigint"))
    i, u = F.col("event_id"), F.col("user_id")
    e = load(spark, sf_dir, "events").select("event_id", F.array(make("a", i), make("b", u), make("c", i + 1)).alias("cards"), make("b", u + 7).alias("b2"), make("d", i * 2).alias("d"))
    text = lambda c: headers.text_of(c, "|")
    cards, b2, d = F.col("cards"), F.col("b2"), F.col("d")
    return e.select(
        "event_id", text(headers.add(cards, d)).alias("added"), text(headers.remove(cards, "b")).alias("removed"), headers.position(cards, "b").alias("at_b"), headers.position(cards, "x").alias("at_x"),
        text(headers.insert(cards, d, 1)).alias("inserted"), text(headers.insert_after(cards, d, "b")).alias("after_b"), text(headers.insert_before(cards, d, "a")).alias("before_a"),
        text(headers.update(cards, b2)).alias("updated"), text(headers.emplace(cards, d)).alias("emplaced"), F.size(headers.to_cards(F.array_join(cards, ""))).alias("n_cards"))


@query("""WITH n AS (SELECT p_partkey, p_name || '/' || p_type || '/' || p_brand AS t FROM part), k AS (SELECT *, greatest(ceil(length(t) / 7.0), 1)::BIGINT AS n FROM n)
SELECT p_partkey, list_transform(range(1, n + 1), lambda i: substr(t, (i - 1) * 7 + 1, 7) || CASE WHEN i < n THEN '&' ELSE '' END) AS parts, t AS whole FROM k""")
def long_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("/", "p_name", "p_type", "p_brand")
    p = load(spark, sf_dir, "part").select("p_partkey", headers.split_long(text, 7).alias("parts"))
    return p.select("p_partkey", "parts", headers.merge_long(F.col("parts")).alias("whole"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END::INT AS n_frames, strftime(ts, '%Y.%m.%d %H:%M:%S') AS first_text, strftime(ts, '%Y.%m.%d %H:%M:%S') AS last_text,
CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS exposure, epoch_us(ts) - 1000000 AS start_us, epoch_us(ts) + 2000000 + CASE WHEN event_id % 2 = 0 THEN 250000 ELSE 500000 END AS end_us,
epoch_us(ts) + 500000 + CASE WHEN event_id % 2 = 0 THEN 125000 ELSE 250000 END AS mean_us, [epoch_us(ts), epoch_us(ts) + 250000, epoch_us(ts) + 500000] AS starts_us,
CASE WHEN event_id % 2 = 0 THEN [3::BIGINT, 4::BIGINT, 5::BIGINT, 9::BIGINT] ELSE [event_id, event_id + 2, event_id + 4] END AS numbers,
round(CASE WHEN event_id % 3 = 0 OR user_id <= 1 THEN value ELSE value / user_id END, 6) AS normal FROM events""")
def header_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    stamp = F.date_format(ts, "yyyy.MM.dd HH:mm:ss")
    text = F.concat(F.lit("Ts="), stamp, F.lit(" x Te="), stamp, F.when(i % 3 != 0, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" SUM= "))).otherwise(F.lit("")))
    e = load(spark, sf_dir, "events").withColumn("text", text).withColumn("x", headers.exposure(F.when(i % 2 == 0, 0.0).otherwise(0.5), F.lit(0.25)))
    table = F.array(dates.add_seconds(ts, F.lit(-1)), dates.add_seconds(ts, F.lit(2)))
    none = F.lit(None).cast("timestamp")
    return e.select(
        "event_id", headers.frame_count(F.col("text")).alias("n_frames"), headers.begin_time(F.col("text")).alias("first_text"), headers.end_time(F.col("text")).alias("last_text"), F.col("x").alias("exposure"),
        F.unix_micros(headers.start_time(none, table)).alias("start_us"), F.unix_micros(headers.end_of(none, table, F.col("x"))).alias("end_us"), F.unix_micros(headers.average_time(none, table, F.col("x"))).alias("mean_us"),
        F.transform(headers.start_times(ts, F.lit(0.25), F.lit(3)), lambda t: F.unix_micros(t)).alias("starts_us"),
        headers.frame_numbers(F.when(i % 2 == 0, "3-5,9").otherwise(F.lit("")), i, F.lit(2).cast("bigint"), F.lit(3).cast("bigint")).alias("numbers"),
        r(F.get(headers.normalize_summed(F.array("value"), F.col("text")), 0)).alias("normal"))


_BOX = "p_partkey % 9 AS ay0, p_size % 7 AS ax0, p_partkey % 9 + 4 AS ay1, p_size % 7 + 5 AS ax1, p_size % 11 AS by0, p_partkey % 5 AS bx0, p_size % 11 + 3 AS by1, p_partkey % 5 + 6 AS bx1"


@query(f"""WITH b AS (SELECT p_partkey, {_BOX} FROM part), i AS (SELECT *, greatest(ay0, by0) AS iy0, greatest(ax0, bx0) AS ix0, least(ay1, by1) AS iy1, least(ax1, bx1) AS ix1 FROM b)
SELECT p_partkey, CASE WHEN iy0 <= iy1 AND ix0 <= ix1 THEN (iy1 - iy0 + 1) * (ix1 - ix0 + 1) END AS common_area, (greatest(ay1, by1) - least(ay0, by0) + 1) * (greatest(ax1, bx1) - least(ax0, bx0) + 1) AS hull_area,
by0 BETWEEN ay0 AND ay1 AND bx0 BETWEEN ax0 AND ax1 AS holds_corner, (7 * 8)::BIGINT AS grown_area, (3 * 4)::BIGINT AS shrunk_area, true AS gone, ay0 + 2 AS gy, ax0 + 3 AS gx, sqrt((by0 - ay0) * (by0 - ay0) + (bx0 - ax0) * (bx0 - ax0))::DECIMAL(18, 6)::DOUBLE AS distance FROM i""")
def region_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    # Corners in the wrong order are put right.
    a, b = geometry.region(k % 9 + 4, s % 7, k % 9, s % 7 + 5), geometry.region(s % 11, k % 5, s % 11 + 3, k % 5 + 6)
    p = load(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    far = geometry.to_global(a, F.lit(2), F.lit(3))
    corner, other = geometry.point(a["y0"], a["x0"]), geometry.point(b["y0"], b["x0"])
    return p.select(
        "p_partkey", geometry.area(geometry.intersect(a, b)).alias("common_area"), geometry.area(geometry.enclose(a, b)).alias("hull_area"), geometry.inside(a, b["y0"], b["x0"]).alias("holds_corner"),
        geometry.area(geometry.grow(a, 1)).alias("grown_area"), geometry.area(geometry.grow(a, -1)).alias("shrunk_area"), geometry.grow(a, -9).isNull().alias("gone"), far["y"].alias("gy"), far["x"].alias("gx"),
        r(geometry.norm(geometry.subtract(other, corner))).alias("distance"))


@query("""SELECT p_partkey, p_retailprice / 10 AS y, (p_size * 1.5)::DOUBLE AS x, round(p_retailprice / 10) AS ry, round(p_retailprice / 10 - round(p_retailprice / 10), 6) AS rest_y, round(p_retailprice / 5 + 1, 6) AS sy, round((p_size * 3.0 + 2)::DOUBLE, 6) AS sx,
greatest(abs(p_retailprice / 10), abs((p_size * 1.5)::DOUBLE)) AS largest, round(abs(p_retailprice / 10) + abs(p_size * 1.5), 6) AS city FROM part""")
def point_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.point(F.col("p_retailprice") / 10, F.col("p_size") * 1.5)
    whole, rest = geometry.round_point(p), geometry.rest(p)
    total = geometry.add(geometry.scale(p, 2.0), geometry.point(F.lit(1.0), F.lit(2.0)))
    return load(spark, sf_dir, "part").select("p_partkey", p["y"].alias("y"), p["x"].alias("x"), whole["y"].alias("ry"), r(rest["y"]).alias("rest_y"), r(total["y"]).alias("sy"), r(total["x"]).alias("sx"),
                                              geometry.max_norm(p).alias("largest"), r(geometry.city_norm(p)).alias("city"))


@query("""WITH i AS (SELECT event_id, event_id % 10 AS alo, event_id % 10 + 4 AS ahi, user_id % 9 AS blo, user_id % 9 + 3 AS bhi, value % 12 AS v FROM events)
SELECT event_id, v >= alo AND v <= ahi AS closed, v > alo AND v < ahi AS open, ahi >= blo AND bhi >= alo AS meet, CASE WHEN ahi >= blo AND bhi >= alo THEN least(ahi, bhi) - greatest(alo, blo) END::DOUBLE AS common,
CASE WHEN ahi >= blo AND bhi >= alo THEN greatest(ahi, bhi) - least(alo, blo) END::DOUBLE AS hull FROM i""")
def interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    alo, blo = F.col("event_id") % 10, F.col("user_id") % 9
    e = load(spark, sf_dir, "events").select("event_id", geometry.interval(d(alo), d(alo + 4)).alias("a"), geometry.interval(d(alo), d(alo + 4), False, False).alias("o"), geometry.interval(d(blo), d(blo + 3)).alias("b"), (F.col("value") % 12).alias("v"))
    a, b, meet = F.col("a"), F.col("b"), geometry.overlaps(F.col("a"), F.col("b"))
    length = lambda i: F.when(meet, i["hi"] - i["lo"])
    safe = F.when(meet, b).otherwise(a)  # disjoint intervals are an error
    return e.select("event_id", geometry.contains(a, F.col("v")).alias("closed"), geometry.contains(F.col("o"), F.col("v")).alias("open"), meet.alias("meet"),
                    length(geometry.common(a, safe)).alias("common"), length(geometry.joined(a, safe)).alias("hull"))


@query("""WITH c AS (SELECT p_partkey, p_size + p_retailprice / 1000 AS y, p_size * 2 - p_retailprice / 700 AS x FROM part)
SELECT p_partkey, (round(y) - 4)::INT AS y0, (round(x) - 4)::INT AS x0, (round(y) + 3)::INT AS y1, (round(x) + 3)::INT AS x1, round(y - round(y), 6) AS rest_y, round(x - round(x), 6) AS rest_x FROM c""")
def cut_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = geometry.cut_geometry(F.col("p_size"), F.col("p_size") * 2, F.col("p_retailprice") / 1000, -F.col("p_retailprice") / 700, 4)
    g = load(spark, sf_dir, "part").select("p_partkey", cut.alias("g"))
    return g.select("p_partkey", "g.y0", "g.x0", "g.y1", "g.x1", r(F.col("g.rest_y")).alias("rest_y"), r(F.col("g.rest_x")).alias("rest_x"))


@query("""WITH f AS (SELECT label AS channel, vec_id AS frame_no, list_transform(embedding, lambda e: 1 + e::DOUBLE) AS px FROM embeddings), g AS (SELECT *, list_reverse(px) AS q FROM f)
SELECT channel, frame_no, list_transform(range(64), lambda i: 2.5::DOUBLE) AS filled, list_transform(px, lambda v: v::FLOAT) AS narrow, list_slice(px, 4, 11) AS shifted,
list_transform(range(1, 65), lambda i: round(px[i] + q[i], 6)) AS summed, list_transform(range(1, 65), lambda i: round(px[i] * q[i], 6)) AS product, list_transform(px, lambda v: CASE WHEN v < 1 THEN 0.0::DOUBLE ELSE v END) AS cut, px[2 * 8 + 3 + 1] AS pixel,
list_transform(range(100), lambda i: CASE WHEN i // 10 BETWEEN 1 AND 8 AND i % 10 BETWEEN 2 AND 9 THEN px[((i // 10) - 1) * 8 + (i % 10 - 2) + 1] ELSE 0.0::DOUBLE END) AS placed,
list_sum(list_transform(px, lambda v: CASE WHEN v = 0 THEN 0 ELSE 1 END)) = 0 AS zero, len(list_filter(px, lambda v: abs(v) >= 3)) = 0 AS small, px = q AS palindrome FROM g""")
def array_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("q", F.reverse("px"))
    px, q = F.col("px"), F.col("q")
    six = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return f.select(
        "channel", "frame_no", arrays.fill(64, 2.5).alias("filled"), arrays.cast(px, "float").alias("narrow"), arrays.shift_view(px, 3, 8).alias("shifted"), six(arrays.elementwise(px, q, lambda a, b: a + b)).alias("summed"),
        six(arrays.elementwise(px, q, lambda a, b: a * b)).alias("product"), arrays.fill_where(px, 0.0, lambda v: v < 1).alias("cut"), arrays.at(px, 8, F.lit(2), F.lit(3)).alias("pixel"),
        arrays.insert(px, 8, 8, 10, 10, 1, 2).alias("placed"), arrays.all_zero(px).alias("zero"), arrays.all_smaller(px, 3.0).alias("small"), (px == q).alias("palindrome"))


@query("""SELECT p_partkey, ((p_partkey & 255) * 16777216 + ((p_partkey >> 8) & 255) * 65536 + ((p_partkey >> 16) & 255) * 256 + ((p_partkey >> 24) & 255))::BIGINT AS swapped, p_partkey AS back FROM part""")
def endian_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", arrays.swap_bytes(F.col("p_partkey"), 4).alias("swapped"))
    return p.select("p_partkey", "swapped", arrays.swap_bytes(F.col("swapped"), 4).alias("back"))


_TEXT = """CASE event_id % 8 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1.5e3' WHEN 2 THEN 'nan' WHEN 3 THEN '-INF' WHEN 4 THEN 'yes' WHEN 5 THEN 'x1' WHEN 6 THEN '99999999999' ELSE '' END"""


@query(f"""WITH t AS (SELECT event_id, trim({_TEXT}) AS t FROM events)
SELECT event_id, CASE lower(t) WHEN 'nan' THEN 'nan' WHEN '-inf' THEN '-inf' ELSE TRY_CAST(t AS DOUBLE)::DECIMAL(20, 2)::VARCHAR END AS number, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN TRY_CAST(t AS INT) END AS whole,
CASE WHEN lower(t) IN ('t', 'true', 'yes') THEN true WHEN lower(t) IN ('f', 'false', 'no') THEN false ELSE TRY_CAST(CASE WHEN lower(t) IN ('nan', '-inf') THEN NULL ELSE t END AS DOUBLE) != 0 END AS told, lower(t) IN ('', 'true', 'yes', 'y', '1') AS flag FROM t""")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(_TEXT)
    e = load(spark, sf_dir, "events").select("event_id", t.alias("t"))
    number = strings.parse_number(F.col("t"))
    shown = F.when(F.isnan(number), "nan").when(number == float("-inf"), "-inf").otherwise(number.cast("decimal(20,2)").cast("string"))
    odd = F.lower(F.trim("t")).isin("nan", "-inf")
    return e.select("event_id", shown.alias("number"), strings.parse_number(F.col("t"), "int").alias("whole"), F.when(~odd, strings.parse_bool(F.col("t"))).alias("told"), strings.flag_bool(F.col("t")).alias("flag"))


@query("""SELECT o_orderkey, '[' || o_orderkey || ', ' || o_custkey || ', ' || o_orderstatus || ']' AS printed, 'a/' || o_custkey || '/c' AS cleaned, o_orderkey % 2 = 0 AS relative FROM orders""")
def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    path = F.concat(F.lit("a//./b/../"), c, F.lit("/d/../c/."))
    return o.select("o_orderkey", strings.print_array(F.array(k, c, F.col("o_orderstatus"))).alias("printed"), strings.clean_path(path).alias("cleaned"),
                    strings.is_relative(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.lit("/")), c)).alias("relative"))


@query("""SELECT o_orderkey, epoch_us(o_orderdate) + 1500000 AS later_us, 1.5::DOUBLE AS between_s, o_orderdate + INTERVAL 1500 MILLISECOND > o_orderdate AS after, date_trunc('second', o_orderdate) = o_orderdate AS whole FROM orders""")
def time_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    later = dates.add_seconds(t, F.lit(1.5))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(later).alias("later_us"), dates.seconds_between(t, later).alias("between_s"), (later > t).alias("after"), (F.date_trunc("second", t) == t).alias("whole"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice = l_extendedprice * (1 + 1e-9) OR abs(l_extendedprice - l_extendedprice * (1 + 1e-9)) <= 1e-6 * l_extendedprice * (1 + 1e-9) AS near, l_tax * 1.01 = l_tax AS same,
round(l_quantity * pi() * pi() / 648000 * 0.06 * 0.97 * 1e6, 6) AS tilt, round(-l_quantity * pi() * 0.02 * 0.02 / (8 * sqrt(3)) * 1e6, 6) AS focus FROM lineitem""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", mathx.almost_equal(p, p * (1 + 1e-9), 1e-6).alias("near"), mathx.almost_equal(F.col("l_tax") * 1.01, F.col("l_tax")).alias("same"),
        r(q * mathx.pix2cf(0.06, 0.97) * 1e6).alias("tilt"), r(q / mathx.cf2def(0.02) * 1e6).alias("focus"))


@query("""WITH RECURSIVE p AS (SELECT x, y, x / 24.0::DOUBLE - 2.0::DOUBLE AS x0, y / 24.0::DOUBLE - 1.3::DOUBLE AS y0 FROM range(64) a(x), range(64) b(y)),
z AS (SELECT x, y, x0, y0, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0 AS n FROM p UNION ALL SELECT x, y, x0, y0, u * u - v * v + x0, 2.0::DOUBLE * u * v + y0, n + 1 FROM z WHERE n < 60 AND u * u + v * v <= 4)
SELECT x, y, max(n)::INT AS n FROM z GROUP BY ALL""")
def mandelbrot_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    return p.select("x", "y", mathx.mandelbrot(F.col("x") / 24.0 - 2.0, F.col("y") / 24.0 - 1.3, 60).alias("n"))


@query("""WITH j AS (SELECT event_id, epoch_us(ts) / 86400000000.0 + 2440587.5 AS jd FROM events), t AS (SELECT *, (jd - 2451545.0) / 36525.0 AS t FROM j),
a AS (SELECT *, radians(357.52911 + 35999.05029 * t - 0.0001537 * t * t) AS m, radians(23.439291111 - (46.8150 * t + 0.00059 * t * t - 0.001813 * t * t * t) / 3600.0) AS e FROM t),
c AS (SELECT *, (1.914602 - 0.004817 * t) * sin(m) + (0.019993 - 0.000101 * t) * sin(2 * m) + 0.000289 * sin(3 * m) AS c, 0.016708634 - 0.000042037 * t AS ec FROM a),
l AS (SELECT *, 1.000001018 * (1 - ec * ec) / (1 + ec * cos(m + radians(c))) AS r, 280.46646 + 36000.76983 * t + 0.0003032 * t * t + c - 0.00569 - 0.00478 * sin(radians(125.04 - 1934.136 * t)) AS raw FROM c),
k AS (SELECT *, radians(raw - 360 * floor(raw / 360)) AS lon, radians(73.6667 + 1.3958333 * (jd - 2396758.0) / 36525.0) AS node FROM l),
p AS (SELECT *, degrees(atan(-cos(lon) * tan(e)) + atan(-cos(lon - node) * tan(radians(7.25)))) AS p, degrees(asin(sin(lon - node) * sin(radians(7.25)))) AS b0, 959.63 / r AS radius, degrees(atan2(cos(e) * sin(lon), cos(lon))) AS ra0, degrees(asin(sin(e) * sin(lon))) AS dec FROM k),
h AS (SELECT *, asin(least(sqrt(300.0 * 300.0 + 200.0 * 200.0) / radius, 1)) AS rho, atan2(-300.0, -200.0) - radians(p) AS th FROM p),
g AS (SELECT *, asin(sin(radians(b0)) * cos(rho) + cos(radians(b0)) * sin(rho) * cos(th)) AS lat FROM h)
SELECT event_id, round(p, 4) AS p, round(b0, 4) AS b0, round(radius, 4) AS radius, round(ra0 - 360 * floor(ra0 / 360), 4) AS ra, round(dec, 4) AS dec, round(degrees(lat), 4) AS lat, round(degrees(asin(sin(rho) * sin(-th) / cos(lat))), 4) AS lon FROM g""")
def solar_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    jd = dates.julian_day(F.col("ts"))
    p, b0, radius = dates.sun_pb(jd)
    ra, dec = dates.sun_position(jd)
    lat, lon = dates.to_heliographic(F.lit(300.0), F.lit(-200.0), radius, p, b0)
    return load(spark, sf_dir, "events").select("event_id", *[r(c, 4).alias(n) for c, n in ((p, "p"), (b0, "b0"), (radius, "radius"), (ra, "ra"), (dec, "dec"), (lat, "lat"), (lon, "lon"))])


@query("""SELECT event_id, round(degrees(atan2(sin(radians(value)), tan(radians(28.75)) * cos(radians(user_id % 20)) - sin(radians(user_id % 20)) * cos(radians(value)))), 5) AS tilt,
round(1.02 / tan(radians(abs(value) % 80 + 5 + 10.3 / (abs(value) % 80 + 5 + 5.11))) / 60, 6) AS refraction FROM events""")
def local_tilts(spark: SparkSession, sf_dir: str) -> DataFrame:
    altitude = F.abs("value") % 80 + 5
    return load(spark, sf_dir, "events").select("event_id", r(dates.local_tilt(F.col("value"), F.col("user_id") % 20, 28.75), 5).alias("tilt"), r(dates.refraction(altitude)).alias("refraction"))


@query("""WITH f AS (SELECT label AS channel, vec_id AS frame_no, list_transform(embedding, lambda e: 1 + e::DOUBLE) AS px FROM embeddings), g AS (SELECT *, list_reverse(px) AS q FROM f)
SELECT channel, frame_no, list_transform(range(64), lambda i: round(px[((i // 4) % 4) * 16 + (i % 4) * 4 + i // 16 + 1], 6)) AS permuted, list_transform(range(1, 65), lambda i: round(px[i] * q[i] * 0.25, 6)) AS product,
list_transform(list_filter(range(64), lambda i: abs(i // 8 - 1) <= 2 AND abs(i % 8 - 6) <= 2), lambda i: round(px[i + 1], 6)) AS near, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i % 3 = 0 THEN px[i] ELSE 0 END)), 5) AS total,
round(list_avg(list_transform(list_filter(range(1, 65), lambda i: i % 3 = 0), lambda i: px[i])), 6) AS mean, list_transform(list_filter(range(64), lambda i: i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5), lambda i: round(px[i + 1], 6)) AS middle FROM g""")
def array_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    px, mask = F.col("px"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 3 == 0).cast("int"))
    six = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return f.select(
        "channel", "frame_no", six(arrays.permute(px, (4, 4, 4), (2, 0, 1))).alias("permuted"), six(arrays.weighted_multiply(px, F.reverse(px), 0.25)).alias("product"),
        six(arrays.neighbourhood(px, 8, 8, F.lit(1), F.lit(6), 2)).alias("near"), r(arrays.masked_total(px, mask), 5).alias("total"), r(arrays.masked_mean(px, mask)).alias("mean"),
        six(arrays.without_border(px, 8, 8, 2)).alias("middle"))
