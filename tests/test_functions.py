"""Column functions on small examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sunstack.functions import arrays, geometry, headers, mathx, strings


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict(recursive=True)


def test_integer_lists(spark):
    for text, want in (("1-3,7,10:2:14", [1, 2, 3, 7, 10, 12, 14]), ("5-2 9", [5, 4, 3, 2, 9]), ("10:3:2", [8, 5, 2]), ("", []), ("4", [4]), ("x,2", [2])):
        assert strings.text_to_uints(text) == want == one(spark, v=strings.str_to_ints(F.lit(text)))["v"]
    for numbers, want in (([1, 3, 4, 5], "1,3-5"), ([1, 2], "1,2"), ([9, 5, 7, 5], "5:2:9"), ([1, 2, 4, 6, 8, 9], "1,2:2:8,9"), ([], ""), ([3], "3")):
        got = one(spark, v=strings.ints_to_str(F.array(*[F.lit(n).cast("bigint") for n in numbers]).cast("array<bigint>")))["v"]
        assert strings.uints_to_text(numbers) == want == got
        assert strings.text_to_uints(want) == sorted(set(numbers))


def test_strings(spark):
    got = one(
        spark, a=strings.replace_n(F.lit("aXbXcX"), "X", "XY", 2), b=strings.replace_n(F.lit("aXb"), "X", ""), c=strings.align_center(F.lit("ab"), 5, "."), d=strings.align_right(F.lit("abcdef"), 3),
        e=strings.parse_bool(F.lit("Yes")), f=strings.parse_number(F.lit(" -INF ")), g=strings.parse_number(F.lit("99999999999"), "int"), h=strings.clean_path(F.lit("/a//b/./c/../d/")),
        i=strings.is_relative(F.lit("a/b")), j=strings.pop_word(F.lit("first rest of it")), k=strings.flag_bool(F.lit("")), m=strings.print_array(F.array(F.lit(1), F.lit(2))), n=strings.only_hex(F.lit("0fG")),
    )
    assert got == {"a": "aXYbXYcX", "b": "ab", "c": "..ab.", "d": "abc", "e": True, "f": float("-inf"), "g": None, "h": "/a/b/d", "i": True,
                   "j": {"word": "first", "rest": "rest of it"}, "k": True, "m": "[1, 2]", "n": False}


def test_template(spark):
    df = spark.createDataFrame([("cam_1_dark.f0",), ("cam_2_dark.f0",), ("odd",), ("cam_2_dark.f0",)], "n string")
    assert strings.template(df, "n").first().asDict() == {"template": "cam_%1_dark.f0", "values": [["1", "2"]]}


def test_cards(spark):
    card = lambda k, v: headers.make_card(F.lit(k), headers.value_text(F.lit(v), "string"))
    cards = F.array(card("a", "1"), card("b", "it's a/b"))
    got = one(
        spark, x=headers.lookup(cards, "B"), n=F.length(card("a", "1")), p=headers.position(cards, "b"), q=headers.position(cards, "z"),
        r=F.size(headers.remove(cards, "a")), s=headers.lookup(headers.emplace(cards, card("a", "9")), "A"), t=F.size(headers.emplace(cards, card("c", "9"))),
        u=headers.position(headers.insert_before(cards, card("c", "3"), "b"), "c"), v=headers.position(headers.insert_after(cards, card("c", "3"), "b"), "c"),
        w=headers.merge_long(headers.split_long(F.lit("abcdefg"), 3)), y=headers.split_long(F.lit("abcdefg"), 3), z=headers.frame_count(F.lit("x 16 SUM= y")),
    )
    assert got == {"x": "it's a/b", "n": 80, "p": 1, "q": -1, "r": 1, "s": "9", "t": 3, "u": 1, "v": 2, "w": "abcdefg", "y": ["abc&", "def&", "g"], "z": 16}
    with pytest.raises(Exception, match="bad card key"):
        one(spark, x=card("a b", "1"))


def test_times(spark):
    row = spark.sql("""SELECT array(timestamp'2020-01-01 00:00:10', timestamp'2020-01-01 00:00:20') AS t, CAST(NULL AS timestamp) AS c""")
    got = row.select(
        headers.start_time(F.col("c"), F.col("t")).alias("a"), headers.end_of(F.col("c"), F.col("t"), F.lit(2.0)).alias("b"), headers.average_time(F.col("c"), F.col("t"), F.lit(2.0)).alias("m"),
        headers.exposure(F.lit(0.0), F.lit(3.0)).alias("e"), headers.frame_numbers(F.lit(""), F.lit(5), F.lit(2), F.lit(3)).alias("n"), F.size(headers.start_times(F.col("t")[0], F.lit(0.5), F.lit(4))).alias("k")).first()
    assert [str(got[i]) for i in range(3)] == ["2020-01-01 00:00:10", "2020-01-01 00:00:22", "2020-01-01 00:00:16"] and got["e"] == 3.0 and got["n"] == [5, 7, 9] and got["k"] == 4


def test_arrays(spark):
    px = F.array(*[F.lit(float(i)) for i in range(6)])
    got = one(
        spark, a=arrays.crop(px, 3, 0, 1, 1, 2), b=arrays.clip(px, 3, (3, 2, 1, 2)), c=arrays.insert(F.array(F.lit(7.0)), 1, 1, 2, 2, 1, 0), d=arrays.reverse_y(px, 2, 3),
        e=arrays.swap_bytes(F.lit(258), 2), f=arrays.next_power_of_two(F.lit(17)), g=arrays.lowest_set_bit(F.lit(12)), h=arrays.at(px, 3, F.lit(1), F.lit(2)), i=arrays.at(px, 3, F.lit(2), F.lit(2)),
        j=arrays.saturate(F.lit(300.7), "tinyint"), k=arrays.fill_where(px, -1.0, lambda v: v > 3), m=arrays.safe_divide(px, F.array(*[F.lit(0.0)] * 6)),
    )
    assert got == {"a": [1, 2, 4, 5], "b": [2, 1, 5, 4], "c": [0, 0, 7, 0], "d": [3, 4, 5, 0, 1, 2], "e": 513, "f": 32, "g": 3, "h": 5, "i": None, "j": 127, "k": [0, 1, 2, 3, -1, -1], "m": [0] * 6}
    assert arrays.segment(8, 91, 32, 8) == [8, 28, 49, 70, 91] and arrays.segment(5, 5, 9, 1) == [5] and arrays.segment(0, 3, 100, 0) == [0, 3]
    with pytest.raises(Exception, match="arrays differ in size"):
        one(spark, x=arrays.elementwise(px, F.array(F.lit(1.0)), lambda a, b: a + b))
    r = {}
    for v in range(14):
        r[v] = one(spark, a=arrays.restrict(F.lit(v), 5, 0), b=arrays.restrict_periodic(F.lit(v), 0, 5), c=arrays.restrict_reflected(F.lit(v), 0, 5))
    assert [r[v]["a"] for v in range(14)] == [0, 1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 5, 5, 5]
    assert [r[v]["b"] for v in range(14)] == [v % 5 for v in range(14)]
    assert [r[v]["c"] for v in range(14)] == [0, 1, 2, 3, 4, 5, 4, 3, 2, 1, 0, 1, 2, 3]


def test_regions_and_intervals(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    a, b, far = geometry.region(*lit(5, 5, 0, 0)), geometry.region(*lit(3, 4, 9, 9)), geometry.region(*lit(20, 20, 30, 30))
    i, j, open_ = geometry.interval(*lit(3.0, 9.0)), geometry.interval(*lit(9.0, 12.0)), geometry.interval(*lit(9.0, 12.0), lo_in=False)
    got = one(spark, a=geometry.intersect(a, b), b=geometry.intersect(a, far), c=geometry.area(geometry.enclose(a, b)), d=geometry.inside(a, *lit(0, 5)), e=geometry.grow(a, -3), f=geometry.to_global(b, *lit(1, 1)),
              g=geometry.contains(i, F.lit(9.0)), h=geometry.overlaps(i, j), k=geometry.overlaps(i, open_), m=geometry.joined(i, j)["hi"], n=geometry.common(i, j)["lo"])
    assert got == {"a": {"y0": 3, "x0": 4, "y1": 5, "x1": 5}, "b": None, "c": 100, "d": True, "e": None, "f": {"y": 4, "x": 5}, "g": True, "h": True, "k": False, "m": 12.0, "n": 9.0}
    with pytest.raises(Exception, match="disjoint"):
        one(spark, x=geometry.common(i, open_))


def test_profiles(spark):
    got = one(spark, a=mathx.gauss(F.lit(3.0), 6.0), b=mathx.lorentz(F.lit(3.0), 6.0), c=mathx.lorentz(F.lit(3.0), 6.0, cavities=2.0), d=mathx.hann(F.lit(4), 9), e=mathx.apodize(2.0, 0.0, F.lit(8), 9),
              f=mathx.almost_equal(F.lit(1.0), F.lit(1.0 + 2**-52)), g=mathx.n_choose_k(F.lit(52), F.lit(5)))
    assert {k: round(v, 9) for k, v in got.items()} == {"a": 0.5, "b": 0.5, "c": 0.5, "d": 0.5, "e": 0.0, "f": True, "g": 2598960}
    assert mathx.pix2cf(0.1, 1.0) * mathx.cf2pix(0.1, 1.0) == pytest.approx(1)


def test_upper_median_is_exact(spark):
    import random

    from sunstack.operators import stack

    rng = random.Random(3)
    values = {k: [rng.choice((rng.random(), 0.5, 0.25)) for _ in range(n)] for k, n in enumerate((1, 2, 3, 10, 999, 1000, 20_001))}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k int, v double").repartition(5)
    got = {r["k"]: r["median"] for r in stack.upper_median(df, "k", "v").collect()}
    assert got == {k: sorted(own)[len(own) // 2] for k, own in values.items()}
