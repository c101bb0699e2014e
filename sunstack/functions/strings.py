"""String functions: class tests, integer lists, templates, padding and parsing."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_digits(s: Column) -> Column:
    return s.rlike("^[0-9]*$")


def only_alpha(s: Column) -> Column:
    return s.rlike("^[A-Za-z]*$")


def only_alnum(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9]*$")


def only_hex(s: Column) -> Column:
    return s.rlike("^[0-9A-Fa-f]*$")


def is_integer(s: Column) -> Column:
    return s.rlike("^[+-]?[0-9]+$")


def is_hex(s: Column) -> Column:
    return s.rlike("^(0[xX])?[0-9A-Fa-f]+$")


def contains(s: Column, needle: str, ignore_case: bool = False) -> Column:
    return F.upper(s).contains(needle.upper()) if ignore_case else s.contains(needle)


def replace_n(s: Column, needle: str, by: str, n: int | None = None) -> Column:
    """Replace the first n occurrences (all if None), left to right; what was put in is not searched again."""
    if n is None:
        return F.replace(s, F.lit(needle), F.lit(by))
    parts = F.split(s, re.escape(needle))
    k = F.least(F.lit(n) + 1, F.size(parts))
    head, tail = F.slice(parts, 1, k), F.slice(parts, k + 1, F.size(parts))
    return F.concat(F.array_join(head, by), F.when(F.size(tail) > 0, F.concat(F.lit(needle), F.array_join(tail, needle))).otherwise(F.lit("")))


def pop_word(s: Column, sep: str = " ") -> Column:
    """first word and rest of a line."""
    line = F.ltrim(s, F.lit(sep))
    return F.struct(F.substring_index(line, sep, 1).alias("word"), F.when(F.instr(line, sep) > 0, F.regexp_replace(line, f"^[^{re.escape(sep)}]*{re.escape(sep)}", "")).otherwise(F.lit("")).alias("rest"))


def align_left(s: Column, n: int, c: str = " ") -> Column:
    return F.when(F.length(s) >= n, F.substring(s, 1, n)).otherwise(F.rpad(s, n, c))


def align_right(s: Column, n: int, c: str = " ") -> Column:
    return F.when(F.length(s) >= n, F.substring(s, 1, n)).otherwise(F.lpad(s, n, c))


def align_center(s: Column, n: int, c: str = " ") -> Column:
    """An odd number of pads leaves one more on the left."""
    left = F.ceil((F.lit(n) - F.length(s)) / 2).cast("int")
    return F.when(F.length(s) >= n, F.substring(s, 1, n)).otherwise(F.rpad(F.concat(F.repeat(F.lit(c), left), s), n, c))


def parse_number(s: Column, kind: str = "double") -> Column:
    """A number of the given type, or null; blanks around it, nan and signed inf are accepted."""
    t = F.lower(F.trim(s))
    if kind in ("double", "float"):
        return F.when(t.isin("nan"), F.lit(float("nan"))).when(t.isin("inf", "+inf"), F.lit(float("inf"))).when(t == "-inf", F.lit(float("-inf"))).otherwise(t.try_cast(kind))
    return t.try_cast(kind)


def parse_bool(s: Column) -> Column:
    """T/true/yes, F/false/no or a number (0 is false)."""
    t = F.lower(F.trim(s))
    return F.when(t.isin("t", "true", "yes"), True).when(t.isin("f", "false", "no"), False).otherwise(t.try_cast("double") != 0)


def flag_bool(s: Column) -> Column:
    """Configuration flags: an empty value, true, yes, y and 1 are true."""
    return F.lower(F.trim(s)).isin("", "true", "yes", "y", "1")


def hex_string(v: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(v)), digits, "0")


def bit_string(v: Column, bits: int) -> Column:
    return F.lpad(F.bin(v), bits, "0")


def str_to_ints(s: Column) -> Column:
    """"1-3,7,10:2:16" to integers: lists by comma or blank, a-b, a:b and a:step:b; a downward range is the upward one reversed."""
    def one(part: Column) -> Column:
        n = F.regexp_extract_all(part, F.lit("([0-9]+)"), 1)
        num = lambda i: F.get(n, i).cast("bigint")
        stepped = part.rlike("^[0-9]+:[0-9]+:[0-9]+$")
        a, b = num(0), F.when(stepped, num(2)).otherwise(F.coalesce(num(1), num(0)))
        up = F.sequence(F.least(a, b), F.greatest(a, b), F.when(stepped, F.greatest(num(1), F.lit(1).cast("bigint"))).otherwise(F.lit(1).cast("bigint")))
        return F.when(a > b, F.reverse(up)).otherwise(up)

    parts = F.filter(F.split(F.trim(s), "[, ]+"), lambda p: p.rlike("^[0-9][0-9:-]*$"))
    return F.flatten(F.transform(parts, one))


def ints_to_str(v: Column) -> Column:
    return compress_ranges(v)


def compress_ranges(numbers: Column) -> Column:
    """Sorted distinct integers as text: three or more of one step become a-b (step 1) or a:step:b; a pair gives up its first only."""
    zero = F.struct(F.lit("").alias("out"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("step"), F.lit(0).alias("n"))
    text = lambda c: c.cast("string")

    def put(s: Column, part: Column) -> Column:
        return F.concat(s["out"], F.when(s["out"] == "", F.lit("")).otherwise(F.lit(",")), part)

    def run(s: Column) -> Column:
        return F.when(s["step"] == 1, F.concat(text(s["a"]), F.lit("-"), text(s["b"]))).otherwise(F.concat_ws(":", text(s["a"]), text(s["step"]), text(s["b"])))

    def closed(s: Column) -> Column:
        last = F.when(s["n"] == 1, text(s["a"])).when(s["n"] == 2, F.concat_ws(",", text(s["a"]), text(s["b"]))).otherwise(run(s))
        return F.when(s["n"] == 0, s["out"]).otherwise(put(s, last))

    def step(s: Column, v: Column) -> Column:
        one = F.lit(1)
        longer = F.struct(s["out"].alias("out"), s["a"].alias("a"), v.alias("b"), (v - s["b"]).alias("step"), (s["n"] + 1).alias("n"))
        pair = F.struct(put(s, text(s["a"])).alias("out"), s["b"].alias("a"), v.alias("b"), (v - s["b"]).alias("step"), (one + 1).alias("n"))
        first = F.struct(closed(s).alias("out"), v.alias("a"), v.alias("b"), F.lit(0).cast("bigint").alias("step"), one.alias("n"))
        same = (s["n"] == 1) | ((s["n"] > 1) & (v - s["b"] == s["step"]))
        return F.when(same, longer).when(s["n"] == 2, pair).otherwise(first)

    return F.aggregate(F.array_sort(F.array_distinct(numbers)), zero, step, closed)


def unique_ints(v: Column) -> Column:
    return F.array_sort(F.array_distinct(v))


def template(df: DataFrame, text: str, split: str = "_") -> DataFrame:
    """One row (template, values): segments that vary become %1, %2 ...; values lists what each stood for.

    Segments are grouped by position, so the number of texts is no limit."""
    own = F.split(text, re.escape(split))
    first = df.select(F.min(F.struct(F.col(text).alias("t"), F.size(own).alias("n"))).alias("f")).select(F.col("f.n").alias("_n"))
    same = df.join(F.broadcast(first), F.size(own) == F.col("_n"))  # one row; texts of another number of segments don't count
    parts = same.select(F.posexplode(own).alias("pos", "part"))
    kinds = parts.groupBy("pos").agg(F.array_sort(F.collect_set("part")).alias("kinds"))
    rows = kinds.agg(F.array_sort(F.collect_list(F.struct("pos", "kinds"))).alias("s"))
    varies = F.filter("s", lambda x: F.size(x["kinds"]) > 1)
    name = F.transform("s", lambda x: F.when(F.size(x["kinds"]) == 1, F.get(x["kinds"], 0)).otherwise(F.concat(F.lit("%"), F.array_position(F.transform(varies, lambda v: v["pos"]), x["pos"]).cast("string"))))
    return rows.select(F.array_join(name, split).alias("template"), F.transform(varies, lambda x: x["kinds"]).alias("values"))


def file_name(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def clean_path(s: Column) -> Column:
    """Without doubled slashes, "." parts and "name/.." pairs."""
    out = F.regexp_replace(F.regexp_replace(s, "/+", "/"), r"(?<=^|/)\./", "")
    for _ in range(8):
        out = F.regexp_replace(out, r"(^|/)(?!\.\./)[^/]+/\.\.(/|$)", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"/\.$", "/"), r"(.)/$", "$1")


def is_relative(s: Column) -> Column:
    return ~s.rlike("^[/~]")


def print_array(v: Column, sep: str = ", ") -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), sep), F.lit("]"))


def uints_to_text(numbers: Iterable[int]) -> str:
    """The driver-side form of ``ints_to_str``."""
    own, out, i = sorted(set(numbers)), [], 0
    while i < len(own):
        j, step = i, own[i + 1] - own[i] if i + 1 < len(own) else 0
        while j + 1 < len(own) and own[j + 1] - own[j] == step:
            j += 1
        if j - i >= 2:
            out.append(f"{own[i]}-{own[j]}" if step == 1 else f"{own[i]}:{step}:{own[j]}")
            i = j + 1
        else:
            out.append(str(own[i]))
            i += 1
    return ",".join(out)


def text_to_uints(text: str) -> list[int]:
    """The driver-side form of ``str_to_ints``."""
    out: list[int] = []
    for part in re.split(r"[,\s]+", text.strip()):
        if not re.fullmatch(r"[0-9][0-9:-]*", part):
            continue
        n = [int(x) for x in re.findall(r"\d+", part)]
        stepped = re.fullmatch(r"\d+:\d+:\d+", part)
        a, b, step = (n[0], n[2], max(1, n[1])) if stepped else (n[0], n[-1], 1)
        own = list(range(min(a, b), max(a, b) + 1, step))
        out += own[::-1] if a > b else own
    return out
