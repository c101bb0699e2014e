"""Header cards of 80 characters: make, split, look up, edit, and what times they tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import strings

WIDTH = 80


def value_text(v: Column, kind: str) -> Column:
    """Text of a value: T/F right-aligned to 20, numbers right-aligned to 20, strings quoted with doubled quotes."""
    if kind == "boolean":
        return F.lpad(F.when(v, "T").otherwise("F"), 20, " ")
    if kind == "string":
        text = F.replace(v, F.lit("'"), F.lit("''"))
        return F.concat(F.lit("'"), F.rpad(text, F.greatest(F.length(text), F.lit(8)), F.lit(" ")), F.lit("'"))
    if kind == "timestamp":
        return F.concat(F.lit("'"), F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("'"))
    return F.lpad(v.cast("string"), 20, " ")


def make_card(key: Column, text: Column, comment: Column | None = None) -> Column:
    """An 80-character card; keys are cut to 8, upper-cased, and other characters than A-Z, 0-9, - and _ are an error."""
    name = F.upper(F.substring(key, 1, 8))
    body = F.concat(F.rpad(name, 8, " "), F.lit("= "), text)
    if comment is not None:
        body = F.concat(body, F.when(F.length(comment) > 0, F.concat(F.lit(" / "), comment)).otherwise(F.lit("")))
    return F.when(name.rlike("^[A-Z0-9_-]+$"), F.substring(F.rpad(body, WIDTH, " "), 1, WIDTH)).otherwise(F.raise_error(F.concat(F.lit("bad card key: "), key)).cast("string"))


def split_card(card: Column) -> Column:
    """key, value (unquoted) and comment; a slash inside quotes is part of the value."""
    key = F.rtrim(F.substring(card, 1, 8))
    rest = F.substring(card, 11, WIDTH)
    quoted = F.regexp_extract(rest, "^ *'((?:[^']|'')*)'", 1)
    plain = F.trim(F.regexp_extract(rest, "^([^/]*)", 1))
    is_quoted = rest.rlike("^ *'")
    comment = F.trim(F.when(is_quoted, F.regexp_extract(rest, "^ *'(?:[^']|'')*' *(?:/ ?(.*))?$", 1)).otherwise(F.regexp_extract(rest, "^[^/]*/ ?(.*)$", 1)))
    return F.struct(key.alias("key"), F.when(is_quoted, F.rtrim(F.replace(quoted, F.lit("''"), F.lit("'")))).otherwise(plain).alias("value"), comment.alias("comment"))


def lookup(cards: Column, key: str) -> Column:
    """Value of the first card of a key, or null."""
    found = F.filter(cards, lambda c: F.rtrim(F.substring(c, 1, 8)) == key.upper())
    return split_card(F.get(found, 0))["value"]


def add(cards: Column, card: Column) -> Column:
    return F.concat(cards, F.array(card))


def remove(cards: Column, key: str) -> Column:
    return F.filter(cards, lambda c: F.rtrim(F.substring(c, 1, 8)) != key.upper())


def position(cards: Column, key: str) -> Column:
    """Position of a key from 0, or -1."""
    return F.array_position(F.transform(cards, lambda c: F.rtrim(F.substring(c, 1, 8))), key.upper()).cast("int") - 1


def insert(cards: Column, card: Column, at: Column | int) -> Column:
    n = F.least(F.lit(at) if isinstance(at, int) else at, F.size(cards))
    return F.concat(F.slice(cards, 1, n), F.array(card), F.slice(cards, n + 1, F.size(cards)))


def insert_after(cards: Column, card: Column, key: str) -> Column:
    p = position(cards, key)
    return F.when(p < 0, add(cards, card)).otherwise(insert(cards, card, p + 1))


def insert_before(cards: Column, card: Column, key: str) -> Column:
    p = position(cards, key)
    return F.when(p < 0, add(cards, card)).otherwise(insert(cards, card, p))


def update(cards: Column, card: Column) -> Column:
    """Put the card in place of those of its key."""
    return F.transform(cards, lambda c: F.when(F.substring(c, 1, 8) == F.substring(card, 1, 8), card).otherwise(c))


def emplace(cards: Column, card: Column) -> Column:
    """Update, or add if the key is new."""
    return F.when(F.exists(cards, lambda c: F.substring(c, 1, 8) == F.substring(card, 1, 8)), update(cards, card)).otherwise(add(cards, card))


def split_long(text: Column, size: int = 67) -> Column:
    """Parts of a long string; every part but the last ends in &."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1))
    return F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.concat(F.substring(text, ((i - 1) * size + 1).cast("int"), F.lit(size)), F.when(i < n, "&").otherwise("")))


def merge_long(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.regexp_replace(p, "&$", "")).otherwise(p)), "")


def text_of(cards: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(cards, lambda c: F.rtrim(c)), sep)


def to_cards(text: Column) -> Column:
    """Header text as cards, by 80 characters."""
    return F.regexp_extract_all(F.rpad(text, (F.ceil(F.length(text) / WIDTH) * WIDTH).cast("int"), " "), F.lit("(?s)(.{80})"), 1)


def frame_count(text: Column) -> Column:
    """Number of frames summed, from "16 SUM=" in old headers; 1 if it isn't told."""
    return F.coalesce(F.regexp_extract(text, "([0-9]+)[ .]+SUM[= ]+", 1).try_cast("int"), F.lit(1))


def begin_time(text: Column) -> Column:
    return F.regexp_extract(text, "Ts=([0-9.]+[ T][0-9:.]+)", 1)


def end_time(text: Column) -> Column:
    return F.regexp_extract(text, "Te=([0-9.]+[ T][0-9:.]+)", 1)


def exposure(xposure: Column, exptime: Column) -> Column:
    return F.coalesce(F.nullif(xposure, F.lit(0.0)), exptime)


def start_time(card: Column, table: Column) -> Column:
    return F.coalesce(card, F.array_min(table))


def end_of(card: Column, table: Column, exposure_s: Column) -> Column:
    last = F.array_max(table)
    return F.coalesce(card, F.timestamp_micros((F.unix_micros(last) + exposure_s * 1_000_000).cast("bigint")))


def average_time(card: Column, table: Column, exposure_s: Column) -> Column:
    mean = F.aggregate(table, F.lit(0).cast("decimal(38,0)"), lambda a, t: (a + F.unix_micros(t)).cast("decimal(38,0)")) / F.size(table)
    return F.coalesce(card, F.timestamp_micros((mean.cast("double") + exposure_s * 500_000).cast("bigint")))


def frame_numbers(ranges: Column, start: Column, step: Column, n: Column) -> Column:
    """From a range text, else start, start + step ..."""
    return F.when(F.length(ranges) > 0, strings.str_to_ints(ranges)).otherwise(F.sequence(start, start + (n - 1) * step, step))


def start_times(start: Column, exposure_s: Column, n: Column) -> Column:
    """Start times of n frames one exposure apart."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.timestamp_micros((F.unix_micros(start) + i * exposure_s * 1_000_000).cast("bigint")))


def normalize_summed(px: Column, text: Column) -> Column:
    n = frame_count(text)
    return F.when(n > 1, F.transform(px, lambda v: v / n)).otherwise(px)
