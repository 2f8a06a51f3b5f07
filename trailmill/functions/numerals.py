"""Numbers in text as column expressions: Han numerals, amounts with units, spans of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Han digits and powers, unit sizes by dimension, the amount pattern.
HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_POWERS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
UNITS = {
    "ml": ("volume", 1.0), "毫升": ("volume", 1.0), "l": ("volume", 1000.0), "升": ("volume", 1000.0),
    "g": ("mass", 1.0), "克": ("mass", 1.0), "kg": ("mass", 1000.0), "千克": ("mass", 1000.0), "公斤": ("mass", 1000.0),
    "mm": ("length", 1.0), "毫米": ("length", 1.0), "cm": ("length", 10.0), "厘米": ("length", 10.0), "m": ("length", 1000.0), "米": ("length", 1000.0),
}
AMOUNT = r"(\d+(?:\.\d+)?)\s*(ml|毫升|l|升|kg|千克|公斤|g|克|mm|毫米|cm|厘米|m|米)"
HAN_NUMBER = "[" + "".join([*HAN_DIGITS, *HAN_POWERS]) + "]+"


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _below_ten_thousand(text: Column) -> Column:
    """The value of a numeral without 万: every power counts by the digit right before it (1 if there is none), then the last digit."""
    digits, small = "".join(HAN_DIGITS), "".join(c for c in HAN_POWERS if c != "万")
    terms = F.regexp_extract_all(text, F.lit(f"([{digits}]?[{small}])"), 1)
    digit, power = _lookup(HAN_DIGITS), _lookup(HAN_POWERS)
    value = lambda t: F.when(F.length(t) == 1, power[t]).otherwise(F.greatest(digit[F.left(t, F.lit(1))], F.lit(1)) * power[F.right(t, F.lit(1))])
    units = digit[F.nullif(F.regexp_extract(text, f"([{digits}])$", 1), F.lit(""))]
    return F.aggregate(F.transform(terms, value), F.lit(0).cast("long"), lambda s, v: s + v) + F.coalesce(units, F.lit(0))


def han_number(text: Column) -> Column:
    """STR16: the integer a Han numeral names; null for an empty text or any other character.

    The numeral is cut at 万; each part is read by its smaller powers, and every part before a 万 counts ten
    thousand times, 1 at least.
    """
    parts = F.split(text, "万", -1)
    high = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.greatest(_below_ten_thousand(x), F.lit(1)) * F.lit(HAN_POWERS["万"]))
    value = F.aggregate(high, F.lit(0).cast("long"), lambda s, v: s + v) + _below_ten_thousand(F.element_at(parts, -1))
    return F.when(text.rlike(f"^{HAN_NUMBER}$"), value)


def amounts(text: Column, unit: str) -> Column:
    """STR17: every amount of the unit's dimension in the text, in the dimension's base unit."""
    same = {u: size for u, (dimension, size) in UNITS.items() if dimension == UNITS[unit][0]}
    low, size = F.lower(text), _lookup(same)
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(AMOUNT), F.lit(1)).alias("v"), F.regexp_extract_all(low, F.lit(AMOUNT), F.lit(2)).alias("u"))
    return F.filter(F.transform(pairs, lambda p: p["v"].cast("double") * size[p["u"]]), lambda x: x.isNotNull())


def amount_verdict(text: Column, operator: str, value: float, unit: str, upper: float | None = None, tolerance: float = 0.0) -> Column:
    """STR17: whether an amount of the text lies in the interval an operator stands for; unverifiable without amounts.

    eq, min, max and range are the closed intervals [value, value], [value, ∞), (-∞, value] and [value, upper], each
    widened by the tolerance on both sides. Unknown units and operators are unverifiable.
    """
    if not (tolerance >= 0 and tolerance != float("inf")):
        raise ValueError(f"a tolerance of {tolerance} makes no interval")
    low = {"eq": value, "min": value, "range": value, "max": float("-inf")}.get(operator)
    high = {"eq": value, "max": value, "range": value if upper is None else upper, "min": float("inf")}.get(operator)
    if low is None or high is None or unit not in UNITS:
        return F.lit("unverifiable")
    size, found = UNITS[unit][1], amounts(text, unit)
    inside = F.exists(found, lambda x: x.between(low * size - tolerance, high * size + tolerance))
    return F.when(F.size(found) > 0, F.when(inside, "pass").otherwise("fail")).otherwise("unverifiable")


def spans(text: Column, value: str) -> Column:
    """STR21: start and end (exclusive, from 0) of each place of the value in the text, case apart, without overlaps."""
    n = len(value)
    if not n:
        return F.when(text.isNotNull(), F.array().cast("array<struct<start:int,end:int>>"))
    pieces = F.split(F.lower(text), "\\Q" + value.lower() + "\\E", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        start = (s["at"] + F.length(piece)).cast("int")
        one = F.struct(start.alias("start"), (start + n).cast("int").alias("end"))
        return F.struct((start + n).cast("int").alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    found = F.aggregate(pieces, zero, step, lambda s: s["out"])
    return F.slice(found, 1, F.size(found) - 1)


def places(text: Column, value: Column) -> Column:
    """STR21 with the value as a column: its places as spans(); none for a value that is null or empty."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    low, n = F.lower(value), F.length(value)
    quoted = F.regexp_replace(low, r"([^\p{L}\p{N}])", r"\\$1")
    pieces = F.split(F.lower(text), quoted, F.lit(-1))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, piece: Column) -> Column:
        start = (s["at"] + F.length(piece)).cast("int")
        one = F.struct(start.alias("start"), (start + n).cast("int").alias("end"))
        return F.struct((start + n).cast("int").alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    found = F.aggregate(pieces, zero, step, lambda s: s["out"])
    return F.when(n > 0, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(none)
