"""Prices in text: amounts found once, then judged by the words to their left and right."""

from __future__ import annotations

import hashlib
import math
import random
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words about prices. A topic may open a phrase; leads stand before an amount, tails after it.
TOPICS = ("预算", "价格")
LINKS = ("控制在", "控制", "要", "得", "需", "需要")
AT_MOST = ("不超过", "不要超过", "别超", "不能超过", "不得超过", "不可超过", "不高于", "最高", "至多", "封顶在", "封顶")
AT_LEAST = ("不低于", "至少", "最低", "不少于", "高于", "超过")
WITHIN = ("以内", "以下", "之内")
FROM = ("以上", "起")
AROUND = ("左右", "上下")
TO = ("-", "~", "～", "至", "到")
SCALE = {"万": 10_000.0, "千": 1_000.0, "k": 1_000.0, "K": 1_000.0}
#: What is allowed above a round budget that is only about right.
ABOUT = 1.1

_TYPES = {"rule": T.StringType(), "operator": T.StringType(), "hardness": T.StringType(), "low": T.DoubleType(), "high": T.DoubleType(), "start": T.IntegerType(), "end": T.IntegerType(), "text": T.StringType()}
CANDIDATE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _TYPES.items()]))
_YUAN = r"\s*元?"
_AMOUNT = re.compile(r"(\d+(?:\.\d+)?)\s*([万千kK])?")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


class Amount(NamedTuple):
    """A number with its scale; end is behind the scale and the space before it."""

    start: int
    end: int
    number: float
    scale: str

    @property
    def value(self) -> float:
        return self.number * SCALE.get(self.scale, 1.0)


def found_amounts(text: str) -> list[Amount]:
    return [Amount(m.start(), m.end(), float(m[1]), m[2] or "") for m in _AMOUNT.finditer(text)]


class Rule(NamedTuple):
    """How an amount is bounded: lead must end where it starts, tail must begin where it ends; short: 1万2 as one amount."""

    name: str
    operator: str
    hardness: str
    lead: re.Pattern | None
    tail: re.Pattern
    short: bool = False


_SAID = rf"{_any(TOPICS)}?\s*"
_LEAD_MOST = re.compile(_SAID + rf"{_any(LINKS)}?\s*{_any(AT_MOST)}\s*$")
_LEAD_LEAST = re.compile(_SAID + rf"{_any(AT_LEAST)}\s*$")
_LEAD_TOPIC = re.compile(rf"{_any(TOPICS)}?(?:控制)?在?\s*$")
_PLAIN = re.compile(_YUAN)
_BEHIND = {words: re.compile(_YUAN + rf"\s*{_any(words)}") for words in (WITHIN, FROM, AROUND, ("\\+",))}
_RANGE_TAIL = re.compile(_YUAN + "(?:之间)?")
_JOINT = re.compile(_YUAN + rf"\s*{_any(TO)}\s*$")

#: In order of precedence; ranges stand between the short forms and the rest.
SHORT = (
    Rule("explicit_upper_budget_rule", "lte", "hard", _LEAD_MOST, _PLAIN, True),
    Rule("explicit_upper_budget_rule", "lte", "hard", None, _BEHIND[WITHIN], True),
)
PLAIN = (
    Rule("explicit_upper_budget_rule", "lte", "hard", _LEAD_MOST, _PLAIN),
    Rule("explicit_upper_budget_rule", "lte", "hard", None, _BEHIND[WITHIN]),
    Rule("explicit_lower_price_rule", "gte", "hard", _LEAD_LEAST, _PLAIN),
    Rule("explicit_lower_price_rule", "gte", "hard", None, _BEHIND[FROM]),
    Rule("explicit_plus_lower_rule", "gte", "hard", None, _BEHIND[("\\+",)]),
    Rule("approximate_price_preference_rule", "approximately", "soft", _LEAD_TOPIC, _BEHIND[AROUND]),
)


def shortened(text: str, amounts: list[Amount]) -> list[Amount]:
    """Amounts of the form 1万2, 1万2千 and 1万2000: the rest counts thousands if it is one digit or says so."""
    out = []
    for a, b in zip(amounts, amounts[1:]):
        if a.scale == "万" and not text[a.end : b.start].strip() and b.scale in ("", "千"):
            rest = b.number * (1000 if b.scale or b.number < 10 else 1)
            out.append(Amount(a.start, b.end, a.number * SCALE["万"] + rest, ""))
    return out


def _phrases(text: str, rule: Rule, amounts: list[Amount]) -> list[tuple[int, int, Amount]]:
    """Start, end and amount of the rule's phrases from left to right, none inside another."""
    out, at = [], 0
    for a in amounts:
        if a.start < at:
            continue
        lead = rule.lead.search(text[at : a.start]) if rule.lead else None
        tail = rule.tail.match(text, a.end)
        if tail and (lead or rule.lead is None):
            start = at + lead.start() if lead else a.start
            out.append((start, tail.end(), a))
            at = tail.end()
    return out


def _ranges(text: str, amounts: list[Amount]) -> list[tuple[int, int, Amount, Amount]]:
    out, at = [], 0
    for a, b in zip(amounts, amounts[1:]):
        if a.start >= at and _JOINT.fullmatch(text[a.end : b.start]):
            end = _RANGE_TAIL.match(text, b.end).end()
            out.append((at + _LEAD_TOPIC.search(text[at : a.start]).start(), end, a, b))
            at = end
    return out


def candidates_of(text: str | None) -> list[dict]:
    """STR14: what a text says of prices, by place.

    Rules are tried in order; a phrase that overlaps one accepted before goes, but for explicit ranges, which
    stand whatever they overlap. A range needs 0 < low <= high.
    """
    amounts = found_amounts(text) if text else []
    if not amounts:
        return []
    taken: list[tuple[int, int]] = []
    out = []

    def accept(rule: str, operator: str, hardness: str, low: float | None, high: float | None, start: int, end: int) -> None:
        taken.append((start, end))
        out.append({"rule": rule, "operator": operator, "hardness": hardness, "low": low, "high": high, "start": start, "end": end, "text": text[start:end]})

    def fold(rules: tuple[Rule, ...]) -> None:
        for rule in rules:
            for start, end, a in _phrases(text, rule, shortened(text, amounts) if rule.short else amounts):
                if any(start < e and s < end for s, e in taken) or (rule.short and a.value <= 0):
                    continue
                accept(rule.name, rule.operator, rule.hardness, None if rule.operator == "lte" else a.value, None if rule.operator == "gte" else a.value, start, end)

    fold(SHORT)
    for start, end, a, b in _ranges(text, amounts):
        if 0 < a.value <= b.value:
            accept("explicit_price_range_rule", "between", "hard", a.value, b.value, start, end)
    fold(PLAIN)
    return sorted(out, key=lambda c: c["start"])


@F.pandas_udf(CANDIDATE)
def _candidates(text: pd.Series) -> pd.Series:
    return text.map(candidates_of)


def candidates(text: Column) -> Column:
    """STR14, JN15: array of (rule, operator, hardness, low, high, start, end, text); a null text has none.

    Texts without a digit never reach Python.
    """
    return F.when(text.rlike(r"(?U)\d"), _candidates(F.when(text.rlike(r"(?U)\d"), text))).otherwise(F.array().cast(CANDIDATE))


_OPEN = re.compile(r"\s*\+")
_CLOSE = re.compile(_YUAN + r"(以内|以下|内|左右)?(?!\s*[-~～至到+kK])")
_AFTER = re.compile(r"\s*(以内|以下|内|左右)?")


def upper_bound_of(text: str | None) -> float | None:
    """STR13: the upper bound in yuan that a text states for its budget or price; null without one.

    A topic (budget first, then price) bounds the amount right behind it: the end of a range, else the amount
    itself, a tenth more if only about right; an open amount such as 4k+ bounds nothing. Without a topic a bound
    needs the currency. An amount before the mark of a range that has no end is no bound.
    """
    text = (text or "").replace(",", "")
    amounts = found_amounts(text)
    behind = lambda a, words: re.search(rf"{_any(words)}(?:控制)?在?\s*$", text[: a.start])
    about = lambda value, word: value * ABOUT if word == "左右" else value
    for a, b in zip(amounts, amounts[1:]):
        whole = a.scale == "万" and a.number.is_integer() and b.number.is_integer() and not text[a.end : b.start].strip()
        if whole and b.scale in ("", "千") and behind(a, ("预算",)):
            return about(a.value + b.number * 1000, _AFTER.match(text, b.end)[1])
    for a, b in zip(amounts, amounts[1:]):
        if _JOINT.fullmatch(text[a.end : b.start]) and behind(a, TOPICS):
            if 0 < a.value <= b.value:
                return b.value
            break
    if any(a.scale in ("k", "K") and _OPEN.match(text, a.end) and behind(a, TOPICS) for a in amounts):
        return None
    for topic in TOPICS:
        for a in amounts:
            closed = _CLOSE.match(text, a.end)
            if closed and behind(a, (topic,)):
                if a.value > 0:
                    return about(a.value, closed[1])
                break
    yuan = [a for a in amounts if a.scale not in ("k", "K") and re.compile(r"\s*元").match(text, a.end)]
    most = [a for a in yuan if re.search(r"(?:不超过|不高于|最高)\s*$", text[: a.start])]
    within = [a for a in yuan if re.compile(r"\s*元(?:以内|以下)").match(text, a.end)]
    return next((found[0].value for found in (most, within) if found and found[0].value > 0), None)


@F.pandas_udf(T.DoubleType())
def _upper_bound(text: pd.Series) -> pd.Series:
    return text.map(upper_bound_of).astype("float64")


def upper_budget(text: Column) -> Column:
    """STR13: upper_bound_of() as a column; texts without a digit never reach Python."""
    bound = F.when(text.rlike(r"(?U)\d"), _upper_bound(F.when(text.rlike(r"(?U)\d"), text)))
    return F.when(~F.isnan(bound), bound)


# Up to this price there are so many round bounds to draw from, ten yuan apart; fewer above the last.
BOUNDS = {100: 3, 1000: 10, 5000: 50, 10_000: 100}
MORE_BOUNDS = 4


def drawn_upper(key: str, said: str, price: float) -> float:
    """MTH8: the stated upper bound, or one drawn above the price by a generator seeded with a digest of key and text.

    Two of the round bounds are drawn without replacement and the larger one counts. The generator is the Mersenne
    Twister, whose numbers the drawn bounds must equal.
    """
    stated = upper_bound_of(said)
    if stated is not None:
        return stated
    first = math.ceil(price / 10) * 10
    bounds = range(first, first + 10 * next((n for most, n in BOUNDS.items() if price <= most), MORE_BOUNDS), 10)
    seed = int.from_bytes(hashlib.sha256(f"{key}\0{said}".encode("utf-8", "surrogatepass")).digest()[:8], "big")
    return float(max(random.Random(seed).sample(bounds, 2)))


@F.pandas_udf(T.DoubleType())
def _drawn(key: pd.Series, said: pd.Series, price: pd.Series) -> pd.Series:
    return pd.Series([drawn_upper(k, s, p) for k, s, p in zip(key, said, price)], dtype="float64")


def price_upper(key: Column, said: Column, price: Column) -> Column:
    """MTH8: drawn_upper() as a column; null for a null key or a price that is null or not finite; a null text counts as empty."""
    fine = key.isNotNull() & (F.abs(price) < float("inf"))
    drawn = _drawn(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(said, F.lit("")), F.when(fine, price).otherwise(F.lit(0.0)))
    return F.when(fine, drawn)
