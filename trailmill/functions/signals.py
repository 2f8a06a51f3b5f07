"""What a request says outright: amounts with units, budgets, words that bind, soften or exclude."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numerals import HAN_DIGITS, HAN_POWERS

# Words of a request.
CURRENCY = ("人民币", "块钱", "元", "块")
MEASURES = ("厘米", "毫米", "cm", "mm", "kg", "公斤", "克", "g", "ml", "毫升", "升", "l", "米", "m", "英寸", "寸", "个", "件", "套", "盒", "包", "袋", "支", "瓶", "片", "对", "双")
SIZES = {"千": 1_000, "万": 10_000}
TOPICS = ("预算", "价格", "价位", "售价", "心里价格")
HOLD = "控制"
NEARLY = ("大概", "大约", "约")
LINKS = ("在", "为", "是")
TO = ("到", "至", "-", "~", "～", "—", "–")
AT_MOST = ("不超过", "至多", "最多", "低于", "小于", "以内", "以下", "之内", "及以内")
ABOUT = ("左右", "上下", "大约", "约", "多", "出头")
AT_MOST_NEARBY = ("不超过", "不得超过", "别超过", "不要超", "不超", "至多", "最多", "以内", "以下", "之内", "低于", "小于", "不到", "控在")
SOFT = ("最好", "优先", "尽量", "左右", "上下", "大约", "约", "差不多")
HARD = ("必须", "需要", "要", "不能", "不要", "不超过", "以内", "以下")
NEGATIVE = ("不要", "不能", "不含", "无", "避免")
#: Characters on either side of a budget that may bound it.
NEARBY = 8


def _any(words) -> str:
    return "(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


def _then(words) -> re.Pattern:
    """Spaces, then one of the words or nothing."""
    return re.compile(r"\s*" + _any(words) + "?")


_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_UNIT = re.compile(r"\s*" + _any(CURRENCY + MEASURES) + _any(("以内", "以下", "不超过", "至多", "最多", "以上", "至少", "左右", "上下", "大约", "约")) + "?", re.IGNORECASE)
_HAN = re.compile("[" + "".join([*HAN_DIGITS, *HAN_POWERS]) + "]+")
_TOPIC = re.compile(_any(TOPICS))
_HOLD, _NEARLY, _LINK, _SIZE, _MONEY, _OVER, _TO = (_then(w) for w in ((HOLD,), NEARLY, LINKS, SIZES, CURRENCY, ("多", "出头"), TO))
_FIRST = _then(("不超过", "至多", "最多", "低于", "小于"))
_LAST = _then([w for w in AT_MOST if w not in ("低于", "小于")] + list(ABOUT))
_GAP = re.compile(r"\s*")
_MARKS = {kind: [re.compile(re.escape(w)) for w in words] for kind, words in (("hard", HARD), ("soft", SOFT), ("negative", NEGATIVE))}

SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
AMOUNT = T.StructType([T.StructField("text", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("qualifier", T.StringType()), *SPAN.fields[1:]])
_FACT = {"operator": T.StringType(), "priority": T.StringType(), "value": T.DoubleType(), "low": T.DoubleType(), "high": T.DoubleType(), "unit": T.StringType(), "qualifier": T.StringType()}
FACT = T.StructType([T.StructField(n, t) for n, t in _FACT.items()] + SPAN.fields)
SIGNALS = T.StructType([
    T.StructField("amounts", T.ArrayType(AMOUNT)), T.StructField("budgets", T.ArrayType(FACT)),
    *[T.StructField(kind, T.ArrayType(SPAN)) for kind in _MARKS],
])


class Reader:
    """Reads a text forward, pattern by pattern."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def word(self, pattern: re.Pattern) -> str:
        """The word at the place, empty if there is none; spaces before it are read in any case."""
        m = pattern.match(self.text, self.at)
        self.at = m.end()
        return m[1] or ""

    def number(self) -> str:
        start = _GAP.match(self.text, self.at).end()
        m = _NUMBER.match(self.text, start)
        if not m:
            return ""
        self.at = m.end()
        return m[0]


class Places:
    """Spans that hold without overlaps, in order."""

    def __init__(self):
        self.held: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.held, (start, end))
        return not any(s < end and start < e for s, e in self.held[max(0, i - 1) : i + 1])

    def hold(self, start: int, end: int) -> None:
        insort(self.held, (start, end))


def han_value(numeral: str) -> int:
    """What a Han numeral names: parts before each 万 count ten thousand times, 1 at least."""

    def part(p: str) -> int:
        terms = re.findall("([" + "".join(HAN_DIGITS) + "]?)([十百千])", p)
        return sum(max(HAN_DIGITS.get(d, 1), 1) * HAN_POWERS[power] for d, power in terms) + HAN_DIGITS.get(p[-1:], 0)

    *high, low = numeral.split("万")
    return sum(max(part(p), 1) * HAN_POWERS["万"] for p in high) + part(low)


def bound(text: str, start: int, end: int, word: str) -> tuple[str, str]:
    """Operator and priority of a budget: by its own word, else by the words around it."""
    if word in AT_MOST:
        return "lte", "hard"
    around = text[max(0, start - NEARBY) : end + NEARBY]
    if word not in ABOUT and any(w in around for w in AT_MOST_NEARBY):
        return "lte", "soft" if any(w in around for w in SOFT) else "hard"
    return "approx", "soft"


def _ranges(text: str, numbers: list[re.Match]) -> Iterator[tuple[int, int, float, float, str]]:
    at = 0
    for a, b in zip(numbers, numbers[1:]):
        if a.start() < at:
            continue
        r = Reader(text, a.end())
        r.word(_MONEY)
        if r.word(_TO) and _GAP.match(text, r.at).end() == b.start():
            r.at = b.end()
            if unit := r.word(_MONEY):
                yield a.start(), r.at, float(a[0]), float(b[0]), unit
                at = r.at


def _topical(text: str) -> Iterator[tuple[int, int, float, str, str]]:
    """Numbers behind a topic: 预算(控制)大概在不超过100千元以内, all but topic and number at will."""
    at = 0
    for topic in _TOPIC.finditer(text):
        if topic.start() < at:
            continue
        r = Reader(text, topic.end())
        if topic[0] == "预算" and text.startswith(HOLD, r.at):
            r.at += len(HOLD)
        for skipped in (_HOLD, _NEARLY, _LINK):
            r.word(skipped)
        first = r.word(_FIRST)
        if number := r.number():
            value = float(number) * SIZES.get(r.word(_SIZE), 1)
            unit, last = r.word(_MONEY), r.word(_LAST)
            yield topic.start(), r.at, value, unit or "元", first or last
            at = r.at


def _in_han(text: str) -> Iterator[tuple[int, int, float, str, str]]:
    for numeral in _HAN.finditer(text):
        r = Reader(text, numeral.end())
        over, unit = r.word(_OVER), r.word(_MONEY)
        if unit:
            last = r.word(_LAST)
            yield numeral.start(), r.at, float(han_value(numeral[0])), unit, last or over


def stated_of(said: str) -> tuple[list[dict], list[dict]]:
    """STR15: amounts with units, and budgets, of a stripped text.

    Budgets are looked for as ranges of money, as amounts of money, behind a topic, as Han numerals of money; one
    that overlaps a budget found before goes. Places count in the stripped text.
    """
    text = said.strip()
    numbers = list(_NUMBER.finditer(text))
    places, amounts, budgets = Places(), [], []

    def fact(start, end, unit, word, value=None, low=None, high=None):
        if low is None:
            if not places.free(start, end):
                return
            operator, priority = bound(text, start, end, word)
        else:
            operator, priority = "between", "hard"
        places.hold(start, end)
        budgets.append({"operator": operator, "priority": priority, "value": value, "low": low, "high": high, "unit": unit, "qualifier": word or None, "text": text[start:end], "start": start, "end": end})

    for start, end, a, b, unit in _ranges(text, numbers):
        fact(start, end, unit, "", low=min(a, b), high=max(a, b))
    for n in numbers:
        m = _UNIT.match(text, n.end())
        if m:
            amounts.append({"text": text[n.start() : m.end()], "value": float(n[0]), "unit": m[1], "qualifier": m[2], "start": n.start(), "end": m.end()})
            if m[1] in CURRENCY:
                fact(n.start(), m.end(), m[1], m[2] or "", value=float(n[0]))
    for found in (_topical, _in_han):
        for start, end, value, unit, word in found(text):
            fact(start, end, unit, word, value=value)
    return amounts, sorted(budgets, key=lambda b: (b["start"], b["end"]))


def signals_of(said: str | None) -> dict | None:
    """STR15: what stated_of() finds, and binding, softening and excluding words of a stripped text; null for a null."""
    if said is None:
        return None
    text = said.strip()
    amounts, budgets = stated_of(text)
    marks = {kind: sorted(({"text": m[0], "start": m.start(), "end": m.end()} for p in patterns for m in p.finditer(text)), key=lambda s: (s["start"], s["end"])) for kind, patterns in _MARKS.items()}
    return {"amounts": amounts, "budgets": budgets, **marks}


@F.pandas_udf(SIGNALS)
def _signals(said: pd.Series) -> pd.DataFrame:
    rows = [signals_of(s) or dict.fromkeys(SIGNALS.names) for s in said]
    return pd.DataFrame(rows, columns=SIGNALS.names)


def signals(said: Column) -> Column:
    """STR15: signals_of() as a struct of arrays, all of them null for a null text."""
    return _signals(said)


@F.pandas_udf(T.ArrayType(FACT))
def _budgets(said: pd.Series) -> pd.Series:
    return said.map(lambda s: None if s is None else stated_of(s)[1])


def budgets(said: Column) -> Column:
    """STR15: the budgets of signals() alone; texts without a numeral never reach Python."""
    numeral = said.rlike(r"(?U)\d|" + _HAN.pattern)
    return F.when(numeral, _budgets(F.when(numeral, said))).when(said.isNotNull(), F.array().cast(T.ArrayType(FACT)))


def money(a: Column) -> Column:
    """Number as text, without a fraction if it is whole."""
    return F.when(a == F.floor(a), a.cast("decimal(38,0)").cast("string")).otherwise(a.cast("string"))
