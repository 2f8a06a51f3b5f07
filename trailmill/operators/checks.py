"""Expectations: each returns a DataFrame of violations, empty when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """SRC2, SRC4: keys that stand for more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def keyset_difference(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """SET5, JN1, JN16: missing and unexpected keys."""
    missing = expected.select(key).join(got.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(got.select(key).join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET3: keys in both."""
    return a.select(key).intersect(b.select(key))


def not_in(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """FLT20: rows whose value is none of an enumeration's."""
    return df.filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """FLT1, FLT8, FLT12: the name of the first condition that holds."""
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])
    for condition, name in steps[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(otherwise)


def reasons(*rules: tuple[Column, str]) -> Column:
    """FLT2: the names of all conditions that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules])))


def open_steps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """JN15: overlapping spans of one key; an equi-join on the key bounds the range condition."""
    other = spans.select(key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    return spans.join(other, key).filter((F.col(start) < F.col("_e")) & (F.col("_s") < F.col(end)) & (F.col(start) < F.col("_s")))


_GAP = "[\\x20\\x09-\\x0D]+"
#: Words of an item's inside that stand for it when candidates are sought.
ANCHOR_WORDS = 3


def _by_words(docs: DataFrame, key: str, items: DataFrame, item_key: str) -> DataFrame:
    """Candidates by the first words inside an item: what has gaps on both sides is a whole word wherever the item stands."""
    words = F.split("__item", _GAP)
    inside = items.select(item_key, F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))).alias("__words")).filter(F.size("__words") > 0)
    anchors = inside.select(item_key, F.concat_ws(" ", F.slice("__words", 1, ANCHOR_WORDS)).alias("__gram"), F.least(F.size("__words"), F.lit(ANCHOR_WORDS)).alias("__n"))
    found = None
    split = docs.select(key, F.split("__text", _GAP).alias("__words"))
    for (n,) in anchors.select("__n").distinct().collect():  # 1 to ANCHOR_WORDS
        last = F.size("__words") - n + 1
        at = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda p: F.concat_ws(" ", F.slice("__words", p, F.lit(n)))))  # noqa: B023
        one = split.select(key, F.explode(F.array_distinct(at)).alias("__gram")).join(anchors.filter(F.col("__n") == n).drop("__n"), "__gram").select(key, item_key)
        found = one if found is None else found.unionByName(one)
    return found


def _by_heads(docs: DataFrame, key: str, items: DataFrame, item_key: str, head: int, chunk: int) -> DataFrame:
    """Candidates by an item's first characters, at every place of a text; the texts are cut into chunks, as a substring is found by walking from the start."""
    heads = items.select(item_key, F.substring("__item", 1, head).alias("__head")).filter(F.length("__head") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.length("__text"), F.lit(1)), F.lit(chunk))
    pieces = docs.select(key, F.explode(F.transform(starts, lambda p: F.substring("__text", p, F.lit(chunk + head - 1)))).alias("__piece"))
    found = None
    for (n,) in heads.select(F.length("__head")).distinct().collect():  # 1 to head
        at = F.transform(F.sequence(F.lit(1), F.lit(chunk)), lambda p: F.substring("__piece", p, F.lit(n)))  # noqa: B023
        one = pieces.select(key, F.explode(at).alias("__head")).join(heads.filter(F.length("__head") == n), "__head").select(key, item_key)
        found = one if found is None else found.unionByName(one)
    return found


def containing(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str, head: int = 24, chunk: int = 256) -> DataFrame:
    """FLT5, JN13: key and item_key of documents that contain an item verbatim, from any character on.

    Candidates come from an equi-join, before the full comparison: on the words
    inside an item, or, for items of fewer than three words, on their first
    characters at every place of a text. Null texts contain nothing, null and
    empty items stand for nothing.
    """
    texts = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"))
    wanted = items.filter(F.col(item).isNotNull()).select(item_key, F.col(item).alias("__item"))
    few = F.size(F.split("__item", _GAP)) < 3
    parts = [_by_words(texts, key, wanted.filter(~few), item_key), _by_heads(texts, key, wanted.filter(few), item_key, head, chunk)]
    pairs = None
    for part in filter(None, parts):
        pairs = part if pairs is None else pairs.unionByName(part)
    if pairs is None:  # no items
        return docs.select(key, F.lit(None).cast(items.schema[item_key].dataType).alias(item_key)).limit(0)
    return pairs.distinct().join(texts, key).join(wanted, item_key).filter(F.contains("__text", "__item")).select(key, item_key).distinct()
