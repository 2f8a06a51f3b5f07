"""Text functions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of credentials to report and redact. Fixed values.
SECRETS = {"access_key": r"AKIA[0-9A-Z]{16}", "bearer": r"[Bb]earer +[A-Za-z0-9._-]{16,}", "api_key": r"sk-[A-Za-z0-9]{16,}"}


@F.pandas_udf(T.StringType())
def nfkc_casefold(x: pd.Series) -> pd.Series:
    """STR1: NFKC, case folded, stripped."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold().strip())


def query_normal(x: Column) -> Column:
    """STR2, STR3: folded text with punctuation as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc_casefold(x), r"(?U)[^\w\s]+", " "), r"\s+", " "))


def han_bigrams(x: Column) -> Column:
    """STR4: bigrams of Han runs (the run itself if of length 1), then latin and number tokens, each once."""
    runs = F.regexp_extract_all(x, F.lit(r"([\x{4e00}-\x{9fff}]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    latin = F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+(?:[._+/-][a-z0-9]+)*)"), 1)
    return F.array_distinct(F.concat(pairs, latin))


# Names of the currency, the punctuation that separates words, Han characters, words of latin letters and digits.
CURRENCY, CURRENCY_CODES = ("人民币", "块钱"), ("rmb", "cny", "yuan")
SEPARATORS = "，,。；;：:！!？?、|"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
LATIN_WORD = r"[a-z0-9]+(?:[._+\-/][a-z0-9]+)*"


def search_normal(x: Column) -> Column:
    """STR2: folded text with one name for the currency and separators as single spaces; null counts as empty."""
    folded = F.coalesce(nfkc_casefold(x.cast("string")), F.lit(""))
    named = F.regexp_replace(folded, "|".join(CURRENCY), "元")
    coded = F.regexp_replace(named, rf"(?U)(?<=\d)\s*(?:{'|'.join(CURRENCY_CODES)})\b", "元")
    return F.trim(F.regexp_replace(coded, rf"(?U)(?:\s|[{SEPARATORS}])+", " "))


def search_tokens(normal: Column) -> Column:
    """STR4: tokens of a normal text, each once: bigrams of Han runs (a run of one stands for itself), then latin words."""
    runs = F.regexp_extract_all(normal, F.lit(f"([{HAN}]+)"), 1)
    bigrams = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    return F.array_distinct(F.concat(F.flatten(F.transform(runs, bigrams)), F.regexp_extract_all(normal, F.lit(f"({LATIN_WORD})"), 1)))


def middle_ellipsis(x: Column, limit: int) -> Column:
    """STR11: two thirds of the head and one third of the tail."""
    head = (limit - 1) * 2 // 3
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("…"), F.right(x, F.lit(limit - 1 - head))))


def action_name(x: Column) -> Column:
    """STR18: the name in `name[argument]`."""
    return F.regexp_extract(x, r"^\s*([a-z_]+)\[", 1)


def action_argument(x: Column) -> Column:
    """STR18: the argument in `name[argument]`."""
    return F.regexp_extract(x, r"^\s*[a-z_]+\[(.*)\]\s*$", 1)


def category_leaf(path: Column) -> Column:
    """STR9."""
    return F.element_at(F.split(path, "›"), -1)


def valid_product_id(x: Column) -> Column:
    """STR23."""
    return x.rlike(r"^[0-9]{8,12}$")


def upper_price(x: Column) -> Column:
    """STR13: the upper bound of a stated budget: a range's end, "under n", "n or less"; null for open ranges."""
    return F.coalesce(
        F.try_to_number(F.nullif(F.regexp_extract(x, r"[0-9]+ *(?:-|to) *([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")),
        F.try_to_number(F.nullif(F.regexp_extract(x, r"(?:under|below|at most|up to) *\$?([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")),
    ).cast("double")


def redact(x: Column) -> Column:
    """PRJ13: secrets become their kind in brackets."""
    for name, pattern in SECRETS.items():
        x = F.regexp_replace(x, pattern, f"[{name}]")
    return x


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(data.strip())


@F.pandas_udf(T.StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """STR22: the text a page shows."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        parser = _Visible()
        parser.feed(s)
        return " ".join(parser.out)

    return html.map(one)


@F.pandas_udf(T.LongType())
def char_tokens(x: pd.Series) -> pd.Series:
    """UDF1: the default token counter, a token for every four characters begun."""
    return x.fillna("").str.len().add(3).floordiv(4).astype("int64")
