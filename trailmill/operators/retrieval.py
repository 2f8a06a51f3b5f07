"""Multi-field BM25 over postings: equi-joins on tokens, never a pass over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import dealt, input_bytes

K1, B = 1.2, 0.75
#: Bytes of files of queries whose tokens are broadcast.
SENT_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    """Latin and number tokens, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def token_count(text: Column) -> Column:
    """How many tokens the text has."""
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))


def _field_tokens(field: str) -> Column:
    return tokens(F.coalesce(F.col(field).cast("string"), F.lit("")))


def _occurrences(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """key, token and weight of every token of every field."""
    out = None
    for field, weight in fields.items():
        # an inner explode would have Spark make the tokens a second time, before the shuffle, to drop texts without any
        one = docs.select(key, F.explode_outer(_field_tokens(field)).alias("token")).filter("token IS NOT NULL").withColumn("w", F.lit(float(weight)))
        out = one if out is None else out.unionByName(one)
    return out


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """SNK8: token, key and weighted term frequency over the fields."""
    return _occurrences(docs, key, fields).groupBy("token", key).agg(F.sum("w").alias("tf"))


def bm25(docs: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, query_key: str, text: str, k: int) -> DataFrame:
    """RET1, JN11, SRT1: query, key, score and rank of the k best by (score, key).

    Texts are dealt once by key, to tasks of bounded input. Where the queries are small enough to be broadcast, all that
    follows stays in those tasks: tokens, term frequencies, lengths, and the sums of a query and a document, of which
    each task hands on no more than its k best of a query. Where they are not, the pairs that share a token are shuffled.
    Documents without tokens are no part of the corpus.
    """
    sent = F.broadcast if input_bytes(queries) <= SENT_BYTES else lambda df: df
    docs = dealt(docs.select(key, *fields), key)
    weighted = sum((token_count(F.coalesce(F.col(f).cast("string"), F.lit(""))) * F.lit(float(w)) for f, w in fields.items()), F.lit(0.0))
    lengths = docs.select(key, weighted.alias("dl")).groupBy(key).agg(F.sum("dl").alias("dl")).filter("dl > 0")
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).distinct()
    index = _occurrences(docs, key, fields).join(sent(asked.select("token").distinct()), "token", "left_semi").groupBy(key, "token").agg(F.sum("w").alias("tf"))
    frequency = index.groupBy("token").agg(F.count("tf").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(frequency, "token").join(F.broadcast(corpus)).select(query_key, "token", idf.alias("idf"), "avgdl")  # corpus: one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = index.join(lengths.hint("merge"), key).join(sent(terms), "token").groupBy(query_key, key).agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("score").desc(), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def evidence(ranked: DataFrame, query_key: str, acceptable: Column, near: Column) -> DataFrame:
    """RET3, RET4: first acceptable rank and near misses of a query's ranking."""
    return ranked.groupBy(query_key).agg(F.min(F.when(acceptable, F.col("rank"))).alias("best_rank"), F.sum(F.coalesce(near, F.lit(False)).cast("long")).alias("near_misses"))


def page(ranked: DataFrame, number: int, size: int = 20) -> DataFrame:
    """SRT2: rows of a page, from 1."""
    if number < 1:
        raise ValueError("pages count from 1")
    return ranked.filter(F.col("rank").between((number - 1) * size + 1, number * size))
