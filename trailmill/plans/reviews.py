"""Queries of the review, numeral, masking and difficulty operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerals
from ..operators import difficulty, reviews, sequence
from ..sources.files import dealt
from .queries import query, t

_AMOUNT = numerals.AMOUNT.replace("'", "''")


@query(f"""WITH m AS (SELECT doc_id, regexp_extract_all(lower(text), '{_AMOUNT}', 1) AS v, regexp_extract_all(lower(text), '{_AMOUNT}', 2) AS u FROM documents),
x AS (SELECT doc_id, list_filter(list_transform(list_zip(v, u), lambda p: CASE WHEN p[2] IN ('g', '克') THEN p[1]::DOUBLE WHEN p[2] IN ('kg', '千克', '公斤') THEN p[1]::DOUBLE * 1000 END), lambda y: y IS NOT NULL) AS a FROM m)
SELECT doc_id, CASE WHEN coalesce(len(a), 0) = 0 THEN 'unverifiable' WHEN len(list_filter(a, lambda y: y >= 500)) > 0 THEN 'pass' ELSE 'fail' END AS verdict FROM x""")
def amount_check(spark, sf_dir):
    """STR17."""
    return t(spark, sf_dir, "documents").select("doc_id", numerals.amount_verdict(F.col("text"), "min", 0.5, "kg").alias("verdict"))


@query("""WITH s AS (SELECT doc_id, string_split(lower(text), 'the') AS p, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (len(p) - 1)::BIGINT AS n_spans, CASE WHEN len(p) > 1 THEN length(p[1]) END::BIGINT AS first_start, CASE WHEN len(p) > 1 THEN n - length(p[len(p)]) END::BIGINT AS last_end FROM s""")
def value_spans(spark, sf_dir):
    """STR21."""
    found = t(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", numerals.spans(F.col("text"), "the").alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.try_element_at("s", F.lit(1))["start"].cast("long").alias("first_start"), F.try_element_at("s", F.lit(-1))["end"].cast("long").alias("last_end"))


@query()
def han_numerals(spark, sf_dir):
    """STR16: Han numerals of every document, counted and added up."""
    found = F.transform(F.regexp_extract_all("text", F.lit(numerals.HAN_NUMBER), F.lit(0)), numerals.han_number)
    got = t(spark, sf_dir, "documents").select("doc_id", F.coalesce(found, F.array().cast("array<bigint>")).alias("v"))
    return got.select("doc_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)")).cast("string").alias("total"))


@query("""WITH r AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber)::BIGINT + 1)) AS line FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, count(*) AS have FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2)
SELECT l_orderkey, sum(CASE WHEN have IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, sum(CASE WHEN required IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unexpected, sum(CASE WHEN have > 1 THEN 1 ELSE 0 END)::BIGINT AS n_repeated
FROM (SELECT *, true AS required FROM r) FULL JOIN g USING (l_orderkey, line) GROUP BY 1""")
def exact_cover_report(spark, sf_dir):
    """JN17."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity")
    required = dealt(lines.select("l_orderkey", "line"), "l_orderkey").groupBy("l_orderkey").agg(F.max("line").alias("n")).select("l_orderkey", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("line"))
    return reviews.exact_cover(required, lines.filter("l_quantity > 5"), "l_orderkey", "line")


@query("""WITH d AS (SELECT doc_id, max(quality)::INT AS q FROM labels GROUP BY 1)
SELECT doc_id, coalesce(q, (n_chars >= 500)::INT)::INT AS quality, (q IS NOT NULL) AS decided FROM documents LEFT JOIN d USING (doc_id)""")
def review_overrides(spark, sf_dir):
    """JN18: a length rule proposes quality, the labels decide."""
    proposals = t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("quality"))
    decisions = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).filter("quality IS NOT NULL")
    return reviews.override(proposals, decisions, "doc_id", ["quality"])


@query("""WITH j AS (SELECT l_orderkey AS o_orderkey, CASE WHEN count_if(l_returnflag = 'R') > 0 THEN 'failed' ELSE 'final' END AS verdict, count_if(l_returnflag = 'R') AS back FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'partial' ELSE 'review_required' END AS s, 'attribution:' || o_orderpriority AS a, CASE WHEN o_totalprice > 200000 THEN 'large' END AS l FROM orders)
SELECT o_orderkey, CASE WHEN s <> 'final' AND verdict IS NOT NULL THEN verdict ELSE s END AS status,
CASE WHEN s <> 'final' AND verdict IS NOT NULL THEN concat_ws(',', l, CASE WHEN back > 0 THEN 'returned' END) ELSE concat_ws(',', a, l) END AS reasons FROM o LEFT JOIN j USING (o_orderkey)""")
def judge_overrides(spark, sf_dir):
    """JN21."""
    status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "partial").otherwise("review_required")
    reasons = F.array_compact(F.array(F.concat(F.lit("attribution:"), "o_orderpriority"), F.when(F.col("o_totalprice") > 200000, "large")))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), reasons.alias("reasons"))
    back = F.sum((F.col("l_returnflag") == "R").cast("int"))
    judge = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(back.alias("back"))
    judge = judge.select("o_orderkey", F.when(F.col("back") > 0, "failed").otherwise("final").alias("status"), F.array_compact(F.array(F.when(F.col("back") > 0, "returned"))).alias("reasons"))
    out = reviews.judged(rows, judge, "o_orderkey", ("partial", "review_required"), "attribution:")
    return out.select("o_orderkey", "status", F.concat_ws(",", "reasons").alias("reasons"))


@query("""WITH o AS (SELECT o_custkey, min_by(o_orderstatus, o_orderkey) = 'F' AS b, max_by(o_orderstatus, o_orderkey) = 'F' AS a FROM orders GROUP BY 1),
s AS (SELECT o_custkey, CASE WHEN b AND a THEN 'both_success' WHEN b THEN 'base_only_success' WHEN a THEN 'candidate_only_success' ELSE 'both_failure' END AS stratum FROM o)
SELECT o_custkey, stratum FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('gold:' || o_custkey), o_custkey) <= 3""")
def gold_strata(spark, sf_dir):
    """SMP11: three customers of each change between first and last order."""
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.min_by("o_orderstatus", "o_orderkey") == "F").alias("b"), (F.max_by("o_orderstatus", "o_orderkey") == "F").alias("a"))
    return reviews.gold_sample(o.select("o_custkey", reviews.transition(F.col("b"), F.col("a")).alias("stratum")), "stratum", "o_custkey", 3, "gold")


@query("""WITH m AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS n FROM conversations),
r AS (SELECT *, sum(coalesce(n, 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM m)
SELECT conv_id, max(e)::BIGINT AS n_tokens, sum(CASE WHEN role = 'assistant' THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS n_labels, min(CASE WHEN role = 'assistant' THEN e - coalesce(n, 0) END)::BIGINT AS first_label FROM r GROUP BY 1""")
def label_masks(spark, sf_dir):
    """ARR9 with words as tokens."""
    m = t(spark, sf_dir, "conversations").withColumn("n", F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")).cast("long"))
    r = sequence.label_ranges(m, "conv_id", "turn", "role", "n")
    return r.groupBy("conv_id").agg(F.max("end").alias("n_tokens"), F.sum(F.when(F.col("keeps"), F.col("end") - F.col("start")).otherwise(0)).alias("n_labels"), F.min(F.when(F.col("keeps"), F.col("start"))).alias("first_label"))


@query()
def logistic_difficulty(spark, sf_dir):
    """MLR1 to MLR4: quality as success, scored for every document."""
    words = F.greatest(F.lit(1), F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")))
    docs = t(spark, sf_dir, "documents").select("doc_id", F.log1p(F.length("text").cast("double")).alias("log_chars"), (F.length("text") / words).alias("word_length"), (F.regexp_count("text", F.lit("[0-9]")) / F.greatest(F.lit(1), F.length("text"))).alias("digit_share"))
    labels = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    features = ["log_chars", "word_length", "digit_share"]
    rows = difficulty.samples(docs.join(labels, "doc_id"), "doc_id", features, "quality", F.col("doc_id").isNotNull())
    out = difficulty.scored(docs, difficulty.fit(rows, "doc_id", features, "quality"))
    return out.select("doc_id", F.round("score", 6).alias("score"), "difficulty")
