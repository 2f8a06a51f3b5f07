"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import checks, grpo, panels, retrieval, sampling, sequence
from ..sources.files import spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_ORDER = ["ts", "event_id"]
_E = "(PARTITION BY user_id ORDER BY ts, event_id"

# ---- curation ---------------------------------------------------------------

_ATTEMPTS = """
per_order AS (SELECT l_orderkey, count(*) AS steps, count(DISTINCT l_returnflag || l_linestatus) AS tools, max(l_discount) AS top_discount FROM lineitem GROUP BY 1),
attempts AS (SELECT o_orderkey, o_custkey, c_mktsegment AS segment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS attempt,
    CASE WHEN o_totalprice <= 0 THEN 'technical_failure' WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'valid_failure' ELSE 'unfinished' END AS outcome,
    coalesce(steps, 0) AS steps, coalesce(tools, 0) AS tools, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN per_order ON o_orderkey = l_orderkey)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1, PRJ6: orders as attempts at a customer's task, lineitems as their steps."""
    steps = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("tools"))
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    outcome = checks.ladder((F.col("o_totalprice") <= 0, "technical_failure"), (F.col("o_orderstatus") == "F", "success"), (F.col("o_orderstatus") == "O", "valid_failure"), otherwise="unfinished")
    attempt = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    joined = o.join(steps, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_custkey", "segment", attempt.alias("attempt"), outcome.alias("outcome"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("tools", F.lit(0)).alias("tools"), "o_totalprice")


@query(f"""WITH {_ATTEMPTS}, ok AS (SELECT * FROM attempts WHERE outcome = 'success' AND steps >= 3 AND o_totalprice <= 400000
    AND NOT (('0x' || substr(sha256('heldout:' || o_custkey), 1, 15))::BIGINT)::DOUBLE / 1152921504606846976.0::DOUBLE < 0.1),
best AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY attempt, o_orderkey) AS rn FROM ok),
one AS (SELECT *, CASE WHEN steps BETWEEN 3 AND 10 THEN 'short' WHEN steps BETWEEN 11 AND 20 THEN 'medium' WHEN steps BETWEEN 21 AND 35 THEN 'long' ELSE 'outside' END AS bucket,
    row_number() OVER (PARTITION BY segment ORDER BY sha256('split:' || o_custkey), o_custkey) AS r, count(*) OVER (PARTITION BY segment) AS n FROM best WHERE rn = 1)
SELECT segment, bucket, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, least(round_even(n * 0.1::DOUBLE, 0), n - 1)) ELSE 0 END THEN 'validation' ELSE 'train' END AS split, count(*)::BIGINT AS n
FROM one GROUP BY ALL""")
def curate_attempts(spark, sf_dir):
    held_out = F.conv(F.substring(sampling.digest("heldout", F.col("o_custkey")), 1, 15), 16, 10).cast("double") / F.lit(float(16**15))
    ok = attempts(spark, sf_dir).filter((F.col("outcome") == "success") & (F.col("steps") >= 3) & (F.col("o_totalprice") <= 400000) & ~(held_out < 0.1))
    best = sequence.first_per_key(ok, ["o_custkey"], ["attempt", "o_orderkey"]).withColumn("bucket", scores.length_bucket(F.col("steps")))
    return sampling.stratified_split(best, "segment", "o_custkey", 0.1, "split").groupBy("segment", "bucket", "split").agg(F.count("*").alias("n"))


@query(f"WITH {_ATTEMPTS} SELECT outcome, segment, count(*)::BIGINT AS n, sum(steps)::BIGINT AS steps FROM attempts GROUP BY ALL")
def attempt_outcomes(spark, sf_dir):
    return attempts(spark, sf_dir).groupBy("outcome", "segment").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"))


@query(f"""WITH {_ATTEMPTS}, r AS (SELECT unnest(list_filter([CASE WHEN outcome <> 'success' THEN 'not_success' END, CASE WHEN steps < 3 THEN 'too_few_steps' END,
    CASE WHEN o_totalprice > 200000 THEN 'too_expensive' END], lambda x: x IS NOT NULL)) AS reason FROM attempts) SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def rejection_reason_counts(spark, sf_dir):
    r = checks.reasons((F.col("outcome") != "success", "not_success"), (F.col("steps") < 3, "too_few_steps"), (F.col("o_totalprice") > 200000, "too_expensive"))
    return attempts(spark, sf_dir).select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_ATTEMPTS} SELECT o_custkey, o_orderkey, attempt FROM attempts WHERE outcome = 'success' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY attempt, o_orderkey) = 1")
def best_attempt_per_task(spark, sf_dir):
    return sequence.first_per_key(attempts(spark, sf_dir).filter("outcome = 'success'"), ["o_custkey"], ["attempt", "o_orderkey"]).select("o_custkey", "o_orderkey", "attempt")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def exact_text_dedup(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    first = d.groupBy("h").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("r"))  # partial sums: a hot text leaves a task once
    return first.select("r.*")


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_guard(spark, sf_dir):
    """FLT5, JN13: documents that contain an item verbatim."""
    items = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return checks.containing(spread(t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", items, "item_id", "item")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE sha256(b.text) = sha256(d.text))")
def heldout_anti_join(spark, sf_dir):
    held = t(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("h"))
    return t(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256)).join(held, "h", "left_anti").select("doc_id")


# ---- conversations ----------------------------------------------------------


@query("""SELECT conv_id, count(*)::BIGINT AS n_turns, sum((role = 'user')::INT)::BIGINT AS n_user, sum(length(text))::BIGINT AS n_chars,
    arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY 1""")
def conversation_profile(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"), F.sum(F.length("text")).alias("n_chars"),
        F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"),
    )


@query("""WITH e AS (SELECT conv_id, turn, 0 AS k, role AS kind FROM conversations UNION ALL SELECT conv_id, max(turn), 1, 'termination' FROM conversations GROUP BY 1)
SELECT conv_id, 'E' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::VARCHAR, 3, '0') AS event_id, kind FROM e""")
def conversation_events(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    end = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select("conv_id", "turn", F.lit(1).alias("k"), F.lit("termination").alias("kind"))
    e = c.select("conv_id", "turn", F.lit(0).alias("k"), F.col("role").alias("kind")).unionByName(end)
    return e.select("conv_id", F.format_string("E%03d", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")) - 1).alias("event_id"), "kind")


@query("""WITH x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT CASE WHEN role = before THEN 'same_role' WHEN role = 'assistant' AND before IS DISTINCT FROM 'user' THEN 'no_question' WHEN role = 'system' AND before IS NOT NULL THEN 'late_system' ELSE 'ok' END AS pairing, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def broken_pairing_report(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    kind = checks.ladder((F.col("role") == F.col("before"), "same_role"), ((F.col("role") == "assistant") & ~F.col("before").eqNullSafe("user"), "no_question"), ((F.col("role") == "system") & F.col("before").isNotNull(), "late_system"), otherwise="ok")
    return c.groupBy(kind.alias("pairing")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT conv_id, turn, sum(length(text)) OVER w AS tail, row_number() OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, tail::BIGINT AS tail_size FROM x WHERE tail <= 800 OR back = 1""")
def context_suffix_within_budget(spark, sf_dir):
    return sequence.suffix_within(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.length("text"), 800).select("conv_id", "turn", "tail_size")


# ---- event sequences ----------------------------------------------------------


@query(f"""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS d, event_type || props = lag(event_type || props) OVER {_E}) AS c FROM events)
SELECT user_id, count(*)::BIGINT AS n_steps, sum(d::INT)::BIGINT AS n_duplicate, sum(coalesce(c, false)::INT)::BIGINT AS n_consecutive FROM x GROUP BY 1""")
def duplicate_action_counts(spark, sf_dir):
    return sequence.duplicate_counts(t(spark, sf_dir, "events"), ["user_id"], ["event_type", "props"], EVENT_ORDER)


@query(f"""WITH x AS (SELECT user_id, event_type, row_number() OVER {_E}) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, count(*) AS n FROM x GROUP BY user_id, event_type, i) SELECT user_id, max(n)::BIGINT AS longest_run FROM r GROUP BY 1""")
def longest_repeat_run(spark, sf_dir):
    return sequence.longest_run(t(spark, sf_dir, "events"), ["user_id"], ["event_type"], EVENT_ORDER)


@query(f"""WITH x AS (SELECT event_id, user_id, row_number() OVER {_E}) AS step, event_type = 'purchase' AS p, ts FROM events)
SELECT event_id, step::BIGINT AS step, (step - coalesce(max(CASE WHEN p THEN step END) OVER {_E} ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS no_progress_steps FROM x""")
def no_progress_counter(spark, sf_dir):
    out = sequence.since_progress(t(spark, sf_dir, "events"), ["user_id"], EVENT_ORDER, F.col("event_type") == "purchase")
    return out.select("event_id", F.col("step").cast("long").alias("step"), F.col("no_progress_steps").cast("long").alias("no_progress_steps"))


@query(f"""SELECT event_id, coalesce(s = lag(s, 1) OVER w, false) OR coalesce(s = lag(s, 2) OVER w, false) OR coalesce(s = lag(s, 3) OVER w, false) AS repeated
FROM (SELECT *, event_type || '|' || props AS s FROM events) WINDOW w AS {_E})""")
def recent_window_repeats(spark, sf_dir):
    return sequence.recent_repeat(t(spark, sf_dir, "events"), ["user_id"], EVENT_ORDER, F.concat_ws("|", "event_type", "props")).select("event_id", "repeated")


@query(f"""WITH b AS (SELECT *, event_type = 'error' AS h, sum((event_type <> 'error')::INT) OVER {_E} ROWS UNBOUNDED PRECEDING) AS g FROM events),
s AS (SELECT user_id, CASE WHEN h THEN sum(h::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM b)
SELECT user_id, max(streak)::BIGINT AS longest_streak, sum((streak = 3)::INT)::BIGINT AS stops FROM s GROUP BY 1""")
def guard_rejection_streaks(spark, sf_dir):
    s = sequence.streaks(t(spark, sf_dir, "events"), ["user_id"], EVENT_ORDER, F.col("event_type") == "error")
    return s.groupBy("user_id").agg(F.max("streak").alias("longest_streak"), F.sum((F.col("streak") == 3).cast("long")).alias("stops"))


@query(f"""WITH x AS (SELECT event_type = 'error' AS e, lag(event_type) OVER {_E}) AS before FROM events)
SELECT coalesce(before, 'none') AS before, count(*)::BIGINT AS n, sum(e::INT)::BIGINT AS errors, round(avg(e::INT::DOUBLE), 6) AS rate FROM x GROUP BY 1""")
def error_after_click_rate(spark, sf_dir):
    x = t(spark, sf_dir, "events").withColumn("before", F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy(*EVENT_ORDER)), F.lit("none")))
    e = (F.col("event_type") == "error").cast("long")
    return x.groupBy("before").agg(F.count("*").alias("n"), F.sum(e).alias("errors"), F.round(F.avg(e.cast("double")), 6).alias("rate"))


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1, 2""")
def first_event_refs(spark, sf_dir):
    place = F.struct("ts", "event_id")
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", place).alias("first_event"), F.max_by("event_id", place).alias("last_event"))


@query(f"""SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER {_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_value FROM events""")
def asof_previous_view(spark, sf_dir):
    value = F.when(F.col("event_type") == "view", F.col("value"))
    return sequence.as_of(t(spark, sf_dir, "events"), ["user_id"], EVENT_ORDER, value, "view_value").select("event_id", "view_value")


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) = 1 AS fresh FROM events WHERE event_type <> 'error')
SELECT user_id, sum(fresh::INT)::BIGINT AS productive, count(*)::BIGINT AS steps FROM x GROUP BY 1""")
def productive_steps(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter("event_type <> 'error'")
    fresh = F.row_number().over(Window.partitionBy("user_id", "event_type", "props").orderBy(*EVENT_ORDER)) == 1
    return e.withColumn("fresh", fresh).groupBy("user_id").agg(F.sum(F.col("fresh").cast("long")).alias("productive"), F.count("*").alias("steps"))


@query(f"""SELECT event_id, round(avg(value) OVER {_E} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean10 FROM events WHERE value IS NOT NULL""")
def rolling_mean_nonnull(spark, sf_dir):
    return sequence.rolling_mean(t(spark, sf_dir, "events"), ["user_id"], EVENT_ORDER, "value", 10, "m").select("event_id", F.round("m", 6).alias("mean10"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def latest_success_per_key(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return sequence.latest_per_key(e, ["user_id"], F.col("event_id"), F.col("event_type") == "purchase").select("user_id", "event_id", "value")


@query("SELECT event_id, (regexp_extract(props, '\"k\": *([0-9]+)', 1))::BIGINT AS k FROM events")
def json_props_extract(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    from ..streaming import tracker

    return tracker.tumbling(t(spark, sf_dir, "events"), "ts", "1 hour")


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY 1")
def event_counters(spark, sf_dir):
    from ..streaming import tracker

    return tracker.counters(t(spark, sf_dir, "events"), "user_id", "value").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id::VARCHAR AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type || '|' || props AS sig, CASE WHEN event_type IN ('view', 'purchase') THEN props END AS ev FROM events),
x AS (SELECT *, lag(sig) OVER (PARTITION BY session ORDER BY n) IS DISTINCT FROM sig AS changed, coalesce(ev <> '', false) AND row_number() OVER (PARTITION BY session, ev ORDER BY n) = 1 AS fresh FROM e),
y AS (SELECT *, n - max(CASE WHEN changed THEN n END) OVER w AS repeats, n - coalesce(max(CASE WHEN fresh THEN n END) OVER w, 0) AS stalled FROM x WINDOW w AS (PARTITION BY session ORDER BY n)),
z AS (SELECT *, CASE WHEN repeats >= 2 THEN 'repeat_loop' WHEN stalled >= 4 THEN 'no_progress' WHEN n >= 35 THEN 'max_steps' END AS why FROM y)
SELECT session, coalesce(min(n) FILTER (why IS NOT NULL), max(n))::INT AS steps, coalesce(arg_min(why, n) FILTER (why IS NOT NULL), '') AS ended FROM z GROUP BY 1""")
def tracker_sessions(spark, sf_dir):
    from ..streaming import tracker

    e = t(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy(*EVENT_ORDER))
    evidence = F.when(F.col("event_type").isin("view", "purchase"), F.col("props"))
    return tracker.track_batch(e.select(F.col("user_id").cast("string").alias("session"), step.alias("step"), F.concat_ws("|", "event_type", "props").alias("signature"), evidence.alias("evidence")))


# ---- panels -----------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS success, bool_or(o_totalprice > 300000) AS large FROM orders GROUP BY 1),
j AS (SELECT c_mktsegment, coalesce(success, false) AS success, coalesce(large, false) AS large FROM customer LEFT JOIN r ON c_custkey = o_custkey)
SELECT coalesce(c_mktsegment, 'all') AS stratum, count(*)::BIGINT AS n_expected, sum(success::INT)::BIGINT AS n_success, sum(large::INT)::BIGINT AS n_large,
  round(sum(success::INT)::DOUBLE / count(*), 6) AS rate_success, round(sum(large::INT)::DOUBLE / count(*), 6) AS rate_large FROM j GROUP BY ROLLUP (c_mktsegment)""")
def fixed_denominator_panel(spark, sf_dir):
    r = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("success"), F.bool_or(F.col("o_totalprice") > 300000).alias("large"))
    return panels.fixed_denominator(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), r, "c_custkey", "c_mktsegment", ["success", "large"])


_RUN = "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ok, max(o_totalprice) AS top FROM orders WHERE o_orderpriority = '{}' GROUP BY 1"


def _run(spark, sf_dir, priority: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == priority)
    return o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ok"), F.max("o_totalprice").alias("top"))


@query(f"""WITH a AS ({_RUN.format('1-URGENT')}), b AS ({_RUN.format('5-LOW')})
SELECT CASE WHEN a.ok IS NULL OR b.ok IS NULL THEN 'unpaired' WHEN a.ok AND b.ok THEN 'both' WHEN a.ok THEN 'lost' WHEN b.ok THEN 'gained' ELSE 'neither' END AS transition, count(*)::BIGINT AS n FROM a FULL JOIN b USING (o_custkey) GROUP BY 1""")
def paired_run_transitions(spark, sf_dir):
    return panels.transitions(_run(spark, sf_dir, "1-URGENT"), _run(spark, sf_dir, "5-LOW"), "o_custkey", "ok")


@query("""WITH r AS (SELECT o_orderpriority AS run, o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1, 2)
SELECT a.run AS run_a, b.run AS run_b, count(*)::BIGINT AS n, round(avg(b.top - a.top), 6) AS mean_delta, sum((b.top > a.top)::INT)::BIGINT AS improved, sum((b.top = a.top)::INT)::BIGINT AS unchanged, sum((b.top < a.top)::INT)::BIGINT AS worsened
FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.run < b.run GROUP BY 1, 2""")
def all_pairs_comparison(spark, sf_dir):
    r = t(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("run")).agg(F.max("o_totalprice").alias("top"))
    pairs = r.select("o_custkey", F.col("run").alias("run_a"), F.col("top").alias("a")).join(r.select("o_custkey", F.col("run").alias("run_b"), F.col("top").alias("b")), "o_custkey").filter("run_a < run_b")
    return panels.deltas(pairs, ["run_a", "run_b"], F.col("a"), F.col("b"))


@query("""SELECT l_returnflag, count(l_quantity)::BIGINT AS n, min(l_quantity) AS low, round(median(l_quantity), 6) AS median, round(avg(l_quantity), 6) AS mean, quantile_disc(l_quantity, 0.9) AS p90,
  quantile_disc(l_quantity, 0.95) AS p95, round(quantile_cont(l_quantity, 0.3), 6) AS p30, max(l_quantity) AS high FROM lineitem GROUP BY 1""")
def distribution_p90_median(spark, sf_dir):
    return panels.distribution(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""WITH x AS (SELECT o_orderpriority AS difficulty, CASE WHEN n <= 2 THEN 'short' WHEN n <= 5 THEN 'medium' ELSE 'long' END AS bucket FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
SELECT coalesce(difficulty, '*') AS difficulty, coalesce(bucket, '*') AS bucket, grouping(difficulty, bucket)::BIGINT AS panel, count(*)::BIGINT AS n FROM x GROUP BY GROUPING SETS ((difficulty), (bucket), (difficulty, bucket))""")
def difficulty_length_crosstab(spark, sf_dir):
    n = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") <= 2, "short").when(F.col("n") <= 5, "medium").otherwise("long")
    return panels.crosstab(t(spark, sf_dir, "orders").join(n, "o_orderkey").select(F.col("o_orderpriority").alias("difficulty"), bucket.alias("bucket")), "difficulty", "bucket")


@query("""SELECT count(*)::BIGINT AS n, round(avg((quality = (length(text) > 300)::INT)::INT::DOUBLE), 6) AS agreement, round(avg((toxic = 0)::INT::DOUBLE), 6) AS clean FROM documents JOIN labels USING (doc_id)""")
def judge_agreement(spark, sf_dir):
    j = t(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 300).cast("int").alias("guess")).join(t(spark, sf_dir, "labels"), "doc_id")
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("guess")).cast("double")), 6).alias("agreement"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 6).alias("clean"))


# ---- groups and rewards ---------------------------------------------------------

_ROLL = "SELECT o_custkey AS uid, o_orderkey, round(max(l_discount) * 10, 1) AS utility, round(max(l_tax) * 10, 1) AS reward, o_orderstatus <> 'P' AS valid FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


def rollouts(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.max("l_discount") * 10, 1).alias("utility"), F.round(F.max("l_tax") * 10, 1).alias("reward"))
    return t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), "o_orderkey", (F.col("o_orderstatus") != "P").alias("valid")).join(li, "o_orderkey")


@query(f"""WITH r AS ({_ROLL}), s AS (SELECT uid, count(*) AS n, max(utility) - min(utility) AS d, max(abs(reward - utility)) AS g, max(utility) AS h FROM r WHERE valid GROUP BY 1)
SELECT uid, n::BIGINT AS n_valid, n >= 2 AND (d > 1e-8 OR g > 1e-8) AS kept, d <= 1e-8 AS all_equal, h = 0 AS all_zero FROM s""")
def reward_varying_groups(spark, sf_dir):
    return grpo.kept_groups(rollouts(spark, sf_dir), "uid", "utility", "reward", F.col("valid"))


@query(f"""WITH r AS ({_ROLL}), s AS (SELECT uid, avg(utility) AS m, stddev_samp(utility) AS sd, count(*) AS n FROM r WHERE valid GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN coalesce(n, 0) < 2 THEN NULL WHEN valid THEN greatest(least((utility - m) / greatest(sd, 0.1), 2), -2) ELSE 0 END, 5) AS advantage FROM r LEFT JOIN s USING (uid)""")
def group_advantage(spark, sf_dir):
    return grpo.group_advantage(rollouts(spark, sf_dir), "uid", "utility", F.col("valid")).select("o_orderkey", F.round("advantage", 5).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0.0 ELSE greatest(least(CASE l_returnflag WHEN 'R' THEN least(l_discount * 30 - 1 - l_tax, -0.25) WHEN 'A' THEN least(l_discount * 30 - 1 - l_tax, -0.5) ELSE l_discount * 30 - 1 - l_tax END, 2), -2) END, 6) AS advantage FROM lineitem""")
def step_advantage_floor(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "wrong_option").when(F.col("l_returnflag") == "A", "bad_buy").otherwise("none")
    mask = ~((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
    a = grpo.step_advantage(F.col("l_discount") * 30 - 1, -F.col("l_tax"), kind, mask)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(a, 6).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_linestatus = 'X' THEN NULL WHEN l_returnflag = 'N' THEN -0.25 WHEN p_type = 'PROMO' THEN -0.5 WHEN l_discount = 0 THEN 1.0 ELSE 0.5 * (1 - l_discount) * (1 - l_tax) * (l_quantity / 50) END, 6) AS orm FROM lineitem JOIN part ON l_partkey = p_partkey""")
def orm_v4_ladder(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    r = scores.outcome_reward(F.col("l_linestatus") == "X", F.col("l_returnflag") != "N", F.col("p_type") != "PROMO", F.col("l_discount") == 0, 1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_quantity") / 50)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(r, 6).alias("orm"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 'unverifiable' WHEN p_size <= 40 THEN 'pass' ELSE 'fail' END AS category, CASE WHEN p_retailprice <= 1500 THEN 'pass' ELSE 'fail' END AS budget, p_size % 10 = 0 AS gold, (p_size % 7) / 6.0::DOUBLE AS match, (p_size % 5) / 4.0::DOUBLE AS coverage FROM part)
SELECT p_partkey, category, budget, round(CASE WHEN category = 'unverifiable' THEN 0.0 WHEN category = 'fail' OR budget = 'fail' THEN -0.85 WHEN gold THEN 1.0 WHEN match >= 0.7 AND coverage >= 0.75 THEN 0.55 ELSE least(0.25, -0.30 + 0.55 * match) END, 6) AS reward FROM x""")
def purchase_reward_v3(spark, sf_dir):
    s = F.col("p_size")
    p = t(spark, sf_dir, "part").select("p_partkey", scores.tri_state(s != 1, s <= 40).alias("category"), scores.tri_state(F.lit(True), F.col("p_retailprice") <= 1500).alias("budget"), (s % 10 == 0).alias("gold"), ((s % 7) / 6.0).alias("match"), ((s % 5) / 4.0).alias("coverage"))
    return p.select("p_partkey", "category", "budget", F.round(scores.purchase_reward(F.col("category"), F.col("budget"), F.col("gold"), F.col("match"), F.col("coverage")), 6).alias("reward"))


@query("""WITH a AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS axes, count(DISTINCT p_retailprice) AS prices, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, CASE WHEN axes > 1 AND prices > 1 THEN 'unverifiable' WHEN prices = 1 THEN 'constant' ELSE 'single_axis' END AS rung, CASE WHEN prices = 1 THEN low END AS price FROM a""")
def variant_price_ladder(spark, sf_dir):
    a = t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.countDistinct("p_size").alias("axes"), F.countDistinct("p_retailprice").alias("prices"), F.min("p_retailprice").alias("low"))
    rung = checks.ladder(((F.col("axes") > 1) & (F.col("prices") > 1), "unverifiable"), (F.col("prices") == 1, "constant"), otherwise="single_axis")
    return a.select("p_brand", "p_type", rung.alias("rung"), F.when(F.col("prices") == 1, F.col("low")).alias("price"))


@query("""SELECT p_brand, round(coalesce(sum(p_size * p_retailprice) FILTER (p_size > 10 AND p_brand <> 'Brand#11') / sum(p_size) FILTER (p_size > 10 AND p_brand <> 'Brand#11'), 1.0::DOUBLE), 4) AS weighted, sum((p_size > 25)::INT)::BIGINT AS passed, count(*)::BIGINT AS required FROM part GROUP BY 1""")
def weighted_preference(spark, sf_dir):
    """AG24: 1.0 where no dimension is active (one brand here)."""
    on, w = (F.col("p_size") > 10) & (F.col("p_brand") != "Brand#11"), F.col("p_size")
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(on, w * F.col("p_retailprice"))), F.sum(F.when(on, w))), F.lit(1.0)), 4).alias("weighted"), F.sum((w > 25).cast("long")).alias("passed"), F.count("*").alias("required"))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS a FROM lineitem GROUP BY 1), q AS (SELECT quantile_disc(a, 0.95) AS a95 FROM a)
SELECT l_orderkey, round(CASE WHEN a95 <= 0 THEN (a > 0)::INT::DOUBLE ELSE least(1.0, ln(1 + a) / ln(1 + a95)) END, 6) AS c FROM a, q""")
def constraint_scores(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("a"))
    q = a.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY a)").alias("a95"))
    return a.join(F.broadcast(q)).select("l_orderkey", F.round(scores.complexity(F.col("a"), F.col("a95")), 6).alias("c"))  # q: one row


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.3) AS e, quantile_cont(o_totalprice, 0.8) AS h FROM orders)
SELECT CASE WHEN o_totalprice <= e THEN 'easy' WHEN o_totalprice >= h THEN 'hard' ELSE 'medium' END AS label, count(*)::BIGINT AS n FROM orders, q GROUP BY 1""")
def preliminary_labels(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_totalprice")
    q = o.agg(F.expr("percentile_cont(0.3) WITHIN GROUP (ORDER BY o_totalprice)").alias("e"), F.expr("percentile_cont(0.8) WITHIN GROUP (ORDER BY o_totalprice)").alias("h"))
    label = F.when(F.col("o_totalprice") <= F.col("e"), "easy").when(F.col("o_totalprice") >= F.col("h"), "hard").otherwise("medium")
    return o.join(F.broadcast(q)).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


# ---- sampling -------------------------------------------------------------------

_QUOTA = """q0 AS (SELECT c_mktsegment, count(*)::DOUBLE * 100.0::DOUBLE / sum(count(*)) OVER () AS s FROM customer GROUP BY 1),
quota AS (SELECT c_mktsegment, (floor(s) + (row_number() OVER (ORDER BY s - floor(s) DESC, c_mktsegment) <= 100 - sum(floor(s)) OVER ())::INT)::BIGINT AS quota FROM q0)"""


def _quota(spark, sf_dir) -> DataFrame:
    n = t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"))
    return sampling.largest_remainder(n, "c_mktsegment", "n", 100)


@query(f"WITH {_QUOTA} SELECT * FROM quota")
def largest_remainder_quotas(spark, sf_dir):
    return _quota(spark, sf_dir)


@query(f"""WITH {_QUOTA} SELECT c_custkey, c_mktsegment FROM customer JOIN quota USING (c_mktsegment) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1:' || c_custkey), c_custkey) <= any_value(quota) OVER (PARTITION BY c_mktsegment)""")
def quota_sample(spark, sf_dir):
    return sampling.take_quota(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", _quota(spark, sf_dir), "s1")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, sha256('s2:' || c_custkey) AS h, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s2:' || c_custkey), c_custkey) AS rn FROM customer),
a AS (SELECT * FROM r WHERE rn <= 15), b AS (SELECT * FROM r WHERE rn > 15 ORDER BY h, c_custkey LIMIT (SELECT greatest(0, 100 - count(*)) FROM a))
SELECT c_custkey, c_mktsegment, 'quota' AS via FROM a UNION ALL SELECT c_custkey, c_mktsegment, 'refill' FROM b""")
def balanced_sample(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    quota = c.select("c_mktsegment").distinct().withColumn("quota", F.lit(15))
    return sampling.balanced(c, "c_mktsegment", "c_custkey", quota, 100, "s2").select("c_custkey", "c_mktsegment", "via")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s3:' || c_custkey), c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN rn <= CASE WHEN n > 1 THEN greatest(1, least(round_even(n * 0.15::DOUBLE, 0), n - 1)) ELSE 0 END THEN 'validation' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.15, "s3")


@query("SELECT c_custkey, ('0x' || substr(sha256('s4:' || c_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.2 AS held_out FROM customer")
def hash_fraction_split(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", (sampling.fraction("s4", F.col("c_custkey")) < 0.2).alias("held_out"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, n_name, row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY sha256('s5:' || c_custkey), c_custkey) AS turn FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, c_mktsegment, n_name, turn FROM r ORDER BY turn, c_mktsegment, n_name LIMIT 150""")
def round_robin_sample(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    return sampling.round_robin(c, ["c_mktsegment", "n_name"], "c_custkey", 150, "s5").select("c_custkey", "c_mktsegment", "n_name", F.col("turn").cast("long").alias("turn"))


@query()
def interleaved_plan(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    quota = _quota(spark, sf_dir).collect()  # a row for each label
    plan = sampling.interleave({r["c_mktsegment"]: r["quota"] for r in quota})
    seen: dict[str, int] = {}
    rows = []
    for place, label in enumerate(plan):
        seen[label] = seen.get(label, 0) + 1
        rows.append((place, label, seen[label]))
    order = spark.createDataFrame(rows, "place int, c_mktsegment string, nth int")
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(sampling.digest("s6", F.col("c_custkey")), "c_custkey"))
    return c.withColumn("nth", nth).join(F.broadcast(order), ["c_mktsegment", "nth"]).select("place", "c_custkey", "c_mktsegment")


@query()
def mincost_category_plan(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = {(r["c_mktsegment"], r["n_name"]): r["n"] for r in c.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n")).collect()}
    take = sampling.min_cost_flow(cells, dict.fromkeys({k[0] for k in cells}, 5), 1, {c: 1.0 / n for c, n in cells.items()})
    chosen = spark.createDataFrame([(a, b, n) for (a, b), n in sorted(take.items()) if n], "c_mktsegment string, n_name string, quota int")
    nth = F.row_number().over(Window.partitionBy("c_mktsegment", "n_name").orderBy(sampling.digest("s7", F.col("c_custkey")), "c_custkey"))
    return c.withColumn("nth", nth).join(F.broadcast(chosen), ["c_mktsegment", "n_name"]).filter("nth <= quota").select("c_custkey", "c_mktsegment", "n_name")


@query("""WITH p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0), v AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 50 = 1),
a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 27 <> 0)
SELECT 'train' AS part, count(*)::BIGINT AS n FROM p UNION ALL SELECT 'validation', count(*)::BIGINT FROM v UNION ALL SELECT 'overlap', count(*)::BIGINT FROM p SEMI JOIN v USING (k)
UNION ALL SELECT 'missing', count(*)::BIGINT FROM a ANTI JOIN (FROM p UNION FROM v) u USING (k) UNION ALL SELECT 'unexpected', count(*)::BIGINT FROM (FROM p UNION FROM v) u ANTI JOIN a USING (k)""")
def set_partition_check(spark, sf_dir):
    """SET3, SET4, SET5: sizes of two parts, keys in both, and what their union lacks or adds against the whole; the parts here overlap on purpose."""
    c = t(spark, sf_dir, "customer").select("c_custkey")
    a, b, whole = c.filter("c_custkey % 9 <> 0"), c.filter("c_custkey % 9 = 0 OR c_custkey % 50 = 1"), c.filter("c_custkey % 27 <> 0")
    size = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    off = checks.keyset_difference(whole, a.union(b).distinct(), "c_custkey")
    parts = [size(a, "train"), size(b, "validation"), size(checks.overlap(a, b, "c_custkey"), "overlap"), *[size(off.filter(F.col("problem") == x), x) for x in ("missing", "unexpected")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- text and retrieval ---------------------------------------------------------


@query("""SELECT doc_id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}'))::BIGINT AS access_key, len(regexp_extract_all(text, '[Bb]earer +[A-Za-z0-9._-]{16,}'))::BIGINT AS bearer, len(regexp_extract_all(text, 'sk-[A-Za-z0-9]{16,}'))::BIGINT AS api_key FROM documents""")
def secret_scan(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in text.SECRETS.items()])


@query()
def query_normaliser(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.query_normal(F.col("text")).cast("binary")).alias("normal"))


@query()
def tokens_bigram(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.size(text.han_bigrams(F.col("text"))).alias("n_tokens"))


@query()
def html_visible_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.visible_text("html").alias("visible"))


_BM25 = """p AS (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l), df AS (SELECT token, count(*)::DOUBLE AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN df USING (token) JOIN p USING (token) JOIN l USING (doc_id), c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _ranked(spark, sf_dir, k: int) -> DataFrame:
    return retrieval.bm25(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", {"text": 1.0}, t(spark, sf_dir, "benchmark"), "item_id", "text", k)


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 4) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, 20).select("item_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT item_id, min(rank) FILTER (score >= 100)::BIGINT AS best_rank, sum((score >= 40 AND score < 100)::INT)::BIGINT AS near_misses FROM r WHERE rank <= 20 GROUP BY 1")
def retrieval_evidence(spark, sf_dir):
    e = retrieval.evidence(_ranked(spark, sf_dir, 20), "item_id", F.col("score") >= 100, (F.col("score") >= 40) & (F.col("score") < 100))
    return e.select("item_id", F.col("best_rank").cast("long").alias("best_rank"), "near_misses")


@query("WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT p_brand, p_partkey, rank::BIGINT AS rank FROM r WHERE rank BETWEEN 21 AND 40")
def paged_results(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    return retrieval.page(t(spark, sf_dir, "part").withColumn("rank", rank), 2).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_name, p_partkey, coalesce(p_retailprice, 100.0) AS price FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def catalog_first_wins(spark, sf_dir):
    return sequence.first_per_key(t(spark, sf_dir, "part"), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey", F.coalesce("p_retailprice", F.lit(100.0)).alias("price"))
