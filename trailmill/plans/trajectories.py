"""Queries of the attempt, event, product and planning operators over the driver's tables.

Orders stand for attempts: what a trajectory says of itself is derived from the keys by
expressions that Spark and DuckDB read alike, so that every rung of a ladder is met.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import outcomes, process, products
from ..operators import events, planning
from ..sources.files import dealt
from .queries import query, t

#: Fields of an attempt, by expressions over orders that both engines have.
FIELDS = {
    "release_error": "CASE WHEN o_orderkey % 31 = 0 THEN 'lost' END",
    "infrastructure_invalid": "o_orderkey % 29 = 0",
    "error_category": "CASE o_orderkey % 23 WHEN 1 THEN 'model' WHEN 2 THEN 'protocol' WHEN 3 THEN 'policy' WHEN 4 THEN 'environment' WHEN 5 THEN 'internal' END",
    "error_type": "CASE o_orderkey % 19 WHEN 1 THEN 'ContextBudgetError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'ShopProtocolError' WHEN 5 THEN 'Strange' END",
    "reward_type": "CASE o_orderkey % 12 WHEN 0 THEN 'gold_purchase' WHEN 1 THEN 'valid_alternative_purchase' WHEN 2 THEN 'partial_alternative_purchase' WHEN 3 THEN 'wrong_purchase' WHEN 4 THEN 'early_abstain' WHEN 5 THEN 'reward_unverifiable' WHEN 6 THEN 'repeat_loop' END",
    "done": "o_orderstatus <> 'P'",
    "reward_valid": "o_orderkey % 13 <> 0",
    "status": "CASE o_orderkey % 17 WHEN 1 THEN 'error' WHEN 2 THEN 'max_steps' WHEN 3 THEN 'invalid_action' WHEN 4 THEN 'assistant_final' WHEN 5 THEN NULL ELSE 'done' END",
    "termination_reason": "CASE o_orderkey % 16 WHEN 1 THEN 'max_steps' WHEN 2 THEN 'context_hard_limit' WHEN 3 THEN 'reward_unverifiable' WHEN 4 THEN 'repeat_loop' WHEN 5 THEN 'tool_error:x' WHEN 6 THEN 'parallel_tool_calls' WHEN 7 THEN NULL ELSE 'gold_purchase' END",
    "termination_category": "CASE o_orderkey % 14 WHEN 1 THEN 'invalid_action' WHEN 2 THEN 'limit_reached' END",
    "blocked": "o_orderkey % 5 = 1",
    "truncated": "o_orderkey % 7 = 1",
}
_RUNS = "runs AS (SELECT o_orderkey, o_custkey, o_totalprice, " + ", ".join(f"{e} AS {c}" for c, e in FIELDS.items()) + " FROM orders)"
_UNFAIR = "('policy', 'environment', 'protocol', 'infrastructure', 'release', 'internal')"
_TECHNICAL = f"""CASE WHEN release_error IS NOT NULL THEN 'environment_release_failed' WHEN infrastructure_invalid THEN CASE WHEN reward_type = 'reward_unverifiable' THEN 'reward_unverifiable' ELSE 'trajectory_marked_infrastructure_invalid' END
  WHEN error_category IN {_UNFAIR} THEN 'error_category:' || error_category WHEN reward_type = 'reward_unverifiable' THEN 'reward_unverifiable' WHEN done AND NOT reward_valid THEN 'terminal_reward_not_valid' WHEN status = 'error' THEN 'unclassified_runtime_error' END"""


def runs(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", *[F.expr(e).alias(c) for c, e in FIELDS.items()])


def fields(*extra):
    return {c: F.col(c) for c in (*FIELDS, *extra)}


@query(f"""WITH {_RUNS}, x AS (SELECT *, {_TECHNICAL} AS why,
  list_filter([CASE WHEN blocked THEN 'has_guard_rejection' END, CASE WHEN truncated THEN 'has_parallel_tool_truncation' END], lambda y: y IS NOT NULL) AS dirty FROM runs)
SELECT o_orderkey, CASE WHEN why = 'reward_unverifiable' THEN why WHEN why IS NOT NULL THEN CASE WHEN error_category IN ('protocol', 'policy', 'internal') THEN 'protocol_error' ELSE 'infrastructure_error' END
    WHEN reward_type IS NOT NULL THEN reward_type WHEN status = 'max_steps' OR termination_reason = 'max_steps' THEN 'max_steps' WHEN status = 'invalid_action' THEN 'invalid_action' WHEN status = 'assistant_final' THEN 'no_purchase' WHEN error_category = 'model' THEN 'model_error' ELSE 'no_purchase' END AS outcome_type,
  why IS NULL AS attempt_valid, CASE WHEN why IS NULL THEN coalesce(reward_type IN ('gold_purchase', 'valid_alternative_purchase'), false) END AS task_success,
  CASE WHEN why IS NOT NULL THEN 'retry' WHEN reward_type = 'gold_purchase' THEN CASE WHEN len(dirty) > 0 THEN 'rejected' ELSE 'accepted_gold' END WHEN reward_type = 'valid_alternative_purchase' THEN 'alternative_audit' ELSE 'rejected' END AS disposition,
  CASE WHEN why IS NOT NULL THEN why WHEN reward_type = 'gold_purchase' THEN array_to_string(dirty, ',') WHEN reward_type = 'valid_alternative_purchase' THEN 'strict_sft_requires_gold_purchase' WHEN reward_type IS NOT NULL THEN 'terminal_outcome:' || reward_type ELSE 'non_success_status:' || coalesce(status, 'unknown') END AS reasons FROM x""")
def attempt_classes(spark, sf_dir):
    """FLT1, FLT4: the whole ladder."""
    one = lambda c: F.col(c).cast("int")
    r = runs(spark, sf_dir).withColumn("mechanical", outcomes.mechanical_reasons(one("blocked"), one("truncated"), F.lit(0)))
    r = r.select("o_orderkey", outcomes.classified(fields("mechanical")).alias("c")).select("o_orderkey", "c.*")
    return r.withColumn("reasons", F.array_join("reasons", ","))


_SPENT = "regexp_matches(lower(concat_ws(' ', error_type, termination_reason)), 'contextbudget|context_budget|context_hard_limit|max_assistant_turns') OR coalesce(error_category = 'policy' AND contains(lower(concat_ws(' ', error_type, termination_reason)), 'context'), false)"
_ELIGIBLE = f"""CASE WHEN release_error IS NOT NULL THEN 'non_model_invalid/non_model/environment_release_failed' WHEN termination_reason = 'reward_unverifiable' THEN 'review_required/non_model/environment_reward_unverifiable'
  WHEN {_SPENT} THEN 'eligible/model/context_or_action_budget_exhausted' WHEN error_category = 'model' THEN 'eligible/model/model_action_error' WHEN termination_category IN ('invalid_action', 'limit_reached') THEN 'eligible/model/'
  WHEN infrastructure_invalid THEN 'non_model_invalid/non_model/trajectory_marked_infrastructure_invalid' WHEN error_category IN {_UNFAIR} THEN 'non_model_invalid/non_model/runtime_error:' || error_category
  WHEN status = 'error' THEN 'non_model_invalid/undetermined/unclassified_runtime_error' ELSE 'eligible/undetermined/' END"""


@query(f"WITH {_RUNS} SELECT {_ELIGIBLE} AS verdict, count(*)::BIGINT AS n, min(o_orderkey) AS first FROM runs GROUP BY 1")
def eligibility_ladder(spark, sf_dir):
    """FLT8."""
    e = outcomes.eligibility(fields())
    return runs(spark, sf_dir).withColumn("e", e).groupBy(F.concat_ws("/", "e.status", "e.responsibility", F.coalesce("e.issue", F.lit(""))).alias("verdict")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


_OUTCOME = """CASE WHEN o_orderkey % 3 = 0 THEN 'no_purchase' WHEN NOT reward_valid THEN 'unverifiable' WHEN o_orderkey % 4 = 0 THEN CASE WHEN reward_type = 'gold_purchase' THEN 'gold_purchase' ELSE 'valid_alternative_purchase' END
  WHEN list_has_any(failed, ['category', 'price_upper']) THEN 'wrong_purchase' WHEN o_orderkey % 6 <> 1 THEN 'partial_purchase' ELSE 'wrong_purchase' END"""
_FAILED = "list_filter([CASE WHEN o_orderkey % 8 = 1 THEN 'category' END, CASE WHEN o_orderkey % 9 = 1 THEN 'price_upper' END, CASE WHEN o_orderkey % 10 = 7 THEN 'option:colour' END], lambda y: y IS NOT NULL)"


def _judged(spark, sf_dir):
    key = F.col("o_orderkey")
    failed = F.array_compact(F.array(F.when(key % 8 == 1, F.lit("category")), F.when(key % 9 == 1, F.lit("price_upper")), F.when(key % 10 == 7, F.lit("option:colour"))))
    r = runs(spark, sf_dir).withColumn("failed", failed)
    return r.withColumn("outcome", outcomes.normalized_outcome(key % 3 != 0, F.col("reward_valid"), key % 4 == 0, F.col("reward_type"), F.col("failed"), F.when(key % 6 != 1, 1).otherwise(0)))


@query(f"""WITH {_RUNS}, x AS (SELECT *, {_FAILED} AS failed FROM runs), y AS (SELECT *, {_OUTCOME} AS outcome FROM x)
SELECT outcome, CASE WHEN reward_type IS NULL OR reward_type = 'reward_unverifiable' THEN NULL WHEN reward_type = 'partial_alternative_purchase' THEN outcome = 'partial_purchase' WHEN reward_type IN ('early_abstain', 'repeat_loop') THEN outcome = 'no_purchase' ELSE reward_type = outcome END AS agrees,
  count(*)::BIGINT AS n FROM y GROUP BY ALL""")
def outcome_agreement(spark, sf_dir):
    """FLT13."""
    return _judged(spark, sf_dir).groupBy("outcome", outcomes.type_agreement(F.col("reward_type"), F.col("outcome")).alias("agrees")).agg(F.count("*").alias("n"))


@query(f"""WITH {_RUNS}, x AS (SELECT *, {_FAILED} AS failed, {_ELIGIBLE} AS e FROM runs), y AS (SELECT *, {_OUTCOME} AS outcome, coalesce(termination_reason, '') AS ends FROM x)
SELECT o_orderkey, CASE WHEN NOT starts_with(e, 'eligible') THEN split_part(e, '/', 3) WHEN outcome IN ('gold_purchase', 'valid_alternative_purchase') THEN NULL WHEN o_orderkey % 21 = 0 THEN 'invalid_action' WHEN ends = 'repeat_loop' THEN 'repeat_loop_no_progress'
    WHEN ends = 'parallel_tool_calls' OR termination_category = 'invalid_action' THEN 'invalid_action' WHEN ends IN ('context_hard_limit', 'max_steps') THEN 'context_or_action_budget_exhausted' WHEN list_contains(failed, 'price_upper') THEN 'over_budget_purchase'
    WHEN list_contains(failed, 'category') THEN 'wrong_product_selection' WHEN list_contains(failed, 'option:colour') THEN 'wrong_option_selection' WHEN outcome IN ('partial_purchase', 'wrong_purchase') THEN 'wrong_product_selection'
    WHEN outcome = 'unverifiable' THEN 'insufficient_evidence' ELSE 'undetermined_model_failure' END AS primary_reason,
  (CASE WHEN NOT starts_with(e, 'eligible') THEN CASE WHEN starts_with(e, 'non_model_invalid') THEN 1.0 ELSE 0.7 END WHEN outcome IN ('gold_purchase', 'valid_alternative_purchase') THEN 1.0 WHEN o_orderkey % 21 = 0 OR ends IN ('repeat_loop', 'parallel_tool_calls') OR coalesce(termination_category = 'invalid_action', false) THEN 1.0
    WHEN ends IN ('context_hard_limit', 'max_steps') THEN 0.95 WHEN list_contains(failed, 'price_upper') THEN 1.0 WHEN list_contains(failed, 'category') THEN 0.95 WHEN list_contains(failed, 'option:colour') THEN 0.9 WHEN outcome IN ('partial_purchase', 'wrong_purchase') THEN 0.65 WHEN outcome = 'unverifiable' THEN 1.0 ELSE 0.4 END)::DOUBLE AS confidence FROM y""")
def attribution_ladder(spark, sf_dir):
    """FLT12."""
    r = _judged(spark, sf_dir).withColumn("eligibility", outcomes.eligibility(fields()))
    r = r.withColumns({"format_correct": F.col("o_orderkey") % 21 != 0, "repeat_loop": F.lit(None).cast("boolean")})
    a = outcomes.attribution(fields("eligibility", "outcome", "format_correct", "repeat_loop", "failed"))
    return r.withColumn("a", a).select("o_orderkey", F.col("a.primary").alias("primary_reason"), F.col("a.confidence").alias("confidence"))


@query(f"""WITH {_RUNS} SELECT (release_error IS NOT NULL OR starts_with(coalesce(termination_reason, ''), 'tool_error:')) AS pause, (o_orderkey % 3 = 0 OR coalesce(blocked, false) OR status = 'review_required') AS review,
  CASE WHEN error_type IS NULL THEN NULL WHEN error_type = 'ShopProtocolError' THEN 'protocol' WHEN error_type = 'ValueError' THEN 'model' WHEN error_type = 'ContextBudgetError' THEN 'policy' WHEN error_type = 'TimeoutError' THEN 'infrastructure' ELSE 'internal' END AS category,
  coalesce(error_type IN ('ShopProtocolError', 'ContextBudgetError', 'TimeoutError', 'Strange'), false) AS spoils, count(*)::BIGINT AS n
FROM (SELECT * REPLACE (coalesce(status, '') AS status) FROM runs) GROUP BY ALL""")
def pause_and_review(spark, sf_dir):
    """FLT14, FLT16, FLT21."""
    c = outcomes.error_category(F.col("error_type"))
    return runs(spark, sf_dir).groupBy(
        outcomes.safety_pause(F.col("release_error"), F.col("status"), F.col("termination_reason")).alias("pause"), outcomes.review_queue(F.col("o_orderkey") % 3 == 0, F.col("blocked"), F.col("status")).alias("review"),
        c.alias("category"), outcomes.invalid_sample(c).alias("spoils"),
    ).agg(F.count("*").alias("n"))


@query(f"""WITH {_RUNS} SELECT (coalesce(status = 'done', false) AND done AND reward_valid AND reward_type = 'gold_purchase' AND coalesce(termination_reason = 'gold_purchase', false) AND o_orderkey % 2 = 0) IS TRUE AS strict, count(*)::BIGINT AS n FROM runs GROUP BY 1""")
def strict_success_count(spark, sf_dir):
    """FLT7."""
    f = fields() | {"terminal_done": F.col("done"), "terminal_over": F.col("done"), "purchase_success": F.col("o_orderkey") % 2 == 0, "reward_version": F.lit("v3")}
    return runs(spark, sf_dir).groupBy(outcomes.strict_success(f, "v3").alias("strict")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_partkey, p_size % 5 AS required, least(p_size % 4, p_size % 5) AS passed, p_size % 3 <> 0 AS bought, CASE p_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'odd' END AS s FROM part)
SELECT p_partkey, round(CASE WHEN required > 0 THEN passed::DOUBLE / required WHEN bought THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS ratio, CASE WHEN NOT bought THEN 'not_purchased' WHEN s IN ('pass', 'fail') THEN s ELSE 'unverifiable' END AS gate, (bought AND coalesce(s IN ('pass', 'fail'), false)) AS verifiable FROM x""")
def dimensions_and_gates(spark, sf_dir):
    """FLT19, AG25 (evaluation's variant)."""
    x = t(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 5 AS required", "least(p_size % 4, p_size % 5) AS passed", "p_size % 3 <> 0 AS bought", "CASE p_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'odd' END AS s")
    d, g = outcomes.dimension(F.col("required"), F.col("passed"), F.col("passed"), F.col("bought")), outcomes.gate(F.col("s"), F.col("bought"))
    return x.select("p_partkey", F.round(d["ratio"], 6).alias("ratio"), g["status"].alias("gate"), g["verifiable"].alias("verifiable"))


# ---- event streams ------------------------------------------------------------

_STEPS = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, event_id, event_type, value, ts FROM events),
steps AS (SELECT user_id, position, event_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'buy' ELSE event_type END AS tool, event_type || ' ' || floor(value % 5)::INT AS action, CASE WHEN event_type = 'error' THEN 'bad' END AS error FROM s),
ev AS (SELECT user_id, position, 1 AS rank, 'tool_step' AS event_type, tool, action, error, event_id::VARCHAR AS call FROM steps UNION ALL SELECT user_id, position + CASE WHEN event_id % 26 = 0 THEN 0 ELSE 1 END, 0, 'guard_rejection', tool, NULL, NULL, event_id::VARCHAR FROM steps WHERE event_id % 13 = 0),
stream AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position, rank, call) AS event_number FROM ev)"""


def stream(spark, sf_dir):
    """PRJ7, JN8: a user's events as a trajectory: steps, and the calls that a guard blocked at or after some of them."""
    e = dealt(t(spark, sf_dir, "events"), "user_id").withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    tool = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "purchase", "buy").otherwise(F.col("event_type"))
    action = F.concat_ws(" ", "event_type", F.floor(F.col("value") % 5).cast("int"))
    call = F.col("event_id").cast("string")
    step = F.struct("position", call.alias("call_id"), tool.alias("tool"), action.alias("action"), F.when(F.col("event_type") == "error", "bad").alias("error"), F.col("value").alias("reward"), F.lit(False).alias("done"))
    guard = F.when(F.col("event_id") % 13 == 0, F.struct((F.col("position") + F.when(F.col("event_id") % 26 == 0, 0).otherwise(1)).alias("step_index"), call.alias("call_id"), tool.alias("tool"), F.lit("blocked").alias("reason")))
    trajectories = e.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.array_sort(F.collect_list(guard)).alias("blocked"), F.map_from_entries(F.collect_list(F.struct(call, F.col("event_type")))).alias("replies"))
    return events.event_stream(trajectories, "user_id")


@query(f"""WITH {_STEPS} SELECT user_id, printf('e%04d', event_number) AS event_id, event_type, tool, CASE WHEN rank = 1 THEN position END AS source_step_index FROM stream""")
def trajectory_events(spark, sf_dir):
    """PRJ7, JN8, WIN9, UDTF1."""
    return stream(spark, sf_dir).select("user_id", "event_id", "event_type", "tool", F.col("source_step_index").cast("long").alias("source_step_index"))


@query(f"""WITH {_STEPS}, g AS (SELECT *, CASE WHEN rank = 1 THEN 'env:' || lower(action) END AS sig FROM stream),
st AS (SELECT *, lag(sig) OVER w AS before FROM g WHERE rank = 1 WINDOW w AS (PARTITION BY user_id ORDER BY event_number)),
r AS (SELECT *, sum(CASE WHEN sig IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_number) AS run FROM st),
l AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1),
a AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (rank = 1) AS n_steps, count(*) FILTER (rank = 0) AS n_guard, count(*) FILTER (error IS NOT NULL) AS n_errors, count(DISTINCT sig) AS n_distinct, count(DISTINCT sig) FILTER (tool = 'search') AS n_searches, arg_min(printf('e%04d', event_number), event_number) FILTER (rank = 1 AND tool = 'buy') AS first_purchase FROM g GROUP BY 1),
c AS (SELECT user_id, count(*) FILTER (sig = before) AS n_consecutive FROM st GROUP BY 1)
SELECT user_id, n_events, n_steps, n_guard, n_errors, n_distinct, n_searches, n_steps - n_distinct AS n_repeats, n_consecutive, longest::BIGINT AS longest, first_purchase, round(n_errors / nullif(n_steps, 0), 6) AS error_rate FROM a JOIN c USING (user_id) JOIN l USING (user_id)""")
def trajectory_behaviour(spark, sf_dir):
    """AG12, AG13, AG33."""
    b = events.behaviour(stream(spark, sf_dir), "user_id")
    return b.select("user_id", "n_events", "n_steps", F.col("n_guard_rejections").alias("n_guard"), "n_errors", F.col("n_distinct_calls").alias("n_distinct"), F.col("n_distinct_searches").alias("n_searches"), F.col("n_exact_repeats").alias("n_repeats"), F.col("n_consecutive_repeats").alias("n_consecutive"), F.col("longest_run").alias("longest"), F.col("first_purchase_event").alias("first_purchase"), F.round("error_rate", 6).alias("error_rate"))


@query("""WITH c AS (SELECT conv_id, list({'i': length(text), 'o': CASE WHEN role = 'assistant' THEN length(text) // 2 END} ORDER BY turn) AS u, list(length(text) ORDER BY turn) AS x FROM conversations GROUP BY 1),
r AS (SELECT conv_id, x, CASE WHEN conv_id % 3 = 0 THEN [] ELSE list_filter(u, lambda y: y.o IS NOT NULL) END AS u FROM c)
SELECT conv_id, CASE WHEN len(u) > 0 THEN 'api_usage' ELSE 'local_context_counter' END AS source, (CASE WHEN len(u) > 0 THEN list_sum(list_transform(u, lambda y: y.i)) ELSE list_sum(x) END)::BIGINT AS prompt,
  (CASE WHEN len(u) > 0 THEN list_sum(list_transform(u, lambda y: y.o)) ELSE 0 END)::BIGINT AS completion, (CASE WHEN len(u) > 0 THEN list_max(list_transform(u, lambda y: y.i + y.o)) ELSE list_max(x) END)::BIGINT AS longest FROM r""")
def token_usage(spark, sf_dir):
    """AG10."""
    n = F.length("text").cast("long")
    u = F.struct("turn", n.alias("input"), F.when(F.col("role") == "assistant", F.floor(n / 2)).alias("output"), F.lit(None).cast("long").alias("total"))
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(u)).alias("u"), F.collect_list(n).alias("x"))
    usage = F.when(F.col("conv_id") % 3 != 0, F.transform("u", lambda y: F.struct(y["input"].alias("input"), y["output"].alias("output"), y["total"].alias("total"))))
    return c.select("conv_id", process.request_tokens(usage, F.col("x")).alias("r")).select("conv_id", "r.*")


# ---- products -------------------------------------------------------------------

@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unverifiable' WHEN lower(p_brand) IN ('brand#12', 'brand#23', 'alias') THEN 'pass' ELSE 'fail' END AS brand,
  CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])' || lower(split_part(p_name, ' ', 1)) || '($|[^a-z0-9])') THEN 'pass' ELSE 'fail' END AS model,
  CASE WHEN p_size <= 25 THEN 'pass' WHEN p_size % 2 = 0 THEN 'unverifiable' WHEN p_retailprice <= 1500 THEN 'pass' ELSE 'fail' END AS price FROM part""")
def product_comparison(spark, sf_dir):
    """RWD1, RWD17, STR6, STR7."""
    aliases = {"brand#12": ["brand#23", "alias"]}
    # texts are made normal first: an Arrow function cannot stand inside a lambda
    p = t(spark, sf_dir, "part").withColumns({"actual": F.when(F.col("p_size") % 7 != 0, products.squeezed(F.col("p_brand"))), "first": products.spaced(F.split_part("p_name", F.lit(" "), F.lit(1))), "title": products.spaced(F.col("p_name"))})
    upper = F.when(F.col("p_size") > 25, F.lit(1500.0))
    return p.select(
        "p_partkey", products.brand(F.array(F.lit("alias")), F.col("actual"), aliases).alias("brand"), products.model(F.array("first"), F.col("title")).alias("model"),
        products.price_gate(F.col("p_retailprice"), F.when(F.col("p_size") % 2 == 1, "pass").otherwise("unverifiable"), upper).alias("price"),
    )


@query("""WITH v AS (SELECT p_brand, p_type, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY ALL), a AS (SELECT p_brand, count(*) AS axes, list_sort(list(p_type) FILTER (list_contains(sizes, 10))) AS hits FROM v GROUP BY 1)
SELECT p_brand, CASE WHEN len(hits) = 1 THEN hits[1] END AS axis, CASE WHEN coalesce(len(hits), 0) = 0 THEN 'axis_not_found' WHEN len(hits) > 1 THEN 'axis_ambiguous' END AS reason FROM a""")
def option_axis_lookup(spark, sf_dir):
    """JN14: a size as an option value, types as the axes that may offer it."""
    v = t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.collect_set(F.col("p_size").cast("string")).alias("sizes"))
    a = v.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "sizes"))).alias("axes"))
    return a.select("p_brand", products.option_axis(F.lit("10"), F.col("axes")).alias("o")).select("p_brand", "o.*")


# ---- plans ----------------------------------------------------------------------


@query("""WITH k AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT count(*) AS n FROM k), v AS (SELECT o_custkey FROM k ORDER BY sha256('task:' || o_custkey), o_custkey LIMIT (SELECT greatest(1, least(round_even(n * 0.2::DOUBLE, 0)::BIGINT, n - 1)) FROM n))
SELECT CASE WHEN o_custkey IN (FROM v) THEN 'validation' ELSE 'train' END AS split, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS tasks FROM orders GROUP BY 1""")
def task_level_split(spark, sf_dir):
    """SMP4."""
    return planning.task_split(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 0.2, "task").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("tasks"))


@query("""WITH d AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 5 <> 0) AS v, count(*) FILTER (o_orderkey % 5 = 0) AS r, bool_or(o_orderstatus = 'F' AND o_orderkey % 5 <> 0) AS g FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(v, 0)::BIGINT AS attempt_index, coalesce(r, 0)::BIGINT AS retry_index FROM customer LEFT JOIN d ON c_custkey = o_custkey WHERE coalesce(v, 0) < 3 AND NOT coalesce(g, false) AND coalesce(r, 0) <= 2""")
def attempts_to_dispatch(spark, sf_dir):
    """SMP13."""
    log = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return planning.next_attempts(t(spark, sf_dir, "customer").select("c_custkey"), log, "c_custkey", F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "F", 3, 2)


@query("""WITH h AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS have FROM lineitem GROUP BY 1) SELECT CASE WHEN have = [0, 1, 2] THEN 'complete' WHEN coalesce(len(have), 0) > 3 THEN 'excessive' ELSE 'incomplete' END AS state, sum(coalesce(len(have), 0))::BIGINT AS n
FROM (SELECT o_orderkey, list_transform(have, lambda x: x - 1) AS have FROM orders LEFT JOIN h ON o_orderkey = l_orderkey) GROUP BY 1""")
def attempt_completeness(spark, sf_dir):
    """AG19."""
    log = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).alias("attempt"))
    return planning.completeness(t(spark, sf_dir, "orders"), log, "o_orderkey", "attempt", 3).groupBy("state").agg(F.sum("n").alias("n"))


@query("""WITH r AS (SELECT c_nationkey AS q, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT q, c_custkey, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN rank BETWEEN 6 AND 10 THEN 0 WHEN rank <= 5 THEN 1 ELSE 2 END, rank)::INT AS new_rank FROM r""")
def rotated_ranking(spark, sf_dir):
    """SRT7."""
    r = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("q"), "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("rank"))
    return planning.perturbed(r, "q", "rank", "rotate", 5).select("q", "c_custkey", "new_rank")


@query("""WITH u AS (SELECT c_nationkey, c_custkey, count(DISTINCT o_orderpriority) AS d, round(coalesce(max(o_totalprice) - min(o_totalprice), 0.0), 2) AS g FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_nationkey, c_custkey FROM u QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY d DESC, g DESC, sha256('case:' || c_custkey), c_custkey) <= 3""")
def case_ranking(spark, sf_dir):
    """SRT6."""
    o = t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").join(t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    u = o.groupBy("c_nationkey", "c_custkey").agg(F.count_distinct("o_orderpriority").alias("d"), F.round(F.coalesce(F.max("o_totalprice") - F.min("o_totalprice"), F.lit(0.0)), 2).alias("g"))
    return planning.case_order(u, "c_custkey", "c_nationkey", "d", "g", "case").filter("place <= 3").select("c_nationkey", "c_custkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'F' AS a, 'O' AS b, count(*)::BIGINT AS n FROM a JOIN b USING (k) UNION ALL SELECT 'F', 'P', count(*)::BIGINT FROM a JOIN c USING (k) UNION ALL SELECT 'O', 'P', count(*)::BIGINT FROM b JOIN c USING (k)""")
def exclusion_overlaps(spark, sf_dir):
    """SET6."""
    o = t(spark, sf_dir, "orders")
    return planning.overlaps({s: o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FOP"}, "o_custkey")


@query("""WITH u AS (SELECT c_custkey, 0 AS batch_pos FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 1) SELECT batch_pos, count(*)::BIGINT AS "rows", count(DISTINCT c_custkey)::BIGINT AS tasks FROM u GROUP BY 1""")
def batch_union(spark, sf_dir):
    """SET1, AG27."""
    c = t(spark, sf_dir, "customer").select("c_custkey")
    return planning.source_counts(planning.batches([c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1")], "c_custkey"), "batch_pos", "c_custkey")


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN value % 7 < 1 THEN NULL ELSE value END AS v FROM events)
SELECT user_id, min(v) AS best_loss, arg_min(event_id, {'v': v, 'e': event_id}) FILTER (v IS NOT NULL) AS best_step, arg_max(v, event_id) FILTER (v IS NOT NULL) AS last_loss, count(v)::BIGINT AS n FROM l GROUP BY 1 HAVING count(v) > 0""")
def best_and_last_loss(spark, sf_dir):
    """AG30."""
    l = t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") % 7 >= 1, F.col("value")).alias("v"))  # noqa: E741
    return planning.best_and_last(l, "user_id", "event_id", "v")


@query("""SELECT sha256(string_agg(doc_id || ':' || n_chars || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || n_chars || ':' || sha256(text))) AS digest, count(*)::BIGINT AS files FROM documents""")
def manifest_digest(spark, sf_dir):
    """AG31."""
    return planning.manifest_digest(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256")))


@query("""WITH b AS (SELECT p_brand, min(p_retailprice) AS low FROM part WHERE p_size > 5 GROUP BY 1) SELECT p_partkey, round(p_retailprice - low, 2) AS above FROM part JOIN b USING (p_brand)""")
def matched_lookup(spark, sf_dir):
    """JN2."""
    p = t(spark, sf_dir, "part")
    low = p.filter("p_size > 5").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"))
    return planning.matched(p, low, "p_brand").select("p_partkey", F.round(F.col("p_retailprice") - F.col("low"), 2).alias("above"))


@query("""WITH m AS (SELECT conv_id, list(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END ORDER BY turn) FILTER (role <> 'system') AS mask FROM conversations GROUP BY 1),
r AS (SELECT conv_id, mask[2:] AS mask FROM m) SELECT conv_id, coalesce(CASE WHEN mask[1] = 1 THEN len(list_filter(range(1, len(mask) + 1), lambda i: mask[i] = 0 AND (i = len(mask) OR mask[i + 1] = 1))) END, 0)::BIGINT AS n_groups FROM r""")
def token_groups(spark, sf_dir):
    """WIN18."""
    c = t(spark, sf_dir, "conversations").filter("role <> 'system'")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("role") == "assistant").cast("int").alias("x")))).alias("m"))
    mask = F.transform(F.expr("slice(m, 2, greatest(size(m) - 1, 0))"), lambda s: s["x"])
    return m.select("conv_id", F.size(process.group_ends(mask)).cast("long").alias("n_groups"))


@query("""WITH a AS (SELECT conv_id, string_split(text, ' ') AS w, string_split(lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS v, turn FROM conversations)
SELECT conv_id, turn, coalesce(list_min(list_filter(range(1, least(len(w), len(v)) + 1), lambda i: w[i] <> v[i])) - 1, least(len(w), len(v)))::BIGINT AS common FROM a WHERE v IS NOT NULL""")
def shared_prefix(spark, sf_dir):
    """WIN19."""
    a = t(spark, sf_dir, "conversations").withColumn("v", F.lead("text", 2).over(Window.partitionBy("conv_id").orderBy("turn"))).filter("v IS NOT NULL")
    return a.select("conv_id", "turn", process.common_prefix(F.split("text", " "), F.split("v", " ")).alias("common"))


@query("""WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_concat(a, [0 FOR i IN range((SELECT max(len(a)) FROM o) - len(a))]), ',') AS padded FROM o""")
def padded_lines(spark, sf_dir):
    """PRJ17."""
    o = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    longest = o.agg(F.max(F.size("a")).alias("n"))
    return o.join(F.broadcast(longest)).select("l_orderkey", F.array_join(process.padded(F.col("a"), F.col("n"), 0), ",").alias("padded"))  # one row
