"""Queries of the behaviour panels over the shop's tables: a client's clicks of a day stand for a trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour
from .queries import query, t

_CALL = {
    "tool": "CASE WHEN kind = 'purchase' THEN 'buy_now' WHEN kind = 'signup' THEN 'finish_without_purchase' WHEN kind = 'click' AND click_id % 3 = 0 THEN 'select_option' WHEN kind = 'click' THEN 'open_product' WHEN kind IS NULL THEN NULL WHEN click_id % 5 = 0 THEN 'view_reviews' WHEN click_id % 5 = 1 THEN 'next_page' ELSE 'search_products' END",
    "asin": "concat('1000000', click_id % 4)",
    "said": "CASE click_id % 4 WHEN 0 THEN ' Red  Cup' WHEN 1 THEN 'red cup ' WHEN 2 THEN 'Blue Cup' END",
    "option_value": "CASE click_id % 2 WHEN 0 THEN 'S' ELSE ' L ' END",
    "env_action": "CASE WHEN click_id % 7 = 0 THEN ' Search[A  b]' WHEN click_id % 7 = 1 THEN '  ' END",
    "guard_reason": "CASE WHEN click_id % 4 = 0 THEN 'schema_missing' WHEN click_id % 4 = 1 THEN 'not_on_page' END",
}
_MADE = ", ".join(f"{e} AS {n}" for n, e in _CALL.items())
_CLICKS = f"""c AS (SELECT click_id, min(client_id) AS client_id, min(ts) AS ts, min(kind) AS kind FROM clicks GROUP BY 1),
r AS (SELECT *, CAST(ts AS DATE) AS day, {_MADE} FROM c)"""
#: What a tool's parameters come to; the note is part of a call, not of an action.
_PARAMETERS = "CASE tool WHEN 'search_products' THEN 'query:' || coalesce(said, '-') WHEN 'open_product' THEN 'asin:' || asin WHEN 'select_option' THEN 'value:' || option_value ELSE '' END"
_FOLDED = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, each once, as a client's calls of a day."""
    c = t(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("ts").alias("ts"), F.min("kind").alias("kind"))
    rows = c.selectExpr("*", "CAST(ts AS DATE) AS day", *[f"{e} AS {n}" for n, e in _CALL.items()])
    note = "map_filter(map('note', CAST(click_id % 3 AS string)), (k, v) -> click_id % 11 = 0)"
    own = "CASE tool WHEN 'search_products' THEN map('query', said) WHEN 'open_product' THEN map('asin', asin) WHEN 'select_option' THEN map('value', option_value) ELSE map_filter(map('', ''), (k, v) -> false) END"
    return rows.selectExpr("*", f"map_concat({own}, {note}) AS parameters")


def joined(column: str):
    """A map of counts as text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(column)


@query(f"""WITH {_CLICKS},
x AS (SELECT *, coalesce(kind = 'error', false) AS guard, {_FOLDED.format("env_action")} AS act, CASE WHEN kind IS DISTINCT FROM 'error' AND tool = 'search_products' THEN {_FOLDED.format("said")} END AS q FROM r),
s AS (SELECT *, CASE WHEN act <> '' THEN 'env:' || act ELSE coalesce(tool, '') || '|' || {_PARAMETERS} END AS sig, NOT guard AND click_id % 6 <> 0 AS had FROM x),
w AS (SELECT *, lag(sig) OVER o AS last_sig, last_value(q IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_q FROM s WINDOW o AS (PARTITION BY client_id, day ORDER BY ts, click_id)),
g AS (SELECT client_id, day, count(*) FILTER (NOT guard) AS executed_tool_steps, count(*) AS action_attempts, count(*) FILTER (NOT guard AND tool = 'search_products') AS search_count, count(*) FILTER (NOT guard AND tool = 'open_product') AS open_product_count,
  count(*) FILTER (NOT guard AND tool = 'view_reviews') AS information_page_count, count(*) FILTER (NOT guard AND tool = 'select_option') AS select_option_count, count(*) FILTER (NOT guard AND tool = 'buy_now') AS buy_count, count(*) FILTER (NOT guard AND tool = 'finish_without_purchase') AS finish_without_purchase_count,
  count(*) FILTER (q = last_q) AS consecutive_duplicate_search_count, count(*) FILTER (sig = last_sig) AS consecutive_duplicate_action_count, count(*) FILTER (guard) AS guard_rejection_count, count(*) FILTER (click_id % 13 = 0) AS malformed_tool_call_count,
  count(*) FILTER (guard AND guard_reason = 'schema_missing') AS schema_rejection_count, count(*) FILTER (NOT guard AND click_id % 17 = 0) AS step_error_count, count(*) FILTER (had) AS projection_count, count(*) FILTER (had AND click_id % 10 = 3) AS truncated_observation_count,
  coalesce(sum(CASE WHEN had AND click_id % 8 > 0 THEN click_id % 500 END), 0)::BIGINT AS raw_observation_tokens, coalesce(sum(CASE WHEN had THEN click_id % 90 END), 0)::BIGINT AS visible_observation_tokens, count(*) FILTER (had AND click_id % 19 < 2) AS critical_footer_failures,
  count(*) FILTER (NOT guard AND tool = 'search_products') - count(DISTINCT q) AS duplicate_search_query_count, count(*) - count(DISTINCT sig) AS duplicate_canonical_action_count, count(*) FILTER (had AND click_id % 10 = 3) > 0 AS any_observation_truncated,
  count(DISTINCT CASE WHEN NOT guard AND tool = 'open_product' THEN asin END) AS opened_candidate_count, count(DISTINCT CASE WHEN NOT guard AND tool = 'search_products' AND click_id % 3 < 2 THEN click_id % 6 END) AS visible_search_candidate_count,
  histogram(coalesce(tool, 'unknown')) FILTER (NOT guard) AS th, histogram(coalesce(guard_reason, 'unknown')) FILTER (guard) AS gh FROM w GROUP BY 1, 2)
SELECT * EXCLUDE (th, gh), coalesce(array_to_string(list_transform(list_sort(map_entries(th)), lambda e: e.key || '=' || e.value), ','), '') AS tool_counts, coalesce(array_to_string(list_transform(list_sort(map_entries(gh)), lambda e: e.key || '=' || e.value), ','), '') AS guard_reason_counts FROM g""")  # fmt: skip
def metric_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: actions, repetition, legality and context of a client's day."""
    projection = "CASE WHEN click_id % 6 <> 0 THEN named_struct('truncated', click_id % 10 = 3, 'raw_tokens', CASE WHEN click_id % 8 > 0 THEN click_id % 500 END, 'visible_tokens', click_id % 90, 'footer_kept', CASE click_id % 19 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END) END AS projection"
    shown = "CASE WHEN click_id % 3 < 2 THEN concat('1|2000000', click_id % 6, '|cup 123 1234567890123 2000000', click_id % 6) END AS shown"
    events = calls(spark, sf_dir).selectExpr("client_id", "day", "ts", "click_id", "CASE WHEN kind = 'error' THEN 'guard_rejection' ELSE 'tool_step' END AS event_type", "tool", "parameters", "env_action", "guard_reason", "click_id % 13 = 0 AS parse_error", "click_id % 17 = 0 AS step_error", shown, projection)
    found = behaviour.metric_panel(events, ["client_id", "day"], ["ts", "click_id"], r"(?<!\d)\d{8,12}(?!\d)")
    maps = ("tool_counts", "guard_reason_counts")
    return found.select(*[joined(c) if c in maps else c for c in found.columns])


@query(f"""WITH {_CLICKS},
x AS (SELECT *, click_id % 9 <> 4 AS call, kind IS DISTINCT FROM 'error' AS ok, nullif(trim(said), '') AS q, coalesce(tool, '') || '|' || {_PARAMETERS} || CASE WHEN click_id % 11 = 0 THEN '|' || click_id % 3 ELSE '' END AS sig FROM r),
k AS (SELECT *, lag(sig) OVER o AS before FROM x WHERE call WINDOW o AS (PARTITION BY client_id, day ORDER BY ts, click_id)),
n AS (SELECT *, sum(CASE WHEN sig IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY client_id, day ORDER BY ts, click_id) AS island FROM k),
l AS (SELECT client_id, day, max(c) AS longest FROM (SELECT client_id, day, island, count(*) AS c FROM n GROUP BY ALL) GROUP BY 1, 2),
a AS (SELECT client_id, day, count(*) AS attempted_tool_calls, count(*) FILTER (ok) AS executed_tool_calls, count(*) FILTER (tool = 'search_products') AS search_count, count(*) FILTER (tool = 'next_page') AS page_navigation_count, count(*) FILTER (tool = 'open_product') AS product_open_count,
  count(*) FILTER (tool = 'view_reviews') AS detail_view_count, count(*) FILTER (tool = 'select_option') AS option_selection_count, count(*) FILTER (tool = 'buy_now') AS purchase_call_count, count(*) FILTER (tool = 'finish_without_purchase') AS finish_without_purchase_count, count(*) FILTER (sig = before) AS exact_consecutive_repeat_count,
  string_agg(CASE WHEN tool = 'search_products' THEN q END, ',' ORDER BY ts, click_id) AS search_queries, string_agg(CASE WHEN tool = 'open_product' THEN asin END, ',' ORDER BY ts, click_id) AS opened_asins, string_agg(CASE WHEN tool = 'select_option' THEN trim(option_value) END, ',' ORDER BY ts, click_id) AS selected_options,
  arg_min(click_id, (ts, click_id)) FILTER (tool = 'search_products') AS first_search, arg_min(click_id, (ts, click_id)) FILTER (tool = 'open_product') AS first_product_open, arg_min(click_id, (ts, click_id)) FILTER (tool = 'select_option') AS first_option_selection, arg_min(click_id, (ts, click_id)) FILTER (tool = 'buy_now') AS first_purchase,
  count(DISTINCT CASE WHEN tool = 'search_products' THEN {_FOLDED.format("q")} END) FILTER (q IS NOT NULL) AS unique_search_query_count, count(DISTINCT CASE WHEN tool = 'open_product' THEN asin END) AS unique_product_open_count, histogram(tool) AS th, histogram(tool) FILTER (ok) AS eh FROM k GROUP BY 1, 2),
e AS (SELECT client_id, day, count(*) FILTER (click_id % 9 = 5) AS guard_rejection_count, arg_max(click_id, (ts, click_id)) FILTER (NOT call AND click_id % 2 = 1) AS termination, count(DISTINCT CASE WHEN click_id % 4 > 0 AND (call OR click_id % 2 = 0) THEN click_id // 3 END) AS total_assistant_turns,
  count(DISTINCT CASE WHEN click_id % 3 = 0 THEN click_id % 7 END) AS products_seen_count, count(DISTINCT CASE WHEN click_id % 5 = 2 THEN coalesce(said, '') || greatest(click_id % 4 - 1, 0) END) AS unique_result_page_count FROM x GROUP BY 1, 2)
SELECT e.*, coalesce(attempted_tool_calls, 0) AS attempted_tool_calls, coalesce(executed_tool_calls, 0) AS executed_tool_calls, coalesce(search_count, 0) AS search_count, coalesce(page_navigation_count, 0) AS page_navigation_count, coalesce(product_open_count, 0) AS product_open_count, coalesce(detail_view_count, 0) AS detail_view_count,
  coalesce(option_selection_count, 0) AS option_selection_count, coalesce(purchase_call_count, 0) AS purchase_call_count, coalesce(finish_without_purchase_count, 0) AS finish_without_purchase_count, coalesce(exact_consecutive_repeat_count, 0) AS exact_consecutive_repeat_count, coalesce(longest, 0) AS max_exact_repeat_run,
  coalesce(search_queries, '') AS search_queries, coalesce(opened_asins, '') AS opened_asins, coalesce(selected_options, '') AS selected_options, first_search, first_product_open, first_option_selection, first_purchase, coalesce(unique_search_query_count, 0) AS unique_search_query_count, coalesce(unique_product_open_count, 0) AS unique_product_open_count,
  coalesce(array_to_string(list_transform(list_sort(map_entries(th)), lambda y: y.key || '=' || y.value), ','), '') AS tool_counts_attempted, coalesce(array_to_string(list_transform(list_sort(map_entries(eh)), lambda y: y.key || '=' || y.value), ','), '') AS tool_counts_executed
FROM e LEFT JOIN a ON e.client_id IS NOT DISTINCT FROM a.client_id AND e.day IS NOT DISTINCT FROM a.day LEFT JOIN l ON e.client_id IS NOT DISTINCT FROM l.client_id AND e.day IS NOT DISTINCT FROM l.day""")  # fmt: skip
def call_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13: what was called, seen, opened and chosen on a client's day."""
    kind = "CASE WHEN click_id % 9 <> 4 THEN 'assistant_tool_call' WHEN click_id % 2 = 0 THEN 'assistant_message' ELSE 'termination' END AS kind"
    page = "CASE WHEN click_id % 5 = 2 THEN named_struct('query', said, 'number', click_id % 4 - 1) END AS page"
    events = calls(spark, sf_dir).selectExpr("client_id", "day", "ts", "click_id", "click_id AS event_id", kind, "CASE WHEN click_id % 4 > 0 THEN 'assistant' ELSE 'tool' END AS role", "click_id div 3 AS message_index", "coalesce(kind, '') <> 'error' AS accepted", "tool", "parameters", "click_id % 9 = 5 AS blocked", "CASE WHEN click_id % 3 = 0 THEN array(CAST(click_id % 7 AS string), ' ', NULL) END AS seen", page)
    found = behaviour.call_behaviour(events, ["client_id", "day"], ["ts", "click_id"])
    maps, lists = ("tool_counts_attempted", "tool_counts_executed"), ("search_queries", "opened_asins", "selected_options")
    return found.select(*[joined(c) if c in maps else F.array_join(c, ",").alias(c) if c in lists else c for c in found.columns])


_OUTCOMES = {
    "kind": "CASE sale_id % 5 WHEN 0 THEN 'gold_purchase' WHEN 1 THEN 'max_steps' WHEN 2 THEN 'repeat_loop' WHEN 3 THEN '' END",
    "why": "CASE sale_id % 7 WHEN 0 THEN 'repeat_loop' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'gold_purchase' END",
    "fault": "CASE sale_id % 11 WHEN 0 THEN 'ContextBudgetError' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'ValueError' WHEN 3 THEN '' END",
    "release": "CASE sale_id % 13 WHEN 0 THEN 'URLError' WHEN 1 THEN '' END",
    "version": "CASE sale_id % 17 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE 'v3' END",
}
_OUT_MADE = ", ".join(f"{e} AS {n}" for n, e in _OUTCOMES.items())


@query(f"""WITH s AS (SELECT DISTINCT sale_id, status, total, priority FROM sales), r AS (SELECT *, {_OUT_MADE}, sale_id % 6 <> 5 AS has, coalesce(status = 'done', false) AS ended, sale_id % 8 <> 0 AS d, sale_id % 10 <> 0 AS td FROM s),
x AS (SELECT *, CASE WHEN has AND kind <> '' THEN kind ELSE 'unknown' END AS reward_type, coalesce(CASE WHEN has THEN nullif(why, '') END, CASE WHEN sale_id % 3 = 0 THEN 'limit' END, nullif(status, ''), 'unknown') AS reason,
  list_filter([total, priority * 10.5, -1.0, NULL], lambda y: y >= 0 AND y < 'inf'::DOUBLE) AS tk FROM r)
SELECT sale_id, status, total, priority, reward_type, reason AS termination_reason, coalesce(total, 0.0) AS final_reward, coalesce(CASE WHEN has AND sale_id % 2 = 0 THEN 0.5 END, total, 0.0) AS terminal_utility, (ended AND d AND td AND has AND version = 'v3' AND kind = 'gold_purchase' AND why = 'gold_purchase') IS TRUE AS strict,
  (reward_type = 'max_steps' OR reason = 'max_steps') AS max_steps, (reward_type = 'repeat_loop' OR reason = 'repeat_loop') AS repeat_loop, len(tk)::BIGINT AS turns, coalesce(list_sum(list_transform(tk, lambda y: trunc(y))), 0)::BIGINT AS tokens, coalesce(list_max(list_transform(tk, lambda y: trunc(y))), 0)::BIGINT AS most,
  (release IS NOT NULL OR coalesce(fault IN ('ContextBudgetError', 'TimeoutError'), false)) AS infrastructure, nullif(fault, '') AS fault_type, nullif(release, '') AS release_type,
  concat_ws(',', CASE WHEN ended AND NOT d THEN 'done_status_without_trajectory_done' END, CASE WHEN ended AND NOT td THEN 'done_status_without_terminal_done' END, CASE WHEN ended AND NOT has THEN 'done_status_without_reward_detail' END,
    CASE WHEN has AND version <> 'v3' THEN 'unexpected_reward_version' END, CASE WHEN sale_id % 19 = 0 THEN 'normalization_warnings' END) AS issues FROM x""")  # fmt: skip
def outcome_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: sales as ended trajectories, their outcome, context and validity."""
    r = t(spark, sf_dir, "sales").select("sale_id", "status", "total", "priority").distinct().selectExpr("*", *[f"{e} AS {n}" for n, e in _OUTCOMES.items()])
    terminal = "named_struct('done', sale_id % 10 <> 0, 'over', true, 'termination_reason', CASE WHEN sale_id % 3 = 0 THEN 'limit' END) AS terminal"
    detail = "CASE WHEN sale_id % 6 <> 5 THEN named_struct('reward_version', version, 'reward_type', kind, 'reward_valid', true, 'terminal_utility', CASE WHEN sale_id % 2 = 0 THEN 0.5D END, 'weighted_score', 0.25D, 'purchase_success', true, 'termination_reason', why) END AS detail"
    rows = r.selectExpr(
        "sale_id", "status", "total", "priority", "sale_id % 8 <> 0 AS done", "total AS final_reward", "false AS infrastructure_invalid", "fault AS trajectory_error", "release AS release_error", "CAST(CASE WHEN sale_id % 19 = 0 THEN 1 END AS long) AS warnings",
        "CAST(NULL AS long) AS truncations", "CAST(0 AS long) AS compactions", "array(total, priority * 10.5D, -1.0D, CAST(NULL AS double)) AS turn_tokens", terminal, detail,
    )
    p = behaviour.outcome_panel(rows, "v3")
    return p.select(
        "sale_id", "status", "total", "priority", "outcome.reward_type", "outcome.termination_reason", "outcome.final_reward", "outcome.terminal_utility", F.col("outcome.strict_gold_success").alias("strict"), F.col("outcome.max_steps_termination").alias("max_steps"),
        F.col("outcome.repeat_loop_termination").alias("repeat_loop"), F.col("context.input_token_turn_count").alias("turns"), F.col("context.input_tokens_sum").alias("tokens"), F.col("context.max_input_tokens").alias("most"), F.col("validity.infrastructure_invalid").alias("infrastructure"),
        F.col("validity.trajectory_error_type").alias("fault_type"), F.col("validity.release_error_type").alias("release_type"), F.array_join("validity.trajectory_contract_issues", ",").alias("issues"),
    )
