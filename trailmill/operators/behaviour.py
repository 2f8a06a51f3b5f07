"""Panels of counts over the event rows of trajectories.

Repeats next to each other need the order of a trajectory's own rows, so its rows meet in one task, once; a trajectory
is bounded by its limit of steps. Rows are dealt by trajectory to as many tasks as the input asks for. Different values and tallies come from the same dealing: a row is made for each
value, and aggregates by (key, name, value), then by key, need no further shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import dealt

#: Names of tools. Fixed values.
SEARCH, OPEN, OPTION, BUY, FINISH = "search_products", "open_product", "select_option", "buy_now", "finish_without_purchase"
INFORMATION = ("view_attributes", "view_description", "view_features", "view_reviews")
PAGING = ("next_page", "prev_page")


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _count(c: Column) -> Column:
    return F.sum(_no(c).cast("long"))


def _folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def _argument(name: str) -> Column:
    """A call's argument without outer white space; null where it is missing or empty."""
    return F.nullif(F.trim(F.col("parameters")[name]), F.lit(""))


def _call(tool: Column, parameters: Column) -> Column:
    # JSON has no bare line break, so the last one ends the tool
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(parameters, F.create_map().cast("map<string,string>")))))
    return F.concat(F.coalesce(tool, F.lit("")), F.lit("\n"), F.to_json(sorted_map, {"ignoreNullFields": "false"}))


def action_signature() -> Column:
    """The environment's action, white space and case folded, else the tool and its parameters by name, a note left out."""
    action = _folded(F.col("env_action"))
    return F.when(action != "", F.concat(F.lit("env:"), action)).otherwise(_call(F.lower("tool"), F.map_filter("parameters", lambda k, _: k != "note")))


def call_signature() -> Column:
    """The tool and all its parameters by name, as they are."""
    return _call(F.col("tool"), F.col("parameters"))


def _panel(rows: DataFrame, key: list[str], facts: list[Column], distinct: dict[str, Column], tallies: dict[str, Column]) -> DataFrame:
    """Facts over the rows of each key, different values of each name in distinct, and a map of value to count of each name in tallies.

    distinct and tallies are arrays of strings whose nulls don't count. Facts are aggregates; those that gather values
    should do so where `_n` is empty, on a row that stands for the event itself.
    """

    def named(n: str, values: Column) -> Column:
        return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(n).alias("_n"), x.alias("_x")))

    own = F.array(F.struct(F.lit("").alias("_n"), F.lit(None).cast("string").alias("_x")))
    each = rows.select("*", F.inline(F.flatten(F.array(own, *[named(n, v) for n, v in {**distinct, **tallies}.items()]))))
    names = [c for c in each.limit(0).groupBy(*key).agg(*facts).columns if c not in key]
    each = each.groupBy(*key, "_n", "_x").agg(*facts, F.count("*").alias("_c"))
    whole = [F.any_value(F.when(F.col("_n") == "", F.col(c)), F.lit(True)).alias(c) for c in names]
    counts = [F.count(F.when(F.col("_n") == n, 1)).alias(n) for n in distinct]
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_n") == n, F.struct("_x", "_c"))))).alias(n) for n in tallies]
    return each.groupBy(*key).agg(*whole, *counts, *maps)


def _one(value: Column) -> Column:
    return F.array(value.cast("string"))


def metric_panel(events: DataFrame, key: list[str], order: list[str], id_pattern: str) -> DataFrame:
    """AG12 over events: actions, repetition, legality and context of each trajectory.

    events: key, order (a total order in the key), event_type ('tool_step' or 'guard_rejection'; others are attempts only),
    tool, parameters map<string, string>, env_action, guard_reason, parse_error, step_error boolean, shown (text that the
    actor saw), projection struct<truncated boolean, raw_tokens long, visible_tokens long, footer_kept boolean>, null where
    a step has none. id_pattern finds product ids in shown texts (its whole match).
    A missing tool or reason counts as 'unknown'. A repeat is an action whose signature came before in the trajectory,
    guard rejections included; a search repeats by its query alone. Null flags count as false, but a footer must be
    known to be kept.
    """
    step, guard = _no(F.col("event_type") == "tool_step"), _no(F.col("event_type") == "guard_rejection")
    is_tool = lambda *names: F.col("_step") & _no(F.col("tool").isin(*names))
    rows = dealt(events, *key).withColumn("_step", step).withColumn("_guard", guard).withColumn("_sig", action_signature())
    rows = rows.withColumn("_query", F.when(is_tool(SEARCH), _folded(F.col("parameters")["query"])))
    by = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("_last_sig", F.lag("_sig").over(by)).withColumn("_last_query", F.last("_query", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    had, p = F.col("_step") & F.col("projection").isNotNull(), F.col("projection")
    number = lambda c: F.coalesce(F.sum(F.when(had, c)), F.lit(0)).cast("long")
    facts = [
        _count(F.col("_step")).alias("executed_tool_steps"), F.count("*").alias("action_attempts"), _count(is_tool(SEARCH)).alias("search_count"), _count(is_tool(OPEN)).alias("open_product_count"),
        _count(is_tool(*INFORMATION)).alias("information_page_count"), _count(is_tool(OPTION)).alias("select_option_count"), _count(is_tool(BUY)).alias("buy_count"), _count(is_tool(FINISH)).alias("finish_without_purchase_count"),
        _count(F.col("_query") == F.col("_last_query")).alias("consecutive_duplicate_search_count"), _count(F.col("_sig") == F.col("_last_sig")).alias("consecutive_duplicate_action_count"),
        _count(F.col("_guard")).alias("guard_rejection_count"), _count(F.col("parse_error")).alias("malformed_tool_call_count"), _count(F.col("_guard") & F.startswith("guard_reason", F.lit("schema_"))).alias("schema_rejection_count"),
        _count(F.col("_step") & _no(F.col("step_error"))).alias("step_error_count"), _count(had).alias("projection_count"), _count(had & _no(p["truncated"])).alias("truncated_observation_count"),
        number(p["raw_tokens"]).alias("raw_observation_tokens"), number(p["visible_tokens"]).alias("visible_observation_tokens"), _count(had & ~_no(p["footer_kept"])).alias("critical_footer_failures"),
    ]
    ids = F.when(is_tool(SEARCH), F.regexp_extract_all("shown", F.lit(id_pattern), F.lit(0)))
    distinct = {"_sigs": _one(F.col("_sig")), "_queries": _one(F.col("_query")), "_shown": ids, "_opened": F.when(is_tool(OPEN), _one(F.col("parameters")["asin"]))}
    label = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    tallies = {"tool_counts": F.when(F.col("_step"), _one(label("tool"))), "guard_reason_counts": F.when(F.col("_guard"), _one(label("guard_reason")))}
    out = _panel(rows, key, facts, distinct, tallies)
    return out.select(
        *[c for c in out.columns if c not in distinct], F.col("_shown").alias("visible_search_candidate_count"), F.col("_opened").alias("opened_candidate_count"),
        (F.col("search_count") - F.col("_queries")).alias("duplicate_search_query_count"), (F.col("action_attempts") - F.col("_sigs")).alias("duplicate_canonical_action_count"),
        (F.col("truncated_observation_count") > 0).alias("any_observation_truncated"),
    )


def call_behaviour(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """AG13: what each trajectory's assistant called, saw, opened and chose, and where it did so first.

    events: key, order (a total order in the key), event_id, kind ('assistant_tool_call', 'assistant_message', 'termination',
    others), role, message_index, accepted boolean, tool, parameters map<string, string>, blocked boolean (the guard refused
    the call), seen array<string> (ids of products shown), page struct<query string, number long> (null but for results).
    A call counts as executed where accepted is true. Counts of one tool are over attempted calls. Repeats are equal
    calls next to each other among the attempted ones. Lists keep the order of calls, repeats included; they are as long
    as a trajectory's calls. A trajectory without calls has zeros and empty lists.
    """
    rows = dealt(events, *key).withColumn("_call", _no(F.col("kind") == "assistant_tool_call")).withColumn("_sig", F.when(F.col("_call"), call_signature()))
    rows = rows.withColumn("_name", F.when(F.col("_call"), F.nullif(F.trim("tool"), F.lit("")))).withColumn("_accepted", F.col("_call") & _no(F.col("accepted")))
    by = Window.partitionBy(*key).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_same", F.col("_call") & _no(F.col("_sig") == F.last("_sig", ignorenulls=True).over(before)))
    rows = rows.withColumn("_nth", F.sum(F.col("_call").cast("long")).over(by))
    # calls of a run so far: those since its first one
    start = F.max(F.when(F.col("_call") & ~F.col("_same"), F.col("_nth"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", F.when(F.col("_call"), F.col("_nth") - start + 1))
    named = lambda *names: _no(F.col("_name").isin(*names))
    at = F.struct(*order)
    argument = lambda tool, name: F.when(F.col("_call") & _no(F.col("tool") == tool), _argument(name))
    query, opened, chosen = argument(SEARCH, "query"), argument(OPEN, "asin"), argument(OPTION, "value")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when((F.col("_n") == "") & c.isNotNull(), F.struct(*order, c.alias("_v"))))), lambda x: x["_v"])
    first = lambda tool: F.min_by("event_id", F.when(F.col("_call") & _no(F.col("tool") == tool), at))
    facts = [
        _count(F.col("_call")).alias("attempted_tool_calls"), _count(F.col("_accepted")).alias("executed_tool_calls"), _count(F.col("blocked")).alias("guard_rejection_count"),
        _count(named(SEARCH)).alias("search_count"), _count(named(*PAGING)).alias("page_navigation_count"), _count(named(OPEN)).alias("product_open_count"), _count(named(*INFORMATION)).alias("detail_view_count"),
        _count(named(OPTION)).alias("option_selection_count"), _count(named(BUY)).alias("purchase_call_count"), _count(named(FINISH)).alias("finish_without_purchase_count"),
        _count(F.col("_same")).alias("exact_consecutive_repeat_count"), F.coalesce(F.max("_run"), F.lit(0)).cast("long").alias("max_exact_repeat_run"),
        listed(query).alias("search_queries"), listed(opened).alias("opened_asins"), listed(chosen).alias("selected_options"),
        first(SEARCH).alias("first_search"), first(OPEN).alias("first_product_open"), first(OPTION).alias("first_option_selection"), first(BUY).alias("first_purchase"),
        F.max_by("event_id", F.when(_no(F.col("kind") == "termination"), at)).alias("termination"),
    ]
    turn = F.when(_no((F.col("role") == "assistant") & F.col("kind").isin("assistant_tool_call", "assistant_message")), _one(F.col("message_index")))
    page = F.when(F.col("page").isNotNull(), _one(F.to_json(F.struct(F.coalesce(F.col("page.query"), F.lit("")).alias("q"), F.greatest(F.coalesce(F.col("page.number"), F.lit(0)), F.lit(0)).alias("n")))))
    seen = F.transform("seen", lambda x: F.nullif(F.trim(x), F.lit("")))
    distinct = {"total_assistant_turns": turn, "unique_search_query_count": _one(F.when(query.isNotNull(), _folded(query))), "unique_product_open_count": _one(opened), "products_seen_count": seen, "unique_result_page_count": page}
    tallies = {"tool_counts_attempted": _one(F.col("_name")), "tool_counts_executed": F.when(F.col("_accepted"), _one(F.col("_name")))}
    return _panel(rows, key, facts, distinct, tallies)


#: Errors of the machinery around a run. Fixed values.
INFRASTRUCTURE_ERRORS = ("ContextBudgetError", "RemoteDisconnected", "ShopHttpError", "TimeoutError", "URLError")


def outcome_panel(rows: DataFrame, version: str, infrastructure: tuple[str, ...] = INFRASTRUCTURE_ERRORS) -> DataFrame:
    """AG12 over trajectories: outcome, context and validity as structs beside the row's own columns.

    rows: status, done, final_reward, infrastructure_invalid, trajectory_error, release_error (types of errors; null for
    none, empty for an error without a type), warnings, truncations, compactions long, turn_tokens array<double>, terminal
    struct<done, over, termination_reason>, detail struct<reward_version, reward_type, reward_valid, terminal_utility,
    weighted_score, purchase_success, termination_reason>; either struct may be null. Turns of negative, infinite or
    unknown size don't count.
    """
    d, e = F.col("detail"), F.col("terminal")
    given = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("unknown"))
    number = lambda c: F.when(F.isnan(c), c).otherwise(F.coalesce(c, F.lit(0.0)))
    status, kind, reason = F.col("status"), given(d["reward_type"]), given(d["termination_reason"], e["termination_reason"], F.col("status"))
    ended = _no(status == "done")
    won = reduce(lambda a, b: a & b, [_no(c) for c in (
        ended, F.col("done"), e["done"], e["over"], d["reward_version"] == version, d["reward_type"] == "gold_purchase", d["reward_valid"], d["purchase_success"], d["termination_reason"] == "gold_purchase",
    )])
    loop = (kind == "repeat_loop") | (reason == "repeat_loop")
    outcome = F.struct(
        kind.alias("reward_type"), number(F.col("final_reward")).alias("final_reward"), number(F.coalesce(d["terminal_utility"], F.col("final_reward"))).alias("terminal_utility"), number(d["weighted_score"]).alias("weighted_score"),
        _no(d["purchase_success"]).alias("purchase_success"), won.alias("strict_gold_success"), _no(F.col("done")).alias("done"), _no(e["done"]).alias("terminal_done"), _no(e["over"]).alias("terminal_over"),
        reason.alias("termination_reason"), ((kind == "max_steps") | (reason == "max_steps") | _no(status == "max_steps")).alias("max_steps_termination"), loop.alias("repeat_loop_termination"), _no(status == "invalid_action_limit").alias("invalid_action_limit"),
    )
    tokens = F.transform(F.filter(F.coalesce("turn_tokens", F.array().cast("array<double>")), lambda x: (x >= 0) & (x < float("inf"))), lambda x: x.cast("long"))
    context = F.struct(
        F.size(tokens).cast("long").alias("input_token_turn_count"), F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: s + x).alias("input_tokens_sum"), F.coalesce(F.array_max(tokens), F.lit(0)).cast("long").alias("max_input_tokens"),
        F.coalesce("truncations", F.lit(0)).cast("long").alias("tool_call_truncation_count"), F.coalesce("compactions", F.lit(0)).cast("long").alias("context_compaction_count"),
    )
    issues = F.array_compact(F.array(
        F.when(ended & ~_no(F.col("done")), "done_status_without_trajectory_done"), F.when(ended & ~_no(e["done"]), "done_status_without_terminal_done"), F.when(ended & ~_no(e["over"]), "done_status_without_terminal_over"),
        F.when(ended & d.isNull(), "done_status_without_reward_detail"), F.when(_no(d["reward_version"] != version), "unexpected_reward_version"), F.when(F.coalesce("warnings", F.lit(0)) > 0, "normalization_warnings"),
    ))
    broken = _no(F.col("infrastructure_invalid")) | F.col("release_error").isNotNull() | _no(F.col("trajectory_error").isin(*infrastructure))
    validity = F.struct(
        broken.alias("infrastructure_invalid"), F.nullif("trajectory_error", F.lit("")).alias("trajectory_error_type"), F.nullif("release_error", F.lit("")).alias("release_error_type"),
        _no(F.col("trajectory_error") == "ContextBudgetError").alias("context_hard_limit"), (F.size(issues) == 0).alias("trajectory_contract_valid"), issues.alias("trajectory_contract_issues"), (~broken).alias("judge_eligible"),
    )
    return rows.withColumn("outcome", outcome).withColumn("context", context).withColumn("validity", validity)
