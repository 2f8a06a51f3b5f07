"""Behaviour panels on literal trajectories."""

import pytest

from trailmill.operators import behaviour

IDS = r"(?<!\d)\d{8,12}(?!\d)"
EVENTS = """key string, n int, event_type string, tool string, parameters map<string,string>, env_action string, guard_reason string, parse_error boolean, step_error boolean, shown string,
projection struct<truncated:boolean,raw_tokens:bigint,visible_tokens:bigint,footer_kept:boolean>"""


def event(key, n, tool, parameters=None, kind="tool_step", action=None, reason=None, parse=None, error=None, shown=None, projection=None):
    return (key, n, kind, tool, parameters, action, reason, parse, error, shown, projection)


def panel(spark, rows):
    # rows come in any order
    got = behaviour.metric_panel(spark.createDataFrame(rows[::-1], EVENTS), ["key"], ["n"], IDS).collect()
    return {r["key"]: r.asDict() for r in got}


def test_metric_panel(spark):
    got = panel(spark, [
        event("a", 1, "search_products", {"query": " Red  Cup"}, shown="10000001|x 10000002|y 1234567 1234567890123", projection=(True, 100, 40, True)),
        event("a", 2, "search_products", {"query": "red cup"}, shown="10000002|y", projection=(None, None, 7, None)),
        event("a", 3, "open_product", {"asin": "10000002", "note": "why"}),
        event("a", 4, "open_product", {"note": "again", "asin": "10000002"}, error=True),
        event("a", 5, "buy_now", {}, kind="guard_rejection", reason="schema_missing", parse=True),
        event("a", 6, "view_reviews", action=" Click[Reviews] "),
        event("a", 7, "", action="click[reviews]"),
        event("a", 8, "buy_now", {}, kind="guard_rejection", reason=""),
        event("b", 1, None, None, kind=None),
        event(None, 1, "finish_without_purchase"),
    ])
    a = got["a"]
    assert (a["executed_tool_steps"], a["action_attempts"], a["search_count"], a["open_product_count"], a["information_page_count"], a["buy_count"]) == (6, 8, 2, 2, 1, 0)
    assert a["tool_counts"] == {"search_products": 2, "open_product": 2, "view_reviews": 1, "unknown": 1} and a["guard_reason_counts"] == {"schema_missing": 1, "unknown": 1}
    # queries repeat by their text alone, actions by tool and parameters: the two searches differ as actions
    assert (a["duplicate_search_query_count"], a["consecutive_duplicate_search_count"]) == (1, 1)
    assert (a["duplicate_canonical_action_count"], a["consecutive_duplicate_action_count"]) == (3, 2)
    assert (a["visible_search_candidate_count"], a["opened_candidate_count"]) == (2, 1)
    assert (a["guard_rejection_count"], a["schema_rejection_count"], a["malformed_tool_call_count"], a["step_error_count"]) == (2, 1, 1, 1)
    assert (a["projection_count"], a["truncated_observation_count"], a["any_observation_truncated"], a["raw_observation_tokens"], a["visible_observation_tokens"], a["critical_footer_failures"]) == (2, 1, True, 100, 47, 1)
    assert got["b"]["action_attempts"] == 1 and got["b"]["executed_tool_steps"] == 0 and got["b"]["tool_counts"] == {} and got["b"]["duplicate_canonical_action_count"] == 0
    assert got[None]["finish_without_purchase_count"] == 1 and got[None]["tool_counts"] == {"finish_without_purchase": 1}


def test_searches_apart_are_consecutive(spark):
    got = panel(spark, [event("a", 1, "search_products", {"query": "x"}), event("a", 2, "next_page"), event("a", 3, "search_products", {"query": "x"}), event("a", 4, "search_products")])["a"]
    # the last one asks for nothing, which is a query of its own
    assert (got["duplicate_search_query_count"], got["consecutive_duplicate_search_count"], got["duplicate_canonical_action_count"], got["consecutive_duplicate_action_count"]) == (1, 1, 1, 0)


def test_no_events(spark):
    assert panel(spark, []) == {}


CALLS = """key string, n int, event_id string, kind string, role string, message_index int, accepted boolean, tool string, parameters map<string,string>, blocked boolean, seen array<string>,
page struct<query:string,number:bigint>"""


def call(n, tool, parameters=None, accepted=True, kind="assistant_tool_call", role="assistant", index=None, blocked=False, seen=None, page=None, key="a"):
    return (key, n, f"E{n:03}", kind, role, n if index is None else index, accepted, tool, parameters, blocked, seen, page)


def test_call_behaviour(spark):
    rows = [
        call(1, "search_products", {"query": "Red Cup"}, seen=["p1", "p2", " "], page=("red cup", 1)),
        call(2, "search_products", {"query": " red  cup "}, seen=["p2", None], page=("red cup", 1)),
        call(3, "next_page", seen=["p3"], page=("red cup", 2)),
        call(4, "open_product", {"asin": " p1 "}, index=3),
        call(5, "open_product", {"asin": " p1 "}, accepted=False, blocked=True),
        call(6, None, kind="tool_message", role="tool"),
        call(7, "open_product", {"asin": " p1 "}),
        call(8, "select_option", {"value": "L"}, page=(None, -4)),
        call(9, "select_option", {"value": " "}),
        call(10, "view_features"),
        call(11, " "),
        call(12, None, kind="assistant_message"),
        call(13, "buy_now", accepted=None),
        call(14, None, kind="termination", role=None),
        call(15, None, kind="termination", role=None),
        call(1, None, kind="assistant_message", key="silent"),
    ]
    found = {r["key"]: r.asDict() for r in behaviour.call_behaviour(spark.createDataFrame(rows[::-1], CALLS), ["key"], ["n"]).collect()}
    a = found["a"]
    assert (a["attempted_tool_calls"], a["executed_tool_calls"], a["guard_rejection_count"], a["total_assistant_turns"]) == (11, 9, 1, 11)
    assert (a["search_count"], a["unique_search_query_count"], a["search_queries"]) == (2, 1, ["Red Cup", "red  cup"])
    assert (a["page_navigation_count"], a["unique_result_page_count"], a["products_seen_count"]) == (1, 3, 3)
    assert (a["product_open_count"], a["unique_product_open_count"], a["opened_asins"]) == (3, 1, ["p1", "p1", "p1"])
    assert (a["detail_view_count"], a["option_selection_count"], a["selected_options"], a["purchase_call_count"], a["finish_without_purchase_count"]) == (1, 2, ["L"], 1, 0)
    # a message between calls doesn't end a run
    assert (a["exact_consecutive_repeat_count"], a["max_exact_repeat_run"]) == (2, 3)
    assert (a["first_search"], a["first_product_open"], a["first_option_selection"], a["first_purchase"], a["termination"]) == ("E001", "E004", "E008", "E013", "E015")
    assert a["tool_counts_attempted"]["open_product"] == 3 and a["tool_counts_executed"]["open_product"] == 2 and " " not in a["tool_counts_attempted"] and "buy_now" not in a["tool_counts_executed"]
    s = found["silent"]
    assert (s["attempted_tool_calls"], s["max_exact_repeat_run"], s["search_queries"], s["first_search"], s["total_assistant_turns"], s["tool_counts_attempted"]) == (0, 0, [], None, 1, {})


OUTCOMES = """id int, status string, done boolean, final_reward double, infrastructure_invalid boolean, trajectory_error string, release_error string, warnings bigint, truncations bigint, compactions bigint, turn_tokens array<double>,
terminal struct<done:boolean,over:boolean,termination_reason:string>, detail struct<reward_version:string,reward_type:string,reward_valid:boolean,terminal_utility:double,weighted_score:double,purchase_success:boolean,termination_reason:string>"""
WON = ("v3", "gold_purchase", True, 1.0, 0.9, True, "gold_purchase")


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [
        (0, "done", True, 1.0, False, None, None, 0, 1, 2, [10.0, 3.9, -1.0, float("nan"), float("inf"), None], (True, True, None), WON),
        (1, "done", None, None, None, None, None, 1, None, None, None, None, None),
        (2, "max_steps", False, 0.5, False, "ContextBudgetError", None, None, None, None, [], (False, None, "limit"), ("v2", "", None, None, None, None, None)),
        (3, "error", False, 0.0, False, "ValueError", "", None, None, None, [], (None, None, ""), None),
        (4, None, None, None, True, "", None, None, None, None, [], None, (None, "repeat_loop", None, None, None, None, "")),
        (5, "invalid_action_limit", None, None, False, "ValueError", None, None, None, None, [], None, None),
    ]
    return {r["id"]: r for r in behaviour.outcome_panel(spark.createDataFrame(rows, OUTCOMES), "v3").collect()}


def test_outcomes(outcomes):
    assert [outcomes[i]["outcome"]["strict_gold_success"] for i in range(6)] == [True] + [False] * 5
    assert [outcomes[i]["outcome"]["reward_type"] for i in range(6)] == ["gold_purchase", "unknown", "unknown", "unknown", "repeat_loop", "unknown"]
    assert [outcomes[i]["outcome"]["termination_reason"] for i in range(6)] == ["gold_purchase", "done", "limit", "error", "unknown", "invalid_action_limit"]
    assert [outcomes[i]["outcome"]["terminal_utility"] for i in range(6)] == [1.0, 0.0, 0.5, 0.0, 0.0, 0.0]
    assert [i for i in range(6) if outcomes[i]["outcome"]["max_steps_termination"]] == [2]
    assert [i for i in range(6) if outcomes[i]["outcome"]["repeat_loop_termination"]] == [4]
    assert [i for i in range(6) if outcomes[i]["outcome"]["invalid_action_limit"]] == [5]


def test_context(outcomes):
    assert tuple(outcomes[0]["context"]) == (2, 13, 10, 1, 2) and tuple(outcomes[1]["context"]) == (0, 0, 0, 0, 0)


def test_validity(outcomes):
    assert [outcomes[i]["validity"]["judge_eligible"] for i in range(6)] == [True, True, False, False, False, True]
    assert [i for i in range(6) if outcomes[i]["validity"]["context_hard_limit"]] == [2]
    assert outcomes[1]["validity"]["trajectory_contract_issues"] == ["done_status_without_trajectory_done", "done_status_without_terminal_done", "done_status_without_terminal_over", "done_status_without_reward_detail", "normalization_warnings"]
    assert outcomes[2]["validity"]["trajectory_contract_issues"] == ["unexpected_reward_version"] and outcomes[0]["validity"]["trajectory_contract_valid"]
    assert (outcomes[3]["validity"]["trajectory_error_type"], outcomes[3]["validity"]["release_error_type"]) == ("ValueError", None)
