"""Rules that judge an attempt, as column expressions over its fields.

A trajectory's fields are given by name in a dict of columns; a field that is
absent counts as null. Every rule is null-safe: null is neither true nor a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.checks import ladder, reasons

# Error categories that make an attempt unfair, outcomes that a reward may name, error types by category.
UNFAIR = ("policy", "environment", "protocol", "infrastructure", "release", "internal")
OUTCOMES = ("gold_purchase", "valid_alternative_purchase", "partial_alternative_purchase", "wrong_purchase", "graceful_stop", "early_abstain", "repeat_loop", "max_steps", "reward_unverifiable")
ERROR_TYPES = {
    "protocol": ("RewardContractError", "ShopProtocolError", "StructuredObservationError"),
    "model": ("ToolRegistryError", "ValueError", "TypeError", "KeyError"),
    "policy": ("ContextBudgetError",),
    "infrastructure": ("ShopHttpError", "ShopEnvironmentError", "TimeoutError", "OSError"),
}
BUDGET_MARKS = ("contextbudget", "context_budget", "context_hard_limit", "max_assistant_turns")


def _is(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _marked(c: Column, marks: tuple[str, ...]) -> Column:
    return F.lower(_text(c)).rlike("|".join(marks))


def mechanical_reasons(blocked: Column, truncations: Column, compactions: Column) -> Column:
    """FLT4: why an attempt is rejected for what happened on the way; arguments are counts."""
    return reasons((blocked > 0, "has_guard_rejection"), (truncations > 0, "has_parallel_tool_truncation"), (compactions > 0, "context_was_compacted"))


def technical_reason(f: dict[str, Column]) -> Column:
    """FLT1: why an attempt was no fair one, null if it was."""
    unverifiable = f["reward_type"] == "reward_unverifiable"
    return (
        F.when(_text(f["release_error"]) != "", "environment_release_failed")
        .when(_is(f["infrastructure_invalid"]) & F.coalesce(unverifiable, F.lit(False)), "reward_unverifiable")
        .when(_is(f["infrastructure_invalid"]), "trajectory_marked_infrastructure_invalid")
        .when(f["error_category"].isin(*UNFAIR), F.concat(F.lit("error_category:"), f["error_category"]))
        .when(unverifiable, "reward_unverifiable")
        .when(_is(f["done"]) & ~_is(f["reward_valid"]), "terminal_reward_not_valid")
        .when(f["status"].isin("error", "environment_release_failed"), "unclassified_runtime_error")
    )


def classified(f: dict[str, Column]) -> Column:
    """FLT1: struct of outcome_type, attempt_valid, task_success, disposition and reasons.

    Fields: release_error, infrastructure_invalid, error_category, reward_type, done, reward_valid,
    status, termination_reason, and mechanical (the array of mechanical_reasons).
    """
    technical, kind, status = technical_reason(f), f["reward_type"], _text(f["status"])
    none = F.array().cast("array<string>")
    gold, other = F.coalesce(kind == "gold_purchase", F.lit(False)), F.coalesce(kind == "valid_alternative_purchase", F.lit(False))
    named = F.coalesce(kind.isin(*OUTCOMES), F.lit(False))
    unfinished = ladder(
        ((status == "max_steps") | (f["termination_reason"] == "max_steps"), "max_steps"),
        (status.isin("invalid_action", "invalid_action_limit", "parallel_tool_calls"), "invalid_action"),
        (status == "assistant_final", "no_purchase"), (f["error_category"] == "model", "model_error"), otherwise="no_purchase",
    )
    technical_outcome = F.when(technical == "reward_unverifiable", "reward_unverifiable").when(f["error_category"].isin("protocol", "policy", "internal"), "protocol_error").otherwise("infrastructure_error")
    dirty = F.size(F.coalesce(f["mechanical"], none)) > 0
    return F.struct(
        F.when(technical.isNotNull(), technical_outcome).when(named, kind).otherwise(unfinished).alias("outcome_type"),
        technical.isNull().alias("attempt_valid"),
        F.when(technical.isNull(), gold | other).alias("task_success"),
        F.when(technical.isNotNull(), "retry").when(gold & dirty, "rejected").when(gold, "accepted_gold").when(other, "alternative_audit").otherwise("rejected").alias("disposition"),
        F.when(technical.isNotNull(), F.array(technical)).when(gold, F.coalesce(f["mechanical"], none)).when(other, F.array(F.lit("strict_sft_requires_gold_purchase")))
        .when(named, F.array(F.concat(F.lit("terminal_outcome:"), kind))).otherwise(F.array(F.concat(F.lit("non_success_status:"), F.when(status == "", "unknown").otherwise(status)))).alias("reasons"),
    )


def strict_success(f: dict[str, Column], version: str) -> Column:
    """FLT7: all nine conditions of a strict success."""
    true = [_is(f[c]) for c in ("done", "terminal_done", "terminal_over", "reward_valid", "purchase_success")]
    same = [f["reward_version"].eqNullSafe(F.lit(version)), f["status"].eqNullSafe(F.lit("done")), f["reward_type"].eqNullSafe(F.lit("gold_purchase")), f["termination_reason"].eqNullSafe(F.lit("gold_purchase"))]
    out = F.lit(True)
    for c in (*true, *same):
        out = out & c
    return out


def eligibility(f: dict[str, Column]) -> Column:
    """FLT8: struct of status, responsibility and issue: whether an attempt can be judged at all."""
    spent = _marked(F.concat_ws(" ", f["error_type"], f["termination_reason"]), BUDGET_MARKS) | F.coalesce((f["error_category"] == "policy") & _marked(F.concat_ws(" ", f["error_type"], f["termination_reason"]), ("context",)), F.lit(False))
    by_model = F.coalesce(f["error_category"] == "model", F.lit(False)) | F.coalesce(f["termination_category"].isin("invalid_action", "limit_reached", "model_stopped"), F.lit(False))
    runtime = F.concat(F.lit("runtime_error:"), f["error_category"])
    rules = [
        (_text(f["release_error"]) != "", "non_model_invalid", "non_model", F.lit("environment_release_failed")),
        (f["termination_reason"] == "reward_unverifiable", "review_required", "non_model", F.lit("environment_reward_unverifiable")),
        (spent, "eligible", "model", F.lit("context_or_action_budget_exhausted")),
        (by_model, "eligible", "model", F.when(f["error_category"] == "model", "model_action_error")),
        (_is(f["infrastructure_invalid"]), "non_model_invalid", "non_model", F.lit("trajectory_marked_infrastructure_invalid")),
        (f["error_category"].isin("environment", "infrastructure", "release", "internal", "protocol", "policy"), "non_model_invalid", "non_model", runtime),
        (f["status"].isin("error", "environment_release_failed"), "non_model_invalid", "undetermined", F.lit("unclassified_runtime_error")),
    ]
    result = lambda status, who, issue: F.struct(F.lit(status).alias("status"), F.lit(who).alias("responsibility"), issue.cast("string").alias("issue"))
    out = F.when(F.lit(False), result("", "", F.lit(None)))
    for condition, status, who, issue in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), result(status, who, issue))
    return out.otherwise(result("eligible", "undetermined", F.lit(None)))


def normalized_outcome(purchased: Column, valid: Column, correct: Column, purchase_type: Column, failed: Column, n_passed: Column) -> Column:
    """FLT13: what a purchase came to, from the verifier's verdict; failed names the checks that did not pass."""
    hard = F.arrays_overlap(F.coalesce(failed, F.array().cast("array<string>")), F.array(F.lit("category"), F.lit("price_upper")))
    return (
        F.when(~_is(purchased), "no_purchase").when(~_is(valid), "unverifiable")
        .when(_is(correct), F.when(purchase_type.eqNullSafe(F.lit("gold_purchase")), "gold_purchase").otherwise("valid_alternative_purchase"))
        .when(hard, "wrong_purchase").when(n_passed > 0, "partial_purchase").otherwise("wrong_purchase")
    )


def type_agreement(environment: Column, normalized: Column) -> Column:
    """FLT13: whether the environment's reward type means the same outcome; null where it cannot say."""
    same = F.when(environment.isin("gold_purchase", "valid_alternative_purchase", "wrong_purchase"), environment).when(environment == "partial_alternative_purchase", "partial_purchase")
    return same.when(environment.isin("graceful_stop", "early_abstain", "repeat_loop", "max_steps"), "no_purchase") == normalized


def attribution(f: dict[str, Column]) -> Column:
    """FLT12: struct of status, responsibility, primary, confidence and review_required; the first rule with direct evidence.

    Fields: eligibility (struct), outcome, format_correct, termination_reason, termination_category, repeat_loop, failed (names of failed checks).
    """
    e, failed = f["eligibility"], F.coalesce(f["failed"], F.array().cast("array<string>"))
    has = lambda name: F.array_contains(failed, name)
    end, blocked = _text(f["termination_reason"]), f["eligibility"]["status"] != "eligible"
    spent = _marked(f["termination_reason"], (*BUDGET_MARKS, "max_steps"))
    bad_action = end.isin("invalid_action_limit", "parallel_tool_calls") | F.coalesce(f["termination_category"] == "invalid_action", F.lit(False))
    result = lambda status, who, primary, sure, review: F.struct(status.alias("status"), who.alias("responsibility"), primary.cast("string").alias("primary"), sure.cast("double").alias("confidence"), review.alias("review_required"))
    known = lambda status, who, primary, sure, review=False: result(F.lit(status), F.lit(who), F.lit(primary), F.lit(sure), F.lit(review))
    held = F.coalesce(e["status"] == "review_required", F.lit(False))
    rules = [
        (blocked, result(F.when(held, "review_required").otherwise("complete"), F.coalesce(e["responsibility"], F.lit("undetermined")), F.coalesce(e["issue"], F.lit("insufficient_evidence")), F.when(e["status"] == "non_model_invalid", 1.0).otherwise(0.7), held)),
        (f["outcome"].isin("gold_purchase", "valid_alternative_purchase"), known("not_applicable", "undetermined", None, 1.0)),
        (f["format_correct"].eqNullSafe(F.lit(False)), known("complete", "model", "invalid_action", 1.0)),
        (_is(f["repeat_loop"]) | (end == "repeat_loop"), known("complete", "model", "repeat_loop_no_progress", 1.0)),
        (bad_action, known("complete", "model", "invalid_action", 1.0)),
        (spent, known("complete", "model", "context_or_action_budget_exhausted", 0.95)),
        (has("price_upper"), known("complete", "model", "over_budget_purchase", 1.0)),
        (has("category"), known("complete", "model", "wrong_product_selection", 0.95)),
        (F.exists(failed, lambda x: x.startswith("option:")), known("complete", "model", "wrong_option_selection", 0.9)),
        (f["outcome"].isin("partial_purchase", "wrong_purchase"), known("partial", "model", "wrong_product_selection", 0.65, True)),
        (f["outcome"] == "unverifiable", known("review_required", "non_model", "insufficient_evidence", 1.0, True)),
    ]
    out = F.when(F.lit(False), known("", "", None, 0.0))
    for condition, value in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out.otherwise(known("partial", "model", "undetermined_model_failure", 0.4, True))


def safety_pause(release_error: Column, status: Column, termination_reason: Column) -> Column:
    """FLT14: whether a batch has to stop, as an action may have been carried out unseen."""
    return (_text(release_error) != "") | _text(status).eqNullSafe(F.lit("environment_release_failed")) | _text(termination_reason).startswith("tool_error:")


def review_queue(required: Column, attribution_required: Column, status: Column) -> Column:
    """FLT16."""
    return _is(required) | _is(attribution_required) | status.eqNullSafe(F.lit("review_required"))


def error_category(error_type: Column) -> Column:
    """FLT21: the category of an error's type; what is not listed is internal."""
    out = F.when(error_type.isNull(), F.lit(None).cast("string"))
    for category, types in ERROR_TYPES.items():
        out = out.when(error_type.isin(*types), category)
    return out.otherwise("internal")


def invalid_sample(category: Column) -> Column:
    """FLT21: whether an error of this category spoils the sample."""
    return F.coalesce(category.isin(*UNFAIR), F.lit(False))


def gate(status: Column, purchased: Column) -> Column:
    """FLT19: struct of a gate's status, passed and verifiable; an unknown status is unverifiable."""
    s = F.when(~_is(purchased), "not_purchased").when(status.isin("pass", "fail", "unverifiable"), status).otherwise("unverifiable")
    return F.struct(s.alias("status"), (_is(purchased) & (s == "pass")).alias("passed"), (_is(purchased) & (s != "unverifiable")).alias("verifiable"))


def dimension(required: Column, passed: Column, verifiable: Column, purchased: Column) -> Column:
    """FLT19, AG25: struct of a dimension's counts and ratio; more passed or verifiable than required is an error."""
    r, p, v = (F.coalesce(c, F.lit(0)).cast("long") for c in (required, passed, verifiable))
    checked = F.when((p > r) | (v > r) | (r < 0) | (p < 0) | (v < 0), F.raise_error(F.lit("invalid dimension counts")).cast("long")).otherwise(r)
    return F.struct(checked.alias("required"), p.alias("passed"), v.alias("verifiable"), evaluation_ratio(p, r, purchased).alias("ratio"))


def evaluation_ratio(passed: Column, required: Column, purchased: Column) -> Column:
    """AG25, evaluation's variant: passed / required; with nothing required 1 if there was a purchase, else 0."""
    return F.coalesce(F.try_divide(passed, required), F.when(_is(purchased), 1.0).otherwise(0.0))
