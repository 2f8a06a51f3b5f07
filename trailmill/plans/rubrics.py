"""Queries of the requirement operators over the shop's tables: items and sales stand for tasks, their requests and rubrics.

Requests and rubrics are made from the keys by expressions that Spark and DuckDB read alike; the SQL states what each
form must come to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices
from ..functions.signals import budgets
from ..operators import requirements
from .queries import query, t

_TOTAL = "greatest(1, CAST(floor(abs(coalesce(total, 7))) AS BIGINT))"
_SAID = """CASE sale_id % 7 WHEN 0 THEN '预算' || p || '元以内' WHEN 1 THEN p || '-' || (p + 50) || '元，最好新的' WHEN 2 THEN '价格大约' || p || '左右' WHEN 3 THEN ' 大概' || p || '块'
  WHEN 4 THEN '尽量不超' || p || '元' WHEN 5 THEN '一千二百块以内' END"""
_N = "length(p::VARCHAR)"


@query(f"""WITH x AS (SELECT sale_id, sale_id % 7 AS c, {_TOTAL} AS p FROM sales)
SELECT sale_id, CASE c WHEN 0 THEN 'lte' WHEN 1 THEN 'between' WHEN 4 THEN 'lte' WHEN 5 THEN 'lte' ELSE 'approx' END AS operator, CASE WHEN c IN (0, 1, 5) THEN 'hard' ELSE 'soft' END AS priority,
  (CASE WHEN c = 5 THEN 1200 WHEN c <> 1 THEN p END)::DOUBLE AS value, (CASE WHEN c = 1 THEN p END)::DOUBLE AS low, (CASE WHEN c = 1 THEN p + 50 END)::DOUBLE AS high,
  CASE c WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 0 END AS span_start,
  (CASE c WHEN 0 THEN 5 + {_N} WHEN 1 THEN 2 + {_N} + length((p + 50)::VARCHAR) WHEN 2 THEN 6 + {_N} WHEN 3 THEN 3 + {_N} WHEN 4 THEN 5 + {_N} ELSE 7 END)::INT AS span_end FROM x WHERE c < 6""")  # fmt: skip
def request_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR15: the budgets in requests about all sales, with their spans."""
    x = t(spark, sf_dir, "sales").selectExpr("sale_id", f"{_TOTAL} AS p").selectExpr("sale_id", f"{_SAID} AS said")
    found = x.select("sale_id", F.explode(budgets(F.col("said"))).alias("b"))
    return found.select("sale_id", *[f"b.{n}" for n in ("operator", "priority", "value", "low", "high")], F.col("b.start").alias("span_start"), F.col("b.end").alias("span_end"))


@query("""WITH x AS (SELECT item_id, 'shop›' || kind AS category, kind, brand, size, '要' || name || '，' || p || '元以内' AS q, length(name) + 2 AS place, p FROM (SELECT *, CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p FROM items)),
l AS (SELECT *, list_filter([
  {'t': 'category', 'f': 'product.category', 'v': category, 's': kind, 'h': NULL}, {'t': 'brand', 'f': 'product.brand', 'v': brand, 's': brand, 'h': NULL}, {'t': 'model', 'f': 'product.model', 'v': 'm' || size, 's': 'm' || size, 'h': NULL},
  {'t': 'core_function', 'f': 'product.attributes', 'v': kind, 's': kind, 'h': NULL},
  {'t': 'option', 'f': 'purchase.options.size', 'v': CASE WHEN item_id % 2 = 0 THEN size::VARCHAR END, 's': size::VARCHAR, 'h': NULL}, {'t': 'option', 'f': 'purchase.options.color', 'v': CASE WHEN item_id % 2 = 0 THEN 'Red One' END, 's': 'Red One', 'h': NULL},
  {'t': 'option', 'f': 'purchase.options.unresolved', 'v': CASE WHEN item_id % 2 = 1 THEN brand END, 's': brand, 'h': NULL}, {'t': 'option', 'f': 'purchase.options.unresolved', 'v': CASE WHEN item_id % 2 = 1 THEN 'E' END, 's': 'E', 'h': NULL},
  {'t': 'budget_upper', 'f': 'purchase.price', 'v': CASE WHEN q IS NOT NULL THEN '' END, 's': '', 'h': p::DOUBLE}], lambda c: c.v IS NOT NULL) AS cs FROM x),
u AS (SELECT item_id, q, place, unnest(cs) AS c, generate_subscripts(cs, 1) AS n FROM l)
SELECT item_id, format('c{:04d}', n) AS candidate_id, c.t AS constraint_type, c.f AS field_path, nullif(c.v, '') AS expected_value, c.h AS high,
  (CASE WHEN c.t = 'budget_upper' THEN 1 ELSE coalesce((length(q) - length(replace(lower(q), lower(c.s), ''))) // length(c.s), 0) END)::INT AS n_spans,
  (CASE WHEN c.t = 'budget_upper' THEN place WHEN strpos(lower(q), lower(c.s)) > 0 THEN strpos(lower(q), lower(c.s)) - 1 END)::INT AS first_start FROM u""")  # fmt: skip
def requirement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RWD14, STR21: what an item and the request for it suggest as requirements."""
    x = t(spark, sf_dir, "items").selectExpr("*", "CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p").selectExpr("*", "'要' || name || '，' || p || '元以内' AS q")
    size, colour = "named_struct('axis', 'size', 'source_axis', '尺码', 'value', CAST(size AS string))", "named_struct('axis', 'color', 'source_axis', '', 'value', ' Red  One ')"
    tasks = x.selectExpr(
        "item_id", "q", "'shop›' || kind AS category", "array(brand, brand || ' ', '') AS brands", "array('m' || size) AS models", "array(kind, kind) AS functions",
        f"CASE WHEN item_id % 2 = 0 THEN array({size}, {size}, {colour}) END AS options", "array(brand, 'E', NULL) AS loose",
    ).withColumn("prices", prices.candidates(F.col("q")))
    found = requirements.requirement_candidates(tasks, "item_id", "q", "category", "brands", "models", "functions", "options", "loose", "prices")
    return found.select("item_id", "candidate_id", "constraint_type", "field_path", "expected_value", "high", F.size("spans").alias("n_spans"), F.try_element_at("spans", F.lit(1))["start"].alias("first_start"))


_CHECKED = """x AS (SELECT sale_id, status, priority, total, coalesce('St:' || upper(status), '') AS said FROM sales),
r AS (SELECT sale_id, unnest(['R001', 'R002', 'R004']) AS requirement_id, unnest(['option:status', 'price_upper', 'requirement:4']) AS name, unnest(['option', 'budget', 'other']) AS type,
  unnest([CASE WHEN priority IS NULL THEN 'unknown' WHEN priority > 2 THEN 'satisfied' ELSE 'violated' END, CASE WHEN total < 50 THEN 'satisfied' ELSE 'violated' END, 'unknown']) AS status,
  unnest([status, NULL, CASE WHEN said <> '' THEN 's T' END]) AS query_evidence FROM x)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as purchases that an environment checked: status, price, a null and a nameless check."""
    check = lambda name, required, verifiable, passed: f"named_struct('name', {name}, 'required', {required}, 'actual', CAST(priority AS string), 'verifiable', {verifiable}, 'passed', {passed})"
    checks = f"""array({check("'option:status'", "array('no such', status)", "priority IS NOT NULL", "priority > 2")}, {check("'price_upper'", "CAST(NULL AS array<string>)", "true", "total < 50")},
      NULL, {check("''", "array('s T')", "CAST(NULL AS boolean)", "true")})"""
    rows = t(spark, sf_dir, "sales").selectExpr("sale_id", "'St:' || upper(status) AS said", "CAST(NULL AS string) AS event", f"{checks} AS checks")
    return requirements.check_requirements(rows, "sale_id", "checks", "said", "event")


@query(f"WITH {_CHECKED} SELECT *, query_evidence IS NOT NULL AS eligible FROM r")
def check_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RWD19: requirements from the checks of all sales."""
    return checked(spark, sf_dir).select("sale_id", "requirement_id", "name", "type", "status", "query_evidence", "eligible")


@query(f"WITH {_CHECKED} SELECT sale_id, count(*) FILTER (status = 'satisfied') AS satisfied, count(*) FILTER (status = 'violated') AS violated, count(*) FILTER (status = 'unknown') AS unknown, 0::BIGINT AS not_applicable, 0::BIGINT AS conflicting FROM r GROUP BY 1")
def check_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RWD19: requirements of a sale by status."""
    return requirements.requirement_counts(checked(spark, sf_dir), "sale_id")


_CUP = '{"requirement": "杯子", "type": "category", "priority": "hard", "query_evidence": "%s", "verifier": {"kind": "deterministic", "field": "category", "operator": "category_match", "value": "杯子"}}'
_BUDGET = """'{{"requirement": "不超过", "type": "budget", "priority": "hard", "query_evidence": "' || p || '元以内", "verifier": {{"kind": "deterministic", "field": "price", "operator": "{}", "value": ' || {} || '}}}}'"""
_ITEMS = {
    0: _BUDGET.format("lte", "p"), 1: _BUDGET.format("<=", """'"' || p || '元"'"""), 2: _BUDGET.format("lte", "(p + 1)"), 3: f"{_BUDGET.format('lte', 'p')} || ', ' || {_BUDGET.format('lt', 'p')}",
    6: _BUDGET.format("near", "p"), 7: _BUDGET.format("range", """'{"max": ' || p || ', "min": ' || (p + 5) || '}'"""),
}
_RAW = f"""CASE WHEN c = 5 THEN '{{"items": []}}' ELSE '{{"items": [' || CASE WHEN c = 4 THEN '{_CUP % "红色"}, ' ELSE '{_CUP % "杯子"}, ' END || CASE c {" ".join(f"WHEN {c} THEN {e}" for c, e in _ITEMS.items())} ELSE {_ITEMS[0]} END || '], "review_required": ' || (c = 0) || '}}' END"""
_REASONS = """CASE c WHEN 0 THEN 'llm_marked_review_without_reason' WHEN 2 THEN 'budget_rule_conflict:1' WHEN 3 THEN 'duplicate_requirements:R002:R003' WHEN 4 THEN 'R001:query_evidence_not_exact'
  WHEN 6 THEN 'R002:unsupported_operator:near,budget_rule_conflict:1' WHEN 7 THEN 'budget_rule_conflict:1' WHEN 5 THEN NULL ELSE '' END AS reasons"""
_SECOND = """CASE WHEN c = 5 THEN NULL WHEN c = 6 THEN 'semantic_entailment' WHEN c = 7 THEN 'between' ELSE 'lte' END AS operator, (CASE WHEN c IN (5, 6, 7) THEN NULL WHEN c = 2 THEN p + 1 ELSE p END)::DOUBLE AS value,
  (CASE WHEN c = 7 THEN p END)::DOUBLE AS low, (CASE WHEN c = 7 THEN p + 5 END)::DOUBLE AS high"""


def shown(audited: DataFrame, *keys: str) -> DataFrame:
    second = F.try_element_at("items", F.lit(2))
    return audited.select(*keys, F.array_join("reasons", ",").alias("reasons"), F.size("items").alias("n_items"), second["operator"].alias("operator"), second["number"]["value"].alias("value"), second["number"]["low"].alias("low"), second["number"]["high"].alias("high"))


@query(f"""WITH x AS (SELECT item_id, item_id % 8 AS c, CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p FROM items)
SELECT item_id, CASE WHEN c = 5 THEN 'items_missing' END AS fault, {_REASONS}, CASE c WHEN 5 THEN NULL WHEN 3 THEN 3 ELSE 2 END::INT AS n_items, {_SECOND} FROM x""")
def audited_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RWD15: the audit of a rubric for every item."""
    x = t(spark, sf_dir, "items").selectExpr("item_id", "name", "item_id % 8 AS c", "CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p")
    rubrics = x.selectExpr("item_id", "'请购买' || p || '元以内的杯子 ' || coalesce(name, '') AS request", f"{_RAW} AS raw")
    return shown(requirements.audited(rubrics, "request", "raw"), "item_id", "fault")


@query(f"""WITH k AS (SELECT client_id, max(CAST(floor(abs(coalesce(balance, 7))) AS BIGINT)) + 1 AS p FROM clients WHERE client_id IS NOT NULL GROUP BY 1), x AS (SELECT client_id, client_id % 8 AS c, source, p FROM clients JOIN k USING (client_id))
SELECT client_id, source, {_REASONS}, CASE c WHEN 3 THEN 3 ELSE 2 END::INT AS n_items, {_SECOND} FROM x WHERE c <> 5""")
def reaudited_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RWD20: a client's rows as stored attempts at the client's request, audited anew; those that break the contract go."""
    clients = t(spark, sf_dir, "clients")
    known = clients.filter("client_id IS NOT NULL").groupBy("client_id").agg(F.expr("max(CAST(floor(abs(coalesce(balance, 7))) AS BIGINT)) + 1").alias("p"))
    requests = known.selectExpr("client_id", "p || '元以内的杯子' AS request")
    stored = clients.select("client_id", "source").join(known, "client_id").selectExpr("client_id", "source", "client_id % 8 AS c", "p").selectExpr("client_id", "source", f"{_RAW} AS raw")
    return shown(requirements.reaudited(stored, requests, "client_id", "request", "raw"), "client_id", "source")
