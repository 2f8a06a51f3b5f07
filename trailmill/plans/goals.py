"""Queries of options, goals, messages, verifiers and collection runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages, options
from ..operators import collection
from .queries import query, t

# ---- options and goals --------------------------------------------------------

_AXIS = "CASE l_returnflag WHEN 'A' THEN '颜色' WHEN 'N' THEN CASE WHEN l_orderkey % 4 = 0 THEN '颜色分类' ELSE '尺码' END ELSE '套餐' END"
_VALUE = "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(l_partkey % 5 AS STRING) END"
_PRICE = "CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity WHEN l_suppkey % 2 = 0 THEN -1.0D END"


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '颜色' WHEN 'N' THEN CASE WHEN l_orderkey % 4 = 0 THEN '颜色分类' ELSE '尺码' END ELSE '套餐' END AS source,
  CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(l_partkey % 5 AS VARCHAR) END AS value, CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END AS price FROM lineitem),
b AS (SELECT *, CASE source WHEN '尺码' THEN 'size' WHEN '套餐' THEN 'bundle' ELSE 'color' END AS axis FROM e),
c AS (SELECT l_orderkey, count(DISTINCT source) <> count(DISTINCT axis) AS collided, bool_or(axis = 'color') AS has_axis, bool_or(axis = 'color' AND value = '1') AS has_value FROM b GROUP BY 1),
g AS (SELECT l_orderkey, axis, count(*) FILTER (value <> '') AS n FROM b GROUP BY 1, 2),
bare AS (SELECT l_orderkey, bool_or(n = 0 AND NOT (l_orderkey % 3 = 0 AND axis = 'color')) AS bare FROM g GROUP BY 1),
r AS (SELECT l_orderkey, CASE WHEN collided THEN 'candidate_axis_collision' WHEN l_orderkey % 3 = 0 AND NOT has_axis THEN 'candidate_axis_missing'
  WHEN l_orderkey % 3 = 0 AND NOT has_value THEN 'candidate_required_value_missing' WHEN bare THEN 'candidate_axis_has_no_values' END AS reason FROM c JOIN bare USING (l_orderkey)),
d AS (SELECT * FROM b WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY l_orderkey, source, value ORDER BY l_linenumber DESC, price DESC NULLS LAST) = 1),
p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey, axis ORDER BY (l_orderkey % 3 = 0 AND axis = 'color' AND value <> '1'), price IS NULL, price, value) = 1),
s AS (SELECT l_orderkey, string_agg(source || '=' || value, ',' ORDER BY source || '=' || value) AS chosen FROM p GROUP BY 1)
SELECT l_orderkey, CASE reason WHEN 'candidate_required_value_missing' THEN 'fail' ELSE CASE WHEN reason IS NULL THEN 'pass' ELSE 'unverifiable' END END AS status, reason, CASE WHEN reason IS NULL THEN chosen END AS chosen
FROM r LEFT JOIN s USING (l_orderkey)""")
def candidate_options(spark, sf_dir):
    """RWD4, ARR3, STR10: an order stands for a product, its lines for the values of its options."""
    value = F.struct(F.expr(_VALUE).alias("normal"), F.expr(_VALUE).alias("value"), F.expr(_PRICE).alias("price"))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_AXIS).alias("axis"), F.struct("l_linenumber", value.alias("v")).alias("e"))
    axes = rows.groupBy("l_orderkey", "axis").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]).alias("values"))
    # no prices order the axes of an order, their names do
    orders = axes.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("axis", "values"))).alias("options"))
    required = F.when(F.col("l_orderkey") % 3 == 0, F.create_map(F.lit("color"), F.lit("1"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    got = orders.withColumn("index", options.axis_index(F.col("options"))).select("l_orderkey", options.candidate_options(F.col("index"), required).alias("r"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("r.chosen"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return got.select("l_orderkey", "r.status", "r.reason", shown.alias("chosen"))


@query("""SELECT l_orderkey, (count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) + count(DISTINCT l_partkey % 3) FILTER (l_partkey % 3 > 0) + max((l_orderkey % 2 = 0)::INT) + max((l_orderkey % 5 <> 0)::INT))::INT AS total
FROM lineitem GROUP BY 1""")
def requirement_totals(spark, sf_dir):
    """AG28: every second order names a brand, four of five a budget, none a model."""
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.concat(F.lit(" "), "l_returnflag")).alias("core"), F.collect_list("l_linestatus").alias("axes"), F.collect_list(F.expr("CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 3 AS STRING) ELSE ' ' END")).alias("open"))
    brand = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("b")))
    count = options.requirement_count(F.col("core"), F.col("axes"), F.col("open"), brand, F.lit(None).cast("array<string>"), F.when(F.col("l_orderkey") % 5 != 0, 1.0))
    return rows.select("l_orderkey", count["total"].alias("total"))


_COLOURS = ["blue", "cold", "red", "old"]
_SIZES = ["large", "small", "(.*)ring", "^new"]


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'blue') THEN 'blue' WHEN contains(p_name, 'cold') THEN 'cold' WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'old') THEN 'old' ELSE p_name END AS colour,
CASE WHEN p_size % 7 = 0 THEN 'numeric_size' WHEN contains(p_name, 'large') THEN 'large' WHEN contains(p_name, 'small') THEN 'small' WHEN contains(p_name, 'ring') THEN '(.*)ring' WHEN starts_with(p_name, 'new') THEN '^new' ELSE 'not_matched' END AS size FROM part""")
def colour_and_size(spark, sf_dir):
    """STR20: names and patterns in order of their lists."""
    size = F.expr("CASE WHEN p_size % 7 = 0 THEN concat(p_size, '.5') ELSE p_name END")
    return t(spark, sf_dir, "part").select("p_partkey", options.first_in(F.col("p_name"), _COLOURS).alias("colour"), options.size_class(size, _SIZES).alias("size"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, p.p_partkey, p_name, p_type, p_retailprice, CASE WHEN l_partkey % 3 > 0 THEN 'PROMO' END AS want_type, CASE WHEN l_suppkey % 2 = 0 THEN 'ring' END AS want,
  CASE WHEN l_suppkey % 5 > 1 THEN 905.0 END AS upper, CASE WHEN l_linenumber % 4 > 0 THEN p_type END AS seen_type, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE p.p_partkey END AS bought FROM lineitem l JOIN part p ON l_partkey = p_partkey),
v AS (SELECT *, CASE WHEN bought IS NULL THEN 'no_purchase' WHEN want_type IS NULL AND want IS NULL AND upper IS NULL THEN 'requirements_empty' WHEN want_type IS NOT NULL AND seen_type IS NULL THEN 'purchase_evidence_missing'
  WHEN coalesce(want_type <> seen_type, false) OR coalesce(NOT contains(p_name, want), false) OR coalesce(p_retailprice > upper, false) THEN 'requirements_not_satisfied' END AS reason FROM x)
SELECT l_orderkey, l_linenumber, reason, coalesce(reason, '') NOT IN ('requirements_empty', 'purchase_evidence_missing') AS valid,
  CASE WHEN reason IS NOT NULL THEN 'unsuccessful_purchase' WHEN p_partkey % 2 = 0 THEN 'gold_purchase' ELSE 'valid_alternative_purchase' END AS type FROM v""")
def verified_purchases(spark, sf_dir):
    """RWD13: a line stands for a purchase; reference, category, attribute and limit are there for some."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e, none = F.expr, F.lit(None).cast("array<string>")
    goal = {"reference": e("CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS STRING) END"), "category": e("CASE WHEN l_partkey % 3 > 0 THEN 'PROMO' END"), "brands": none, "models": none,
            "attributes": e("CASE WHEN l_suppkey % 2 = 0 THEN array('ring') END"), "options": none, "upper": e("CASE WHEN l_suppkey % 5 > 1 THEN 905.0D END")}
    bought = {"asin": e("CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE CAST(p_partkey AS STRING) END"), "category": e("CASE WHEN l_linenumber % 4 > 0 THEN p_type END"), "text": F.col("p_name"), "options": none, "price": F.col("p_retailprice")}
    r = options.verified_purchase(goal, bought)
    return rows.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.reason", "r.valid", "r.type")


@query("""WITH b AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS s, count(DISTINCT props) FILTER (event_type = 'view') AS q, count(*) FILTER (event_type = 'click') AS o, count(DISTINCT props) FILTER (event_type = 'click') AS p,
  count(*) FILTER (event_type = 'signup' AND value > 50) AS d, count(*) FILTER (event_type = 'purchase') AS buys, bool_or(event_type = 'purchase' AND value < 30) AS correct, count(*) FILTER (event_type = 'error' AND value > 150) AS bad,
  count(*) FILTER (event_type = 'error') AS repeats FROM events GROUP BY 1),
e AS (SELECT *, CASE WHEN o = 0 THEN 0 WHEN d > 0 THEN 2 ELSE 1 END AS seen FROM b)
SELECT user_id, CASE WHEN s = 0 THEN 0 WHEN q >= 2 THEN 2 ELSE 1 END::INT AS search_strategy, CASE WHEN o = 0 THEN 0 WHEN p >= 2 THEN 2 ELSE 1 END::INT AS candidate_utilization, seen::INT AS evidence_verification,
  CASE WHEN correct THEN CASE WHEN seen >= 1 THEN 2 ELSE 1 END WHEN buys > 0 THEN 0 ELSE 1 END::INT AS decision_quality, CASE WHEN bad > 0 OR user_id % 9 = 0 THEN 0 WHEN repeats > 0 THEN 1 ELSE 2 END::INT AS termination_efficiency FROM e""")
def draft_labels(spark, sf_dir):
    """RWD16: a user's events stand for a trajectory."""
    n = lambda c: F.count_if(F.expr(c))
    d = lambda c: F.count_distinct(F.when(F.expr(c), F.col("props")))
    b = t(spark, sf_dir, "events").groupBy("user_id").agg(
        n("event_type = 'view'").alias("searches"), d("event_type = 'view'").alias("queries"), n("event_type = 'click'").alias("opened"), d("event_type = 'click'").alias("products"),
        n("event_type = 'signup' AND value > 50").alias("details"), n("event_type = 'purchase'").alias("purchases"), F.bool_or(F.expr("event_type = 'purchase' AND value < 30")).alias("correct"),
        n("event_type = 'error' AND value > 150").alias("invalid"), n("event_type = 'error'").alias("repeats"))
    f = {c: F.col(c) for c in b.columns if c != "user_id"} | {"selected": F.lit(0), "looped": F.lit(False), "termination": F.expr("CASE WHEN user_id % 9 = 0 THEN 'max_steps' END")}
    return b.select("user_id", options.draft_scores(f).alias("s")).select("user_id", "s.*")


# ---- messages -----------------------------------------------------------------

SCHEMAS = {"search": {"type": "object", "properties": {"query": {"type": "string"}, "page": {"type": "integer"}}, "required": ["query"], "additionalProperties": False}}
_ARGUMENTS = """CASE (conv_id * 5 + turn) % 37 WHEN 0 THEN '{"query": 3}' WHEN 1 THEN '[1]' WHEN 2 THEN '{"query": "a", "page": 1}' WHEN 3 THEN '{"query": "b", "extra": true}' WHEN 4 THEN '{bad' WHEN 5 THEN '{"query": "c", "page": "x"}' ELSE '{"query": "d"}' END"""
_TOOL = "CASE WHEN (conv_id * 3 + turn) % 29 = 0 THEN 'teleport' ELSE 'search' END"
_CALLS = "CASE (conv_id + turn * 7) % 31 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"


@query(f"""WITH m AS (SELECT conv_id, turn, {_ARGUMENTS} AS a, {_TOOL} AS tool, {_CALLS} AS calls, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, nth, CASE WHEN calls = 0 THEN 'missing_tool_call' WHEN calls = 2 THEN 'multiple_tool_calls' WHEN tool <> 'search' THEN 'unknown_tool' WHEN a IN ('[1]', '{{bad') THEN 'malformed_arguments'
  WHEN a IN ('{{"query": 3}}', '{{"query": "b", "extra": true}}', '{{"query": "c", "page": "x"}}') THEN 'schema_invalid' END AS reason FROM m),
g AS (SELECT conv_id, min(nth) FILTER (reason IS NOT NULL) AS turn, arg_min(reason, nth) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CASE WHEN g.conv_id IS NULL THEN 0 WHEN reason IS NOT NULL THEN turn WHEN c.conv_id % 6 = 0 THEN 0 END::INT AS turn,
  CASE WHEN g.conv_id IS NULL THEN 'missing_tool_call' WHEN reason IS NOT NULL THEN reason WHEN c.conv_id % 6 = 0 THEN 'multiple_tool_calls' END AS reason FROM c LEFT JOIN g USING (conv_id)""")
def first_format_errors(spark, sf_dir):
    """FLT9, FLT10: calls made up by turn; every sixth conversation had calls cut off."""
    call = F.struct(F.struct(F.expr(_TOOL).alias("name"), F.expr(_ARGUMENTS).alias("arguments")).alias("function"))
    m = t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.array_repeat(call, F.expr(_CALLS)).alias("tool_calls")).alias("m"))
    rows = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    cut = F.when(F.col("conv_id") % 6 == 0, 1).otherwise(0)
    return rows.select("conv_id", messages.first_format_error(F.col("messages"), cut, SCHEMAS).alias("e")).select("conv_id", "e.turn", "e.reason")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 THEN nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') END AS instruction FROM conversations WHERE role = 'user'""")
def instruction_blocks(spark, sf_dir):
    """STR24: every third message has no mark, every second one a first page after the block."""
    content = F.concat(F.when(F.col("conv_id") % 3 > 0, "Task\nInstruction: ").otherwise(""), "text", F.when(F.col("conv_id") % 2 > 0, "\n\n【初始页】").otherwise("\n[SHOPPING_OBSERVATION_V2]\nx"))
    return t(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", messages.instruction_block(content).alias("instruction"))


@query("""SELECT event_id, sha256('{"a":[1,"x"],"k":' || json_extract_string(props, '$.k') || '}') AS digest, '1|x|' || json_extract_string(props, '$.k') AS leaves, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def canonical_digests(spark, sf_dir):
    """MTH6, ARR2, ARR4: properties within a larger object."""
    text = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, "x"]}'))
    rows = t(spark, sf_dir, "events").select("event_id", text.alias("j"))
    return rows.select("event_id", messages.canonical_digest(messages.canonical_json("j")).alias("digest"), F.array_join(messages.json_leaves("j"), "|").alias("leaves"), messages.nested(F.col("j"), "k", as_="long").alias("k"))


# ---- collection ---------------------------------------------------------------


@query("""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS task_id, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 4 <> 0 QUALIFY task_id % 10 <> 3""")
def goal_positions(spark, sf_dir):
    """SRC9, PRJ4: an order stands for a product, its lines for its instructions; a tenth of the tasks is held out."""
    line = F.struct("l_linenumber", F.when(F.col("l_suppkey") % 4 != 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("attributes"))
    products = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("instructions"))
    goals = collection.goals(products, "l_orderkey", "instructions", "attributes")
    public = collection.public_tasks(goals, goals.filter("task_id % 10 = 3"), F.concat_ws(":", "l_orderkey", "goal.l_linenumber"), F.lit("c"))
    return public.select("task_id", F.split_part("instruction", F.lit(":"), F.lit(1)).cast("long").alias("l_orderkey"), F.split_part("instruction", F.lit(":"), F.lit(2)).cast("int").alias("l_linenumber"))


@query("""WITH b AS (SELECT o_orderkey // 100 AS batch, count(*) FILTER (o_orderstatus = 'F') AS a FROM orders GROUP BY 1), r AS (SELECT batch, coalesce(sum(a) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT batch, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS accepted FROM (SELECT o_orderkey // 100 AS batch, o_orderstatus FROM orders) JOIN r USING (batch) WHERE before < 200 GROUP BY 1""")
def collected_until_target(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("batch"), "o_orderstatus")
    kept = collection.collect_until(rows, "batch", F.col("o_orderstatus") == "F", 200)
    return kept.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"))


@query("""SELECT o_orderpriority, round(min(o_totalprice / 1000), 6) AS orm_min, round(avg(o_totalprice / 1000), 6) AS orm_mean, round(max(o_totalprice / 1000), 6) AS orm_max, round(avg((o_orderstatus = 'F')::INT), 6) AS gold_rate,
round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 7 END), 6) AS average_steps FROM orders GROUP BY 1""")
def batch_metrics(spark, sf_dir):
    """AG14: a null number of steps counts as 0."""
    means = {"gold_rate": F.col("o_orderstatus") == "F", "average_steps": F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 7 END")}
    got = collection.batch_metrics(t(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_totalprice") / 1000, means)
    return got.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


_MODE = "CASE n_nationkey % 5 WHEN 0 THEN '<a> ECONOMY' WHEN 1 THEN '<c> PROMO rest' WHEN 2 THEN '<q> cold widget' WHEN 3 THEN '<r>' ELSE 'red ring' END"


@query("""WITH n AS (SELECT n_nationkey, n_nationkey % 5 AS m FROM nation), r AS (SELECT p_partkey FROM part ORDER BY sha256('seed:' || p_partkey), p_partkey LIMIT 50)
SELECT n_nationkey, p_partkey FROM n JOIN part ON (m = 0 AND (p_type = 'ECONOMY' OR p_brand = 'ECONOMY')) OR (m = 1 AND p_type = 'PROMO') OR (m = 2 AND p_name = 'cold widget') UNION ALL SELECT n_nationkey, p_partkey FROM n, r WHERE m = 3""")
def browsed_products(spark, sf_dir):
    """RET2: the four modes, and queries without one, which belong to the ranked search."""
    part = t(spark, sf_dir, "part").withColumn("attributes", F.array("p_type", "p_brand"))
    asked = t(spark, sf_dir, "nation").select("n_nationkey", F.expr(_MODE).alias("text"))
    return collection.browse(part, "p_partkey", {"attributes": "attributes", "category": "p_type", "query": "p_name"}, asked, "n_nationkey", "text", 50, "seed")
