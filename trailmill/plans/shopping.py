"""Queries of the index, price, guard, tracker, scan and resampling operators over the shop's tables.

Clicks stand for a client's calls and the pages it was shown: names, ids and pages are made from the keys by
expressions that Spark and DuckDB read alike. Queries that write files have no SQL; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import options, prices, text
from ..operators import guard, index
from ..sources import lines
from ..sources.shared import new_folder
from ..streaming import progress, resampling
from .queries import query, t

# ---- the stored index -----------------------------------------------------------

ITEM_FIELDS = {
    "title": "name", "brand": "brand", "category": "kind", "model": "concat('m', size)", "attributes": "concat(kind, ' ', size)",
    "options": "concat(brand, '/', size)", "bullets": "concat_ws(' ', name, kind, cast(floor(price) AS string))",
}


@query()
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1, SNK8, SRC11: the 20 best items for every pair of a name and a brand, by an index written and opened anew."""
    items = t(spark, sf_dir, "items")
    folder = new_folder(spark, "index")
    source = index.build(items, "item_id", ITEM_FIELDS, folder, ["kind", "brand", "name"], size=256)
    asked = items.select(F.concat_ws(" ", "name", "brand").alias("q")).distinct()
    found = index.search(index.opened(spark, folder, source), asked.withColumn("text", F.col("q")), "q", "text", 20)
    return found.select("query", F.col("key").alias("item_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "opened", "ranges")


@query(r"SELECT item_id, lower(regexp_replace(name || ' ' || coalesce(brand, 'x'), '\s+', ' ', 'g')) || ' ' || size || '元' AS words FROM items")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2: an item's text as a searcher would write it, normal."""
    said = F.concat(F.col("name"), F.lit("  "), F.upper(F.coalesce("brand", F.lit("x"))), F.lit("，！"), F.col("size").cast("string"), F.lit(" RMB"))
    return t(spark, sf_dir, "items").select("item_id", text.search_normal(said).alias("words"))


# ---- prices ---------------------------------------------------------------------

_PRICE_TEXT = """CASE item_id % 8 WHEN 0 THEN '预算不超过' || p || '元，要好' WHEN 1 THEN name || ' ' || p || '元以内' WHEN 2 THEN '价格' || p || '-' || (p + 50) || '元之间' WHEN 3 THEN '至少' || p || '元以上'
  WHEN 4 THEN p || '元左右，不要超过' || (p * 2) WHEN 5 THEN p || '千+' WHEN 6 THEN '封顶1万' || (p % 9 + 1) || '千元' ELSE name END"""
_PRICED = "x AS (SELECT item_id, name, item_id % 8 AS c, CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p FROM items)"
_N = "length(p::VARCHAR)"


@query(f"""WITH {_PRICED} SELECT item_id, rule, low, high, span_start::INT AS span_start, span_end::INT AS span_end FROM (
SELECT item_id, 'explicit_upper_budget_rule' AS rule, NULL::DOUBLE AS low, p::DOUBLE AS high, 0 AS span_start, {_N} + 6 AS span_end FROM x WHERE c = 0
UNION ALL SELECT item_id, 'explicit_upper_budget_rule', NULL, p, length(name) + 1, length(name) + {_N} + 4 FROM x WHERE c = 1
UNION ALL SELECT item_id, 'explicit_price_range_rule', p, p + 50, 0, {_N} + length((p + 50)::VARCHAR) + 6 FROM x WHERE c = 2
UNION ALL SELECT item_id, 'explicit_lower_price_rule', p, NULL, 0, {_N} + 3 FROM x WHERE c = 3
UNION ALL SELECT item_id, 'explicit_upper_budget_rule', NULL, p * 2, {_N} + 4, {_N} + 8 + length((p * 2)::VARCHAR) FROM x WHERE c = 4
UNION ALL SELECT item_id, 'approximate_price_preference_rule', p, p, 0, {_N} + 3 FROM x WHERE c = 4
UNION ALL SELECT item_id, 'explicit_plus_lower_rule', p * 1000, NULL, 0, {_N} + 2 FROM x WHERE c = 5
UNION ALL SELECT item_id, 'explicit_upper_budget_rule', NULL, 10000 + (p % 9 + 1) * 1000, 0, 7 FROM x WHERE c = 6)""")  # fmt: skip
def price_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR14, JN15: price phrases of texts about items, with spans."""
    x = t(spark, sf_dir, "items").selectExpr("item_id", "name", "CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p")
    found = x.select("item_id", F.explode(prices.candidates(F.expr(_PRICE_TEXT))).alias("c"))
    return found.select("item_id", "c.rule", "c.low", "c.high", F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"))


@query(f"""WITH {_PRICED}
SELECT item_id, (CASE c WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN p + 50 WHEN 3 THEN NULL WHEN 4 THEN NULL END)::DOUBLE AS upper FROM x""")
def upper_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13: the upper bounds in texts about items."""
    x = t(spark, sf_dir, "items").selectExpr("item_id", "name", "CAST(floor(coalesce(price, 7)) AS BIGINT) + 1 AS p")
    return x.select("item_id", prices.upper_budget(F.expr(_PRICE_TEXT)).alias("upper"))


@query()
def drawn_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH8: upper bounds of all items, stated in every eighth text or drawn."""
    said = F.when(F.col("item_id") % 8 == 0, F.concat(F.lit("预算不超过"), (F.col("size") + 1).cast("string"), F.lit("元"))).otherwise(F.col("name"))
    return t(spark, sf_dir, "items").select("item_id", prices.price_upper(F.col("item_id").cast("string"), said, F.col("price")).alias("upper"))


_SHAPE = """x AS (SELECT item_id, item_id % 9 AS c, CAST(coalesce(price, 5) AS DOUBLE) AS r FROM items)"""


@query(f"""WITH {_SHAPE} SELECT item_id, CASE WHEN c IN (2, 3, 6, 7, 8) THEN 'unverifiable' ELSE 'pass' END AS status, CASE WHEN c IN (0, 1, 4, 5) THEN r END AS price,
  CASE c WHEN 0 THEN 'full_variant_combination' WHEN 1 THEN 'unique_effective_price_axis' WHEN 2 THEN 'effective_price_axis_unselected' WHEN 3 THEN 'multiple_effective_price_axes' WHEN 4 THEN 'constant_option_price'
    WHEN 5 THEN 'single_base_price' WHEN 6 THEN 'price_not_deterministic' WHEN 7 THEN 'selected_variant_price_missing' ELSE 'invalid_option_axes' END AS method,
  CASE WHEN c IN (1, 2, 7) THEN 'color' END AS axis FROM x""")
def variant_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RWD3: what a selection of an item costs, all rungs."""
    x = t(spark, sf_dir, "items").selectExpr("item_id", "item_id % 9 AS c", "CAST(coalesce(price, 5) AS DOUBLE) AS r")
    value = lambda n, p: f"named_struct('normal', '{n}', 'value', '{n}', 'price', CAST({p} AS DOUBLE))"
    colours = f"named_struct('axis', '颜色', 'values', array({value('red', 'IF(c IN (0, 6), NULL, r)')}, {value('blue', 'CASE WHEN c IN (1, 2, 3, 7) THEN r + 1 WHEN c = 4 THEN r END')}))"
    sizes = f"named_struct('axis', IF(c = 8, '颜色分类', '尺码'), 'values', array({value('m', 'IF(c = 3, r, NULL)')}, {value('l', 'IF(c = 3, r + 2, NULL)')}))"
    axes = F.expr(f"IF(c IN (5, 6), filter(array({colours}), a -> false), array({colours}, {sizes}))")
    chosen = F.expr("CASE c WHEN 2 THEN map('尺码', 'm') WHEN 7 THEN map('颜色', 'green') ELSE map('颜色', 'red', '尺码', 'm') END")
    variants = F.expr("array(named_struct('options', map('尺码', 'l', '颜色', 'red'), 'price', r + 9), named_struct('options', map('鞋码', IF(c = 0, 'm', 'x'), '颜色', 'red'), 'price', r))")
    price = options.variant_price(options.axis_index(axes), chosen, variants, F.expr("IF(c = 6, array(r, r + 1), array(r, r, CAST('NaN' AS DOUBLE)))"))
    return x.select("item_id", price.alias("p")).select("item_id", "p.*")


# ---- pages and the guard ----------------------------------------------------------

_CALL = """CASE click_id % 5 WHEN 0 THEN 'open_product' WHEN 1 THEN 'select_option' WHEN 2 THEN 'buy_now' WHEN 3 THEN 'search_products' ELSE 'fly' END"""
_VALUE = "CASE click_id % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'Buy Now' ELSE 'Blue' END"
_PAGE = """CASE click_id % 4 WHEN 0 THEN concat('Page 1\\n1|1000000', click_id % 8, '|a\\n可点击的按钮: ["Next >"]') WHEN 1 THEN '价格: 1\\n可点击的按钮: ["Buy Now", "Red"]' WHEN 2 THEN '搜索功能是否可用: False\\n可点击的按钮: []' ELSE '' END"""


@query(f"""WITH c AS (SELECT DISTINCT click_id, client_id, ts, kind, floor(epoch(ts))::BIGINT AS pos FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL),
pages AS (SELECT client_id, pos, max(CASE click_id % 4 WHEN 3 THEN 0 WHEN 1 THEN 10 WHEN 0 THEN 20 + click_id % 8 ELSE 90 END) AS page FROM c WHERE kind = 'view' GROUP BY ALL),
calls AS (SELECT click_id, client_id, pos, {_CALL} AS name, lower({_VALUE}) AS value, click_id % 8 AS asin FROM c WHERE kind <> 'view'),
j AS (SELECT calls.*, coalesce(page, 0) AS page FROM calls ASOF LEFT JOIN pages ON calls.client_id = pages.client_id AND calls.pos > pages.pos)
SELECT click_id, CASE WHEN name = 'search_products' THEN CASE WHEN page = 90 THEN 'search_not_available_on_current_page' END WHEN page = 0 THEN 'missing_previous_observation'
  WHEN name = 'open_product' THEN CASE WHEN page BETWEEN 20 AND 28 AND page - 20 = asin THEN NULL ELSE 'click_not_in_previous_observation' END
  WHEN name = 'fly' THEN 'unknown_or_invalid_tool' WHEN name = 'select_option' AND value = 'buy now' THEN 'select_option_is_navigation_button'
  WHEN name = 'select_option' THEN CASE WHEN page = 10 AND value = 'red' THEN NULL ELSE 'click_not_in_previous_observation' END
  ELSE CASE WHEN page = 10 THEN NULL ELSE 'click_not_in_previous_observation' END END AS reason FROM j""")
def guarded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11, STR19, JN9: a client's clicks as calls on the page of its last view."""
    c = t(spark, sf_dir, "clicks").filter("client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL").select("click_id", "client_id", "ts", "kind").distinct()
    c = c.withColumn("pos", F.unix_seconds(F.col("ts").cast("timestamp")))
    arguments = F.expr(f"CASE click_id % 5 WHEN 0 THEN map('asin', concat('1000000', click_id % 8)) WHEN 1 THEN map('value', {_VALUE}) WHEN 3 THEN map('query', 'x') ELSE map() END")
    calls = c.filter("kind <> 'view'").select("click_id", "client_id", "pos", F.expr(_CALL).alias("name"), arguments.alias("arguments"))
    pages = c.filter("kind = 'view'").select("client_id", "pos", F.expr(_PAGE).alias("page"))
    # a window holds a day of a client
    met = guard.latest(calls, pages.select("client_id", "pos", guard.parsed(F.col("page")).alias("page")), "client_id", "pos", "page", 86_400)
    return met.select("click_id", guard.reject_reason(F.col("name"), F.col("arguments"), F.col("page")).alias("reason"))


# ---- the tracker ----------------------------------------------------------------

_STEP = (
    "click_id AS step",
    "CASE kind WHEN 'view' THEN 'Search ' WHEN 'click' THEN 'click' ELSE kind END AS name",
    "CASE WHEN click_id % 7 = 0 THEN 'next >' WHEN kind = 'click' AND click_id % 3 = 1 THEN CAST(10000000 + click_id % 50 AS {string}) ELSE concat('K', click_id % 5) END AS argument",
    "CASE WHEN click_id % 4 = 1 THEN 'information_subpage' END AS page_type",
)


def tracked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's clicks, each once, as steps of a session."""
    c = t(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("kind").alias("kind"))
    ids = "transform(filter(array(0, 1, 2, 3, 4, 5), i -> i < click_id % 6), i -> CAST((click_id * 7 + i * 3) % 200 AS string)) AS visible"
    options, met = "CASE WHEN click_id % 10 = 3 THEN map('size', CAST(click_id % 3 AS string)) END AS options", "CASE WHEN click_id % 15 = 2 THEN array(concat('c', click_id % 8)) END AS constraints"
    return c.selectExpr("CAST(client_id AS string) AS session", *[e.format(string="string") for e in _STEP], ids, options, met).select("session", "step", "name", "argument", "visible", "page_type", "options", "constraints")


@query(f"""WITH c AS (SELECT click_id, min(client_id)::VARCHAR AS session, min(kind) AS kind FROM clicks GROUP BY 1),
b AS (SELECT session, {", ".join(_STEP).format(string="VARCHAR")} FROM c),
r AS (SELECT session, coalesce('s' || session, '') AS s, step, lower(trim(coalesce(name, ''))) AS a, lower(argument) AS arg, page_type, row_number() OVER (PARTITION BY session ORDER BY step) AS n FROM b),
k AS (SELECT * FROM r WHERE n <= 35),
ids AS (SELECT s, n, step, i, ((step * 7 + i * 3) % 200)::VARCHAR AS id FROM k, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i) WHERE i < step % 6),
shown AS (SELECT s, n, string_agg(id, '|' ORDER BY i) AS list, min(id) FILTER (i = 0) AS head FROM ids GROUP BY 1, 2),
x AS (SELECT k.*, list, head FROM k LEFT JOIN shown USING (s, n)),
e AS (SELECT s, n, 'id' AS kind, id AS key FROM ids
  UNION ALL SELECT s, n, 'result_set', list FROM x WHERE list IS NOT NULL AND (a = 'search' OR (a = 'click' AND arg = 'next >'))
  UNION ALL SELECT s, n, 'product', arg FROM x WHERE a = 'click' AND length(arg) = 8 AND arg LIKE '100000%'
  UNION ALL SELECT s, n, 'subpage', head || ':' || arg FROM x WHERE a = 'click' AND list IS NOT NULL AND page_type = 'information_subpage'
  UNION ALL SELECT s, n, 'option', head || ':' || (step % 3) FROM x WHERE list IS NOT NULL AND step % 10 = 3
  UNION ALL SELECT s, n, 'constraint', 'c' || (step % 8) FROM x WHERE step % 15 = 2),
f AS (SELECT s, kind, key, min(n) AS n FROM e GROUP BY 1, 2, 3),
g AS (SELECT s, n, count(*) FILTER (kind = 'id') AS ids, count(*) FILTER (kind = 'result_set') AS rs, count(*) FILTER (kind = 'product') AS pr, count(*) FILTER (kind = 'subpage') AS su, count(*) FILTER (kind = 'option') AS op, count(*) FILTER (kind = 'constraint') AS co FROM f GROUP BY 1, 2),
h AS (SELECT k.s, k.session, k.n, (a, arg) IS DISTINCT FROM lag((a, arg)) OVER (PARTITION BY k.s ORDER BY k.n) AS changed, coalesce(ids, 0) AS ids, CASE WHEN coalesce(ids, 0) >= 3 THEN coalesce(rs, 0) ELSE 0 END AS rs, coalesce(pr, 0) AS pr, coalesce(su, 0) AS su, coalesce(op, 0) AS op, coalesce(co, 0) AS co FROM k LEFT JOIN g ON k.s = g.s AND k.n = g.n),
w AS (SELECT *, n - max(CASE WHEN changed THEN n END) OVER o AS repeats, n - coalesce(max(CASE WHEN rs + pr + su + op + co > 0 THEN n END) OVER o, 0) AS stalled FROM h WINDOW o AS (PARTITION BY s ORDER BY n)),
y AS (SELECT *, CASE WHEN repeats >= 2 OR stalled >= 4 THEN 'repeat_loop' WHEN n >= 35 THEN 'max_steps' END AS why FROM w),
z AS (SELECT *, count(why) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM y)
SELECT session, max(n)::INT AS steps, coalesce(max(why), '') AS ended, arg_max(repeats, n)::INT AS repeats, arg_max(stalled, n)::INT AS stalled, sum(ids)::INT AS seen_ids, sum(pr)::INT AS opened,
  least(sum(rs), 3)::INT AS n_result_set, least(sum(pr), 5)::INT AS n_product, least(sum(su), 6)::INT AS n_subpage, sum(op)::INT AS n_option, sum(co)::INT AS n_constraint FROM z WHERE over = 0 GROUP BY s, session""")
def progress_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM1: how a client's session of clicks ends, with the evidence it found."""
    return progress.track_batch(tracked_steps(spark, sf_dir)).withColumnsRenamed({k: f"n_{k}" for k in progress.KINDS})


# ---- files and streams ------------------------------------------------------------


@query()
def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, SNK1: conversations written as lines of JSON and scanned strictly, with each line's size and place among its file's lines."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    folder = new_folder(spark, "lines")
    dealt = rows.repartition(8, "conv_id").sortWithinPartitions("conv_id", "turn")
    dealt.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    found = lines.read_strict(spark, folder, schema)
    return found.select("record.conv_id", "record.turn", "number", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("record.text", 256).alias("text_sha256"))


@query()
def resampled_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6: sales as rollouts of their clients, streamed in six parts; what each batch did."""
    sales = t(spark, sf_dir, "sales").filter("client_id IS NOT NULL")
    folder = new_folder(spark, "resampling")
    reward = F.coalesce(F.col("total"), F.lit(0.0)) % 7
    rollouts = sales.select(F.col("client_id").cast("string").alias("g"), F.floor(reward / 4).cast("double").alias("utility"), F.floor(reward / 4).cast("double").alias("reward"), (F.col("status") != "held").alias("ok"), "sale_id")
    handler = resampling.Resampler(f"{folder}/state", 100, "g", "utility", "reward", F.col("ok"))
    for part in range(6):
        rollouts.filter(F.pmod(F.xxhash64("sale_id"), F.lit(6)) == part).write.mode("append").parquet(f"{folder}/in")
        resampling.resample(spark.readStream.schema(rollouts.schema).parquet(f"{folder}/in"), handler, f"{folder}/checkpoint").awaitTermination()
    return resampling.history(spark, f"{folder}/state").select("batch", "gathered", "generated", "updates", "skips", "outcome")
