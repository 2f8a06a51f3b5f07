"""Goals, plans and collection runs: positions, public projections, resumable caches, batches up to a target, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Catalogue positions that share a range while goals are numbered.
RANGE = 1 << 16
#: Fields of a public task.
PUBLIC = ("task_id", "instruction", "official_split", "category", "difficulty_label", "difficulty_score", "difficulty_version")
#: Keys in which a resumed run must equal the earlier one, and two more where the temperature has an effect. Fixed values.
CONTRACT = [
    "teacher_base_url", "teacher_model", "teacher_tokenizer", "teacher_tokenizer_revision", "thinking", "reasoning_effort", "shopsim_base_url", "mode", "task_plan_sha256",
    "held_out_tasks_sha256", "task_limit", "tasks_selected", "system_prompt_version", "system_prompt_sha256", "tool_schema_version", "tool_schema_fingerprint",
    "generation_reserve_tokens", "harness_contract_sha256",
]
SAMPLING = ["temperature", "top_p"]


def goals(products: DataFrame, position: str, instructions: str, attributes: str) -> DataFrame:
    """SRC9: a row for each instruction (field goal) with attributes; task_id is its place among all of them, from 0.

    Places follow from counts by range of the catalogue position, so no task holds more than a range.
    """
    rows = products.select(*[c for c in products.columns if c != instructions], F.posexplode(instructions).alias("nth", "goal")).filter(F.size(F.col("goal")[attributes]) > 0)
    rows = rows.withColumn("_range", F.floor(F.col(position) / RANGE))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = counts.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(position, "nth")) - 1
    return rows.withColumn("_place", place).join(offsets, "_range").withColumn("task_id", F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def public_tasks(goals_: DataFrame, held_out: DataFrame, instruction: Column, category: Column) -> DataFrame:
    """PRJ4: the seven public fields of the goals that are not held out (by task_id); difficulty is not known yet."""
    kept = goals_.join(held_out.select("task_id").distinct(), "task_id", "left_anti")
    fields = [F.col("task_id"), F.coalesce(instruction, F.lit("")), F.lit("train"), F.nullif(category, F.lit("")), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")]
    return kept.select(*[f.alias(n) for f, n in zip(fields, PUBLIC)])


def forbidden_fields(schema: T.StructType, names: set[str], path: str = "") -> list[str]:
    """PRJ9: paths of fields with a forbidden name, at any depth of structs, arrays and maps."""
    out = []
    for f in schema.fields:
        here = f"{path}{f.name}"
        if f.name in names:
            out.append(here)
        inner = f.dataType
        while isinstance(inner, (T.ArrayType, T.MapType)):
            inner = inner.elementType if isinstance(inner, T.ArrayType) else inner.valueType
        if isinstance(inner, T.StructType):
            out += forbidden_fields(inner, names, here + ".")
    return out


def blind(df: DataFrame, allowed: list[str], forbidden: set[str]) -> DataFrame:
    """PRJ9: the allowed columns alone; an error if any of them holds a forbidden field."""
    out = df.select(*allowed)
    found = forbidden_fields(out.schema, forbidden)
    if found:
        raise ValueError("hidden fields in a blind projection: " + ", ".join(found))
    return out


def with_request(stage: Column, difficulty: dict[str, Column]) -> Column:
    """PRJ5: a stage struct whose request has the difficulty's fields; other fields stay."""
    for name, value in difficulty.items():
        stage = stage.withField(f"request.{name}", value)
    return stage


def contract_mismatches(existing: Column, expected: Column, effective: Column, keys: list[str] = CONTRACT, sampling: list[str] = SAMPLING) -> Column:
    """FLT17: keys in which two configurations (maps) differ, nulls and absent keys alike; the sampling keys only where effective."""
    differs = lambda k: F.when(~F.try_element_at(existing, F.lit(k)).eqNullSafe(F.try_element_at(expected, F.lit(k))), F.lit(k))
    return F.array_compact(F.array(*[differs(k) for k in keys], *[F.when(F.coalesce(effective, F.lit(False)), differs(k)) for k in sampling]))


def pending(goals_: DataFrame, cache: DataFrame, key: str, version: str, expected: str) -> DataFrame:
    """RET5: goals without a row in the cache; an error if the cache holds another version."""
    if cache.filter(~F.col(version).eqNullSafe(F.lit(expected))).limit(1).count():
        raise ValueError("the cache was made with other versions")
    return goals_.join(cache.select(key).distinct(), key, "left_anti")


def collect_until(rows: DataFrame, batch: str, accepted: Column, target: int) -> DataFrame:
    """SMP15: rows of the batches, in order, up to the one with which the accepted rows reach the target."""
    per_batch = rows.groupBy(batch).agg(F.sum(F.coalesce(accepted, F.lit(False)).cast("long")).alias("_a"))
    before = F.coalesce(F.sum("_a").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each batch
    wanted = per_batch.select(batch, before.alias("_before")).filter(F.col("_before") < target).select(batch)
    return rows.join(wanted, batch, "left_semi")


def batch_metrics(df: DataFrame, key: list[str], utility: Column, means: dict[str, Column]) -> DataFrame:
    """AG14: least, mean and largest utility of each batch, and the means of flags and numbers, a null counting as 0.

    A null or not finite utility fails the job.
    """
    u = F.when(utility.isNull() | F.isnan(utility) | (F.abs(utility) == float("inf")), F.raise_error(F.lit("utility is not finite"))).otherwise(utility)
    number = {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in means.items()}
    return df.groupBy(*key).agg(F.min(u).alias("orm_min"), F.avg(u).alias("orm_mean"), F.max(u).alias("orm_max"), *[F.avg(c).alias(n) for n, c in number.items()])


def browse(products: DataFrame, key: str, fields: dict[str, str], queries: DataFrame, query_key: str, text: str, k: int, seed: str) -> DataFrame:
    """RET2: query and product for the queries with a mode: `<a> attribute`, `<c> category` (one word), `<q> query`, `<r>`.

    fields: the products' columns for attributes (array), category and query. `<r>` takes the k products that come
    first in the order of sha256(seed:key), the same for all. Other queries belong to the ranked search.
    """
    words = F.split(F.col(text), " ")
    asked = queries.select(query_key, F.get(words, F.lit(0)).alias("mode"), F.trim(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")).alias("all"), F.trim(F.get(words, F.lit(1))).alias("one"))
    by = lambda mode, arg, value: asked.filter(F.col("mode") == mode).select(query_key, F.col(arg).alias("_v")).join(products.select(key, value.alias("_v")).distinct(), "_v").select(query_key, key)
    first = products.select(key).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256), key).limit(k)
    any_ = asked.filter("mode = '<r>'").select(query_key, F.lit(1).alias("_v")).join(first.withColumn("_v", F.lit(1)), "_v").select(query_key, key)
    return by("<a>", "all", F.explode(fields["attributes"])).union(by("<c>", "one", F.col(fields["category"]))).union(by("<q>", "all", F.col(fields["query"]))).union(any_)


def ranked_products(hits: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """JN12: products of ranked hits with their rank; hits of unknown products go, the ranks of the others stay."""
    return hits.join(products, key)
