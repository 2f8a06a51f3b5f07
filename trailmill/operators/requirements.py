"""Requirements of a task: candidates from its facts, rows from an environment's checks, the audit of written rubrics.

Every rule works inside its row: what a task or a rubric holds never meets another's, so nothing is shuffled but
for the one join that brings a stored rubric its request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerals import places
from ..functions.signals import budgets, money
from ..functions.text import nfkc_casefold

# What a rubric may name, other names of operators, numbers in a text.
TYPES = ("category", "brand", "model", "function", "attribute", "option", "quantity", "budget", "preference", "other")
PRIORITIES = ("hard", "soft")
KINDS = ("deterministic", "semantic")
OPERATORS = ("equals", "contains", "category_match", "option_match", "lt", "lte", "gt", "gte", "approx", "between")
NUMERIC = ("lt", "lte", "gt", "gte", "approx", "between")
ALIASES = {
    "<": "lt", "less_than": "lt", "<=": "lte", "less_than_or_equal": "lte", ">": "gt", "greater_than": "gt", ">=": "gte", "greater_than_or_equal": "gte",
    "range": "between", "in_range": "between", "within_range": "between",
}
SEMANTIC = "semantic_entailment"
MOST_ITEMS = 30
A_NUMBER = r"(?<!\d)(\d+(?:\.\d+)?)"
RANGE_MARK = "[到至~～—–-]"
PREFIXES = ("brand", "model", "attribute", "option")
UNSATISFIED = ("satisfied", "violated", "unknown", "not_applicable", "conflicting")
WHITE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
#: Characters that do not count when evidence of a check is sought in the request.
APART = r"(?U)[\s/|,，。:：;；、\-]+"

_CANDIDATE = "struct<constraint_type:string,description_hint:string,field_path:string,operator:string,expected_value:string,low:double,high:double,hardness:string,source:string,spans:array<struct<start:int,end:int>>>"
_TYPES = {"lte": "budget_upper", "gte": "price_lower", "between": "price_range", "approximately": "price_preference"}


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def cleaned(values: Column) -> Column:
    """Texts of an array with single spaces, the empty ones left out, each once; none for null."""
    tidy = F.transform(values, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.coalesce(F.array_distinct(F.filter(tidy, lambda x: x != "")), F.array().cast("array<string>"))


def _candidate(kind: str | Column, hint: Column, path: str | Column, operator: str | Column, value: Column | None, source: str | Column, spans: Column, hardness: str | Column = "hard", low: Column | None = None, high: Column | None = None) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = {"constraint_type": kind, "description_hint": hint, "field_path": path, "operator": operator, "expected_value": value, "low": low, "high": high, "hardness": hardness, "source": source, "spans": spans}
    return F.struct(*[col(x).alias(n) for n, x in parts.items()]).cast(_CANDIDATE)


def requirement_candidates(tasks: DataFrame, key: str, query: str, category: str, brands: str, models: str, functions: str, options: str, loose: str, prices: str) -> DataFrame:
    """RWD14: a row for each requirement that a task's facts suggest: key, candidate_id and the candidate.

    Columns: query and category texts; brands, models, functions, loose arrays of texts; options an array of (axis,
    source_axis, value), null if no axes are known, when the loose values count; prices the price phrases of the
    query (functions.prices.candidates). Candidates come by kind in this order and count once: of those with one type,
    field, operator and value the first stays. Nulls and empty values suggest nothing.
    """
    said, c = F.coalesce(F.col(query), F.lit("")), F.col
    none = F.array().cast(f"array<{_CANDIDATE}>")

    def of(values: Column, kind: str, hint: str, path: str, operator: str, source: str) -> Column:
        return F.transform(cleaned(values), lambda v: _candidate(kind, F.concat(F.lit(hint), v), path, operator, v, source, places(said, v)))

    leaf = F.trim(F.element_at(F.split(c(category), "›"), -1))
    by_category = F.when(c(category) != "", F.array(_candidate("category", F.concat(F.lit("商品品类应为"), leaf), "product.category", "in_category", c(category), "explicit_category_rule", places(said, leaf))))
    tidy = F.transform(c(options), lambda o: F.struct(o["axis"].alias("axis"), F.coalesce(F.nullif(o["source_axis"], F.lit("")), o["axis"]).alias("said"), F.trim(F.regexp_replace(o["value"], r"(?U)\s+", " ")).alias("value")))
    by_axis = F.transform(
        F.filter(tidy, lambda o: o["value"] != ""),
        lambda o: _candidate("option", F.concat(o["said"], F.lit("应选择"), o["value"]), F.concat(F.lit("purchase.options."), o["axis"]), "eq", o["value"], "explicit_option_rule", places(said, o["value"])),
    )
    by_value = of(c(loose), "option", "规格应包含", "purchase.options.unresolved", "contains", "explicit_option_rule")

    def price(p: Column) -> Column:
        low, high = money(p["low"]), money(p["high"])
        hint = (
            F.when(p["operator"] == "lte", F.concat(F.lit("价格不应超过"), high, F.lit("元"))).when(p["operator"] == "gte", F.concat(F.lit("价格不应低于"), low, F.lit("元")))
            .when(p["operator"] == "between", F.concat(F.lit("价格应在"), low, F.lit("元到"), high, F.lit("元之间"))).otherwise(F.concat(F.lit("价格倾向于"), low, F.lit("元左右")))
        )
        kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[p["operator"]]
        span = F.array(F.struct(p["start"].alias("start"), p["end"].alias("end")))
        return _candidate(kind, hint, "purchase.price", p["operator"], None, p["rule"], span, p["hardness"], p["low"], p["high"])

    parts = [
        by_category,
        of(c(brands), "brand", "品牌应为", "product.brand", "eq", "explicit_brand_rule"),
        of(c(models), "model", "型号应为", "product.model", "eq", "explicit_model_rule"),
        of(c(functions), "core_function", "商品应支持", "product.attributes", "contains", "explicit_core_function_rule"),
        F.coalesce(by_axis, by_value),
        F.transform(c(prices), price),
    ]
    listed = tasks.select(key, F.concat(*[F.coalesce(p, none) for p in parts]).alias("_all"))
    identity = F.transform("_all", lambda x: F.sha2(F.to_json(F.struct(*[x[n].alias(n) for n in ("constraint_type", "field_path", "operator", "expected_value", "low", "high")])), 256))
    numbered = listed.withColumn("_ids", identity)
    # the first of its identity is where its identity is found
    first = F.filter(F.arrays_zip(F.col("_all").alias("c"), F.col("_ids").alias("i"), F.sequence(F.lit(1), F.size("_ids")).alias("n")), lambda z: F.array_position("_ids", z["i"]) == z["n"])
    rows = numbered.filter(F.size("_all") > 0).select(key, F.posexplode(first).alias("_n", "_z"))
    return rows.select(key, F.format_string("c%04d", F.col("_n") + 1).alias("candidate_id"), F.col("_z.i").alias("identity"), "_z.c.*")


def _bare(x: Column) -> Column:
    return F.regexp_replace(nfkc_casefold(x), APART, "")


def check_requirements(rows: DataFrame, key: str, checks: str, instruction: str, event: str) -> DataFrame:
    """RWD19: a row for each check of an environment: requirement_id, name, type, priority, status, required, actual,
    query_evidence, eligible and evidence_event_ids.

    checks: array of (name, required array of texts, actual text, verifiable, passed), null for none; a null check
    keeps its number but gives no row. Evidence is the first required value whose bare text (compatible forms, case
    folded, no separators) is in the bare request; a value of separators only is found in any. A check that cannot be
    verified is unknown, whatever it says.
    """
    # the array is exploded before any text reaches Python, the request once by itself
    bare = rows.withColumn("_bare", _bare(F.col(instruction)))
    each = bare.select("*", F.posexplode(checks).alias("_n", "_c")).filter("_c IS NOT NULL")
    name = F.col("_c.name")
    kind = F.when(name == "category", "category").when(name == "price_upper", "budget")
    for p in PREFIXES:
        kind = kind.when(F.startswith(name, F.lit(p + ":")), p)
    status = F.when(~F.col("_c.verifiable").eqNullSafe(F.lit(True)), "unknown").when(F.col("_c.passed").eqNullSafe(F.lit(True)), "satisfied").otherwise("violated")
    values = F.filter(F.transform("_c.required", _strip), lambda v: v != "")
    # values are joined by a separator that bare texts lack, so that one text crosses to Python for a check
    bare_values = F.split(_bare_lines(values), "\n")
    found = F.filter(F.arrays_zip(values.alias("v"), bare_values.alias("b")), lambda z: F.contains(F.col("_bare"), z["b"]))
    evidence = F.when((F.size(values) > 0) & (_strip(F.col(instruction)) != ""), F.try_element_at(found, F.lit(1))["v"])
    return each.select(
        key,
        F.format_string("R%03d", F.col("_n") + 1).alias("requirement_id"),
        F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("requirement:"), (F.col("_n") + 1).cast("string"))).alias("name"),
        F.coalesce(kind, F.lit("other")).alias("type"),
        F.lit("hard").alias("priority"),
        status.alias("status"),
        F.col("_c.required").alias("required"),
        F.col("_c.actual").alias("actual"),
        evidence.alias("query_evidence"),
        evidence.isNotNull().alias("eligible"),
        F.array_compact(F.array(F.nullif(F.col(event), F.lit("")))).alias("evidence_event_ids"),
    )


def _bare_lines(values: Column) -> Column:
    """Bare values, a line each: a line's end inside a value is a space, which goes."""
    lines = F.array_join(F.transform(values, lambda v: F.translate(v, "\n", " ")), "\n")
    return F.regexp_replace(nfkc_casefold(lines), APART[:-2] + r"&&[^\n]]+", "")


def requirement_counts(requirements: DataFrame, key: str) -> DataFrame:
    """RWD19: how many requirements of a key have each status, zeros included."""
    return requirements.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in UNSATISFIED])


# ---- rubrics that a model or a reviewer wrote -------------------------------------


def _text(v: Column, path: str) -> Column:
    """Text of a field, stripped; numbers and truth values as JSON writes them; empty if it is absent or null."""
    return _strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _squeezed(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)\s+", ""))


def _kind_of(v: Column) -> Column:
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _number(v: Column) -> Column:
    """A field's finite number, null for what is none; texts of numbers count, truth values do not."""
    d = F.when(_kind_of(v) != "BOOLEAN", F.try_variant_get(v, "$", "double"))
    return F.when(F.abs(d) < float("inf"), d)


def numeric(v: Column) -> Column:
    """RWD15: struct of value or low and high that a verifier's value comes to, null if unusable.

    Numbers and texts of one number stand for themselves; objects with two ends (min or minimum, max or maximum)
    and texts of two numbers and a mark between or about them are ranges, ends in order.
    """
    nothing = F.lit(None).cast("double")
    made = lambda value, a, b: F.struct(value.alias("value"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    one = _number(v)
    ends = [_number(F.coalesce(F.try_variant_get(v, f"$.{short}", "variant"), F.try_variant_get(v, f"$.{long}", "variant"))) for short, long in (("min", "minimum"), ("max", "maximum"))]
    said = F.when(_kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))
    numbers = F.transform(F.regexp_extract_all(said, F.lit(A_NUMBER), 1), lambda x: x.cast("double"))
    return (
        F.when(one.isNotNull(), made(one, nothing, nothing))
        .when(ends[0].isNotNull() & ends[1].isNotNull(), made(nothing, *ends))
        .when(F.size(numbers) == 1, made(F.get(numbers, F.lit(0)), nothing, nothing))
        .when((F.size(numbers) == 2) & said.rlike(RANGE_MARK), made(nothing, F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))))
    )


def _normal_items(listed: Column, request: Column, bare: Column) -> Column:
    """Items in normal form, with their fault (they break the contract) and reasons (they must be reviewed).

    Fields are read first, then what they come to, then what is made of that, so that none is worked out twice.
    """
    fields = {"requirement": "requirement", "type": "type", "priority": "priority", "evidence": "query_evidence", "judge": "verifier.kind", "field": "verifier.field", "criterion": "verifier.criterion", "said": "verifier.operator"}
    aliases = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])

    def read(v: Column, n: Column) -> Column:
        kind = _kind_of(v)
        value = F.try_variant_get(v, "$.verifier.value", "variant")
        texts = [_text(v, f"$.{path}").alias(name) for name, path in fields.items()]
        return F.struct(*texts, F.format_string("R%03d", n + 1).alias("rid"), F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)).alias("object"), value.alias("value"))

    def weighed(i: Column) -> Column:
        fixed = i["judge"] == "deterministic"
        operator = F.when(fixed, F.coalesce(aliases[F.lower(i["said"])], i["said"])).otherwise(i["said"])
        number = F.when(fixed & operator.isin(*NUMERIC), numeric(i["value"]))
        return F.struct(i.alias("i"), fixed.alias("fixed"), operator.alias("operator"), number.alias("number"), F.contains(bare, _squeezed(i["evidence"])).alias("exact"))

    def ruled(w: Column) -> Column:
        i, operator = w["i"], w["operator"]
        unfit = (
            F.when(~operator.isin(*OPERATORS), F.concat(F.lit("unsupported_operator:"), F.when(operator == "", "empty").otherwise(operator)))
            .when(i["value"].isNull(), "deterministic_value_missing")
            .when(operator.isin(*NUMERIC) & w["number"].isNull(), "numeric_value_unusable")
        )
        return F.struct(w.alias("w"), F.when(w["fixed"], unfit).alias("unfit"), F.when(w["exact"], i["evidence"]).otherwise(request).alias("kept"))

    def made(r: Column) -> Column:
        w, i, unfit, rid = r["w"], r["w"]["i"], r["unfit"], r["w"]["i"]["rid"]
        falls, fixed = unfit.isNotNull(), w["fixed"]
        faults = [
            (~i["object"], "item_not_object"),
            ((i["requirement"] == "") | (i["evidence"] == ""), "requirement_or_evidence_missing"),
            (~i["type"].isin(*TYPES) | ~i["priority"].isin(*PRIORITIES), "type_or_priority_unknown"),
            (~i["judge"].isin(*KINDS), "verifier_kind_unknown"),
            ((i["judge"] == "semantic") & ((i["said"] != SEMANTIC) | (i["criterion"] == "")), "semantic_verifier_incomplete"),
            (~falls & (i["field"] == ""), "verifier_field_empty"),
        ]
        fault = F.coalesce(*[F.when(c, F.lit(name)) for c, name in faults])
        reasons = F.array_compact(F.array(F.when(~w["exact"], F.lit("query_evidence_not_exact")), unfit, F.when(F.length(r["kept"]) < 2, F.lit("query_evidence_too_short"))))
        field = F.when(falls & (i["field"] == ""), "product").otherwise(i["field"])
        operator = F.when(falls, SEMANTIC).when(w["number"]["low"].isNotNull(), "between").otherwise(w["operator"])
        return F.struct(
            rid.alias("requirement_id"), i["requirement"].alias("requirement"), i["type"].alias("type"), i["priority"].alias("priority"), r["kept"].alias("query_evidence"),
            F.when(falls, "semantic").otherwise(i["judge"]).alias("kind"), field.alias("field"), operator.alias("operator"),
            F.when(~falls, w["number"]).alias("number"), F.when(fixed & ~falls & w["number"].isNull(), F.to_json(i["value"])).alias("value"),
            F.when(falls, i["requirement"]).otherwise(F.nullif(i["criterion"], F.lit(""))).alias("criterion"),
            F.concat(rid, F.lit(":"), fault).alias("fault"), F.transform(reasons, lambda x: F.concat(rid, F.lit(":"), x)).alias("reasons"),
        )

    return F.transform(F.transform(F.transform(F.transform(listed, read), weighed), ruled), made)


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1e-9, F.lit(False))


def audited(rubrics: DataFrame, request: str, raw: str) -> DataFrame:
    """RWD15, RWD20: rubrics with items in normal form, reasons, review and fault, in one pass over their rows.

    request: what the user said; raw: the rubric as JSON, an object of items, review_required and review_reasons.
    A null fault means that the rubric keeps the contract; else it has no items and no reasons. Reasons come once
    each: those of the items, repeated requirements (same type, same text apart from spaces and case), budgets of the
    request that no budget item states alike, then the writer's own. An unfit verifier becomes one to be read by
    meaning. Audit rubrics anew by calling this on the stored raw column: nothing else of them is used.
    """
    if clash := {"_said", "_bare", "_raw", "_array", "_items", "_facts", "_names"} & set(rubrics.columns):
        raise ValueError(f"columns {sorted(clash)} are used by the audit")
    said = _strip(F.coalesce(F.col(request), F.lit("")))
    read = rubrics.withColumn("_said", said).withColumn("_bare", _squeezed(F.col("_said"))).withColumn("_raw", F.try_parse_json(F.col(raw)))
    listed = read.withColumn("_array", F.try_variant_get(F.col("_raw"), "$.items", "array<variant>"))
    # more items than may be are a fault and never looked at
    few = F.when(F.size("_array") <= MOST_ITEMS, F.col("_array"))
    normal = listed.withColumn("_items", _normal_items(few, F.col("_said"), F.col("_bare"))).withColumn("_facts", budgets(F.col("_said")))
    fault = (
        F.when(F.col("_said") == "", "request_empty")
        .when(F.coalesce(~F.startswith(_kind_of(F.col("_raw")), F.lit("OBJECT")), F.lit(True)), "rubric_not_object")
        .when(F.coalesce(F.size("_array"), F.lit(0)) <= 0, "items_missing")
        .when(F.size("_array") > MOST_ITEMS, "too_many_items")
        .otherwise(F.try_element_at(F.array_compact(F.transform("_items", lambda i: i["fault"])), F.lit(1)))
    )
    judged = normal.withColumn("fault", fault)
    judged = judged.withColumn("_names", F.transform("_items", lambda i: F.concat(i["type"], F.lit(":"), _squeezed(i["requirement"]))))
    # where an item's name is found first, if before the item itself
    first = F.transform("_names", lambda x, n: F.array_position("_names", x).cast("int"))
    repeated = F.array_compact(F.transform(first, lambda f, n: F.when(f <= n, F.concat(F.lit("duplicate_requirements:"), F.format_string("R%03d", f), F.lit(":"), F.format_string("R%03d", n + 1)))))

    def stated(fact: Column) -> Column:
        meets = lambda i: F.contains(i["query_evidence"], fact["text"]) | F.contains(fact["text"], i["query_evidence"])
        alike = lambda i: _same(i["number"]["value"], fact["value"]) | (_same(i["number"]["low"], fact["low"]) & _same(i["number"]["high"], fact["high"]))
        return F.exists("_items", lambda i: (i["type"] == "budget") & (i["kind"] == "deterministic") & (i["operator"] == fact["operator"]) & meets(i) & alike(i))

    conflicts = F.array_compact(F.transform("_facts", lambda f, n: F.when(~stated(f), F.concat(F.lit("budget_rule_conflict:"), (n + 1).cast("string")))))
    own = F.try_variant_get(F.col("_raw"), "$.review_reasons", "variant")
    empty = F.array().cast("array<string>")
    asked = F.try_variant_get(own, "$", "array<string>")
    told = F.filter(F.transform(asked, _strip), lambda r: r != "")
    # null, false, zero and what is empty say nothing
    silent = own.isNull() | F.coalesce(F.to_json(own), F.lit("null")).isin("null", "false", "0", '""', "[]", "{}")
    marked = F.coalesce(F.try_variant_get(F.col("_raw"), "$.review_required", "boolean"), F.lit(False)) & (_kind_of(F.try_variant_get(F.col("_raw"), "$.review_required", "variant")) == "BOOLEAN")
    writers = (
        F.when(silent, F.when(marked, F.array(F.lit("llm_marked_review_without_reason"))))
        .when(F.startswith(_kind_of(own), F.lit("ARRAY")), told)
        .otherwise(F.array(F.lit("llm_review_reasons_not_array")))
    )
    every = F.array_distinct(F.concat(F.flatten(F.transform("_items", lambda i: i["reasons"])), repeated, F.coalesce(conflicts, empty), F.coalesce(writers, empty)))
    kept = ("requirement_id", "requirement", "type", "priority", "query_evidence", "kind", "field", "operator", "number", "value", "criterion")
    items = F.transform("_items", lambda i: F.struct(*[i[n].alias(n) for n in kept]))
    fine = F.col("fault").isNull()
    out = judged.withColumn("items", F.when(fine, items)).withColumn("reasons", F.when(fine, every)).withColumn("review", F.size("reasons") > 0)
    return out.withColumn("review", F.when(fine, F.col("review"))).drop("_said", "_bare", "_raw", "_array", "_items", "_facts", "_names")


def reaudited(attempts: DataFrame, requests: DataFrame, key: str, request: str, raw: str) -> DataFrame:
    """RWD20: stored attempts with the audit by the current rules; those that no longer keep the contract, or whose
    request is gone, are left out, so that they are written anew. requests: one row for each key."""
    asked = requests.select(F.col(key).alias("_k"), F.col(request).alias("_request"))
    met = attempts.join(asked, F.col(key) == F.col("_k")).drop("_k")
    return audited(met, "_request", raw).filter("fault IS NULL").drop("_request", "fault")
