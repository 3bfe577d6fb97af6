"""Rows of the raw sources as samples: id, code, label, cwe_types, severity. Blank codes give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.functions.text import strip
from quillon.operators.datasets import numbered

COLUMNS = ("id", "code", "label", "cwe_types", "severity")


def _with_code(df: DataFrame) -> DataFrame:
    return df.withColumn("code", strip(F.coalesce("code", F.lit("")))).where("code <> ''")


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *(p.cast("string") for p in parts))


def typed(df: DataFrame, task: str, position: str, target: str | None = None, prefix: str = "typed") -> DataFrame:
    """Items with vulnerability types: 'binary', 'multiclass' (one type, several, or SAFE) or 'specific' (the target type against safe items)."""
    t = _with_code(df).withColumn("types", F.coalesce(F.filter("vulnerability_types", lambda x: x.isNotNull()), F.array().cast("array<string>"))).withColumn("vulnerable", F.coalesce("vulnerable", F.lit(False)))
    named = _id(prefix, F.col("dataset"), F.col(position))
    types = F.when(F.size("types") > 0, F.col("types"))
    if task == "binary":
        cols = (named, F.when(F.col("vulnerable"), "1").otherwise("0"), types, N.severity_of_types(F.col("types")))
    elif task == "multiclass":
        label = F.when(F.size("types") == 0, "SAFE").when(F.size("types") == 1, F.try_element_at("types", F.lit(1))).otherwise("Multiple-Vulnerabilities")
        cols = (F.concat_ws("_", named, F.lit("multiclass")), label, types, N.severity_of_types(F.col("types")))
    elif task == "specific" and target:
        has = F.array_contains("types", target)
        t = t.where(has | ~F.col("vulnerable"))
        only = F.when(has, F.array(F.lit(target)))
        cols = (F.concat_ws("_", named, F.lit(target.replace("-", "_"))), F.when(has, "1").otherwise("0"), only, N.severity_of_types(F.coalesce(only, F.array().cast("array<string>"))))
    else:
        raise ValueError(f"unknown task {task!r} or no target")
    return t.select(cols[0].alias("id"), "code", cols[1].alias("label"), cols[2].alias("cwe_types"), cols[3].alias("severity"))


def five_tasks(df: DataFrame, task: str, prefix: str = "task") -> DataFrame:
    """Items of the five-task source (code, answer, cwe, idx): task1 as 1 or 0, the others keep their answer."""
    if task not in ("task1", "task2", "task3", "task4", "task5"):
        raise ValueError(f"unknown task {task!r}")
    cwe = N.cwe(F.col("cwe"), "loose")
    answer = F.coalesce("answer", F.lit(""))
    label = F.when(F.upper(answer) == "YES", "1").otherwise("0") if task == "task1" else answer
    return _with_code(df).select(_id(prefix, F.lit(task), F.col("idx")).alias("id"), "code", label.alias("label"), F.when(cwe.isNotNull(), F.array(cwe)).otherwise(F.array().cast("array<string>")).alias("cwe_types"), N.severity_of_cwe(cwe, True).alias("severity"))


def token_labelled(df: DataFrame, kind: str, position: str, prefix: str = "tokens") -> DataFrame:
    """Items with vulnerable tokens: vulnerable if there are any; class and severity of the kind."""
    hit = F.coalesce(F.size("vulnerable_tokens") > 0, F.lit(False))
    k = F.lit(kind)
    return _with_code(df).select(
        _id(prefix, k, F.col(position)).alias("id"), "code", F.when(hit, "1").otherwise("0").alias("label"), F.when(hit, F.array(N.cwe_of_type(k))).otherwise(F.array().cast("array<string>")).alias("cwe_types"), F.when(hit, N.severity_of_token_type(k)).alias("severity")
    )


def matched(df: DataFrame, order: str, prefix: str = "cleanvul") -> DataFrame:
    """Matched entries (func_code, sample_id, is_vulnerable) as samples; an entry without an id gets ``prefix``-n, n being its sample's number in ``order``."""
    t = numbered(df.withColumn("code", strip(F.coalesce("func_code", F.lit("")))).where("code <> ''"), order)
    given = F.nullif(F.col("sample_id"), F.lit(""))
    return t.select(F.coalesce(given, F.concat(F.lit(f"{prefix}-"), (F.col("_i") + 1).cast("string"))).alias("id"), "code", F.coalesce("is_vulnerable", F.lit(False)).cast("int").alias("label"))


def variants(df: DataFrame, codes: dict[str, Column], order: str, smoke_of: str) -> DataFrame:
    """(variant, order, code) of each variant's non-blank codes, in one pass, and as variant 'smoke' the shortest of one of them (the first of equals)."""
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("variant"), strip(F.coalesce(c, F.lit(""))).alias("code")) for k, c in codes.items())))
    t = df.select(order, each).where("code <> ''").select("variant", order, "code")
    return t.unionByName(t.where(F.col("variant") == smoke_of).orderBy(F.length("code"), order).limit(1).withColumn("variant", F.lit("smoke")))


def function_pairs(df: DataFrame, position: str, call_graph: bool = False, target: str | None = None, prefix: str = "pair") -> DataFrame:
    """Vulnerable and fixed functions of a pair source as two samples, with their call graph before them if asked for; only pairs of the target class if there is one."""
    cwe = N.cwe(F.col("cwe"))
    t = df.withColumn("_cwe", cwe)
    if target:
        t = t.where(F.col("_cwe") == target)
    code = lambda c: N.with_context(F.col("call_graph"), F.col(c)) if call_graph else F.col(c)
    side = lambda kind, label, c, types, severity: F.struct(_id(prefix, F.col(position), F.lit(kind)).alias("id"), code(c).alias("code"), F.lit(label).alias("label"), types.alias("cwe_types"), severity.alias("severity"), F.col(c).alias("plain"))
    none = F.array().cast("array<string>")
    types = F.when(F.col("_cwe").isNotNull(), F.array("_cwe")).otherwise(none)
    rows = F.array(side("vulnerable", "1", "vulnerable_function_body", types, N.severity_of_cwe(F.col("_cwe"))), side("non_vulnerable", "0", "non_vulnerable_function_body", none, F.lit(None).cast("string")))
    return t.select(F.inline(rows)).where(strip(F.coalesce("plain", F.lit(""))) != "").select(*COLUMNS)
