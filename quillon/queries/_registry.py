"""Where queries and their SQL are kept, and the views that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.metrics import binary_label
from quillon.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with their run, binary labels t and p, and ok: successful and both known."""
    r = table(spark, d, "runs").select("run_id", "experiment_name", "task_type", "model_name", "model_type", "backend", "prompt_id", "binary_decision_mode")
    x = table(spark, d, "prediction_results").join(r, "run_id")
    x = x.withColumn("t", binary_label(F.col("true_label"))).withColumn("p", binary_label(F.col("predicted_label")))
    return x.withColumn("ok", F.coalesce(F.col("is_success"), F.lit(False)) & F.col("t").isNotNull() & F.col("p").isNotNull())


def _bin(c: str) -> str:
    return f"CASE WHEN {c} IN ('0', 'SAFE') THEN 0 WHEN {c} = '1' OR starts_with({c}, 'CWE-') THEN 1 END"


PRED = f"""pred AS (SELECT *, coalesce(is_success, false) AND t IS NOT NULL AND p IS NOT NULL AS ok FROM (
    SELECT a.*, r.experiment_name, r.task_type, r.model_name, r.model_type, r.backend, r.prompt_id, r.binary_decision_mode,
           {_bin('true_label')} AS t, {_bin('predicted_label')} AS p
    FROM prediction_results a JOIN runs r USING (run_id)))"""


def cells(where: str = "ok") -> str:
    return ", ".join(f"count(*) FILTER ({where} AND t = {t} AND p = {p}) AS {n}" for t, p, n in ((1, 1, "tp"), (0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn")))


def div(a: str, b: str, zero: str = "0.0::double") -> str:
    return f"CASE WHEN ({b}) = 0 THEN {zero} ELSE ({a})::double / ({b}) END"


def metric_sql(names: tuple[str, ...], zero: str = "0.0::double", digits: int = 6) -> str:
    recall, spec = div("tp", "tp + fn", zero), div("tn", "tn + fp", zero)
    m = {
        "accuracy": div("tp + tn", "tp + tn + fp + fn", zero), "precision": div("tp", "tp + fp", zero), "recall": recall, "f1": div("2 * tp", "2 * tp + fp + fn", zero), "specificity": spec,
        "fnr": f"1 - ({recall})", "fpr": f"1 - ({spec})", "balanced_accuracy": f"(({recall}) + ({spec})) / 2", "youden_j": f"({recall}) + ({spec}) - 1",
        "mcc": div("tp::double * tn - fp::double * fn", "sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))", zero),
    }
    return ", ".join(f"round({m[n]}, {digits}) AS {n}" for n in names)
