"""Reports over predictions: multiclass tables, descriptions, totals, footers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.functions.metrics import ratio
from quillon.functions.parse import BINARY_TASKS


def label_pairs(predictions: DataFrame, keys: list[str], true: str, pred: str) -> DataFrame:
    """(keys, true, pred, n): cells of the confusion matrix that occur. Everything below works on these few rows."""
    return predictions.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The dense matrix over all labels of a key: each label of the truth or the predictions against each other, 0 where none."""
    labels = cells.select(*keys, F.explode(F.array("true", "pred")).alias("label")).distinct()
    per = labels.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = per.select(*keys, F.explode("labels").alias("true"), "labels").select(*keys, "true", F.explode("labels").alias("pred"))
    return grid.join(cells, [*keys, "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, precision, recall, f1, support) for every label of either side; undefined ratios are 0."""
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    t = cells.groupBy(*keys, F.col("true").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    p = cells.groupBy(*keys, F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = t.join(p, [*keys, "label"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return both.select(*keys, "label", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), F.col("support").cast("long").alias("support"))


def macro_weighted(report: DataFrame, cells: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Macro averages over all labels, support-weighted averages, accuracy."""
    w = lambda c: F.round(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), digits)
    avg = report.groupBy(*keys).agg(
        *(F.round(F.avg(c), digits).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(w(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")), F.count("*").alias("labels")
    )
    acc = cells.groupBy(*keys).agg(F.round(ratio(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")), digits).alias("accuracy"))
    return avg.join(acc, keys)


def describe(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """count, min, max, mean, variance and std with one degree of freedom (null for one value); zeros where there is none."""
    v = F.col(value)
    r = lambda c: F.round(c, digits)
    out = df.groupBy(*keys).agg(F.count(v).alias("count"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"), r(F.avg(v)).alias("mean"), r(F.var_samp(v)).alias("variance"), r(F.stddev_samp(v)).alias("std"))
    none = F.col("count") == 0
    return out.withColumns({c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("min", "max", "mean", "variance", "std")})


def confidence_stats(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """mean, min, max and count over non-null values, null where there is none."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.round(F.avg(v), digits).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def footer(table: DataFrame, name: str, columns: list[str], lower_is_better: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Rows mean, median, best, worst and range under a table of few rows."""
    long = table.select(F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, cast({c} as double)' for c in columns)}) as (metric, value)"))
    down = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    s = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = s.select(
        "metric", F.explode(F.array(
            F.struct(F.lit("mean").alias(name), F.col("mean").alias("v")), F.struct(F.lit("median").alias(name), F.col("median").alias("v")),
            F.struct(F.lit("best").alias(name), F.when(down, F.col("lo")).otherwise(F.col("hi")).alias("v")), F.struct(F.lit("worst").alias(name), F.when(down, F.col("hi")).otherwise(F.col("lo")).alias("v")),
            F.struct(F.lit("range").alias(name), (F.col("hi") - F.col("lo")).alias("v")),
        )).alias("r"),
    )
    return rows.select(f"r.{name}", "metric", F.round("r.v", digits).alias("v")).groupBy(name).pivot("metric", columns).agg(F.first("v"))


def calculator_for(task_type: str, task: str | None = None) -> str:
    """Which metrics a task has: 'code' for tasks 3 to 5 of the five-task source, else by its type."""
    if task in ("task3", "task4", "task5"):
        return "code"
    return "binary" if task_type in BINARY_TASKS else "multiclass"


def metric_summary(predictions: DataFrame, keys: list[str], task_type: str, task: str | None = None, digits: int = 6) -> DataFrame:
    """(keys, metric, value) of predictions (keys, true, pred as strings) by the metrics of their task. Null labels: 'UNKNOWN' for classes, no text for code; left out of binary ones."""
    kind = calculator_for(task_type, task)
    if kind == "code":
        recall = (M.token_recall if task == "task3" else M.line_recall)(F.coalesce("pred", F.lit("")), F.coalesce("true", F.lit("")))
        names = ("macro_token_recall", "micro_token_recall", "accuracy") if task == "task3" else ("avg_line_recall", "avg_union_line_recall", "accuracy")
        m = predictions.groupBy(*keys).agg(F.count("*").cast("double").alias("total_predictions"), F.avg(recall).alias("_r")).select(*keys, "total_predictions", *(F.col("_r").alias(n) for n in names))
    elif kind == "binary":
        t, p = M.binary_label(F.col("true")), M.binary_label(F.col("pred"))
        m = M.with_metrics(predictions.groupBy(*keys).agg(*M.confusion_counts(t, p)), ["accuracy", "precision", "recall", "f1", "specificity"]).withColumnRenamed("f1", "f1_score").drop(*M.COUNTS)
    else:
        x = predictions.withColumn("true", F.coalesce("true", F.lit("UNKNOWN"))).withColumn("pred", F.coalesce(F.nullif("pred", F.lit("")), F.lit("UNKNOWN")))
        c = label_pairs(x, keys, "true", "pred")
        macro = macro_weighted(class_report(c, keys), c, keys)
        m = macro.select(*keys, "accuracy", "macro_precision", "macro_recall", F.col("macro_f1").alias("macro_f1_score"))
    names = [c for c in m.columns if c not in keys]
    return m.select(*keys, F.expr(f"stack({len(names)}, {', '.join(f"'{n}', round(cast({n} as double), {digits})" for n in names)}) as (metric, value)"))
