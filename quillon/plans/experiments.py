"""Running experiments as one pipeline from samples to metrics, and plans over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import parse
from quillon.functions.metrics import binary_label, confusion_counts, with_metrics
from quillon.operators import datasets, votes
from quillon.session import materialise

from . import inference, prompts


@dataclass
class Outcome:
    name: str
    is_success: bool
    error: str | None = None
    metrics: DataFrame | None = None
    skipped: bool = False


def score(samples: DataFrame, task: str, system: str, template: str, open_backend: Callable, context: int = 8192, max_output: int = 512, draws: int = 1, limit: int | None = None) -> DataFrame:
    """Predictions of samples (id, code, label): rendered, filtered by length, answered ``draws`` times, parsed, voted."""
    s = samples.withColumn("system", F.lit(prompts.clean(system))).withColumn("user", prompts.render(template, {}, F.col("code"), task))
    s = datasets.within_budget(s, F.col("system"), F.col("user"), F.lit(context), F.lit(max_output))
    if limit:
        s = s.orderBy("id").limit(limit)
    asked = votes.expand_draws(s.select("id", F.col("label").alias("true_label"), "system", "user"), draws)
    answered = materialise(inference.infer(asked, open_backend), "draws")
    parser = parse.parser_for(task)
    labelled = answered.withColumn("label", F.when(F.col("_error").isNull(), parser(F.col("response_text")).cast("string")))
    counts = votes.vote_counts(labelled, ["id"])
    won = votes.majority(counts, ["id"]).select("id", F.col("label").alias("predicted_label"), F.col("confidence").alias("vote_share"))
    per = labelled.groupBy("id").agg(
        F.min("true_label").alias("true_label"), F.sum("tokens_used").alias("tokens_used"), F.avg("duration").alias("processing_time"), F.avg("confidence").alias("confidence"), F.max("_error").alias("error_message"),
        F.array_sort(F.collect_list(F.struct("pass_idx", "response_text"))).alias("draws"),
    )
    return per.join(won, "id", "left").withColumn("responses", F.transform("draws", lambda x: x["response_text"])).drop("draws").withColumn("is_success", F.col("predicted_label").isNotNull())


def binary_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and metrics of successful rows with labels; n_failed counts the others."""
    t, p = binary_label(F.col("true_label")), binary_label(F.col("predicted_label"))
    ok = F.coalesce(F.col("is_success"), F.lit(False)) & t.isNotNull() & p.isNotNull()
    counts = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((~ok).cast("long")).alias("n_failed"), *confusion_counts(F.when(ok, t), F.when(ok, p)))
    return with_metrics(counts)


def run_plan(spark: SparkSession, experiments: list[tuple[str, Callable[[], DataFrame]]], done: set[str] = frozenset()) -> list[Outcome]:
    """Run each experiment by itself: a failure is noted and the next one begins; those already done are skipped."""
    out = []
    for name, make in experiments:
        if name in done:
            out.append(Outcome(name, True, skipped=True))
            continue
        try:
            out.append(Outcome(name, True, metrics=materialise(make(), "plan")))
        except Exception as e:  # noqa: BLE001 - experiments are isolated from each other
            out.append(Outcome(name, False, f"{type(e).__name__}: {e}"[:500]))
    return out


def summary(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    rows = [(o.name, o.is_success, o.skipped, o.error) for o in outcomes]
    df = spark.createDataFrame(rows, "name string, is_success boolean, skipped boolean, error string")
    return success_summary(df.where("not skipped"))


def success_summary(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """total, successful, failed, success_rate in percent (0 of none), all_successful."""
    ok = F.coalesce(F.col("is_success"), F.lit(False))
    g = results.groupBy(*keys).agg(F.count("*").alias("total"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("successful"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_successful"))
    rate = F.coalesce(F.try_divide(F.col("successful") * 100.0, F.col("total")), F.lit(0.0))
    return g.select(*keys, "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), F.round(rate, 4).alias("success_rate"), "all_successful")


def rebuilt_plan(reports: DataFrame) -> DataFrame:
    """A plan's summary from its report rows: times, and each setting that has one value only."""
    single = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).alias(c)
    ts = F.coalesce(F.to_timestamp("timestamp"), F.col("modified"))
    return reports.agg(
        F.count("*").alias("total_experiments"), F.sum(F.col("is_success").cast("long")).alias("successful_experiments"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), single("model_name"), single("task_type"), single("dataset_path")
    )


def checks(samples: DataFrame, required: list[str]) -> DataFrame:
    """(rule, violations): required columns null, ids twice, classes malformed."""
    missing = [F.sum(F.col(c).isNull().cast("long")).alias(f"{c} is null") for c in required]
    bad = F.sum((~F.coalesce(F.forall("cwe_types", lambda c: (c == "SAFE") | c.startswith("CWE-")), F.lit(True))).cast("long")).alias("class is malformed")
    twice = samples.groupBy("id").agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("violations")).select(F.lit("id is repeated").alias("rule"), "violations")
    one = samples.agg(*missing, bad)
    long = one.select(F.expr(f"stack({len(one.columns)}, {', '.join(f'{c!r}, coalesce(`{c}`, 0)' for c in one.columns)}) as (rule, violations)"))
    return long.unionByName(twice)


def text_report(results: DataFrame) -> DataFrame:
    """(position, line): a tick or cross, the name and the accuracy or the error of each experiment."""
    mark = F.when(F.col("is_success"), "✓").otherwise("✗")
    tail = F.when(F.col("is_success"), F.format_string("accuracy %.4f", F.col("accuracy"))).otherwise(F.coalesce("error", F.lit("failed")))
    return results.select("position", F.concat_ws(" ", mark, "name", F.lit("-"), tail).alias("line"))
