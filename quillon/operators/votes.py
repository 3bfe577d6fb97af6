"""Voting over repeated draws (self-consistency) in long form: one row per sample and draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import parse
from quillon.session import if_small


def draws_of(records: DataFrame, keys: list[str], responses: str = "responses") -> DataFrame:
    """(keys, pass_idx, response): one row per element of an array of responses."""
    return records.select(*keys, F.posexplode(responses).alias("pass_idx", "response"))


def labelled_draws(draws: DataFrame, task_type: str = "task_type", response: str = "response") -> DataFrame:
    """``draws`` with label, parsed by the parser of each row's task type, and vote: 1 or 0 of binary tasks, else null.

    Every draw counts: a null or unreadable response has the parser's default label. Unknown task types have neither.
    """
    text, task = F.coalesce(response, F.lit("")), F.col(task_type)
    binary = parse.binary(text)
    label = F.when(task.isin(*parse.BINARY_TASKS), binary.cast("string"))
    for t in parse.TASKS:
        if t not in parse.BINARY_TASKS:
            label = label.when(task == t, parse.parser_for(t)(text))
    return draws.withColumn("label", label).withColumn("vote", F.when(task.isin(*parse.BINARY_TASKS), F.col("label").cast("int")))


def complete_of_run(records: DataFrame, run: str, n: str) -> DataFrame:
    """The records with as many draws as the run's fullest ones; ``n`` is the column of their number. Records without a draw are left out."""
    most = records.groupBy(run).agg(F.max(n).alias("_most"))
    return records.join(if_small(most), run).where((F.col(n) == F.col("_most")) & (F.col(n) > 0)).drop("_most")


def vote_counts(votes: DataFrame, keys: list[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """(keys, label, votes, first_idx) - votes of each label and where it first occurs."""
    n = F.count("*") if weight is None else F.sum(weight)
    return votes.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("label")).agg(n.cast("long").alias("votes"), F.min("pass_idx").alias("first_idx"))


def majority(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, votes, total, confidence): the label with most votes; ties go to the one that occurs first."""
    best = F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("first_idx")))
    out = counts.groupBy(*keys).agg(best.alias("b"), F.sum("votes").alias("total"))
    return out.select(*keys, F.col("b.label").alias("label"), F.col("b.votes").alias("votes"), "total", (F.col("b.votes") / F.col("total")).alias("confidence"))


def as_map(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vote_counts map<string,int>)."""
    entries = F.array_sort(F.collect_list(F.struct("label", F.col("votes").cast("int").alias("votes"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("vote_counts"))


def decide(majority_label: Column, mean_confidence: Column, mode: Column, threshold: Column, binary_task: Column) -> Column:
    """The label by log-probability where a binary task has a threshold and a confidence, else the majority's."""
    by_prob = binary_task & (mode == "logprob_threshold") & threshold.isNotNull() & mean_confidence.isNotNull()
    return F.when(by_prob, F.when(mean_confidence > threshold, "1").otherwise("0")).otherwise(majority_label)


def expand_draws(samples: DataFrame, n: int) -> DataFrame:
    """Each sample with pass_idx 0 to n - 1."""
    return samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pass_idx"))


def running_votes(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, ones): votes for 1 among the first k draws, for every k, in one running sum. Needs columns pass_idx and vote (0 or 1)."""
    w = W.partitionBy(*keys).orderBy("pass_idx").rowsBetween(W.unboundedPreceding, 0)
    return votes.select("*", F.row_number().over(W.partitionBy(*keys).orderBy("pass_idx")).alias("k"), F.sum("vote").over(w).cast("long").alias("ones"))


def by_rule(rule: Column, ones: Column, k: Column, t: Column) -> Column:
    """1 or 0 by majority (more than half), threshold (a share of at least t) or or (any)."""
    share = ones / k
    return F.when(rule == "majority", (share > 0.5).cast("int")).when(rule == "threshold", (share >= t).cast("int")).when(rule == "or", (ones >= 1).cast("int"))


def complete_only(votes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Votes of the samples that have exactly n draws."""
    full = votes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == n).drop("_n")
    return votes.join(full, keys, "left_semi")


def assert_error_rate(results: DataFrame, most: float = 0.2) -> DataFrame:
    """``results`` unless more than that share of rows failed; the check runs with the plan, not before it."""
    failed = results.agg(F.avg((~F.coalesce("is_success", F.lit(False))).cast("double")).alias("_failed")).scalar()
    return results.where(F.when(failed > most, F.raise_error(F.format_string("%.3f of the rows failed", failed))).isNull())
