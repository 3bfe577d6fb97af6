"""From raw sources to labelled datasets: grouping, pair split, task labels, sampling, limits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.functions.text import order_key, strip
from quillon.session import materialise


def pair_split(df: DataFrame, row_id: str, vulnerable: Column, fixed: Column, carry: list[str], prefix: str) -> DataFrame:
    """Each row as a vulnerable (label 1) and a fixed (label 0) sample; blank codes give none."""
    side = lambda label, kind, code: F.struct(F.lit(label).alias("label"), F.concat_ws("_", F.lit(prefix), F.col(row_id).cast("string"), F.lit(kind)).alias("id"), code.alias("code"))
    both = F.array(side(1, "vulnerable", vulnerable), side(0, "fixed", fixed))
    out = df.select(*carry, F.inline(both))
    return out.where(F.coalesce(strip(F.col("code")), F.lit("")) != "")


def joined_code(df: DataFrame, keys: list[str], code: str, order: str, separator: str = N.FUNCTION_SEPARATOR) -> DataFrame:
    """(keys, code, function_count): non-blank parts of a group in order, with a separator between them."""
    part = F.coalesce(strip(F.col(code)), F.lit(""))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("part")))), lambda x: x["part"]), lambda x: x != "")
    return df.groupBy(*keys).agg(F.array_join(parts, separator).alias("code"), F.count("*").alias("function_count"))


def first_of_group(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """The columns of the first row of each group."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("f")).select(*keys, "f.*")


def first_non_blank(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    there = F.coalesce(strip(F.col(value)), F.lit("")) != ""
    return df.groupBy(*keys).agg(F.min_by(F.when(there, F.col(value)), F.when(there, F.col(order))).alias(value))


def union_of_lists(df: DataFrame, keys: list[str], values: str, order: str) -> DataFrame:
    """Elements of the lists of a group, each once, in order of first occurrence."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(values).alias("v")))), lambda x: x["v"])
    return df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull()))).alias(values))


def for_target(samples: DataFrame, target: str) -> DataFrame:
    """Rows of the target class as 1 and purely safe rows as 0; the others are left out."""
    n = F.lit(int(target.removeprefix("CWE-")))
    hit = F.col("cwe_number") == n
    safe = F.col("cwe_types") == F.array(F.lit("SAFE"))
    return samples.where(F.coalesce(hit, F.lit(False)) | F.coalesce(safe, F.lit(False))).withColumn("label", F.when(F.coalesce(hit, F.lit(False)), "1").otherwise("0"))


def task_label(vulnerable: Column, cwe: Column, task: str, target: str | None = None) -> Column:
    """The label of a task; null for rows that the task leaves out."""
    if task == "binary":
        return F.when(vulnerable, "1").otherwise("0")
    if task == "multiclass":
        return F.when(vulnerable, F.coalesce(cwe, F.lit("UNKNOWN"))).otherwise("SAFE")
    if task == "specific":
        return F.when(vulnerable & (cwe == target), "1").when(~vulnerable, "0")
    raise ValueError(f"unknown task {task!r}")


def shuffled(df: DataFrame, row_id: str, limit: int | None = None, seed: str = "42") -> DataFrame:
    """A reproducible random order, capped if asked for."""
    out = df.orderBy(order_key(seed, F.col(row_id)), row_id)
    return out.limit(limit) if limit else out


def balanced(df: DataFrame, label: str, row_id: str, seed: str = "42") -> DataFrame:
    """The same number of rows of each class, as many as the smallest has; one class stays as it is. Null labels are no class.

    Which rows stay depends on their hash alone. Only those whose hash rank could matter are ranked: a first cut by the share each class keeps
    would need estimates, so the window is partitioned by class and hash bucket, with the buckets' sizes added up before.
    """
    t = df.where(F.col(label).isNotNull()).withColumn("_h", order_key(seed, F.col(row_id))).withColumn("_b", F.substring("_h", 1, 2))
    sizes = t.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    plan = (  # a row per class and bucket
        sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(label).orderBy("_b")) - F.col("_n")).withColumn("_c", F.sum("_n").over(W.partitionBy(label)))
        .withColumn("_least", F.min("_c").over(W.partitionBy(F.lit(0)))).select(label, "_b", "_before", "_least")
    )
    ranked = t.join(plan, [label, "_b"]).where("_before < _least")
    rank = F.col("_before") + F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", row_id))
    return ranked.withColumn("_rank", rank).where("_rank <= _least").drop("_h", "_b", "_before", "_least", "_rank")


def limited(df: DataFrame, mode: str, n: int, order: str, group: str | None = None) -> DataFrame:
    """LIMIT in one of its meanings: 'samples', 'lines' and 'rows' (in order), 'shuffled', 'groups' (all rows of the first n groups)."""
    if mode in ("samples", "lines", "rows"):
        return df.orderBy(order).limit(n)
    if mode == "shuffled":
        return shuffled(df, order, n)
    if mode == "groups":
        first = df.groupBy(group).agg(F.min(order).alias("_o")).orderBy("_o").limit(n).select(group)
        return df.join(first, group, "left_semi")
    raise ValueError(f"unknown limit mode {mode!r}")


def tokens_by_length(text: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def tokens_counted_by(open_counter: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """Token counts by a tokenizer that each worker opens once, in Arrow batches; null counts as empty."""
    from pyspark.sql.types import LongType

    held: list = []

    @F.pandas_udf(LongType())
    def count(text: pd.Series) -> pd.Series:
        if not held:
            held.append(open_counter())
        return text.fillna("").map(held[0]).astype("int64")

    return count


def within_budget(
    samples: DataFrame, system: Column, user: Column, context: Column, max_output: Column, reserve: int = 200, tokens: Callable[[Column], Column] = tokens_by_length
) -> DataFrame:
    """Samples whose prompt fits: tokens <= context - output - reserve. A budget of 0 or less filters nothing."""
    count = tokens(F.concat(system, F.lit("\n"), user))
    out = samples.withColumn("prompt_tokens", count).withColumn("budget", context - max_output - reserve)
    return out.where((F.col("budget") <= 0) | (F.col("prompt_tokens") <= F.col("budget")))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``_i``, their positions from 0 in ``order``, which must be unique: from the counts of its ranges, so that no task gets all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = materialise(rows.repartitionByRange(parts, F.col(order)).withColumn("_p", F.spark_partition_id()), "ranges")  # bounds are sampled: fix them once
    r = r.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(order)))
    n = r.groupBy("_p").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    before = n.select("_p", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_first")) - F.col("_n")).alias("_before"))  # a row per partition
    return r.join(before, "_p").withColumn("_i", F.col("_before") + F.col("_i") - 1).drop("_p", "_before")


def metadata_of(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_samples, vulnerable_samples, safe_samples, languages): one row per dataset."""
    vulnerable = F.coalesce(F.col("cwe_number") > 0, F.lit(False))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("total_samples"), F.sum(vulnerable.cast("long")).alias("vulnerable_samples"), F.sum((~vulnerable).cast("long")).alias("safe_samples"), F.count_distinct("language").alias("languages")
    )
