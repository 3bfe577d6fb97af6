"""Dataset profiles: distributions, lengths, balance, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Counts per value, nulls as a value of their own."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def list_distribution(df: DataFrame, values: Column, default: str) -> DataFrame:
    """Counts of the elements of a list column; rows without elements count as ``default``."""
    x = df.select(F.explode_outer(values).alias("value")).select(F.coalesce("value", F.lit(default)).alias("value"))
    return x.groupBy("value").agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, keys: list[str], text: str, digits: int = 4) -> DataFrame:
    """mean, min, max, median and std (one degree of freedom) of lengths in characters; null texts are left out."""
    n = F.length(text).cast("long")
    r = lambda c: F.round(c, digits)
    return df.groupBy(*keys).agg(F.count(n).alias("n"), r(F.avg(n)).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.expr(f"round(percentile(length({text}), 0.5), {digits})").alias("median"), r(F.stddev_samp(n)).alias("std"))


def class_balance(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """label, n, percent, imbalance (largest class over smallest). Windows run over the classes, not the rows."""
    everything = W.partitionBy(F.lit(0))
    c = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return c.select("label", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(everything), digits).alias("percent"), F.round(F.max("n").over(everything) / F.min("n").over(everything), digits).alias("imbalance"))


def duplicates(df: DataFrame, text: str, row_id: str, snippet: int = 100) -> DataFrame:
    """Groups of equal texts: digest, n, first_id, snippet. Grouped by digest, so that texts are not shuffled."""
    t = df.where(F.col(text).isNotNull())
    short = F.when(F.length(text) > snippet, F.concat(F.substring(text, 1, snippet), F.lit("..."))).otherwise(F.col(text))
    g = t.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("n"), F.min_by(F.struct(F.col(row_id).alias("id"), short.alias("s")), row_id).alias("f"))
    return g.where("n > 1").select("digest", "n", F.col("f.id").alias("first_id"), F.col("f.s").alias("snippet"))


def duplicate_members(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """(digest, row_id) of every row in a duplicate group."""
    rows = df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"), row_id)
    many = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return rows.join(many, "digest", "left_semi")


def long_report(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, key, value) rows of small tables whose first column is the key."""
    out = None
    for section, df in parts.items():
        key, *values = df.columns
        pairs = ", ".join(f"'{v}', cast({v} as double)" for v in values)
        one = df.selectExpr(f"'{section}' as section", f"coalesce(cast({key} as string), '(null)') as key0", f"stack({len(values)}, {pairs}) as (name, value)")
        one = one.select("section", F.concat_ws(".", "key0", "name").alias("key"), "value")
        out = one if out is None else out.unionByName(one)
    return out
