"""Sinks: Parquet as the primary form, JSON, CSV and Markdown for interchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.datasets import numbered


def dataset_parquet(samples: DataFrame, path: str, partition: list[str]) -> None:
    samples.write.mode("overwrite").partitionBy(*partition).parquet(path)


def dataset_documents(samples: DataFrame, meta: DataFrame, key: str, classes: str | None = None) -> DataFrame:
    """(key, value): one JSON document ``{metadata, samples}`` per key, samples in order. For interchange: a document is one row.

    ``classes`` names the column that is written as ``cwe_type`` (a source whose readers expect the older name).
    """
    item = F.struct(*(F.col(c).alias("cwe_type" if c == classes else c) for c in samples.columns if c not in (key, "_ord")))
    body = samples.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", item.alias("s")))), lambda x: x["s"]).alias("samples"))
    head = meta.select(key, F.struct(*(c for c in meta.columns if c != key)).alias("metadata"))
    return head.join(body, key).select(key, F.to_json(F.struct("metadata", "samples")).alias("value"))


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    documents.repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def report_json(report: DataFrame, path: str, run: str = "run_id") -> None:
    report.write.mode("overwrite").partitionBy(run).json(path)


def csv_fixed(df: DataFrame, path: str, digits: int = 3) -> None:
    """CSV with a header; floats with a fixed number of decimals."""
    cols = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def flattened(samples: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Samples with each key of their JSON metadata as a column ``meta_<key>``. The keys are few and found in a pass of their own."""
    keys = [r[0] for r in samples.select(F.explode(F.json_object_keys(metadata)).alias("k")).distinct().orderBy("k").collect()]
    m = F.from_json(metadata, "map<string,string>")
    rest = [c for c in samples.columns if c != metadata]
    return samples.select(*rest, *(F.try_element_at(m, F.lit(k)).alias(f"meta_{k}") for k in keys))


def samples_of_csv(rows: DataFrame, order: str, code: str = "code", label: str = "label") -> DataFrame:
    """Rows as samples: ids sample_000000 on in the given order, labels as integers where they are digits, the rest as metadata.

    ``order`` must be unique.
    """
    rest = [c for c in rows.columns if c not in (code, label)]
    return numbered(rows, order).select(
        F.format_string("sample_%06d", "_i").alias("id"), code, label, F.when(F.col(label).rlike("^[0-9]+$"), F.col(label).try_cast("int")).alias("label_int"), F.to_json(F.struct(*rest)).alias("metadata")
    )


def markdown(rows: DataFrame, title: str, parts: list[tuple[str, str]]) -> DataFrame:
    """A Markdown text per row: a heading and one section for each (heading, column)."""
    body = [F.concat(F.lit(f"## {h}\n\n"), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for h, c in parts]
    return rows.withColumn("markdown", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col(title)), *body))


def write_markdown(texts: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per key with a text file of its Markdown."""
    texts.select(*keys, "markdown").write.mode("overwrite").partitionBy(*keys).text(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through the session's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def plan_result(experiments: DataFrame, path: str, plan_name: str, description: str = "") -> None:
    """The result file of a plan: its experiments (position, benchmark_info, metrics, is_success) in order, and their summary. A plan's experiments are a list that was on the driver before."""
    rows = [json.loads(r.j) for r in experiments.select("position", F.to_json(F.struct(*(c for c in experiments.columns if c != "position"))).alias("j")).orderBy("position").collect()]
    good = sum(bool(r.get("is_success")) for r in rows)
    summary = {"total_experiments": len(rows), "successful_experiments": good, "failed_experiments": len(rows) - good}
    put_text(experiments.sparkSession, f"{path}/experiment_plan_results.json", json.dumps({"plan_name": plan_name, "description": description, "experiments": rows, "summary": summary, "output_dir": path}, ensure_ascii=False, indent=2))


def contamination_prompts(prompts: DataFrame, path: str) -> None:
    """JSON lines of id and prompt."""
    prompts.write.mode("overwrite").json(path)
