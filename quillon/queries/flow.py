"""Sources and sinks as round trips through files in the shared folder, plans, inference."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.functions.metrics import binary_label
from quillon.plans import config, experiments, inference
from quillon.session import _made, shared_dir, table
from quillon.sources import readers, writers

from ._registry import PRED, cells, metric_sql, predictions, query


def _folder(spark) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/flow-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_GROUPED = "idx::varchar AS idx, project, commit_id, target, md5(func) AS func_digest, array_to_string(cwe, ',') AS cwe"


@query(f"SELECT {_GROUPED} FROM primevul_raw")
def src_jsonl(spark, d):
    """The grouped source written as JSON lines and read by its reader."""
    p = _folder(spark)
    table(spark, d, "primevul_raw").drop("row_id", "ingested_at").write.json(p)
    rows, _ = readers.jsonl(spark, p, readers.GROUPED)
    return rows.select("idx", "project", "commit_id", "target", F.md5("func").alias("func_digest"), F.array_join("cwe", ",").alias("cwe"))


@query("SELECT count(*) AS good, 2::bigint AS corrupt FROM primevul_raw")
def src_jsonl_corrupt(spark, d):
    """Blank lines are skipped, broken ones counted apart."""
    p = _folder(spark)
    lines = table(spark, d, "primevul_raw").select(F.to_json(F.struct(F.col("idx").cast("string").alias("idx"), "target")).alias("value"))
    lines.write.text(p)
    spark.sql("SELECT explode(array('{\"idx\": 1', '', '   ', 'no json')) AS value").write.mode("append").text(p)
    good, bad = readers.jsonl(spark, p, "idx string, target int")
    return good.agg(F.count("*").alias("good")).select("good", bad.agg(F.count("*").alias("corrupt")).scalar().alias("corrupt"))


@query("SELECT md5(func_before) AS before, md5(func_after) AS after, commit_url, cve_id, cwe_id, extension, is_test FROM (SELECT nullif(func_before, '') AS func_before, nullif(func_after, '') AS func_after, nullif(commit_url, '') AS commit_url, nullif(cve_id, '') AS cve_id, nullif(cwe_id, '') AS cwe_id, nullif(extension, '') AS extension, nullif(is_test, '') AS is_test FROM cleanvul_raw)")
def src_csv(spark, d):
    """The commit pairs written as CSV, quotes and line ends in cells, and read again. CSV has one form for empty and null."""
    p = _folder(spark)
    c = table(spark, d, "cleanvul_raw")
    cols = [x.split()[0] for x in readers.COMMITS.split(", ")]
    c = c.withColumn("date", F.col("commit_date")).select(*(F.nullif(F.col(x).cast("string"), F.lit("")).alias(x) for x in cols))
    c.write.option("header", True).option("quoteAll", False).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").csv(p)
    r = readers.csv_commits(spark, p)
    return r.select(F.md5("func_before").alias("before"), F.md5("func_after").alias("after"), "commit_url", "cve_id", "cwe_id", "extension", "is_test")


@query("SELECT id, md5(code) AS digest, label, try_cast(label AS INT) AS label_int, _ord FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS _ord FROM samples)")
def src_dataset_document(spark, d):
    """Samples written as one document per dataset, and read again in order."""
    from pyspark.sql import Window as W

    p = _folder(spark)
    s = table(spark, d, "samples").withColumn("_ord", F.row_number().over(W.partitionBy("dataset").orderBy("row_id")) - 1).withColumn("dataset", F.coalesce("dataset", F.lit("(null)")))
    meta = s.groupBy("dataset").agg(F.count("*").alias("total_samples"))
    docs = writers.dataset_documents(s.select("dataset", "_ord", "id", "code", "label", "metadata", "cwe_types", "severity"), meta, "dataset")
    docs.select(F.regexp_replace("dataset", r"\W", "_").alias("dataset"), "value").repartition("dataset").write.partitionBy("dataset").text(p)
    r = readers.dataset(spark, f"{p}/*")
    return r.select("id", F.md5("code").alias("digest"), "label", "label_int", "_ord")


@query("SELECT id, count(*) AS n FROM samples GROUP BY id")
def src_json_array(spark, d):
    p = _folder(spark)
    table(spark, d, "samples").groupBy("dataset").agg(F.to_json(F.collect_list(F.struct("id", "label"))).alias("value")).select("value").write.option("lineSep", "\u0001").text(p + "/x")
    # one array per line of a file: every file is a single array only if it has a single row, so each row gets a file of its own
    q = p + "/y"
    spark.read.option("lineSep", "\u0001").text(p + "/x").withColumn("k", F.md5("value")).repartition("k").write.partitionBy("k").text(q)
    return readers.json_array(spark, f"{q}/*", "id string, label string").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(func_hash, ''), 'none') AS id, CASE WHEN target = 1 THEN true ELSE false END AS vulnerable, nullif(regexp_extract(cwe[1], 'CWE-\\d+'), '') AS cwe, length(regexp_replace(regexp_replace(replace(replace(func, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '/[*]\\s*\\n.*?[*]/\\s*\\n', '', 'gs'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))::bigint AS n FROM primevul_raw WHERE func IS NOT NULL")
def src_annotated_files(spark, d):
    """Functions as files with a comment header, one folder each, and read by the reader of annotated files."""
    p = _folder(spark)
    t = table(spark, d, "primevul_raw").where("func is not null")
    head = F.concat(F.lit("/*\nname: "), F.coalesce(F.nullif(F.col("func_hash"), F.lit("")), F.lit("none")), F.lit("\nvulnerable: "), F.when(F.col("target") == 1, "true").otherwise("false"), F.lit("\ncwe: "), F.coalesce(F.try_element_at("cwe", F.lit(1)), F.lit("")), F.lit("\n*/\n"))
    body = F.regexp_replace("func", "\r\n?", "\n")
    _write_files(t.select("row_id", F.concat(head, body).alias("value")), p, "f.c")
    r = readers.header_files(spark, p)
    return r.select("id", "vulnerable", F.col("cwe"), F.length("code").cast("long").alias("n"))


def _write_files(rows, path: str, name: str) -> None:
    """One small file per row through the session's file system (a sink for interchange)."""

    def put(it):
        for r in it:
            os.makedirs(f"{path}/{r.row_id}", exist_ok=True)
            with open(f"{path}/{r.row_id}/{name}", "w", encoding="utf-8", newline="") as f:
                f.write(r.value)

    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)  # without rows there is an empty folder
    rows.foreachPartition(put)


@query("SELECT target = 1 AS vulnerable, array_to_string(cwe, ',') AS kinds, md5(func) AS digest FROM primevul_raw WHERE func IS NOT NULL AND func <> ''")
def src_sample_folders(spark, d):
    """A folder per sample with its metadata and code; folders with only one of them are left out."""
    p = _folder(spark)
    t = table(spark, d, "primevul_raw")
    _write_files(t.where("func <> ''").select("row_id", F.col("func").alias("value")), p, "src.c")
    _write_files(t.select("row_id", F.to_json(F.struct((F.col("target") == 1).alias("vulnerable"), F.col("cwe").alias("vulnerability_type"))).alias("value")), p, "meta_data.json")
    return readers.sample_folders(spark, p).select("vulnerable", F.array_join("vulnerability_type", ",").alias("kinds"), F.md5("code").alias("digest"))


_REL = """WITH cve AS (SELECT DISTINCT cve AS cve_id FROM primevul_raw WHERE cve LIKE 'CVE-%'), fixes AS (SELECT DISTINCT cve AS cve_id, commit_id AS hash FROM primevul_raw WHERE cve LIKE 'CVE-%'), commits AS (SELECT DISTINCT commit_id AS hash FROM primevul_raw),
    file_change AS (SELECT row_id AS file_change_id, commit_id AS hash, func AS code_before, func AS code_after FROM primevul_raw), cls AS (SELECT DISTINCT cve AS cve_id, unnest(cwe) AS cwe_id FROM primevul_raw WHERE cve LIKE 'CVE-%')"""


@query(f"{_REL} SELECT cve_id, hash, file_change_id, cwe_id FROM cve JOIN fixes USING (cve_id) JOIN commits USING (hash) JOIN file_change USING (hash) LEFT JOIN cls USING (cve_id) WHERE length(code_before) > 50 AND length(code_after) > 50")
def src_relational(spark, d):
    """The tables of a relational source, derived from the grouped one, exported to Parquet and joined."""
    p = _folder(spark)
    t = table(spark, d, "primevul_raw")
    c = t.where("cve like 'CVE-%'")
    parts = {
        "cve": c.select(F.col("cve").alias("cve_id")).distinct(), "fixes": c.select(F.col("cve").alias("cve_id"), F.col("commit_id").alias("hash")).distinct(), "commits": t.select(F.col("commit_id").alias("hash")).distinct(),
        "file_change": t.select(F.col("row_id").alias("file_change_id"), F.col("commit_id").alias("hash"), F.lit("C").alias("programming_language"), F.col("func").alias("code_before"), F.col("func").alias("code_after")),
        "cwe_classification": c.select(F.col("cve").alias("cve_id"), F.explode("cwe").alias("cwe_id")).distinct(),
    }
    for name, df in parts.items():
        df.write.parquet(f"{p}/{name}.parquet")
    return readers.relational_changes({k: spark.read.parquet(f"{p}/{k}.parquet") for k in parts}, "C").select("cve_id", "hash", "file_change_id", "cwe_id")


def _reports(spark, d, p: str) -> None:
    """A report file per run, in the nested layout, with its predictions."""
    x = predictions(spark, d)
    inner = F.struct("sample_id", "predicted_label", "true_label", "is_success", "error_message")
    g = x.groupBy("run_id").agg(F.min("experiment_name").alias("e"), F.min("model_name").alias("m"), F.min("backend").alias("b"), F.min("task_type").alias("t"), F.min("created_at").alias("ts"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("acc"), F.array_sort(F.collect_list(F.struct("row_id", inner.alias("x")))).alias("ps"))
    info = F.struct(F.col("e").alias("experiment_name"), F.col("t").alias("task_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(F.col("m").alias("model_name"), F.col("b").alias("backend")).alias("model"))
    doc = F.struct(info.alias("benchmark_info"), F.struct(F.col("t").alias("task_type"), F.round("acc", 6).alias("accuracy")).alias("metrics"), F.lit(True).alias("is_success"), F.transform("ps", lambda q: q["x"]).alias("predictions"))
    rows = g.select(F.col("run_id").alias("row_id"), F.to_json(doc).alias("value"))
    _write_files(rows, p, "benchmark_report_20250101.json")
    _write_files(rows.where(F.col("row_id") < "run-0006"), p, "benchmark_report_20240101.json")


@query("SELECT experiment_name, model_name, backend, count(*) AS n FROM prediction_results JOIN runs USING (run_id) GROUP BY experiment_name, model_name, backend, run_id")
def src_reports(spark, d):
    """Reports in folders, the latest of each, exploded into predictions."""
    p = _folder(spark)
    _reports(spark, d, p)
    r = readers.latest_per_folder(readers.reports(spark, p))
    return r.select("experiment_name", "model_name", "backend", F.size("predictions").cast("long").alias("n"))


@query("SELECT experiment_name, sample_id, predicted_label, true_label, is_success FROM prediction_results JOIN runs USING (run_id)")
def src_report_predictions(spark, d):
    p = _folder(spark)
    _reports(spark, d, p)
    r = readers.predictions_of(readers.latest_per_folder(readers.reports(spark, p)))
    return r.select("experiment_name", "sample_id", "predicted_label", "true_label", "is_success")


@query(f"WITH {PRED}, g AS (SELECT run_id, min(experiment_name) AS experiment_name, min(created_at) AS ts FROM pred GROUP BY run_id) SELECT count(*) AS total_experiments, count(*) AS successful_experiments, date_trunc('second', min(ts)) AS start_time, date_trunc('second', max(ts)) AS end_time FROM g")
def orc_rebuild_plan(spark, d):
    p = _folder(spark)
    _reports(spark, d, p)
    r = experiments.rebuilt_plan(readers.latest_per_folder(readers.reports(spark, p)))
    return r.select("total_experiments", "successful_experiments", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"))


@query("SELECT experiment_name, row_number() OVER (ORDER BY run_id)::int - 1 AS position, backend FROM runs")
def src_plan_results(spark, d):
    """A plan file with all runs, half of its entries in the older flat layout, and read in one form."""
    from pyspark.sql import Window as W

    p = _folder(spark)
    r = table(spark, d, "runs").withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("run_id")))  # forty rows
    common = F.col("experiment_name").alias("experiment_name")
    nested = F.to_json(F.struct(F.struct(common, F.struct("model_name", "backend").alias("model")).alias("benchmark_info"), F.lit(True).alias("is_success")))
    flat = F.to_json(F.struct(F.struct(common, "model_name", "backend").alias("benchmark_info"), F.lit(True).alias("is_success")))
    one = r.select("i", F.when(F.col("i") % 2 == 0, nested).otherwise(flat).alias("j")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: x["j"]), ",").alias("all"))
    _write_files(one.select(F.lit("plan").alias("row_id"), F.concat(F.lit('{"plan_name": "p", "experiments": ['), "all", F.lit("]}")).alias("value")), p, "experiment_plan_results.json")
    return readers.plan_results(spark, p).select("experiment_name", "position", "backend")


@query("SELECT id, json_extract_string(metadata, '$.cwe_number') AS meta_cwe_number, json_extract_string(metadata, '$.programming_language') AS meta_programming_language FROM samples")
def snk_flattened(spark, d):
    f = writers.flattened(table(spark, d, "samples").select("id", "metadata"))
    return f.select("id", "meta_cwe_number", "meta_programming_language")


@query("SELECT printf('sample_%06d', row_number() OVER (ORDER BY row_id) - 1) AS id, md5(code) AS digest, label, CASE WHEN regexp_full_match(label, '[0-9]+') THEN try_cast(label AS INT) END AS label_int FROM samples")
def snk_samples_of_csv(spark, d):
    r = writers.samples_of_csv(table(spark, d, "samples").select("row_id", "code", "label", "dataset"), "row_id")
    return r.select("id", F.md5("code").alias("digest"), "label", "label_int")


@query("SELECT run_id, printf('%.3f', temperature) AS temperature, printf('%.3f', top_p) AS top_p FROM runs")
def snk_csv_fixed(spark, d):
    p = _folder(spark)
    writers.csv_fixed(table(spark, d, "runs").select("run_id", "temperature", "top_p"), p)
    return spark.read.option("header", True).schema("run_id string, temperature string, top_p string").csv(p)


@query("SELECT row_id, '# ' || project || chr(10) || chr(10) || '## Commit' || chr(10) || chr(10) || coalesce(commit_message, '-') || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || coalesce(cve_desc, '-') AS markdown FROM primevul_raw WHERE project IS NOT NULL")
def snk_markdown(spark, d):
    m = writers.markdown(table(spark, d, "primevul_raw").where("project is not null"), "project", [("Commit", "commit_message"), ("Description", "cve_desc")])
    return m.select("row_id", "markdown")


@query("SELECT dataset, label, count(*) AS n FROM samples WHERE dataset IS NOT NULL GROUP BY ALL")
def snk_partitioned_parquet(spark, d):
    p = _folder(spark)
    writers.dataset_parquet(table(spark, d, "samples").where("dataset is not null"), p, ["dataset"])
    return spark.read.parquet(p).groupBy("dataset", "label").agg(F.count("*").alias("n"))


@query(f"WITH {PRED}, c AS (SELECT run_id, {cells()} FROM pred GROUP BY run_id) SELECT run_id, {metric_sql(('accuracy', 'f1'))} FROM c")
def snk_report_json(spark, d):
    from quillon.functions.metrics import confusion_counts, with_metrics

    p = _folder(spark)
    c = predictions(spark, d).groupBy("run_id").agg(*confusion_counts(F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))))
    writers.report_json(with_metrics(c, ["accuracy", "f1"], digits=6), p)
    return spark.read.schema("accuracy double, f1 double, run_id string").json(p)


@query("SELECT DISTINCT cve AS id, 'Do you know ' || cve || '?' AS prompt FROM primevul_raw WHERE cve LIKE 'CVE-%'")
def snk_contamination_prompts(spark, d):
    p = _folder(spark)
    writers.contamination_prompts(table(spark, d, "primevul_raw").where("cve like 'CVE-%'").select(F.col("cve").alias("id"), F.format_string("Do you know %s?", "cve").alias("prompt")).distinct(), p)
    return spark.read.schema("id string, prompt string").json(p)


@query(f"WITH {PRED}, c AS (SELECT run_id, min(experiment_name) AS experiment_name, {cells()} FROM pred GROUP BY run_id) SELECT experiment_name, row_number() OVER (ORDER BY run_id)::int - 1 AS position, {metric_sql(('accuracy',))} FROM c")
def snk_plan_result(spark, d):
    """The result file of a plan with an experiment for each run, written and read again."""
    from pyspark.sql import Window as W

    p = _folder(spark)
    m = experiments.binary_metrics(predictions(spark, d), ["run_id", "experiment_name"]).withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("run_id")) - 1)  # a row per run
    info, metrics = F.struct("experiment_name").alias("benchmark_info"), F.struct(F.round("accuracy", 6).alias("accuracy")).alias("metrics")
    writers.plan_result(m.select("position", info, metrics, F.lit(True).alias("is_success")), p, "all runs")
    return readers.plan_results(spark, p).select("experiment_name", "position", "accuracy")


@query(f"WITH {PRED}, c AS (SELECT run_id, model_name, backend, {cells()}, count(*) AS n, avg(tokens_used) AS tok FROM pred GROUP BY ALL) SELECT backend AS source, model_name, sum(tp)::bigint AS tp, sum(tn)::bigint AS tn, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, round(sum(tok * n), 2) AS tokens_total, count(*) AS n_runs FROM c GROUP BY ALL")
def src_metrics_summaries(spark, d):
    """Metrics summaries in folders whose names tell the source; runs of a model and source are summed."""
    from quillon.functions.metrics import confusion_counts

    p = _folder(spark)
    c = predictions(spark, d).groupBy("run_id", "model_name", "backend").agg(*confusion_counts(F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))), F.count("*").alias("n"), F.avg("tokens_used").alias("tok"))
    cm = F.struct(F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"))
    doc = F.struct(F.struct(F.struct("model_name").alias("model"), F.struct(F.col("n").alias("total_samples"), F.col("tok").alias("tokens_used_avg")).alias("stats")).alias("benchmark_info"), F.struct(F.struct(cm.alias("confusion_matrix")).alias("details")).alias("metrics"))
    _write_files(c.select(F.concat("backend", F.lit("_experiments/plan/"), "run_id", F.lit("/step_by_step")).alias("row_id"), F.to_json(doc).alias("value")), p, "metrics_summary_1.json")
    r = readers.metrics_summaries(spark, p, {"source": r"/([^/]+)_experiments/"})
    return r.groupBy("source", "model_name").agg(*(F.sum(x).alias(x) for x in ("tp", "tn", "fp", "fn")), F.round(F.sum(F.col("tokens_used_avg") * F.col("total_samples")), 2).alias("tokens_total"), F.count("*").alias("n_runs"))


_CONFIG = {
    "models": {"small": {"backend": "stub"}, "large": {"backend": "vllm"}}, "datasets": {"a": {}, "b": {}, "c": {}}, "prompts": {"plain": {}, "strict": {}},
    "plans": {"all": {"models": ["small", "large"], "datasets": ["a", "b", "c"], "prompts": ["plain", "strict"]}},
}


@query("SELECT (m.i * 6 + d.i * 2 + p.i)::int AS position, m.v || '_' || d.v || '_' || p.v AS name, m.v AS model, d.v AS dataset, p.v AS prompt FROM (VALUES (0, 'small'), (1, 'large')) m(i, v), (VALUES (0, 'a'), (1, 'b'), (2, 'c')) d(i, v), (VALUES (0, 'plain'), (1, 'strict')) p(i, v)")
def orc_plan_expansion(spark, d):
    return config.expanded(spark, config.compose(_CONFIG), "all")


@query("SELECT count(DISTINCT id) AS n, count(DISTINCT id) AS answered FROM samples WHERE code IS NOT NULL AND greatest(1, length('Look.' || chr(10) || 'Is this vulnerable?' || chr(10) || code || chr(10) || '....................................................................................') // 4) <= 100000")
def inf_stub_pipeline(spark, d):
    """Samples through rendering, budget, three draws of the stand-in backend, parsing and voting."""
    s = table(spark, d, "samples").where("code is not null").groupBy("id").agg(F.min("code").alias("code"), F.min("label").alias("label"))
    p = experiments.score(s, "binary_vulnerability", "Look.", "Is this vulnerable?\n{code}", inference.backend("stub"), context=100_000_000, draws=3)
    return p.agg(F.count("*").alias("n"), F.sum(F.col("is_success").cast("long")).alias("answered"))


@query("SELECT 2::bigint AS total, 1::bigint AS successful, 1::bigint AS failed, 50.0::double AS success_rate, false AS all_successful")
def orc_run_plan(spark, d):
    """Three experiments: one done before, one that works, one that fails by itself."""

    def works():
        return table(spark, d, "runs").groupBy("backend").agg(F.count("*").alias("n"))

    def fails():
        return table(spark, d, "no_such_table")

    return experiments.summary(spark, experiments.run_plan(spark, [("old", works), ("works", works), ("fails", fails)], {"old"}))


class _Refusing(inference.StubBackend):
    """The stand-in, failing on prompts that hold a goto."""

    def infer_batch(self, prompts):
        if any("goto" in user for _, user in prompts):
            raise RuntimeError("no goto")
        return super().infer_batch(prompts)


def _inferred(spark, d, chunk: int):
    s = table(spark, d, "primevul_raw").where("func is not null").select("row_id", F.lit("Look.").alias("system"), F.col("func").alias("user"))
    return inference.infer(s, _Refusing, chunk=chunk)


@query(
    """SELECT row_id, contains(func, 'goto') AS failed, CASE WHEN contains(func, 'goto') THEN 'ERROR: RuntimeError: no goto' ELSE 'The code was looked at once.' || chr(10) || '[[FINAL_ANSWER: ' || CASE WHEN left(md5('0|Look.|' || func), 1) < '8' THEN 'VULNERABLE' ELSE 'SAFE' END || ']]' END AS response_text,
        CASE WHEN contains(func, 'goto') THEN 0 ELSE greatest(1, length(func) // 4) + CASE WHEN left(md5('0|Look.|' || func), 1) < '8' THEN 57 ELSE 51 END // 4 END::bigint AS tokens FROM primevul_raw WHERE func IS NOT NULL"""
)
def inf_usage_and_failures(spark, d):
    """Answers, their tokens and failures of the stand-in backend, one prompt at a time."""
    return _inferred(spark, d, 1).select("row_id", F.col("_error").isNotNull().alias("failed"), "response_text", F.col("tokens_used").alias("tokens"))


@query("SELECT count(*) AS prompts, true AS shared_equally FROM primevul_raw WHERE func IS NOT NULL")
def inf_duration_share(spark, d):
    """The prompts of a chunk share its time equally: no more different times than chunks."""
    x = _inferred(spark, d, 16).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("duration").alias("times"), F.min("duration").alias("least"))
    ok = (F.col("times") <= F.ceil(F.col("n") / 16) + 1) & (F.col("least") >= 0)
    return x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("prompts"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("shared_equally"))
