"""Readers of raw sources and reports into the sample model, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import normalise as N

SAMPLE = "id string, code string, label string, metadata string, cwe_types array<string>, severity string"
DOCUMENT = f"metadata string, samples array<struct<{', '.join(p.replace(' ', ':', 1) for p in SAMPLE.split(', '))}>>"
GROUPED = "idx string, project string, commit_id string, commit_message string, target int, func string, func_hash string, cwe array<string>, cve string, cve_desc string"
PAIRED = "vulnerable_function_body string, non_vulnerable_function_body string, cwe string, project string, func_hash string, call_graph string"
COMMITS = "func_before string, func_after string, commit_msg string, commit_url string, cve_id string, cwe_id string, file_name string, vulnerability_score string, extension string, is_test string, date string"
TOKENS = "code string, vulnerable_tokens array<string>, filename string, commit_hash string, repo_url string"
FIVE_TASKS = "code string, answer string, cwe string, idx string, selection string"
TYPED = "identifier string, code string, vulnerable boolean, vulnerability_types array<string>, func_name string, dataset string"
_MODEL = "model_name:string,model_type:string,backend:string,context_length:int,max_output_tokens:int,temperature:double,self_consistency_samples:int,binary_decision_mode:string,binary_logprob_threshold:double"
_STATS = "total_samples:int,total_time_seconds:double,avg_time_per_sample:double,tokens_used_total:bigint,tokens_used_avg:double"
_INFER = "responses:array<string>,vote_counts:map<string,int>,tokens_used:bigint,processing_time:double,confidence:double,binary_label_confidence:double"
# both layouts of reports: model and stats nested, or their members directly in benchmark_info
REPORT = (
    f"benchmark_info struct<experiment_name:string,task_type:string,dataset_path:string,timestamp:string,model:struct<{_MODEL}>,stats:struct<{_STATS}>,{_MODEL},{_STATS}>, "
    "metrics struct<task_type:string,accuracy:double,summary:map<string,double>,details:string>, is_success boolean, "
    f"predictions array<struct<sample_id:string,predicted_label:string,true_label:string,is_success:boolean,error_message:string,inference_data:struct<{_INFER}>>>"
)
PLAN = f"plan_name string, description string, start_time string, end_time string, experiments array<struct<{REPORT.replace(' struct<', ':struct<').replace(' boolean', ':boolean').replace(' array<', ':array<')}>>, output_dir string"


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines): blank lines are skipped, unreadable ones end up in the second table with their text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    rows = parsed.select("r.*")
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("_corrupt")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def dataset(spark: SparkSession, path: str, sample_limit: int | None = None) -> DataFrame:
    """Samples of processed files ``{metadata, samples}`` with their order; labels become strings, ``label_int`` their number if they are one."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "samples")
    out = docs.select("file", F.posexplode("samples").alias("_ord", "s")).select("file", F.col("_ord").cast("long").alias("_ord"), "s.*")
    out = out.withColumn("label_int", F.col("label").try_cast("int")).where(_valid_classes())
    return out.orderBy("file", "_ord").limit(sample_limit) if sample_limit else out


def _valid_classes():
    """Every class is SAFE or begins with CWE-."""
    return F.coalesce(F.forall("cwe_types", lambda c: (c == "SAFE") | c.startswith("CWE-")), F.lit(True))


def dataset_or_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A processed document or JSON lines, told apart by the file's first character and whether the whole is one object with samples."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c"), F.get_json_object("value", "$.samples").isNotNull().alias("doc")).first()
    if head and head.c == "{" and head.doc:
        return dataset(spark, path)
    return jsonl(spark, path, schema)[0]


def csv_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit pairs: quoted cells may hold commas, quotes and line ends."""
    return spark.read.schema(COMMITS).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def header_files(spark: SparkSession, path: str) -> DataFrame:
    """Samples of annotated source files: one file each, its comment header as columns, the code without headers."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.c").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    vulnerable = N.truthy(N.header_field(F.col("text"), "vulnerable"))
    cwe = N.cwe(N.header_field(F.col("text"), "cwe"), "loose")
    return t.select(
        "file", N.header_field(F.col("text"), "name").alias("id"), N.header_field(F.col("text"), "description").alias("description"), vulnerable.alias("vulnerable"), cwe.alias("cwe"),
        N.marker_line(F.col("text"), "{!LINE}").alias("line"), N.without_headers(F.col("text")).alias("code"),
    )


def sample_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders with meta_data.json and src.c: joined on the folder; incomplete ones are left out."""
    folder = F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1).alias("folder")
    meta = spark.read.schema("vulnerable boolean, vulnerability_type array<string>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta_data.json").json(path)
    code = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="src.c")
    return meta.select(folder, "vulnerable", "vulnerability_type").join(code.select(folder, F.col("value").alias("code")), "folder")


def relational(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """Tables exported from a relational source, one Parquet table each, also as temporary views."""
    out = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def relational_changes(t: dict[str, DataFrame], language: str, level: str = "file", cves: list[str] | None = None) -> DataFrame:
    """Vulnerability fixes at file or method level: inner joins along the fix, the classification by a left join; several classes or fixes repeat rows."""
    length = 50 if level == "file" else 20
    j = t["cve"].join(t["fixes"], "cve_id").join(t["commits"], "hash").join(t["file_change"].where(F.col("programming_language") == language), "hash")
    before, after = "code_before", "code_after"
    if level == "method":
        j = j.join(t["method_change"].select("file_change_id", "name", "signature", "code", "before_change"), "file_change_id")
        before, after = "before_change", "code"
    j = j.where((F.length(before) > length) & (F.length(after) > length))
    if cves:
        j = j.where(F.col("cve_id").isin(*sorted(cves)))
    return j.join(t["cwe_classification"], "cve_id", "left")


def reports(spark: SparkSession, path: str, pattern: str = "benchmark_report_*.json") -> DataFrame:
    """Report files in either layout, with model and stats in one place."""
    r = spark.read.schema(REPORT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return r.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), *_flat("benchmark_info"), "metrics", "is_success", "predictions")


CELLS = "true_positives:bigint,true_negatives:bigint,false_positives:bigint,false_negatives:bigint"
SUMMARY = f"benchmark_info struct<model:struct<{_MODEL}>,stats:struct<{_STATS}>>, metrics struct<details:struct<confusion_matrix:struct<{CELLS}>>>"


def metrics_summaries(spark: SparkSession, path: str, keys: dict[str, str], pattern: str = "metrics_summary_*.json") -> DataFrame:
    """Metrics summaries below a folder: model, stats and confusion counts, and for each of ``keys`` the first group of its expression in the file's path."""
    r = spark.read.schema(SUMMARY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    cells = [F.col(f"metrics.details.confusion_matrix.{long}").alias(short) for long, short in (("true_positives", "tp"), ("true_negatives", "tn"), ("false_positives", "fp"), ("false_negatives", "fn"))]
    named = [F.regexp_extract("_metadata.file_path", e, 1).alias(k) for k, e in keys.items()]
    return r.select(*named, "benchmark_info.model.model_name", "benchmark_info.stats.total_samples", "benchmark_info.stats.avg_time_per_sample", "benchmark_info.stats.tokens_used_avg", *cells)


def _flat(info: str) -> list:
    both = lambda group, c: F.coalesce(F.col(f"{info}.{group}.{c}"), F.col(f"{info}.{c}")).alias(c)
    names = lambda spec: [p.split(":")[0] for p in spec.split(",")]
    return [F.col(f"{info}.{c}").alias(c) for c in ("experiment_name", "task_type", "dataset_path", "timestamp")] + [both("model", c) for c in names(_MODEL)] + [both("stats", c) for c in names(_STATS)]


def plan_results(spark: SparkSession, path: str) -> DataFrame:
    """Successful experiments of plan files, one row each."""
    p = spark.read.schema(PLAN).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "experiment_plan_results.json").json(path)
    e = p.select(F.col("_metadata.file_path").alias("file"), "plan_name", F.posexplode("experiments").alias("position", "e")).where("e.is_success")
    return e.select("file", "plan_name", "position", *_flat("e.benchmark_info"), F.col("e.metrics.accuracy").alias("accuracy"), F.col("e.metrics.summary").alias("summary"))


def predictions_of(report_rows: DataFrame) -> DataFrame:
    return report_rows.select("file", "experiment_name", "model_name", F.posexplode("predictions").alias("position", "p")).select("file", "experiment_name", "model_name", "position", "p.*")


def latest_per_folder(files: DataFrame, file: str = "file") -> DataFrame:
    """The row with the greatest file name in each folder."""
    folder, name = F.regexp_extract(file, r"^(.*)/[^/]+$", 1), F.regexp_extract(file, r"([^/]+)$", 1)
    best = files.groupBy(folder.alias("_d")).agg(F.max(name).alias("_n"))
    return files.withColumn("_d", folder).withColumn("_n", name).join(best, ["_d", "_n"], "left_semi").drop("_d", "_n")
