"""Profiles of datasets and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.operators import datasets as D
from quillon.operators import profile as P
from quillon.plans.experiments import checks
from quillon.session import table

from ._registry import query


@query("SELECT label AS value, count(*) AS n FROM samples GROUP BY 1")
def agg_distribution(spark, d):
    return P.distribution(table(spark, d, "samples"), F.col("label"))


@query("SELECT coalesce(c, 'NONE') AS value, count(*) AS n FROM (SELECT unnest(CASE WHEN cwe_types IS NULL OR len(cwe_types) = 0 THEN [NULL] ELSE cwe_types END) AS c FROM samples) GROUP BY 1")
def agg_list_distribution(spark, d):
    return P.list_distribution(table(spark, d, "samples"), F.col("cwe_types"), "NONE")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in ("samples", "primevul_raw", "cleanvul_raw", "prediction_results", "prediction_records", "documents")) + ")")
def agg_table_counts(spark, d):
    out = None
    for t in ("samples", "primevul_raw", "cleanvul_raw", "prediction_results", "prediction_records", "documents"):
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT dataset, count(code) AS n, round(avg(length(code)), 4) AS mean, min(length(code))::bigint AS min, max(length(code))::bigint AS max, round(quantile_cont(length(code), 0.5), 4) AS median, round(stddev_samp(length(code)), 4) AS std FROM samples GROUP BY dataset")
def agg_length_stats(spark, d):
    return P.length_stats(table(spark, d, "samples"), ["dataset"], "code")


@query("WITH c AS (SELECT label, count(*) AS n FROM samples GROUP BY 1) SELECT label, n, round(n * 100.0::double / sum(n) OVER (), 4) AS percent, round(max(n) OVER ()::double / min(n) OVER (), 4) AS imbalance FROM c")
def agg_class_balance(spark, d):
    return P.class_balance(table(spark, d, "samples"), "label")


@query("SELECT sha256(code) AS digest, count(*) AS n, min(row_id) AS first_id, any_value(CASE WHEN length(code) > 100 THEN left(code, 100) || '...' ELSE code END) AS snippet FROM samples WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg_duplicates(spark, d):
    return P.duplicates(table(spark, d, "samples"), "code", "row_id")


@query("SELECT sha256(code) AS digest, row_id FROM samples WHERE code IN (SELECT code FROM samples GROUP BY code HAVING count(*) > 1)")
def agg_duplicate_members(spark, d):
    return P.duplicate_members(table(spark, d, "samples"), "code", "row_id")


@query("SELECT round(avg(CASE WHEN len(cwe) > 0 THEN len(cwe) END), 6) AS mean_non_empty, count(*) FILTER (len(cwe) > 0) AS non_empty FROM primevul_raw")
def agg_mean_non_empty(spark, d):
    n = F.when(F.size("cwe") > 0, F.size("cwe"))
    return table(spark, d, "primevul_raw").agg(F.round(F.avg(n), 6).alias("mean_non_empty"), F.count(n).alias("non_empty"))


@query("SELECT model_type, round(avg((true_label = '1')::int), 6) AS prevalence, count(*) AS n FROM prediction_results JOIN runs USING (run_id) WHERE true_label IS NOT NULL GROUP BY model_type")
def agg_prevalence(spark, d):
    x = table(spark, d, "prediction_results").join(table(spark, d, "runs").select("run_id", "model_type"), "run_id").where("true_label is not null")
    return x.groupBy("model_type").agg(F.round(F.avg((F.col("true_label") == "1").cast("double")), 6).alias("prevalence"), F.count("*").alias("n"))


_J = "json_extract_string(metadata, '$.{0}')"


_BASIC = f"""SELECT 'label' AS section, coalesce(label, '(null)') || '.n' AS key, count(*)::double AS value FROM samples GROUP BY label
    UNION ALL SELECT 'language', coalesce({_J.format('programming_language')}, '(null)') || '.n', count(*)::double FROM samples GROUP BY {_J.format('programming_language')}
    UNION ALL SELECT 'cwe', coalesce(c, '(null)') || '.n', count(*)::double FROM (SELECT unnest(CASE WHEN cwe_types IS NULL OR len(cwe_types) = 0 THEN [NULL] ELSE cwe_types END) AS c FROM samples) GROUP BY c
    UNION ALL SELECT 'samples', 'all.' || m, v FROM (SELECT unnest(['total', 'unique_labels']) AS m, unnest([count(*)::double, (count(DISTINCT label) + max((label IS NULL)::int))::double]) AS v FROM samples)
    UNION ALL SELECT 'code_length', 'all.' || m, v FROM (SELECT unnest(['n', 'mean', 'min', 'max', 'median', 'std']) AS m, unnest([count(code)::double, round(avg(length(code)), 4), min(length(code))::double, max(length(code))::double, round(quantile_cont(length(code), 0.5), 4), round(stddev_samp(length(code)), 4)]) AS v FROM samples)"""
_BALANCE = "SELECT 'balance' AS section, coalesce(label, '(null)') || '.' || m AS key, v AS value FROM (SELECT label, unnest(['n', 'percent', 'imbalance']) AS m, unnest([n::double, round(n * 100.0::double / sum(n) OVER (), 4), round(max(n) OVER ()::double / min(n) OVER (), 4)]) AS v FROM (SELECT label, count(*) AS n FROM samples GROUP BY 1))"


@query(_BASIC)
def prf_basic_stats(spark, d):
    """Totals, lengths and the distributions of labels, languages and classes, missing ones as a value."""
    return P.long_report(_basic(spark, d))


def _basic(spark, d):
    s = table(spark, d, "samples")
    every = s.withColumn("_all", F.lit("all"))
    totals = every.groupBy("_all").agg(F.count("*").alias("total"), (F.count_distinct("label") + F.max(F.col("label").isNull().cast("long"))).alias("unique_labels"))
    return {
        "label": P.distribution(s, F.col("label")), "language": P.distribution(s, F.get_json_object("metadata", "$.programming_language")), "cwe": P.list_distribution(s, F.col("cwe_types"), "(null)"),
        "samples": totals, "code_length": P.length_stats(every, ["_all"], "code"),
    }


@query(f"{_BASIC} UNION ALL {_BALANCE} UNION ALL SELECT 'duplicates', digest || '.n', n::double FROM (SELECT sha256(code) AS digest, count(*) AS n FROM samples WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def prf_balance_report(spark, d):
    """The whole report: basic statistics, balance of the classes, groups of equal codes."""
    s = table(spark, d, "samples")
    return P.long_report(_basic(spark, d) | {"balance": P.class_balance(s, "label"), "duplicates": P.duplicates(s, "code", "row_id").select("digest", "n")})


@query("SELECT coalesce(c, 'NONE') AS value, count(*) AS n, (SELECT count(*) FROM primevul_raw) AS total FROM (SELECT unnest(CASE WHEN cwe IS NULL OR len(cwe) = 0 THEN [NULL] ELSE cwe END) AS c FROM primevul_raw) GROUP BY 1")
def prf_lines_stats(spark, d):
    """Readable rows and classes of a source of JSON lines, with broken lines among them."""
    import uuid

    from quillon.session import _made, shared_dir
    from quillon.sources import readers

    p = f"{shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    _made.append((spark, p))
    table(spark, d, "primevul_raw").select("idx", "cwe").write.json(p)
    spark.sql("SELECT explode(array('{\"idx\": 1', '', 'no json')) AS value").write.mode("append").text(p)
    rows, _ = readers.jsonl(spark, p, "idx string, cwe array<string>")
    return P.list_distribution(rows, F.col("cwe"), "NONE").withColumn("total", rows.agg(F.count("*").alias("n")).scalar())


@query(
    """SELECT 'count' AS section, k AS value, n FROM (SELECT unnest(['cve', 'fixes', 'commits', 'file_change', 'classes']) AS k, unnest([count(DISTINCT cve) FILTER (cve LIKE 'CVE-%'), count(DISTINCT (cve, commit_id)) FILTER (cve LIKE 'CVE-%'), count(DISTINCT commit_id), count(*), (SELECT count(DISTINCT c) FROM (SELECT unnest(cwe) AS c FROM primevul_raw))]) AS n FROM primevul_raw)
    UNION ALL SELECT 'class', c, count(*) FROM (SELECT unnest(cwe) AS c FROM primevul_raw) GROUP BY c
    UNION ALL SELECT 'severity', CASE WHEN len(cwe) >= 2 THEN 'HIGH' WHEN len(cwe) = 1 THEN 'MEDIUM' ELSE 'NONE' END, count(*) FROM primevul_raw GROUP BY 2"""
)
def prf_relational_stats(spark, d):
    """Row counts of a relational source's tables, its classes and severity bands (of a score made from the number of classes)."""
    t = table(spark, d, "primevul_raw")
    is_cve = F.col("cve").startswith("CVE-")
    counts = t.agg(
        F.count_distinct(F.when(is_cve, F.col("cve"))).alias("cve"), F.count_distinct(F.when(is_cve, F.struct("cve", "commit_id"))).alias("fixes"), F.count_distinct("commit_id").alias("commits"), F.count("*").alias("file_change")
    )
    classes = P.distribution(t.select(F.explode("cwe").alias("c")), F.col("c"))
    long = counts.select(F.expr("stack(4, 'cve', cve, 'fixes', fixes, 'commits', commits, 'file_change', file_change) as (value, n)")).unionByName(classes.agg(F.count("*").alias("n")).select(F.lit("classes").alias("value"), "n"))
    score = F.least(F.coalesce(F.size("cwe"), F.lit(0)), F.lit(2))
    bands = P.distribution(t, N.severity_of_score(F.when(score == 2, 7).when(score == 1, 4).otherwise(0)))
    return long.withColumn("section", F.lit("count")).unionByName(classes.withColumn("section", F.lit("class"))).unionByName(bands.withColumn("section", F.lit("severity"))).select("section", "value", "n")


@query("SELECT idx % 2 = 0 AS even, count(DISTINCT idx) AS groups, count(DISTINCT idx) FILTER (target = 1) AS vulnerable_groups, count(DISTINCT idx) FILTER (target = 0) AS safe_groups FROM primevul_raw GROUP BY 1")
def prf_group_stats(spark, d):
    g = table(spark, d, "primevul_raw").groupBy("idx").agg(F.max((F.col("target") == 1).cast("long")).alias("v"), F.max((F.col("target") == 0).cast("long")).alias("s"))
    return g.groupBy((F.col("idx") % 2 == 0).alias("even")).agg(F.count("*").alias("groups"), F.sum("v").alias("vulnerable_groups"), F.sum("s").alias("safe_groups"))


@query("SELECT lower(trim(extension)) AS extension, count(*) AS n, count(*) FILTER (trim(coalesce(cwe_id, '')) <> '') AS with_class, round(avg(length(func_before)), 4) AS mean_length FROM cleanvul_raw GROUP BY 1")
def prf_source_stats(spark, d):
    c = table(spark, d, "cleanvul_raw")
    return c.groupBy(F.lower(F.trim("extension")).alias("extension")).agg(F.count("*").alias("n"), F.sum((F.trim(F.coalesce("cwe_id", F.lit(""))) != "").cast("long")).alias("with_class"), F.round(F.avg(F.length("func_before")), 4).alias("mean_length"))


@query(f"SELECT DISTINCT 'CWE-' || try_cast({_J.format('cwe_number')} AS INT) AS cwe FROM samples WHERE try_cast({_J.format('cwe_number')} AS INT) > 0")
def prf_class_listing(spark, d):
    n = F.get_json_object("metadata", "$.cwe_number").try_cast("int")
    return table(spark, d, "samples").where(n > 0).select(F.concat(F.lit("CWE-"), n.cast("string")).alias("cwe")).distinct().orderBy("cwe")


@query("SELECT CASE WHEN vulnerability_score >= 9 THEN 'CRITICAL' WHEN vulnerability_score >= 7 THEN 'HIGH' WHEN vulnerability_score >= 4 THEN 'MEDIUM' WHEN vulnerability_score > 0 THEN 'LOW' WHEN vulnerability_score IS NOT NULL THEN 'NONE' END AS band, count(*) AS n FROM cleanvul_raw GROUP BY 1")
def prf_severity_bands(spark, d):
    return P.distribution(table(spark, d, "cleanvul_raw"), N.severity_of_score(F.col("vulnerability_score")), "band")


@query(
    f"""SELECT dataset, count(*) AS total_samples, count(*) FILTER (n > 0) AS vulnerable_samples, count(*) FILTER (coalesce(n, 0) <= 0) AS safe_samples, count(DISTINCT lang) AS languages
    FROM (SELECT dataset, try_cast({_J.format('cwe_number')} AS INT) AS n, {_J.format('programming_language')} AS lang FROM samples) GROUP BY dataset"""
)
def prf_dataset_metadata(spark, d):
    s = table(spark, d, "samples").withColumn("cwe_number", F.get_json_object("metadata", "$.cwe_number").try_cast("int")).withColumn("language", F.get_json_object("metadata", "$.programming_language"))
    return D.metadata_of(s, ["dataset"])


@query(
    """SELECT 'id is null' AS rule, count(*) FILTER (id IS NULL) AS violations FROM samples UNION ALL SELECT 'code is null', count(*) FILTER (code IS NULL) FROM samples UNION ALL SELECT 'label is null', count(*) FILTER (label IS NULL) FROM samples
    UNION ALL SELECT 'class is malformed', count(*) FILTER (len(list_filter(cwe_types, lambda c: c <> 'SAFE' AND NOT starts_with(c, 'CWE-'))) > 0) FROM samples UNION ALL SELECT 'id is repeated', count(*) - count(DISTINCT id) FROM samples"""
)
def orc_checks(spark, d):
    return checks(table(spark, d, "samples"), ["id", "code", "label"])


@query("SELECT dataset, coalesce(json_extract_string(metadata, '$.programming_language'), 'unknown') AS language, count(*) AS files, count(code) AS with_code FROM samples GROUP BY ALL")
def orc_cross_file_summary(spark, d):
    lang = F.coalesce(F.get_json_object("metadata", "$.programming_language"), F.lit("unknown"))
    return table(spark, d, "samples").groupBy("dataset", lang.alias("language")).agg(F.count("*").alias("files"), F.count("code").alias("with_code"))


@query("SELECT t.c AS target, s.row_id, CASE WHEN list_contains(s.cwe, t.c) THEN '1' ELSE '0' END AS label FROM (SELECT DISTINCT unnest(cwe) AS c FROM primevul_raw) t, primevul_raw s WHERE list_contains(s.cwe, t.c) OR s.target = 0")
def orc_per_class_datasets(spark, d):
    """All per-class datasets in one job: positives from their own lists, safe rows for every class from one short list."""
    p = table(spark, d, "primevul_raw")
    classes = p.select(F.explode("cwe").alias("c")).agg(F.collect_set("c").alias("cs"))
    pos = p.select(F.explode(F.array_distinct("cwe")).alias("target"), "row_id", F.lit("1").alias("label"))
    safe = p.where("target = 0").select("row_id", F.coalesce("cwe", F.array().cast("array<string>")).alias("own"))
    neg = safe.select(F.explode(F.array_except(classes.scalar(), F.col("own"))).alias("target"), "row_id", F.lit("0").alias("label"))
    return pos.unionByName(neg)
