"""Joins, grouped rows, sorts, samples and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.functions.metrics import binary_label
from quillon.functions.text import strip
from quillon.operators import compare as C
from quillon.operators import datasets as D
from quillon.plans import config, inference
from quillon.session import table

from ._registry import PRED, predictions, query

# ---- joins ----


@query(
    """SELECT r_name, n_name, o_orderkey, l_linenumber, p_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 WHERE r_name IN ('ASIA', 'EUROPE') AND length(c_name) > 5 AND c_mktsegment IS NOT NULL GROUP BY ALL"""
)
def join_four_inner_one_left(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("region").where(F.col("r_name").isin("ASIA", "EUROPE")).join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.join(t("customer").where((F.length("c_name") > 5) & F.col("c_mktsegment").isNotNull()), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").where("p_size > 25"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy("r_name", "n_name", "o_orderkey", "l_linenumber", "p_name").agg(F.count("*").alias("n"))


@query(
    """SELECT n_name, s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 40 WHERE p_name IS NULL OR length(p_name) > 3 GROUP BY ALL"""
)
def join_five_inner_one_left(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("lineitem"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("part").where("p_size > 40"), F.col("p_partkey") == F.col("l_partkey"), "left").where("p_name is null or length(p_name) > 3")
    return j.groupBy("n_name", "s_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


_CVE = "SELECT id, min(coalesce(json_extract_string(metadata, '$.\"CVEFixes-Number\"'), json_extract_string(metadata, '$.cve_id'))) AS cve_id FROM samples GROUP BY id"


def _cves(spark, d):
    j = lambda k: F.get_json_object("metadata", f"$['{k}']")
    return table(spark, d, "samples").groupBy("id").agg(F.min(F.coalesce(j("CVEFixes-Number"), j("cve_id"))).alias("cve_id"))


@query(f"SELECT row_id, coalesce(cve_id, '') AS cve_id FROM prediction_results LEFT JOIN ({_CVE}) s ON s.id = sample_id")
def join_left_map(spark, d):
    c = _cves(spark, d).withColumnRenamed("id", "sample_id")
    return table(spark, d, "prediction_results").select("row_id", "sample_id").join(c, "sample_id", "left").select("row_id", F.coalesce("cve_id", F.lit("")).alias("cve_id"))


@query("SELECT DISTINCT row_id, sample_id IN (SELECT sample_id FROM prediction_records) AS in_shared FROM prediction_results")
def join_membership_flag(spark, d):
    shared = table(spark, d, "prediction_records").select("sample_id").distinct().withColumn("in_shared", F.lit(True))
    return table(spark, d, "prediction_results").join(shared, "sample_id", "left").select("row_id", F.coalesce("in_shared", F.lit(False)).alias("in_shared")).distinct()


@query("SELECT row_id FROM prediction_results WHERE sample_id IN (SELECT sample_id FROM prediction_records)")
def join_semi(spark, d):
    return table(spark, d, "prediction_results").join(table(spark, d, "prediction_records"), "sample_id", "left_semi").select("row_id")


@query("SELECT row_id FROM prediction_results WHERE sample_id NOT IN (SELECT sample_id FROM prediction_records)")
def join_anti(spark, d):
    return table(spark, d, "prediction_results").join(table(spark, d, "prediction_records"), "sample_id", "left_anti").select("row_id")


_SIDE = f"""{PRED}, side AS (SELECT sample_id, prompt_id, max((t = p)::int) AS hit FROM pred WHERE ok AND prompt_id IN (1, 2) GROUP BY ALL)"""


@query(f"WITH {_SIDE} SELECT a.sample_id, a.hit AS a_right, b.hit AS b_right FROM side a JOIN side b USING (sample_id) WHERE a.prompt_id = 1 AND b.prompt_id = 2")
def join_paired(spark, d):
    s = predictions(spark, d).where("ok and prompt_id in (1, 2)").groupBy("sample_id").pivot("prompt_id", [1, 2]).agg(F.max((F.col("t") == F.col("p")).cast("int")))
    return s.where("`1` is not null and `2` is not null").select("sample_id", F.col("1").alias("a_right"), F.col("2").alias("b_right"))


@query("WITH a AS (SELECT run_id, sample_id, count(*) AS answers FROM prediction_results GROUP BY ALL), b AS (SELECT run_id, sample_id, count(*) AS records FROM prediction_records GROUP BY ALL) SELECT * FROM a JOIN b USING (run_id, sample_id)")
def join_composite_key(spark, d):
    keys = ["run_id", "sample_id"]
    a = table(spark, d, "prediction_results").groupBy(*keys).agg(F.count("*").alias("answers"))
    return a.join(table(spark, d, "prediction_records").groupBy(*keys).agg(F.count("*").alias("records")), keys)


_ACC = "round(avg((t = p)::int), 6)"


@query(f"WITH {PRED}, f AS (SELECT model_name, {_ACC} AS accuracy, count(*) AS n FROM pred WHERE ok GROUP BY 1), l AS (SELECT model_name, {_ACC} AS accuracy, count(*) AS n FROM pred WHERE ok AND created_at >= TIMESTAMP '2025-01-01' GROUP BY 1) SELECT model_name, f.accuracy AS accuracy_full, f.n AS n_full, l.accuracy AS accuracy_late, l.n AS n_late, round(l.accuracy - f.accuracy, 6) AS delta FROM f JOIN l USING (model_name)")
def join_full_against_subset(spark, d):
    """Metrics of all rows beside those of the later ones."""
    x = predictions(spark, d).where("ok")
    late = F.col("created_at") >= F.lit("2025-01-01").cast("timestamp_ntz")
    hit = (F.col("t") == F.col("p")).cast("double")
    g = x.groupBy("model_name").agg(F.round(F.avg(hit), 6).alias("accuracy_full"), F.count("*").alias("n_full"), F.round(F.avg(F.when(late, hit)), 6).alias("accuracy_late"), F.sum(late.cast("long")).alias("n_late"))
    return g.where("n_late > 0").withColumn("delta", F.round(F.col("accuracy_late") - F.col("accuracy_full"), 6))


@query(f"WITH {PRED}, a AS (SELECT backend, prompt_id, {_ACC} AS accuracy FROM pred WHERE ok GROUP BY ALL), b AS (SELECT backend, accuracy AS base FROM a WHERE prompt_id = 1) SELECT backend, prompt_id, round(accuracy - base, 6) AS d_accuracy FROM a LEFT JOIN b USING (backend)")
def join_left_baseline(spark, d):
    a = predictions(spark, d).where("ok").groupBy("backend", "prompt_id").agg(F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 6).alias("accuracy"))
    return C.delta_to_baseline(a, ["backend"], "prompt_id", 1, ["accuracy"])


@query("WITH a AS (SELECT sample_id, count(*) AS answers FROM prediction_results GROUP BY 1), b AS (SELECT sample_id, count(*) AS records FROM prediction_records GROUP BY 1), k AS (SELECT DISTINCT id AS sample_id FROM samples) SELECT k.sample_id, coalesce(answers, 0)::bigint AS answers, coalesce(records, 0)::bigint AS records FROM (a FULL JOIN b USING (sample_id)) RIGHT JOIN k USING (sample_id)")
def join_outer_reindexed(spark, d):
    a = table(spark, d, "prediction_results").groupBy("sample_id").agg(F.count("*").alias("answers"))
    b = table(spark, d, "prediction_records").groupBy("sample_id").agg(F.count("*").alias("records"))
    k = table(spark, d, "samples").select(F.col("id").alias("sample_id")).distinct()
    return a.join(b, "sample_id", "full_outer").join(k, "sample_id", "right").fillna(0, ["answers", "records"])


@query(f"WITH {PRED} SELECT b.backend, m.model_type, coalesce(n, 0)::bigint AS n FROM (SELECT DISTINCT backend FROM runs) b, (SELECT DISTINCT model_type FROM runs) m LEFT JOIN (SELECT backend, model_type, count(*) AS n FROM pred GROUP BY ALL) c ON c.backend = b.backend AND c.model_type = m.model_type")
def join_dense_grid(spark, d):
    """Counts on the grid of all backends and model types: two short lists, exploded."""
    r = table(spark, d, "runs").agg(F.collect_set("backend").alias("b"), F.collect_set("model_type").alias("m"))
    grid = r.select(F.explode("b").alias("backend"), "m").select("backend", F.explode("m").alias("model_type"))
    n = predictions(spark, d).groupBy("backend", "model_type").agg(F.count("*").alias("n"))
    return grid.join(n, ["backend", "model_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT m.model_name AS model, s.dataset, p.prompt_name AS prompt FROM (SELECT DISTINCT model_name FROM runs) m, (SELECT DISTINCT dataset FROM samples WHERE dataset IS NOT NULL) s, prompts p")
def join_plan_product(spark, d):
    t = lambda n, c, a: table(spark, d, n).select(F.col(c).alias(a))
    return config.product(t("runs", "model_name", "model"), t("samples", "dataset", "dataset"), t("prompts", "prompt_name", "prompt"))


@query("WITH k AS (SELECT model_name FROM runs GROUP BY 1 HAVING count(DISTINCT prompt_id) >= 2 AND count(DISTINCT prompt_id) = 2) SELECT run_id FROM runs SEMI JOIN k USING (model_name)")
def join_division(spark, d):
    return C.dividing(table(spark, d, "runs"), "model_name", "prompt_id", 2).select("run_id")


@query(f"WITH {PRED}, o AS (SELECT s.id AS sample_id, q.prompt_id, p.hit FROM (SELECT DISTINCT id FROM samples) s, (VALUES (1), (2)) q(prompt_id) LEFT JOIN (SELECT sample_id, prompt_id, max((t = p)::int) AS hit FROM pred WHERE ok GROUP BY ALL) p ON p.sample_id = s.id AND p.prompt_id = q.prompt_id) SELECT sample_id, CASE WHEN count(*) = count(hit) THEN bool_and(hit = 1) END AS all_right FROM o GROUP BY sample_id")
def join_complete_pairs(spark, d):
    """Whether both prompts got a sample right; null where one of them has no answer."""
    ids = table(spark, d, "samples").select(F.col("id").alias("sample_id")).distinct().select("sample_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("prompt_id"))
    p = predictions(spark, d).where("ok").groupBy("sample_id", "prompt_id").agg(F.max((F.col("t") == F.col("p")).cast("int")).alias("hit"))
    g = ids.join(p, ["sample_id", "prompt_id"], "left").groupBy("sample_id").agg(F.count("*").alias("n"), F.count("hit").alias("k"), F.bool_and(F.col("hit") == 1).alias("r"))
    return g.select("sample_id", F.when(F.col("n") == F.col("k"), F.col("r")).alias("all_right"))


@query("SELECT position, id AS request_id, CASE WHEN ok IS NOT NULL THEN ok WHEN bad IS NOT NULL THEN 'ERROR: ' || bad ELSE 'ERROR: missing result' END AS text, ok IS NOT NULL AS is_success FROM (SELECT s.row_id AS position, s.id, s.row_id, max(md5(response_text)) FILTER (error_message IS NULL) AS ok, max(error_message) AS bad FROM samples s LEFT JOIN prediction_results p ON p.sample_id = s.id GROUP BY ALL)")
def join_batch_results(spark, d):
    """Each request once with its result: a success before an error, a placeholder where nothing came."""
    req = table(spark, d, "samples").select(F.col("row_id").alias("position"), F.col("id").alias("request_id"))
    res = table(spark, d, "prediction_results").select(F.col("sample_id").alias("request_id"), F.md5("response_text").alias("text"), F.col("error_message").alias("error"))
    return inference.in_request_order(req, res)


# ---- grouped rows ----

_SEP = "chr(10) || chr(10) || '/* ---- next function ---- */' || chr(10) || chr(10)"


@query(rf"SELECT idx, target, md5(coalesce(string_agg(part, {_SEP} ORDER BY row_id) FILTER (part <> ''), '')) AS digest, count(*) AS function_count FROM (SELECT *, coalesce(regexp_replace(func, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '') AS part FROM primevul_raw) GROUP BY idx, target")
def agg_group_concat(spark, d):
    return D.joined_code(table(spark, d, "primevul_raw"), ["idx", "target"], "func", "row_id").select("idx", "target", F.md5("code").alias("digest"), "function_count")


@query("SELECT idx, arg_min(project, row_id) AS project, arg_min(commit_id, row_id) AS commit_id FROM primevul_raw GROUP BY idx")
def agg_first_row(spark, d):
    return D.first_of_group(table(spark, d, "primevul_raw"), ["idx"], ["project", "commit_id"], "row_id")


@query("SELECT commit_url, arg_min(cwe_id, row_id) FILTER (trim(cwe_id) <> '') AS cwe_id FROM cleanvul_raw GROUP BY commit_url")
def agg_first_non_blank(spark, d):
    return D.first_non_blank(table(spark, d, "cleanvul_raw"), ["commit_url"], "cwe_id", "row_id")


@query("SELECT idx, coalesce(string_agg(c, ',' ORDER BY f), '') AS cwe FROM (SELECT idx, c, min(row_id * 100 + i) AS f FROM (SELECT idx, row_id, unnest(cwe) AS c, unnest(range(len(cwe))) AS i FROM primevul_raw) GROUP BY idx, c UNION ALL SELECT DISTINCT idx, NULL, 0 FROM primevul_raw) GROUP BY idx")
def nrm_cwe_union(spark, d):
    return D.union_of_lists(table(spark, d, "primevul_raw"), ["idx"], "cwe", "row_id").select("idx", F.array_join("cwe", ",").alias("cwe"))


@query(f"WITH {PRED} SELECT sample_id, bool_and(t = p) AS all_right, CASE WHEN sum((t = p)::int) > count(*) / 2.0::double THEN 1 ELSE 0 END AS majority_right FROM pred WHERE ok GROUP BY sample_id")
def agg_all_and_majority(spark, d):
    hit = F.col("t") == F.col("p")
    return predictions(spark, d).where("ok").groupBy("sample_id").agg(F.bool_and(hit).alias("all_right"), F.when(F.sum(hit.cast("int")) > F.count("*") / 2.0, 1).otherwise(0).alias("majority_right"))


@query("SELECT project, count(DISTINCT idx) FILTER (target = 1) AS groups_with_vuln, count(DISTINCT idx) FILTER (target = 0) AS groups_with_safe FROM primevul_raw GROUP BY project")
def agg_group_distinct_counts(spark, d):
    """Two levels: groups per project first."""
    g = table(spark, d, "primevul_raw").groupBy("project", "idx").agg(F.max((F.col("target") == 1).cast("long")).alias("v"), F.max((F.col("target") == 0).cast("long")).alias("s"))
    return g.groupBy("project").agg(F.sum("v").alias("groups_with_vuln"), F.sum("s").alias("groups_with_safe"))


@query("SELECT model_name, min(created_at) AS first_at, max(created_at) AS last_at, CASE WHEN count(DISTINCT backend) = 1 THEN min(backend) END AS backend FROM prediction_results JOIN runs USING (run_id) GROUP BY model_name")
def agg_time_and_single(spark, d):
    x = predictions(spark, d)
    return x.groupBy("model_name").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.when(F.count_distinct("backend") == 1, F.min("backend")).alias("backend"))


@query(f"WITH {PRED} SELECT prompt_id, round(avg(CASE WHEN backend = 'vllm' THEN (t = p)::int END), 6) AS vllm, round(avg(CASE WHEN backend = 'hf' THEN (t = p)::int END), 6) AS hf, round(avg(CASE WHEN backend = 'online' THEN (t = p)::int END), 6) AS online, round(avg(CASE WHEN backend = 'llama_cpp' THEN (t = p)::int END), 6) AS llama_cpp FROM pred WHERE ok GROUP BY prompt_id")
def agg_pivot(spark, d):
    return predictions(spark, d).where("ok").groupBy("prompt_id").pivot("backend", ["vllm", "hf", "online", "llama_cpp"]).agg(F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 6))


@query("SELECT model_name, backend, count(*) AS n FROM prediction_results JOIN runs USING (run_id) GROUP BY ROLLUP (model_name, backend)")
def agg_rollup(spark, d):
    return predictions(spark, d).rollup("model_name", "backend").agg(F.count("*").alias("n"))


@query("SELECT model_type, backend, count(*) AS n FROM prediction_results JOIN runs USING (run_id) GROUP BY CUBE (model_type, backend)")
def agg_cube(spark, d):
    return predictions(spark, d).cube("model_type", "backend").agg(F.count("*").alias("n"))


@query("SELECT run_id, count(DISTINCT sample_id) AS samples, count(DISTINCT predicted_label) AS labels FROM prediction_results GROUP BY run_id")
def agg_distinct(spark, d):
    return table(spark, d, "prediction_results").groupBy("run_id").agg(F.count_distinct("sample_id").alias("samples"), F.count_distinct("predicted_label").alias("labels"))


# ---- sorts, limits, samples ----


@query("SELECT run_id, model_name, n, rank::int AS rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, model_name, run_id) AS rank FROM (SELECT run_id, model_name, count(*) AS n FROM prediction_results JOIN runs USING (run_id) GROUP BY ALL))")
def srt_multi_key(spark, d):
    """Ranks over one row per run, by count and name."""
    g = predictions(spark, d).groupBy("run_id", "model_name").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "model_name", "run_id")))


@query("SELECT file_name, rank::int AS rank FROM (SELECT file_name, row_number() OVER (ORDER BY lower(file_name), file_name) AS rank FROM (SELECT DISTINCT file_name FROM cleanvul_raw WHERE file_name IS NOT NULL))")
def srt_lower_path(spark, d):
    """A global order without one task for all: ranks within ranges of the first letters, added up."""
    f = table(spark, d, "cleanvul_raw").where("file_name is not null").select("file_name", F.lower("file_name").alias("k")).distinct().withColumn("b", F.substring("k", 1, 5))
    n = f.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("b")) - F.col("n"))
    r = f.join(n.select("b", "before"), "b").withColumn("rank", (F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("k", "file_name"))).cast("int"))
    return r.select("file_name", "rank")


@query("SELECT cwe, n FROM (SELECT unnest(cwe) AS cwe, count(*) AS n FROM primevul_raw GROUP BY 1) ORDER BY n DESC, cwe LIMIT 10")
def srt_top_k(spark, d):
    return table(spark, d, "primevul_raw").select(F.explode("cwe").alias("cwe")).groupBy("cwe").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwe").limit(10)


@query("SELECT dataset, arg_min(row_id, length(code) * 1000000000 + row_id) AS row_id, min(length(code))::bigint AS n FROM samples WHERE code IS NOT NULL GROUP BY dataset")
def srt_shortest(spark, d):
    s = table(spark, d, "samples").where("code is not null")
    return s.groupBy("dataset").agg(F.min_by("row_id", F.struct(F.length("code"), "row_id")).alias("row_id"), F.min(F.length("code")).cast("long").alias("n"))


@query("SELECT row_id FROM samples ORDER BY md5('42|' || row_id), row_id LIMIT 50")
def smp_shuffle_and_cap(spark, d):
    return D.shuffled(table(spark, d, "samples").select("row_id"), "row_id", 50)


@query("WITH x AS (SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || row_id), row_id) AS r FROM primevul_raw), c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM primevul_raw GROUP BY target)) SELECT row_id, target FROM x, c WHERE r <= m")
def smp_balanced(spark, d):
    return D.balanced(table(spark, d, "primevul_raw").select("row_id", "target"), "target", "row_id")


@query("SELECT row_id, idx FROM primevul_raw WHERE idx IN (SELECT idx FROM primevul_raw GROUP BY idx ORDER BY min(row_id) LIMIT 20)")
def smp_limit_groups(spark, d):
    return D.limited(table(spark, d, "primevul_raw").select("row_id", "idx"), "groups", 20, "row_id", "idx")


@query("SELECT row_id FROM primevul_raw ORDER BY row_id LIMIT 30")
def smp_limit_in_order(spark, d):
    return D.limited(table(spark, d, "primevul_raw").select("row_id"), "samples", 30, "row_id")


# ---- sets ----


@query("SELECT sample_id FROM prediction_results INTERSECT SELECT sample_id FROM prediction_records")
def set_intersection(spark, d):
    return table(spark, d, "prediction_results").select("sample_id").intersect(table(spark, d, "prediction_records").select("sample_id"))


@query("SELECT 'samples' AS src, row_id, id, NULL::varchar AS project FROM samples UNION ALL SELECT 'primevul_raw', row_id, NULL, project FROM primevul_raw")
def set_union(spark, d):
    a = table(spark, d, "samples").select(F.lit("samples").alias("src"), "row_id", "id")
    return a.unionByName(table(spark, d, "primevul_raw").select(F.lit("primevul_raw").alias("src"), "row_id", "project"), allowMissingColumns=True)


@query("SELECT id FROM samples EXCEPT SELECT sample_id FROM prediction_results")
def set_difference(spark, d):
    return table(spark, d, "samples").select("id").subtract(table(spark, d, "prediction_results").select(F.col("sample_id").alias("id")))


@query("SELECT DISTINCT unnest(cwe) AS cwe FROM primevul_raw")
def set_distinct_elements(spark, d):
    return table(spark, d, "primevul_raw").select(F.explode("cwe").alias("cwe")).distinct()
