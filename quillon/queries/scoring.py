"""Confusion counts, metrics, reports and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.operators import reports as R
from quillon.operators import votes as V
from quillon.plans.experiments import binary_metrics, success_summary
from quillon.session import table

from ._registry import PRED, cells, metric_sql, predictions, query
from .parsing import BINARY_SQL, MULTICLASS_SQL

ALL = ("accuracy", "precision", "recall", "f1", "specificity", "fnr", "fpr", "balanced_accuracy", "youden_j", "mcc")


def _counts(spark, d, *keys):
    x = predictions(spark, d)
    return x.groupBy(*keys).agg(*M.confusion_counts(F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))))


@query(f"WITH {PRED} SELECT run_id, count(*) AS n, count(*) FILTER (NOT ok) AS n_failed, {cells()} FROM pred GROUP BY run_id")
def agg_confusion_binary(spark, d):
    x = predictions(spark, d)
    t, p = F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))
    return x.groupBy("run_id").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("n_failed"), *M.confusion_counts(t, p))


@query(f"WITH {PRED}, c AS (SELECT model_name, count(*) AS n, count(*) FILTER (NOT ok) AS n_failed, {cells()} FROM pred GROUP BY model_name) SELECT model_name, n, n_failed, tp, tn, fp, fn, {metric_sql(('accuracy', 'precision', 'recall', 'f1', 'specificity'))} FROM c")
def metrics_binary(spark, d):
    m = binary_metrics(predictions(spark, d), ["model_name"])
    return m.select("model_name", "n", "n_failed", *M.COUNTS, *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "specificity")))


@query(f"WITH {PRED}, c AS (SELECT experiment_name, {cells()} FROM pred GROUP BY experiment_name) SELECT experiment_name, {metric_sql(ALL)} FROM c")
def met_derived(spark, d):
    return M.with_metrics(_counts(spark, d, "experiment_name"), list(ALL), digits=6).drop(*M.COUNTS)


@query(f"WITH {PRED}, c AS (SELECT run_id, backend, {cells()} FROM pred GROUP BY run_id, backend) SELECT run_id, backend, {metric_sql(ALL, 'NULL')} FROM c")
def met_null_on_zero(spark, d):
    return M.with_metrics(_counts(spark, d, "run_id", "backend"), list(ALL), zero_div="null", digits=6).drop(*M.COUNTS)


@query(f"WITH {PRED}, c AS (SELECT run_id, model_name, backend, {cells()} FROM pred GROUP BY ALL) SELECT model_name, backend, sum(tp)::bigint AS tp, sum(tn)::bigint AS tn, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, count(*) AS runs FROM c GROUP BY model_name, backend")
def agg_confusion_over_runs(spark, d):
    c = _counts(spark, d, "run_id", "model_name", "backend")
    return c.groupBy("model_name", "backend").agg(*(F.sum(x).alias(x) for x in M.COUNTS), F.count("*").alias("runs"))


_REC = "rec AS (SELECT row_id, run_id, sample_id, true_label, predicted_label, inference_data AS i FROM prediction_records)"


@query(
    f"""WITH {_REC}, v AS (SELECT run_id, CASE WHEN true_label IN ('0', 'SAFE') THEN 0 WHEN true_label = '1' OR starts_with(true_label, 'CWE-') THEN 1 END AS t,
        unnest(map_keys(i.vote_counts)) AS label, unnest(map_values(i.vote_counts)) AS w FROM rec)
    SELECT run_id, coalesce(sum(w) FILTER (t = 1 AND label = '1'), 0)::bigint AS tp, coalesce(sum(w) FILTER (t = 0 AND label = '0'), 0)::bigint AS tn,
        coalesce(sum(w) FILTER (t = 0 AND label = '1'), 0)::bigint AS fp, coalesce(sum(w) FILTER (t = 1 AND label = '0'), 0)::bigint AS fn FROM v GROUP BY run_id"""
)
def agg_confusion_by_votes(spark, d):
    r = table(spark, d, "prediction_records").select("run_id", M.binary_label(F.col("true_label")).alias("t"), F.explode("inference_data.vote_counts").alias("label", "w"))
    p = F.when(F.col("label") == "1", 1).when(F.col("label") == "0", 0)
    return r.groupBy("run_id").agg(*M.confusion_counts(F.col("t"), p, F.col("w").cast("long")))


_MULTI = f"""WITH {PRED}, m AS (SELECT model_name, coalesce(true_label, 'UNKNOWN') AS "true", CASE WHEN coalesce(predicted_label, '') = '' THEN 'UNKNOWN' ELSE predicted_label END AS pred FROM pred
    WHERE task_type = 'multiclass_vulnerability' AND coalesce(is_success, false)),
    c AS (SELECT model_name, "true", pred, count(*) AS n FROM m GROUP BY ALL),
    l AS (SELECT model_name, "true" AS label FROM c UNION SELECT model_name, pred FROM c),
    s AS (SELECT l.model_name, l.label, coalesce((SELECT sum(n) FROM c WHERE c.model_name = l.model_name AND c."true" = l.label), 0)::bigint AS support,
        coalesce((SELECT sum(n) FROM c WHERE c.model_name = l.model_name AND c.pred = l.label), 0)::bigint AS predicted,
        coalesce((SELECT sum(n) FROM c WHERE c.model_name = l.model_name AND c.pred = l.label AND c."true" = l.label), 0)::bigint AS tp FROM l),
    r AS (SELECT model_name, label, CASE WHEN predicted = 0 THEN 0.0::double ELSE tp::double / predicted END AS precision, CASE WHEN support = 0 THEN 0.0::double ELSE tp::double / support END AS recall,
        CASE WHEN predicted + support = 0 THEN 0.0::double ELSE 2.0::double * tp / (predicted + support) END AS f1, support FROM s)"""


def _multi(spark, d):
    x = predictions(spark, d).where("task_type = 'multiclass_vulnerability' and is_success")
    x = x.withColumn("true", F.coalesce("true_label", F.lit("UNKNOWN"))).withColumn("pred", F.when(F.coalesce("predicted_label", F.lit("")) == "", "UNKNOWN").otherwise(F.col("predicted_label")))
    return R.label_pairs(x, ["model_name"], "true", "pred")


@query(f'''{_MULTI} SELECT a.model_name, a.label AS "true", b.label AS pred, coalesce(c.n, 0)::bigint AS n FROM l a JOIN l b USING (model_name) LEFT JOIN c ON c.model_name = a.model_name AND c."true" = a.label AND c.pred = b.label''')
def agg_confusion_multiclass(spark, d):
    return R.confusion_matrix(_multi(spark, d), ["model_name"])


@query(f"{_MULTI} SELECT model_name, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def agg_class_report(spark, d):
    return R.class_report(_multi(spark, d), ["model_name"]).select("model_name", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(
    f"""{_MULTI} SELECT model_name, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
        round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
        count(*) AS labels, (SELECT round(sum(CASE WHEN c."true" = c.pred THEN n ELSE 0 END)::double / sum(n), 6) FROM c WHERE c.model_name = r.model_name) AS accuracy FROM r GROUP BY model_name"""
)
def met_macro_weighted(spark, d):
    c = _multi(spark, d).cache()
    return R.macro_weighted(R.class_report(c, ["model_name"]), c, ["model_name"])


@query(
    """SELECT backend, count(processing_time) AS count, round(coalesce(min(processing_time), 0), 6) AS min, round(coalesce(max(processing_time), 0), 6) AS max, round(coalesce(avg(processing_time), 0), 6) AS mean,
        round(var_samp(processing_time), 4) AS variance, round(stddev_samp(processing_time), 4) AS std FROM prediction_results JOIN runs USING (run_id) GROUP BY backend"""
)
def agg_describe(spark, d):
    x = R.describe(predictions(spark, d), ["backend"], "processing_time")
    return x.withColumn("variance", F.round("variance", 4)).withColumn("std", F.round("std", 4))


@query("SELECT model_name, round(avg(confidence), 6) AS mean, min(confidence) AS min, max(confidence) AS max, count(confidence) AS count FROM prediction_results JOIN runs USING (run_id) GROUP BY model_name")
def agg_confidence_stats(spark, d):
    return R.confidence_stats(predictions(spark, d), ["model_name"], "confidence")


@query("SELECT run_id, count(*) AS total_samples, sum(tokens_used)::bigint AS tokens_used_total, round(avg(tokens_used), 4) AS tokens_used_avg, round(sum(processing_time), 4) AS total_time, round(sum(processing_time) / count(*), 4) AS time_per_sample FROM prediction_results GROUP BY run_id")
def agg_run_totals(spark, d):
    return table(spark, d, "prediction_results").groupBy("run_id").agg(
        F.count("*").alias("total_samples"), F.sum("tokens_used").alias("tokens_used_total"), F.round(F.avg("tokens_used"), 4).alias("tokens_used_avg"), F.round(F.sum("processing_time"), 4).alias("total_time"), F.round(F.sum("processing_time") / F.count("*"), 4).alias("time_per_sample")
    )


@query("SELECT run_id, count(*) AS total, count(*) FILTER (coalesce(is_success, false)) AS successful, count(*) FILTER (NOT coalesce(is_success, false)) AS failed, round(count(*) FILTER (coalesce(is_success, false)) * 100.0::double / count(*), 4) AS success_rate, bool_and(coalesce(is_success, false)) AS all_successful FROM prediction_results GROUP BY run_id")
def agg_success_summary(spark, d):
    return success_summary(table(spark, d, "prediction_results"), ("run_id",))


@query(
    """WITH s AS (SELECT r.row_id, r.inference_data AS i, s.code AS truth FROM prediction_records r JOIN (SELECT id, min(code) AS code FROM samples GROUP BY id) s ON s.id = r.sample_id),
    p AS (SELECT row_id, coalesce(array_to_string(i.responses, chr(10)), '') AS pred, coalesce(truth, '') AS truth FROM s WHERE i IS NOT NULL),
    w AS (SELECT row_id, list_distinct(list_filter(regexp_extract_all(pred, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS a, list_distinct(list_filter(regexp_extract_all(truth, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS b FROM p)
    SELECT row_id, round(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b))::double / len(b) WHEN len(a) = 0 THEN 1.0 ELSE 0.0 END, 6) AS token_recall FROM w"""
)
def met_token_recall(spark, d):
    """Identifiers of the sample that the answers name."""
    return _recall(spark, d).select("row_id", F.round(M.token_recall(F.col("pred"), F.col("true")), 6).alias("token_recall"))


def _recall(spark, d):
    s = table(spark, d, "samples").groupBy(F.col("id").alias("sample_id")).agg(F.min("code").alias("code"))
    r = table(spark, d, "prediction_records").where("inference_data is not null").join(s, "sample_id")
    return r.select("row_id", F.coalesce(F.array_join("inference_data.responses", "\n"), F.lit("")).alias("pred"), F.coalesce("code", F.lit("")).alias("true"))


@query(
    """WITH l AS (SELECT row_id, list_distinct(list_filter(list_transform(string_split(func_before, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS b,
        list_distinct(list_filter(list_transform(string_split(func_after, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS a FROM cleanvul_raw WHERE func_before IS NOT NULL AND func_after IS NOT NULL)
    SELECT row_id, round(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b))::double / len(b) WHEN len(a) = 0 THEN 1.0 ELSE 0.0 END, 6) AS line_recall FROM l"""
)
def met_line_recall(spark, d):
    """Lines of the vulnerable function that the fixed one still has."""
    c = table(spark, d, "cleanvul_raw").where("func_before is not null and func_after is not null")
    return c.select("row_id", F.round(M.line_recall(F.col("func_after"), F.col("func_before")), 6).alias("line_recall"))


@query("SELECT row_id, round(exp(ln(confidence) * 0.5 + ln(binary_label_confidence) * 0.5), 6) AS geometric, round(confidence / (confidence + binary_label_confidence), 6) AS normalised FROM prediction_results WHERE confidence > 0 AND binary_label_confidence > 0")
def met_probabilities(spark, d):
    x = table(spark, d, "prediction_results").where("confidence > 0 and binary_label_confidence > 0")
    return x.select("row_id", F.round(M.token_probability(F.array(F.log("confidence"), F.log("binary_label_confidence"))), 6).alias("geometric"), F.round(M.two_label_probability(F.col("confidence"), F.col("binary_label_confidence")), 6).alias("normalised"))


@query(
    f"""WITH {PRED}, x AS (SELECT model_name, t, confidence FROM pred WHERE ok AND confidence IS NOT NULL),
    k AS (SELECT model_name, t, avg(r) OVER (PARTITION BY model_name, confidence) AS r FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY confidence) AS r FROM x))
    SELECT model_name, CASE WHEN sum(t) > 0 AND sum(1 - t) > 0 THEN round((sum(r * t) - sum(t) * (sum(t) + 1) / 2.0::double) / (sum(t) * sum(1 - t)), 6) END AS auc FROM k GROUP BY model_name"""
)
def met_auc(spark, d):
    """Area under the curve by rank sums, ties at their mean rank. Ranks come from counts per value, so that no task sorts all rows."""
    x = predictions(spark, d).where("ok and confidence is not null").groupBy("model_name", "confidence").agg(F.sum("t").alias("pos"), F.count("*").alias("n"))
    from pyspark.sql import Window as W

    before = F.sum("n").over(W.partitionBy("model_name").orderBy("confidence")) - F.col("n")
    r = x.withColumn("r", before + (F.col("n") + 1) / 2)
    p, q = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return r.groupBy("model_name").agg(F.round(F.when((p > 0) & (q > 0), (F.sum(F.col("r") * F.col("pos")) - p * (p + 1) / 2.0) / (p * q)), 6).alias("auc"))


_LONG = lambda names: "unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS metric, unnest([" + ", ".join(f"({n})::double" for n in names) + "]) AS value"
_BIN = ("accuracy", "precision", "recall", "f1_score", "specificity")
_TOKENS = lambda c: f"list_distinct(list_filter(regexp_extract_all(coalesce({c}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*')))"
_LINES = lambda c: f"list_distinct(list_filter(list_transform(string_split(coalesce({c}, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''))"
_SHARE = "CASE WHEN len(b) > 0 THEN len(list_intersect(a, b))::double / len(b) WHEN len(a) = 0 THEN 1.0 ELSE 0.0 END"


@query(
    f"""{_MULTI}, bc AS (SELECT run_id, {cells('t IS NOT NULL AND p IS NOT NULL')} FROM pred WHERE starts_with(task_type, 'binary') GROUP BY run_id), bm AS (SELECT run_id, {metric_sql(('accuracy', 'precision', 'recall', 'f1', 'specificity'))} FROM bc),
    x AS (SELECT run_id AS g, {_LONG(_BIN)} FROM (SELECT *, f1 AS f1_score FROM bm)),
    k3 AS (SELECT 'task3' AS g, count(*) AS total_predictions, round(avg({_SHARE}), 6) AS r FROM (SELECT {_TOKENS('func_after')} AS a, {_TOKENS('func_before')} AS b FROM cleanvul_raw)),
    k4 AS (SELECT 'task4' AS g, count(*) AS total_predictions, round(avg({_SHARE}), 6) AS r FROM (SELECT {_LINES('func_after')} AS a, {_LINES('func_before')} AS b FROM cleanvul_raw)),
    am AS (SELECT model_name, coalesce(true_label, 'UNKNOWN') AS "true", CASE WHEN coalesce(predicted_label, '') = '' THEN 'UNKNOWN' ELSE predicted_label END AS pred FROM pred WHERE task_type = 'multiclass_vulnerability'),
    ac AS (SELECT model_name, "true", pred, count(*) AS n FROM am GROUP BY ALL), al AS (SELECT model_name, "true" AS label FROM ac UNION SELECT model_name, pred FROM ac),
    s2 AS (SELECT al.model_name, al.label, coalesce((SELECT sum(n) FROM ac WHERE ac.model_name = al.model_name AND ac."true" = al.label), 0) AS support, coalesce((SELECT sum(n) FROM ac WHERE ac.model_name = al.model_name AND ac.pred = al.label), 0) AS predicted,
        coalesce((SELECT sum(n) FROM ac WHERE ac.model_name = al.model_name AND ac.pred = al.label AND ac."true" = al.label), 0) AS tp FROM al),
    am2 AS (SELECT model_name AS g, round(avg(CASE WHEN predicted = 0 THEN 0.0::double ELSE tp::double / predicted END), 6) AS macro_precision, round(avg(CASE WHEN support = 0 THEN 0.0::double ELSE tp::double / support END), 6) AS macro_recall,
        round(avg(CASE WHEN predicted + support = 0 THEN 0.0::double ELSE 2.0::double * tp / (predicted + support) END), 6) AS macro_f1_score, (SELECT round(sum(CASE WHEN ac."true" = ac.pred THEN n ELSE 0 END)::double / sum(n), 6) FROM ac WHERE ac.model_name = s2.model_name) AS accuracy FROM s2 GROUP BY model_name)
    SELECT g, metric, value FROM x UNION ALL SELECT g, {_LONG(('accuracy', 'macro_precision', 'macro_recall', 'macro_f1_score'))} FROM am2
    UNION ALL SELECT g, {_LONG(('total_predictions', 'macro_token_recall', 'micro_token_recall', 'accuracy'))} FROM (SELECT *, r AS macro_token_recall, r AS micro_token_recall, r AS accuracy FROM k3)
    UNION ALL SELECT g, {_LONG(('total_predictions', 'avg_line_recall', 'avg_union_line_recall', 'accuracy'))} FROM (SELECT *, r AS avg_line_recall, r AS avg_union_line_recall, r AS accuracy FROM k4)"""
)
def met_by_task(spark, d):
    """The metrics of each task: binary ones by run, those of classes by model, token and line recall of code."""
    x = predictions(spark, d).select("run_id", "model_name", "task_type", F.col("true_label").alias("true"), F.col("predicted_label").alias("pred"))
    binary = R.metric_summary(x.where(F.col("task_type").startswith("binary")).withColumnRenamed("run_id", "g"), ["g"], "binary_vulnerability")
    classes = R.metric_summary(x.where("task_type = 'multiclass_vulnerability'").withColumnRenamed("model_name", "g"), ["g"], "multiclass_vulnerability")
    c = table(spark, d, "cleanvul_raw").select(F.col("func_before").alias("true"), F.col("func_after").alias("pred"))
    code = [R.metric_summary(c.withColumn("g", F.lit(t)), ["g"], "binary_vulnerability", t) for t in ("task3", "task4")]
    return binary.unionByName(classes).unionByName(code[0]).unionByName(code[1])


# ---- votes ----

# a draw's label: by the parser of its run's task, as every other answer; ``vote`` is that of binary tasks
_DRAW = f"""draw AS (SELECT run_id, sample_id, row_id, pass_idx, label, CASE WHEN starts_with(task_type, 'binary') THEN try_cast(label AS int) END AS vote FROM (
    SELECT run_id, sample_id, row_id, pass_idx, task_type, CASE WHEN starts_with(task_type, 'binary') THEN ({BINARY_SQL})::varchar WHEN task_type = 'multiclass_vulnerability' THEN {MULTICLASS_SQL} END AS label FROM (
        SELECT run_id, sample_id, row_id, pass_idx, task_type, regexp_replace(coalesce(response, ''), '^\\s+|\\s+$', '', 'g') AS r FROM (
            SELECT run_id, sample_id, row_id, unnest(range(len(inference_data.responses)))::int AS pass_idx, unnest(inference_data.responses) AS response FROM prediction_records) JOIN runs USING (run_id))))"""
# records with as many draws as the fullest of their run
_FULL = """complete AS (SELECT row_id, n AS draws FROM (SELECT row_id, len(inference_data.responses) AS n, max(len(inference_data.responses)) OVER (PARTITION BY run_id) AS m FROM prediction_records) WHERE n = m AND n > 0)"""


def _draws(spark, d):
    runs = table(spark, d, "runs").select("run_id", "task_type")
    r = table(spark, d, "prediction_records").select("run_id", "sample_id", "row_id", F.col("inference_data.responses").alias("responses"))
    x = V.draws_of(r, ["run_id", "sample_id", "row_id"]).join(runs, "run_id")
    return V.labelled_draws(x).drop("response", "task_type")


def _complete(spark, d):
    r = table(spark, d, "prediction_records").select("row_id", "run_id", "true_label", "inference_data", F.coalesce(F.size("inference_data.responses"), F.lit(0)).alias("draws"))
    return V.complete_of_run(r, "run_id", "draws")


_MAJ = f"""WITH {_DRAW}, c AS (SELECT row_id, label, count(*) AS votes, min(pass_idx) AS f FROM draw WHERE label IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, f) AS rk, sum(votes) OVER (PARTITION BY row_id) AS total FROM c)"""


@query(f"{_MAJ} SELECT row_id, label, votes, total::bigint AS total, round(votes::double / total, 6) AS confidence FROM w WHERE rk = 1")
def vot_majority(spark, d):
    x = V.majority(V.vote_counts(_draws(spark, d), ["row_id"]), ["row_id"])
    return x.withColumn("confidence", F.round("confidence", 6))


@query(f"{_MAJ} SELECT row_id, label, votes FROM c")
def vot_counts(spark, d):
    return V.vote_counts(_draws(spark, d), ["row_id"]).select("row_id", "label", "votes")


@query(f"WITH {_DRAW} SELECT row_id, string_agg(label || '=' || votes, ',' ORDER BY label) AS vote_counts FROM (SELECT row_id, label, count(*) AS votes FROM draw WHERE label IS NOT NULL GROUP BY ALL) GROUP BY row_id")
def vot_count_map(spark, d):
    m = V.as_map(V.vote_counts(_draws(spark, d), ["row_id"]), ["row_id"])
    return m.select("row_id", F.array_join(F.transform(F.array_sort(F.map_entries("vote_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("vote_counts"))


@query("SELECT s.row_id, r.k::int AS pass_idx FROM samples s, range(5) r(k)")
def vot_expand(spark, d):
    return V.expand_draws(table(spark, d, "samples").select("row_id"), 5)


@query(
    """WITH m AS (SELECT run_id, sample_id, unnest(map_keys(inference_data.vote_counts)) AS label, unnest(map_values(inference_data.vote_counts)) AS w, row_id FROM prediction_records),
    c AS (SELECT sample_id, label, sum(w)::bigint AS votes, min(row_id * 1000 + CASE WHEN label = '0' THEN 0 ELSE 1 END) AS f FROM m GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, f) AS rk, sum(votes) OVER (PARTITION BY sample_id) AS total FROM c)
    SELECT sample_id, label, votes, total::bigint AS total, round(votes::double / total, 6) AS confidence FROM w WHERE rk = 1"""
)
def vot_merge_runs(spark, d):
    """Votes of all runs of a sample together."""
    x = table(spark, d, "prediction_records").select("sample_id", "row_id", F.explode("inference_data.vote_counts").alias("label", "w"))
    x = x.withColumn("pass_idx", F.col("row_id") * 1000 + F.when(F.col("label") == "0", 0).otherwise(1))
    out = V.majority(V.vote_counts(x, ["sample_id"], weight="w"), ["sample_id"])
    return out.withColumn("confidence", F.round("confidence", 6))


_RUN = f"""WITH {_DRAW}, {_FULL}, v AS (SELECT row_id, pass_idx, vote FROM draw JOIN complete USING (row_id) WHERE vote IS NOT NULL),
    k AS (SELECT row_id, row_number() OVER w AS k, sum(vote) OVER w AS ones FROM v WINDOW w AS (PARTITION BY row_id ORDER BY pass_idx))"""


def _running(spark, d):
    """Running votes of the complete samples of binary tasks; k is a draw's position, as every draw has a vote."""
    v = _draws(spark, d).where("vote is not null").join(_complete(spark, d).select("row_id"), "row_id", "left_semi").select("row_id", "pass_idx", "vote")
    return V.running_votes(v, ["row_id"])


@query(f"{_RUN} SELECT row_id, k::int AS k, ones::bigint AS ones FROM k WHERE k <= 3")
def vot_first_k(spark, d):
    return _running(spark, d).where("k <= 3").select("row_id", "k", "ones")


@query(
    f"""{_RUN}, r(rule, t) AS (VALUES ('majority', 0.0::double), ('threshold', 0.33::double), ('threshold', 0.5::double), ('or', 0.0::double))
    SELECT row_id, k::int AS k, rule, t, CASE rule WHEN 'majority' THEN (ones::double / k > 0.5)::int WHEN 'threshold' THEN (ones::double / k >= t)::int ELSE (ones >= 1)::int END AS verdict FROM k, r"""
)
def vot_rules(spark, d):
    """Every rule for every k, from one running sum."""
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("t")) for r, t in (("majority", 0), ("threshold", 0.33), ("threshold", 0.5), ("or", 0)))))
    x = _running(spark, d).select("row_id", "k", "ones", rules.alias("r")).select("row_id", "k", "ones", "r.*")
    return x.select("row_id", "k", "rule", "t", V.by_rule(F.col("rule"), F.col("ones"), F.col("k"), F.col("t")).alias("verdict"))


@query(f"WITH {_FULL} SELECT row_id, draws::int AS draws FROM complete")
def vot_complete_only(spark, d):
    return _complete(spark, d).select("row_id", "draws")


@query(
    f"""{_MAJ} SELECT w.row_id, CASE WHEN r.binary_decision_mode = 'logprob_threshold' AND starts_with(r.task_type, 'binary') AND i.binary_label_confidence IS NOT NULL
        THEN CASE WHEN i.binary_label_confidence > 0.5 THEN '1' ELSE '0' END ELSE w.label END AS label
    FROM w JOIN (SELECT row_id, run_id, inference_data AS i FROM prediction_records) USING (row_id) JOIN runs r USING (run_id) WHERE rk = 1"""
)
def vot_logprob_decision(spark, d):
    m = V.majority(V.vote_counts(_draws(spark, d), ["row_id"]), ["row_id"]).select("row_id", "label")
    r = table(spark, d, "prediction_records").select("row_id", "run_id", F.col("inference_data.binary_label_confidence").alias("c")).join(table(spark, d, "runs"), "run_id")
    x = m.join(r, "row_id")
    return x.select("row_id", V.decide(F.col("label"), F.col("c"), F.col("binary_decision_mode"), F.lit(0.5), F.col("task_type").startswith("binary")).alias("label"))


@query("SELECT run_id, count(*) AS n FROM prediction_results GROUP BY run_id")
def vot_circuit_breaker(spark, d):
    """Rows per run, behind the assertion that at most a fifth of all rows failed."""
    return V.assert_error_rate(table(spark, d, "prediction_results")).groupBy("run_id").agg(F.count("*").alias("n"))


@query(
    "SELECT run_id, sample_id, sum(tokens_used)::bigint AS tokens, round(avg(processing_time), 6) AS mean_time, round(avg(confidence), 6) AS mean_confidence FROM prediction_results GROUP BY run_id, sample_id"
)
def agg_mean_over_draws(spark, d):
    return table(spark, d, "prediction_results").groupBy("run_id", "sample_id").agg(F.sum("tokens_used").alias("tokens"), F.round(F.avg("processing_time"), 6).alias("mean_time"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


_SPREAD = ("accuracy", "f1", "fnr")


@query(
    f"""WITH {_DRAW}, {_FULL}, x AS (SELECT draws, pass_idx, vote AS p, CASE WHEN true_label IN ('0', 'SAFE') THEN 0 WHEN true_label = '1' OR starts_with(true_label, 'CWE-') THEN 1 END AS t
        FROM draw JOIN complete USING (row_id) JOIN (SELECT row_id, true_label FROM prediction_records) USING (row_id) WHERE vote IS NOT NULL),
    c AS (SELECT draws, pass_idx, {cells('t IS NOT NULL')} FROM x WHERE t IS NOT NULL GROUP BY ALL), m AS (SELECT draws, {metric_sql(_SPREAD, digits=12)} FROM c)
    SELECT draws::int AS draws, count(*) AS passes, {', '.join(f'round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS std_{m}' for m in _SPREAD)} FROM m GROUP BY draws"""
)
def agg_pass_spread(spark, d):
    """Each draw position as a run of its own: mean and spread (population's divisor) of its metrics, for each number of draws per sample."""
    r = _complete(spark, d).select("row_id", "draws", M.binary_label(F.col("true_label")).alias("t")).where("t is not null")
    x = _draws(spark, d).where("vote is not null").join(r, "row_id")
    m = M.with_metrics(x.groupBy("draws", "pass_idx").agg(*M.confusion_counts(F.col("t"), F.col("vote"))), list(_SPREAD), digits=12)
    return m.groupBy("draws").agg(F.count("*").alias("passes"), *(f(n) for n in _SPREAD for f in (lambda n: F.round(F.avg(n), 6).alias(f"mean_{n}"), lambda n: F.round(F.stddev_pop(n), 6).alias(f"std_{n}"))))
