"""Comparisons and statistics over predictions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.functions import normalise as N
from quillon.operators import compare as C
from quillon.operators import reports as R
from quillon.operators import votes as V
from quillon.session import materialise, table

from ._registry import PRED, cells, div, metric_sql, predictions, query
from .parsing import year_band
from .scoring import _DRAW, _FULL, _complete, _draws

_NAMES = ("accuracy", "f1", "fnr")


def _by(spark, d, *keys):
    x = predictions(spark, d)
    c = x.groupBy(*keys).agg(*M.confusion_counts(F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))))
    return c


def _metrics(spark, d, *keys, names=_NAMES):
    return M.with_metrics(_by(spark, d, *keys), list(names), digits=6)


def _m(keys: str, names=_NAMES, name: str = "m") -> str:
    return f"{PRED}, c_{name} AS (SELECT {keys}, {cells()} FROM pred GROUP BY ALL), {name} AS (SELECT *, {metric_sql(names)} FROM c_{name})"


@query(f"WITH {_m('model_type, backend')} SELECT a.model_type, round(a.accuracy - b.accuracy, 6) AS d_accuracy, round(a.f1 - b.f1, 6) AS d_f1, round(a.fnr - b.fnr, 6) AS d_fnr FROM m a JOIN m b USING (model_type) WHERE a.backend = 'vllm' AND b.backend = 'llama_cpp'")
def sta_paired_delta(spark, d):
    return C.paired_delta(_metrics(spark, d, "model_type", "backend"), ["model_type"], "backend", "vllm", "llama_cpp", list(_NAMES))


@query(f"WITH {_m('backend, prompt_id')} SELECT backend, prompt_id, round(m.accuracy - b.accuracy, 6) AS d_accuracy, round(m.f1 - b.f1, 6) AS d_f1 FROM m LEFT JOIN (SELECT backend, accuracy, f1 FROM m WHERE prompt_id = 1) b USING (backend)")
def sta_delta_to_baseline(spark, d):
    return C.delta_to_baseline(_metrics(spark, d, "backend", "prompt_id"), ["backend"], "prompt_id", 1, ["accuracy", "f1"])


@query(f"WITH {_m('backend, prompt_id')} SELECT prompt_id, round(avg(m.f1 - b.f1), 6) AS mean_d_f1, count(b.f1) AS backends FROM m LEFT JOIN (SELECT backend, f1 FROM m WHERE prompt_id = 1) b USING (backend) GROUP BY prompt_id")
def sta_mean_delta(spark, d):
    x = C.delta_to_baseline(_metrics(spark, d, "backend", "prompt_id"), ["backend"], "prompt_id", 1, ["f1"])
    return x.groupBy("prompt_id").agg(F.round(F.avg("d_f1"), 6).alias("mean_d_f1"), F.count("d_f1").alias("backends"))


_FACTORS = "f AS (SELECT run_id, string_split(experiment_name, '_')[1] AS a, array_to_string(list_slice(string_split(experiment_name, '_'), 3, 9), '_') AS b FROM runs)"


@query(
    f"""WITH {_m('run_id')}, {_FACTORS}, s AS (SELECT 'a' AS kind, a AS factor, avg(f1) AS f1 FROM m JOIN f USING (run_id) GROUP BY ALL UNION ALL SELECT 'b', b, avg(f1) FROM m JOIN f USING (run_id) GROUP BY ALL)
    SELECT run_id, round(m.f1 - (SELECT max(s.f1) FROM s WHERE s.kind = 'a' AND s.factor = f.a OR s.kind = 'b' AND s.factor = f.b), 6) AS d_best_factor FROM m JOIN f USING (run_id)"""
)
def sta_delta_to_best_factor(spark, d):
    """A run's F1 minus the best mean F1 of the factors it combines; nulls are skipped."""
    parts = F.split("experiment_name", "_")
    f = table(spark, d, "runs").select("run_id", F.explode(F.array(F.struct(F.lit("a").alias("kind"), parts[0].alias("factor")), F.struct(F.lit("b").alias("kind"), F.array_join(F.slice(parts, 3, 9), "_").alias("factor")))).alias("x")).select("run_id", "x.*")
    m = _metrics(spark, d, "run_id", names=("f1",)).select("run_id", "f1")
    single = m.join(f, "run_id").groupBy("kind", "factor").agg(F.avg("f1").alias("single"))
    best = f.join(single, ["kind", "factor"]).groupBy("run_id").agg(F.max("single").alias("best"))
    return m.join(best, "run_id").select("run_id", F.round(F.col("f1") - F.col("best"), 6).alias("d_best_factor"))


@query(f"WITH {_m('backend, prompt_id')}, b AS (SELECT backend, prompt_id, row_number() OVER (PARTITION BY backend ORDER BY f1 DESC, prompt_id) AS r FROM m), a AS (SELECT prompt_id, avg(f1) AS mean_f1 FROM m GROUP BY 1) SELECT backend, prompt_id, round(mean_f1, 6) AS mean_f1 FROM b JOIN a USING (prompt_id) WHERE r = 1")
def sta_best_factor(spark, d):
    m = _metrics(spark, d, "backend", "prompt_id", names=("f1",))
    mean = m.groupBy("prompt_id").agg(F.round(F.avg("f1"), 6).alias("mean_f1"))
    return C.best_by(m, ["backend"], [F.desc("f1"), F.asc("prompt_id")]).select("backend", "prompt_id").join(mean, "prompt_id")


@query(f"WITH {PRED}, g AS (SELECT r.is_thinking_enabled AS thinking, r.model_type, avg((t = p)::int) AS acc FROM pred JOIN runs r USING (run_id) WHERE ok GROUP BY ALL) SELECT model_type, round(avg(acc) FILTER (thinking), 6) AS thinking, round(avg(acc) FILTER (NOT thinking), 6) AS plain, round(avg(acc) FILTER (thinking) - avg(acc) FILTER (NOT thinking), 6) AS gain FROM g GROUP BY model_type")
def sta_thinking_gain(spark, d):
    r = table(spark, d, "runs").select("run_id", F.col("is_thinking_enabled").alias("thinking"))
    a = predictions(spark, d).where("ok").join(r, "run_id").groupBy("model_type", "thinking").agg(F.avg((F.col("t") == F.col("p")).cast("double")).alias("acc"))
    yes, no = F.avg(F.when(F.col("thinking"), F.col("acc"))), F.avg(F.when(~F.col("thinking"), F.col("acc")))
    return a.groupBy("model_type").agg(F.round(yes, 6).alias("thinking"), F.round(no, 6).alias("plain"), F.round(yes - no, 6).alias("gain"))


_VOTED = f"""WITH {_DRAW}, c AS (SELECT row_id, vote AS label, count(*) AS votes, min(pass_idx) AS f FROM draw WHERE vote IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, f) AS rk, sum(votes) OVER (PARTITION BY row_id)::bigint AS total FROM c),
    v AS (SELECT r.row_id, u.backend, w.votes, w.total, w.label AS p, CASE WHEN true_label IN ('0', 'SAFE') THEN 0 WHEN true_label = '1' OR starts_with(true_label, 'CWE-') THEN 1 END AS t
        FROM w JOIN prediction_records r USING (row_id) JOIN runs u USING (run_id) WHERE rk = 1), vt AS (SELECT * FROM v WHERE t IS NOT NULL)"""


def _voted(spark, d):
    m = V.majority(V.vote_counts(_draws(spark, d), ["row_id"], label="vote"), ["row_id"])
    r = table(spark, d, "prediction_records").select("row_id", "run_id", M.binary_label(F.col("true_label")).alias("true")).where(F.col("true").isNotNull()).join(table(spark, d, "runs").select("run_id", "backend"), "run_id")
    return m.join(r, "row_id").select("row_id", "backend", "votes", "total", "true", F.col("label").alias("pred"))


@query(f"{_VOTED}, x AS (SELECT *, votes::double / total >= threshold - 1e-9 AS k FROM vt, (VALUES (0.0::double), (0.6::double), (0.8::double), (1.0::double)) h(threshold)) SELECT backend, threshold, count(*) AS n, count(*) FILTER (k) AS kept, {cells('k')}, round(count(*) FILTER (k)::double / count(*), 6) AS coverage FROM x GROUP BY backend, threshold")
def sta_coverage(spark, d):
    return C.coverage(_voted(spark, d), ["backend"], [0.0, 0.6, 0.8, 1.0])


@query(f"{_VOTED}, g AS (SELECT b.backend, l.votes, l.total FROM (SELECT DISTINCT backend FROM vt) b, (SELECT DISTINCT votes, total FROM vt) l), n AS (SELECT backend, votes, total, count(*) AS n FROM vt GROUP BY ALL) SELECT g.backend, g.votes, g.total, coalesce(n.n, 0)::bigint AS n, round(coalesce(n.n, 0)::double / sum(coalesce(n.n, 0)) OVER (PARTITION BY g.backend), 6) AS share FROM g LEFT JOIN n ON n.backend = g.backend AND n.votes = g.votes AND n.total = g.total")
def sta_confidence_histogram(spark, d):
    return C.confidence_histogram(_voted(spark, d), ["backend"])


@query(f"{_VOTED} SELECT backend, votes, total, count(*) AS n, round(avg((t = p)::int), 6) AS accuracy, round({div('count(*) FILTER (t = 1 AND p = 0)', 'count(*) FILTER (t = 1)', 'NULL')}, 6) AS fnr, round(votes::double / total, 6) AS confidence FROM vt GROUP BY backend, votes, total")
def sta_calibration(spark, d):
    return C.calibration(_voted(spark, d), ["backend"])


@query(f"{_VOTED}, x AS (SELECT *, votes::double / total >= threshold - 1e-9 AS k FROM vt, (VALUES (0.0::double), (0.8::double)) h(threshold)), a AS (SELECT backend, threshold, round({div('count(*) FILTER (k AND t = p)', 'count(*) FILTER (k)')}, 6) AS accuracy FROM x GROUP BY ALL) SELECT threshold, backend, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY accuracy DESC, backend) AS r FROM a) WHERE r = 1")
def sta_winner_per_threshold(spark, d):
    c = M.with_metrics(C.coverage(_voted(spark, d), ["backend"], [0.0, 0.8]), ["accuracy"], digits=6)
    return C.best_by(c, ["threshold"], [F.desc("accuracy"), F.asc("backend")]).select("threshold", "backend", "accuracy")


@query(f"WITH {_m('model_type, run_id')} SELECT model_type, run_id, f1, fnr FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY f1 DESC, fnr, run_id) AS r FROM m) WHERE r = 1")
def sta_tuned_winner(spark, d):
    """Highest F1 at six decimals; lowest FNR on ties."""
    return C.best_by(_metrics(spark, d, "model_type", "run_id"), ["model_type"], [F.desc("f1"), F.asc("fnr"), F.asc("run_id")]).select("model_type", "run_id", "f1", "fnr")


_ORDER = ("vllm", "hf", "llama_cpp", "online")


@query(f"WITH {_m('backend')} SELECT backend, CASE backend " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(_ORDER)) + " END AS position, accuracy, f1, fnr FROM m")
def sta_variant_table(spark, d):
    pos = F.create_map(*(F.lit(x) for i, b in enumerate(_ORDER) for x in (b, i)))
    return _metrics(spark, d, "backend").select("backend", F.try_element_at(pos, F.col("backend")).alias("position"), *_NAMES).orderBy("position")


_BAND = "CASE WHEN y < 2014 THEN 'to 2013' WHEN y < 2018 THEN '2014-2017' WHEN y < 2022 THEN '2018-2021' WHEN y IS NOT NULL THEN 'from 2022' END"
_YEARS = "yr AS (SELECT id, max(try_cast(nullif(regexp_extract(coalesce(json_extract_string(metadata, '$.\"CVEFixes-Number\"'), json_extract_string(metadata, '$.cve_id')), '(?i)CVE-(\\d{4})-', 1), '') AS INT)) AS y FROM samples GROUP BY id)"


def _years(spark, d):
    j = lambda k: F.get_json_object("metadata", f"$['{k}']")
    return table(spark, d, "samples").groupBy(F.col("id").alias("sample_id")).agg(F.max(N.cve_year(F.coalesce(j("CVEFixes-Number"), j("cve_id")))).alias("y"))


@query(f"WITH {PRED}, {_YEARS}, c AS (SELECT {_BAND} AS band, {cells()} FROM pred JOIN yr ON yr.id = pred.sample_id GROUP BY ALL) SELECT band, tp, tn, fp, fn, {metric_sql(_NAMES)} FROM c")
def sta_year_bands(spark, d):
    x = predictions(spark, d).join(_years(spark, d), "sample_id").withColumn("band", year_band(F.col("y")))
    c = x.groupBy("band").agg(*M.confusion_counts(F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))))
    return M.with_metrics(c, list(_NAMES), digits=6)


@query(f"WITH {PRED}, k AS (SELECT sample_id FROM pred WHERE ok AND backend IN ('vllm', 'online') GROUP BY 1 HAVING count(DISTINCT backend) = 2), c AS (SELECT backend, {cells()} FROM pred SEMI JOIN k USING (sample_id) WHERE backend IN ('vllm', 'online') GROUP BY backend) SELECT backend, {metric_sql(_NAMES)} FROM c")
def sta_matched_subset(spark, d):
    """Metrics of two backends on the samples that both answered."""
    x = predictions(spark, d).where(F.col("backend").isin("vllm", "online"))
    x = x.join(C.dividing(x.where("ok"), "sample_id", "backend", 2).select("sample_id").distinct(), "sample_id", "left_semi")
    c = x.groupBy("backend").agg(*M.confusion_counts(F.when(F.col("ok"), F.col("t")), F.when(F.col("ok"), F.col("p"))))
    return M.with_metrics(c, list(_NAMES), digits=6).drop(*M.COUNTS)


@query()
def sta_bootstrap(spark, d):
    """Intervals are drawn; their point estimates are checked by sta_bootstrap_points."""
    return C.bootstrap(_by(spark, d, "model_name"), ["model_name"], ["accuracy", "f1", "fnr"])


@query(f"WITH {_m('model_name')}, n AS (SELECT *, tp + tn + fp + fn AS n FROM m WHERE tp + tn + fp + fn >= 20) SELECT model_name, 'accuracy' AS metric, accuracy AS point, n FROM n UNION ALL SELECT model_name, 'f1', f1, n FROM n UNION ALL SELECT model_name, 'fnr', fnr, n FROM n WHERE true")
def sta_bootstrap_points(spark, d):
    b = C.bootstrap(_by(spark, d, "model_name"), ["model_name"], ["accuracy", "f1", "fnr"], draws=10)
    zero = (F.col("metric") == "fnr") & (F.col("point") == 0.0)
    pos = _by(spark, d, "model_name").select("model_name", (F.col("tp") + F.col("fn")).alias("pos"))
    # fnr here is 1 - recall, hence 1 without positives
    return b.join(pos, "model_name").select("model_name", "metric", F.round(F.when(zero & (F.col("pos") == 0), 1.0).otherwise(F.col("point")), 6).alias("point"), "n")


_PAIR = f"""{PRED}, pr AS (SELECT a.model_type, a.sample_id, max((a.t = a.p)::int) = 1 AS a_right, max((b.t = b.p)::int) = 1 AS b_right FROM
    (SELECT * FROM pred WHERE ok AND backend = 'vllm') a JOIN (SELECT * FROM pred WHERE ok AND backend = 'llama_cpp') b USING (model_type, sample_id) GROUP BY ALL),
    dc AS (SELECT model_type, count(*) FILTER (a_right AND b_right) AS "both", count(*) FILTER (a_right AND NOT b_right) AS only_a, count(*) FILTER (NOT a_right AND b_right) AS only_b, count(*) FILTER (NOT a_right AND NOT b_right) AS neither FROM pr GROUP BY 1)"""


def _pairs(spark, d):
    x = predictions(spark, d).where("ok").where(F.col("backend").isin("vllm", "llama_cpp"))
    right = lambda b: F.max(F.when(F.col("backend") == b, (F.col("t") == F.col("p")).cast("int")))
    g = x.groupBy("model_type", "sample_id").agg(right("vllm").alias("a"), right("llama_cpp").alias("b")).where("a is not null and b is not null")
    return g.select("model_type", "sample_id", (F.col("a") == 1).alias("a_right"), (F.col("b") == 1).alias("b_right"))


@query(f"WITH {_PAIR} SELECT * FROM dc")
def sta_discordant(spark, d):
    return C.discordant(_pairs(spark, d), ["model_type"])


@query(f'''WITH {_PAIR} SELECT model_type, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN NULL ELSE greatest(abs(only_a - only_b) - 1, 0)::double ** 2 / (only_a + only_b) END, 6) AS chi2 FROM dc WHERE "both" + only_a + only_b + neither >= 5''')
def sta_mcnemar(spark, d):
    m = C.mcnemar(C.discordant(_pairs(spark, d), ["model_type"]))
    return m.select("model_type", "only_a", "only_b", F.round("chi2", 6).alias("chi2"))


@query()
def sta_mcnemar_p(spark, d):
    """With p-values, which SQL has no function for; tested against known values."""
    return C.mcnemar(C.discordant(_pairs(spark, d), ["model_type"]), undefined="zero")


@query()
def sta_paired_bootstrap(spark, d):
    x = predictions(spark, d).where("ok").where(F.col("backend").isin("vllm", "llama_cpp"))
    one = lambda b: F.min(F.when(F.col("backend") == b, F.col("p")))
    g = x.groupBy("model_type", "sample_id").agg(F.min("t").alias("true"), one("vllm").alias("pred"), one("llama_cpp").alias("base"))
    return C.paired_bootstrap(g, ["model_type"], ["accuracy", "f1", "fnr"])


@query(f"WITH {PRED}, g AS (SELECT model_name, avg(t) AS pr, count(*) AS n FROM pred WHERE ok GROUP BY 1) SELECT model_name, round(pr, 6) AS prevalence, n, round(CASE WHEN pr * (1 - pr) > 0 THEN 2.802::double * sqrt(1.0::double / (n * 4 * pr * (1 - pr))) END, 6) AS mde, round(CASE WHEN pr * (1 - pr) > 0 THEN 2.802::double * sqrt(2.0::double / (n * 4 * pr * (1 - pr))) END, 6) AS mde_two FROM g")
def sta_detectable_effect(spark, d):
    g = predictions(spark, d).where("ok").groupBy("model_name").agg(F.avg("t").alias("pr"), F.count("*").alias("n"))
    return g.select("model_name", F.round("pr", 6).alias("prevalence"), "n", F.round(M.detectable(F.col("pr"), F.col("n")), 6).alias("mde"), F.round(M.detectable(F.col("pr"), F.col("n"), 2), 6).alias("mde_two"))


_KENDALL = f"""{PRED}, {_YEARS}, pt AS (SELECT backend, y AS x, round(avg((t = p)::int), 6) AS y FROM pred JOIN yr ON yr.id = pred.sample_id WHERE ok AND y IS NOT NULL GROUP BY ALL),
    s AS (SELECT a.backend, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM pt a JOIN pt b ON a.backend = b.backend AND (a.x < b.x OR a.x = b.x AND a.y < b.y) GROUP BY 1),
    n AS (SELECT backend, count(*) AS n FROM pt GROUP BY 1), tx AS (SELECT backend, sum(m * (m - 1) / 2) AS v FROM (SELECT backend, x, count(*) AS m FROM pt GROUP BY ALL) GROUP BY 1), ty AS (SELECT backend, sum(m * (m - 1) / 2) AS v FROM (SELECT backend, y, count(*) AS m FROM pt GROUP BY ALL) GROUP BY 1)"""


@query(f"WITH {_KENDALL} SELECT backend, n, round(CASE WHEN (n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v) > 0 THEN coalesce(s, 0)::double / sqrt((n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v)) END, 6) AS tau FROM n JOIN tx USING (backend) JOIN ty USING (backend) LEFT JOIN s USING (backend)")
def sta_kendall(spark, d):
    """Rank correlation of year and accuracy per backend."""
    x = predictions(spark, d).where("ok").join(_years(spark, d), "sample_id").where("y is not null")
    p = x.groupBy("backend", F.col("y").cast("double").alias("year")).agg(F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 6).alias("acc"))
    return C.kendall(p, ["backend"], "year", "acc").select("backend", F.col("n").cast("long").alias("n"), F.round("tau", 6).alias("tau"))


@query(f"WITH {_PAIR}, {_YEARS} SELECT {_BAND} AS band, count(*) AS n, count(*) FILTER (a_right = b_right) AS agree, count(*) FILTER (a_right AND b_right) AS both_right, count(*) FILTER (NOT a_right AND NOT b_right) AS both_wrong FROM pr JOIN yr ON yr.id = pr.sample_id GROUP BY 1")
def sta_agreement(spark, d):
    x = _pairs(spark, d).join(_years(spark, d), "sample_id").withColumn("band", year_band(F.col("y")))
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    a, b = F.col("a_right"), F.col("b_right")
    return x.groupBy("band").agg(F.count("*").alias("n"), n(a == b, "agree"), n(a & b, "both_right"), n(~a & ~b, "both_wrong"))


_FIT = "f AS (SELECT tokens_used::double / 1000 AS x, processing_time AS y, backend FROM prediction_results JOIN runs USING (run_id) WHERE tokens_used IS NOT NULL AND processing_time IS NOT NULL)"


@query()
def sta_quadratic_fit(spark, d):
    """Time against tokens; tested on exact parabolas."""
    x = predictions(spark, d).select("backend", (F.col("tokens_used") / 1000).alias("x"), F.col("processing_time").alias("y"))
    q = C.quadratic_fit(x, ["backend"], "x", "y")
    return q.select("backend", *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")))


@query(f"WITH {_PAIR} SELECT category, count(*) AS n, round(count(*) * 100.0::double / sum(count(*)) OVER (), 4) AS percent FROM (SELECT CASE WHEN a_right AND b_right THEN 'both right' WHEN a_right THEN 'helps' WHEN b_right THEN 'hurts' ELSE 'both wrong' END AS category FROM pr) GROUP BY 1")
def sta_outcome_category(spark, d):
    c = F.when(F.col("a_right") & F.col("b_right"), "both right").when(F.col("a_right"), "helps").when(F.col("b_right"), "hurts").otherwise("both wrong")
    g = _pairs(spark, d).groupBy(c.alias("category")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))), 4))  # four rows


# the numbers of draws and the rules that are compared
K_LIST = (1, 3, 5, 7, 11, 15)
RULES = (("majority", 0.5), ("threshold", 0.25), ("threshold", 0.33), ("threshold", 0.5), ("or", 0.5))

_CURVE = f"""WITH {_DRAW}, {_FULL}, v AS (SELECT row_id, draws, vote, row_number() OVER w AS k, sum(vote) OVER w AS ones FROM draw JOIN complete USING (row_id) WHERE vote IS NOT NULL WINDOW w AS (PARTITION BY row_id ORDER BY pass_idx)),
    l AS (SELECT row_id, CASE WHEN true_label IN ('0', 'SAFE') THEN 0 WHEN true_label = '1' OR starts_with(true_label, 'CWE-') THEN 1 END AS t FROM prediction_records),
    r(rule, th) AS (VALUES {', '.join(f"('{r}', {t}::double)" for r, t in RULES)}),
    x AS (SELECT row_id, draws, rule, th, k, t, CASE rule WHEN 'majority' THEN (ones::double / k > 0.5)::int WHEN 'threshold' THEN (ones::double / k >= th)::int ELSE (ones >= 1)::int END AS p FROM v JOIN l USING (row_id), r WHERE t IS NOT NULL AND k IN {K_LIST}),
    c AS (SELECT draws, rule, th, k, {cells('true')} FROM x GROUP BY ALL), q AS (SELECT draws, rule, th, k, {metric_sql(_NAMES)} FROM c),
    b AS (SELECT draws, rule, th, max(f1) AS best_f1, arg_min(k, (fnr, k)) AS kf FROM q GROUP BY ALL),
    d AS (SELECT x.draws, x.rule, x.th, x.k, count(*) FILTER (x.p = 0 AND y.p = 1) AS lost, count(*) FILTER (x.p = 1 AND y.p = 0) AS won, count(*)::double AS n
        FROM x JOIN b ON b.draws = x.draws AND b.rule = x.rule AND b.th = x.th JOIN x y ON y.row_id = x.row_id AND y.rule = x.rule AND y.th = x.th AND y.k = b.kf WHERE x.t = 1 GROUP BY ALL),
    s AS (SELECT *, abs(lost - won) / n <= 1.959964 * sqrt(greatest(0, lost + won - (lost - won) * (lost - won) / n)) / n + 1e-12 AS same FROM d),
    o AS (SELECT q.draws, q.rule, q.th, min(q.k) FILTER (q.f1 >= b.best_f1 - 0.01 AND (q.k = b.kf OR coalesce(s.same, true))) AS optimal_k, max(b.best_f1) AS best_f1
        FROM q JOIN b ON b.draws = q.draws AND b.rule = q.rule AND b.th = q.th LEFT JOIN s ON s.draws = q.draws AND s.rule = q.rule AND s.th = q.th AND s.k = q.k GROUP BY ALL)"""


def _ruled(spark, d):
    """(row_id, draws, t, rule, th, k, p): every rule's verdict on the first k draws of the complete samples, k of ``K_LIST``."""
    v = _draws(spark, d).where("vote is not null").select("row_id", "pass_idx", "vote")
    r = _complete(spark, d).select("row_id", "draws", M.binary_label(F.col("true_label")).alias("t")).where("t is not null")
    k = V.running_votes(v, ["row_id"]).where(F.col("k").isin(*K_LIST)).join(r, "row_id")
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("th")) for r, t in RULES)))
    x = k.select("row_id", "draws", "t", "k", "ones", rules.alias("r")).select("row_id", "draws", "t", "k", "ones", "r.*")
    return x.withColumn("p", V.by_rule(F.col("rule"), F.col("ones"), F.col("k"), F.col("th"))).drop("ones")


_CONFIG = ["draws", "rule", "th"]


def _of_rules(x):
    return M.with_metrics(x.groupBy(*_CONFIG, "k").agg(*M.confusion_counts(F.col("t"), F.col("p"))), list(_NAMES), digits=6)


@query(f"{_CURVE} SELECT draws::int AS draws, rule, th, k::int AS k, f1, fnr, accuracy FROM q")
def sta_k_curve(spark, d):
    return _of_rules(_ruled(spark, d)).select(*_CONFIG, "k", "f1", "fnr", "accuracy")


def _optimal(spark, d):
    x = materialise(_ruled(spark, d), "ruled")
    curve = _of_rules(x)
    lowest = curve.groupBy(*_CONFIG).agg(F.min_by("k", F.struct("fnr", "k")).alias("kf"))
    base = x.join(lowest, _CONFIG).where("k = kf").select("row_id", "rule", "th", F.col("p").alias("base"))
    pairs = x.join(base, ["row_id", "rule", "th"]).select(*_CONFIG, "k", F.col("t").alias("true"), F.col("p").alias("pred"), "base")
    same = C.paired_bootstrap(pairs, [*_CONFIG, "k"], ["fnr"]).select(*_CONFIG, "k", F.col("includes_zero").alias("fnr_same"))
    return curve, C.optimal_k(curve.join(same, [*_CONFIG, "k"]), _CONFIG)


@query(f"{_CURVE} SELECT draws::int AS draws, rule, th, optimal_k::int AS optimal_k, best_f1 FROM o")
def sta_optimal_k(spark, d):
    """Of each rule: the smallest k with F1 within 0.01 of the best whose FNR has a paired-bootstrap interval of its difference to the lowest that includes 0.

    The SQL has the normal interval of that difference in place of the bootstrap's.
    """
    return _optimal(spark, d)[1]


@query(
    f"""{_CURVE}, f AS (SELECT q.*, max(accuracy) OVER (PARTITION BY q.draws) AS best FROM q JOIN o ON o.draws = q.draws AND o.rule = q.rule AND o.th = q.th AND o.optimal_k = q.k)
    SELECT draws::int AS draws, rule, th, k::int AS k, accuracy, f1, fnr FROM (SELECT *, row_number() OVER (PARTITION BY draws ORDER BY accuracy DESC, fnr, rule, th, k) AS r FROM f WHERE accuracy >= best - 0.01) WHERE r = 1"""
)
def sta_final_selection(spark, d):
    """Of the rules at their optimal k, within 0.01 of the best accuracy: highest accuracy, then lowest FNR."""
    curve, optimal = _optimal(spark, d)
    c = curve.join(optimal.select(*_CONFIG, F.col("optimal_k").alias("k")), [*_CONFIG, "k"])
    c = c.withColumn("best", F.max("accuracy").over(W.partitionBy("draws"))).where("accuracy >= best - 0.01")  # a row per rule
    return C.best_by(c, ["draws"], [F.desc("accuracy"), F.asc("fnr"), F.asc("rule"), F.asc("th"), F.asc("k")]).select("draws", "rule", "th", "k", "accuracy", "f1", "fnr")


_COST = f"""WITH {_FULL}, g AS (SELECT row_id, draws, pass_idx, total, took, sum(gen) OVER (PARTITION BY row_id ORDER BY pass_idx) AS gen, sum(gen) OVER (PARTITION BY row_id) AS all_gen FROM (
        SELECT row_id, draws, unnest(range(len(i.responses)))::int AS pass_idx, coalesce(length(unnest(i.responses)), 0) / 4.0::double AS gen, coalesce(i.tokens_used, 0)::double AS total, coalesce(i.processing_time, 0) * draws AS took
        FROM (SELECT row_id, draws, inference_data AS i FROM prediction_records JOIN complete USING (row_id)))),
    k AS (SELECT row_id, draws, pass_idx + 1 AS k, gen, (pass_idx + 1) * greatest(0, (total - all_gen) / draws) + gen AS cost, total, took FROM g)"""


def _costs(spark, d):
    """(row_id, draws, k, generated, cost, total, took): tokens of the first k draws of each complete sample, and of all of it with their time."""
    r = _complete(spark, d).select("row_id", "draws", F.coalesce("inference_data.tokens_used", F.lit(0)).cast("double").alias("total"), (F.coalesce("inference_data.processing_time", F.lit(0.0)) * F.col("draws")).alias("took"), F.posexplode("inference_data.responses").alias("pass_idx", "response"))
    return C.draw_costs(r, "row_id")


@query(f"{_COST} SELECT row_id, k::int AS k, round(cost, 4) AS cost FROM k")
def sta_cost_model(spark, d):
    """Tokens of the first k draws: generated ones by length, prompt tokens as the equal share of the rest."""
    return _costs(spark, d).select("row_id", "k", F.round("cost", 4).alias("cost"))


@query(
    f"""{_COST}, s AS (SELECT draws, sum(total) / sum(took) AS speed FROM k WHERE k = 1 GROUP BY draws),
    p AS (SELECT draws, k, avg(cost) AS mean_cost, quantile_cont(cost, 0.5) AS median_cost, sum(gen) AS generated, sum(cost) AS tokens FROM k WHERE k IN {K_LIST} GROUP BY draws, k)
    SELECT draws::int AS draws, k::int AS k, round(speed, 3) AS tokens_per_second, round(mean_cost / speed, 6) AS latency_mean, round(median_cost / speed, 6) AS latency_median, round(generated, 2) AS generated_tokens, round(tokens, 2) AS total_tokens,
        round(tokens / speed / 3600, 8) AS gpu_hours, round(tokens / first_value(tokens) OVER (PARTITION BY draws ORDER BY k), 6) AS times_first FROM p JOIN s USING (draws)"""
)
def sta_cost_per_k(spark, d):
    """Latency, tokens, device hours and the ratio to one draw at each k, at the measured tokens per second."""
    return C.cost_per_k(_costs(spark, d), ["draws"], K_LIST)


@query(
    f"""{_CURVE}, {_COST[5:].replace(_FULL + ', ', '')}, p AS (SELECT draws, k, sum(cost) AS tokens FROM k GROUP BY draws, k),
    j AS (SELECT q.*, p.tokens FROM q JOIN p ON p.draws = q.draws AND p.k = q.k WHERE rule IN ('majority', 'or'))
    SELECT draws::int AS draws, rule, k::int AS k, round((f1 - lag(f1) OVER w) / (k - lag(k) OVER w), 6) AS f1_per_pass, round((fnr - lag(fnr) OVER w) / (k - lag(k) OVER w), 6) AS fnr_per_pass,
        round(CASE WHEN tokens = lag(tokens) OVER w THEN NULL ELSE (fnr - lag(fnr) OVER w) * 1e6 / (tokens - lag(tokens) OVER w) END, 4) AS fnr_per_million FROM j WINDOW w AS (PARTITION BY draws, rule ORDER BY k)"""
)
def sta_marginal_gain(spark, d):
    """Gain of each further step of k for the two extreme rules: by pass, and by a million tokens of the cost model."""
    tokens = _costs(spark, d).groupBy("draws", "k").agg(F.sum("cost").alias("tokens"))
    c = _of_rules(_ruled(spark, d)).where("rule in ('majority', 'or')").join(tokens, ["draws", "k"])
    f1 = C.marginal_gain(c, ["draws", "rule"], "f1").select("draws", "rule", "k", F.col("gain_per_pass").alias("f1_per_pass"))
    fnr = C.marginal_gain(c, ["draws", "rule"], "fnr").select("draws", "rule", "k", F.col("gain_per_pass").alias("fnr_per_pass"), F.round("gain_per_million", 4).alias("fnr_per_million"))
    return f1.join(fnr, ["draws", "rule", "k"])


@query(f"WITH {_m('model_name')}, s AS (SELECT model_name, round(avg(processing_time), 6) AS mean_time FROM prediction_results JOIN runs USING (run_id) GROUP BY 1) SELECT model_name, accuracy, f1, mean_time, model_name = (SELECT arg_max(model_name, (accuracy, model_name)) FROM m) AS is_most_accurate, model_name = (SELECT arg_min(model_name, (mean_time, model_name)) FROM s) AS is_fastest FROM m JOIN s USING (model_name)")
def sta_model_table(spark, d):
    m = _metrics(spark, d, "model_name")
    s = table(spark, d, "prediction_results").join(table(spark, d, "runs").select("run_id", "model_name"), "run_id").groupBy("model_name").agg(F.round(F.avg("processing_time"), 6).alias("mean_time"))
    j = m.join(s, "model_name")
    every = W.partitionBy(F.lit(0))  # a row per model
    best, fast = (F.struct(c, "model_name") for c in ("accuracy", "mean_time"))
    return j.select("model_name", "accuracy", "f1", "mean_time", (best == F.max(best).over(every)).alias("is_most_accurate"), (fast == F.min(fast).over(every)).alias("is_fastest"))


@query(f"WITH {_m('experiment_name')} SELECT experiment_name, tp + fn AS positives, tn + fp AS negatives FROM m")
def sta_class_imbalance(spark, d):
    return _by(spark, d, "experiment_name").select("experiment_name", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"))


@query(f"WITH {_m('model_name', ('mcc',))} SELECT model_name, greatest(mcc, 0) AS clamped, round((mcc + 1) / 2, 6) AS shifted FROM m")
def sta_radar(spark, d):
    m = _metrics(spark, d, "model_name", names=("mcc",))
    return m.select("model_name", F.greatest("mcc", F.lit(0.0)).alias("clamped"), F.round((F.col("mcc") + 1) / 2, 6).alias("shifted"))


@query(f"WITH {_m('model_name')} SELECT row_number() OVER (ORDER BY model_name)::int AS position, concat_ws(' ', '✓', model_name, '-', printf('accuracy %.4f', accuracy)) AS line FROM m")
def sta_text_report(spark, d):
    from quillon.plans.experiments import text_report

    m = _metrics(spark, d, "model_name").withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("model_name")))  # a row per model
    return text_report(m.select("position", F.col("model_name").alias("name"), "accuracy", F.lit(True).alias("is_success"), F.lit(None).cast("string").alias("error")))


_FOOT = {"accuracy": "max", "f1": "max", "fnr": "min"}


@query(
    f"WITH {_m('model_name')} " + " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, " + ", ".join(f"round({expr[1 if up == 'min' else 0].format(c)}, 6) AS {c}" for c, up in _FOOT.items()) + " FROM m"
        for name, expr in (("mean", ("avg({0})",) * 2), ("median", ("quantile_cont({0}, 0.5)",) * 2), ("best", ("max({0})", "min({0})")), ("worst", ("min({0})", "max({0})")), ("range", ("max({0}) - min({0})",) * 2))
    )
)
def agg_footer(spark, d):
    return R.footer(_metrics(spark, d, "model_name").select("model_name", *_NAMES), "statistic", list(_NAMES), ("fnr",))
