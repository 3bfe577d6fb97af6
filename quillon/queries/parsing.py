"""Answers to labels, and the row-level normalisers, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.functions import parse as P
from quillon.functions.text import last_match, strip
from quillon.operators import datasets as D
from quillon.plans import prompts as T
from quillon.session import table
from quillon.sources import samples as S

from ._registry import PRED, predictions, query

# ---- the parsers in SQL ----

_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BARE = "upper(trim(" + _S + ", '\"''`[](){{}}.,:; '))"


def _strip(x: str) -> str:
    return _S.format(x)


def _bare(x: str) -> str:
    return _BARE.format(x)


def _word(x: str) -> str:
    q = lambda ws: ", ".join(f"'{w}'" for w in ws)
    return f"(CASE WHEN {_bare(x)} IN ({q(P.POSITIVE)}) THEN 1 WHEN {_bare(x)} IN ({q(P.NEGATIVE)}) THEN 0 END)"


def _last(x: str, pattern: str, options: str, group: int = 1) -> str:
    return f"regexp_extract_all({x}, '{pattern}', {group}, '{options}')[-1]"


_PREFIX = r"^(?:FINAL\s*ANSWER|ANSWER|VERDICT|DECISION)\s*[:\-]?\s*(.+?)\s*$"
_FA = r"\[\[FINAL_ANSWER:\s*(.*?)\s*\]\]"


def _payload(x: str) -> str:
    return f"nullif(regexp_extract({x}, '{_PREFIX}', 1, 'i'), '')"


def _cand(x: str) -> str:
    return f"coalesce({_payload(x)}, {x})"


def _tail(x: str, one) -> str:
    lines = rf"list_filter(list_transform(regexp_split_to_array({x}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda y: {_strip('y')}), lambda y: y <> '')"
    return f"list_filter(list_transform(list_slice(list_reverse({lines}), 1, 12), lambda z: {one('z')}), lambda z: z IS NOT NULL)[1]"


def _cwe(x: str) -> str:
    return rf"nullif(upper(regexp_extract({x}, '\bCWE-\d+\b', 0, 'i')), '')"


_R = f"SELECT row_id, {_strip('response_text')} AS r FROM prediction_results WHERE response_text IS NOT NULL"


def _answers(spark, d):
    return table(spark, d, "prediction_results").where("response_text is not null").select("row_id", F.col("response_text").alias("r"))


# a stripped answer ``r`` to its label
BINARY_SQL = f"""coalesce(CASE lower({_last('r', '"is_vulnerable"' + chr(92) + 's*:' + chr(92) + 's*(true|false)', 'i')}) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END, {_word(_last('r', _FA, 'is'))},
    {_tail('r', lambda z: f"coalesce({_word(_payload(z))}, {_word(z)})")}, CASE upper({_last('r', chr(92) + 'b(VULNERABLE|SAFE)' + chr(92) + 'b', 'i')}) WHEN 'VULNERABLE' THEN 1 WHEN 'SAFE' THEN 0 END,
    {_word(_last('r', chr(92) + 'b(YES|NO|TRUE|FALSE|FOUND|DETECTED|NONE|CLEAN)' + chr(92) + 'b', 'i'))}, 0)"""


@query(f"SELECT row_id, {BINARY_SQL} AS label FROM ({_R})")
def prs_binary(spark, d):
    return _answers(spark, d).select("row_id", P.binary(F.col("r")).alias("label"))


_CL = lambda z: f"coalesce({_cwe(_cand(z))}, CASE WHEN {_bare(_cand(z))} = 'SAFE' THEN 'SAFE' END)"


MULTICLASS_SQL = f"""coalesce({_tail(_last('r', _FA, 'is'), _CL)}, {_tail('r', _CL)}, upper({_last('r', chr(92) + 'bCWE-' + chr(92) + 'd+' + chr(92) + 'b|' + chr(92) + 'bSAFE' + chr(92) + 'b', 'i', 0)}), 'UNKNOWN')"""


@query(f"SELECT row_id, {MULTICLASS_SQL} AS label FROM ({_R})")
def prs_multiclass(spark, d):
    return _answers(spark, d).select("row_id", P.multiclass(F.col("r")).alias("label"))


_TYPES = "(CASE " + "WHEN {0} = 'SAFE' THEN 'No-Vulnerability' " + " ".join(f"WHEN {{0}} = '{n.upper()}' THEN '{n}'" for n in P.TYPE_LABELS) + " END)"
_TYPE = lambda x: _TYPES.format(_bare(x))
_NAMES = "|".join(sorted(P.TYPE_LABELS, key=lambda n: -len(n)))


@query(
    f"""SELECT row_id, coalesce({_cwe(_last('r', _FA, 'is'))}, {_TYPE(_last('r', _FA, 'is'))}, {_tail('r', lambda z: f"coalesce({_cwe(_cand(z))}, {_TYPE(_cand(z))})")},
        {_TYPE(_last('r', f'({_NAMES})', 'i'))}, CASE WHEN regexp_matches(r, '\\b(?:SAFE|NO-VULNERABILITY|CLEAN)\\b', 'i') THEN 'No-Vulnerability' END, 'UNKNOWN') AS label FROM ({_R})"""
)
def prs_type_label(spark, d):
    return _answers(spark, d).select("row_id", P.type_multiclass(F.col("r")).alias("label"))


_YN = lambda w: f"CASE {w} WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END"


@query(
    f"""SELECT row_id, coalesce({_YN(_word(_last('r', _FA, 'is')))}, {_YN(_tail('r', lambda z: f"coalesce({_word(_payload(z))}, {_word(z)})"))}, upper({_last('r', chr(92) + 'b(YES|NO)' + chr(92) + 'b', 'i')}), 'NO') AS label FROM ({_R})"""
)
def prs_task1(spark, d):
    return _answers(spark, d).select("row_id", P.parser_for("", "task1")(F.col("r")).alias("label"))


_CH = lambda z: f"nullif(regexp_extract(upper({_strip(_cand(z))}), '^(?:FINAL\\s*ANSWER|ANSWER|OPTION|CHOICE|VERDICT)?\\s*[:\\-]?\\s*([ABCDE])(?:[.:])?$', 1), '')"


@query(f"SELECT row_id, coalesce({_tail(_last('r', _FA, 'is'), _CH)}, {_tail('r', _CH)}, 'A') AS label FROM ({_R})")
def prs_task2(spark, d):
    return _answers(spark, d).select("row_id", P.choice(F.col("r")).alias("label"))


@query("SELECT row_id, md5(regexp_replace(response_text, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g')) AS digest FROM prediction_results WHERE response_text IS NOT NULL")
def prs_task3(spark, d):
    """Tasks 3 to 5 keep the stripped text."""
    return _answers(spark, d).select("row_id", F.md5(P.parser_for("", "task3")(F.col("r"))).alias("digest"))


@query(f"SELECT row_id, {_last('r', _FA, 'is')} AS payload FROM ({_R})")
def prs_final_answer(spark, d):
    return _answers(spark, d).select("row_id", P.final_answer(F.col("r")).alias("payload"))


@query(f"SELECT row_id, lower({_last('r', chr(34) + 'is_vulnerable' + chr(34) + chr(92) + 's*:' + chr(92) + 's*(true|false)', 'i')}) AS verdict FROM ({_R})")
def prs_json_verdict(spark, d):
    return _answers(spark, d).select("row_id", F.lower(last_match(F.col("r"), P.IS_VULNERABLE)).alias("verdict"))


@query("SELECT run_id, count(*) AS n, count(*) FILTER (missing) AS missing, round(count(*) FILTER (missing) * 100.0::double / count(*), 4) AS percent FROM (SELECT run_id, coalesce(len(list_filter(inference_data.responses, lambda x: contains(coalesce(x, ''), '[[FINAL_ANSWER: '))), 0) = 0 AS missing FROM prediction_records) GROUP BY run_id")
def flt_marker_audit(spark, d):
    x = table(spark, d, "prediction_records").withColumn("m", P.lacks_marker(F.col("inference_data.responses")))
    return x.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.col("m").cast("long")).alias("missing"), F.round(F.sum(F.col("m").cast("long")) * 100.0 / F.count("*"), 4).alias("percent"))


# ---- normalisers ----

_U = "upper(" + _strip("cwe_id") + ")"


@query(
    f"""SELECT row_id, nullif(regexp_extract({_U}, 'CWE-\\d+'), '') AS search, CASE WHEN {_U} IS NULL OR NOT regexp_matches({_U}, '^(CWE-|\\d+$)') THEN 'CWE-UNKNOWN' WHEN starts_with({_U}, 'CWE-') THEN {_U} ELSE 'CWE-' || {_U} END AS exact,
        CASE WHEN starts_with({_U}, 'CWE-') THEN {_U} WHEN regexp_matches({_U}, '^\\d+$') THEN 'CWE-' || {_U} END AS strict,
        coalesce(nullif(regexp_extract({_U}, 'CWE-\\d+'), ''), 'CWE-' || nullif(regexp_extract({_U}, '\\b(\\d+)\\b', 1), '')) AS loose, 'CWE-' || nullif(regexp_extract({_U}, '^(?:CWE[-_ ]?)?(\\d+)$', 1), '') AS digits FROM cleanvul_raw"""
)
def nrm_cwe(spark, d):
    return table(spark, d, "cleanvul_raw").select("row_id", *(N.cwe(F.col("cwe_id"), m).alias(m) for m in ("search", "exact", "strict", "loose", "digits")))


@query(f"SELECT row_id, coalesce(try_cast(nullif(regexp_extract({_U}, '(\\d+)', 1), '') AS INT), 0) AS or_zero, coalesce(try_cast(nullif(regexp_extract({_U}, '(\\d+)', 1), '') AS INT), 1) AS or_one FROM cleanvul_raw")
def nrm_cwe_number(spark, d):
    c = F.upper(strip(F.col("cwe_id")))
    return table(spark, d, "cleanvul_raw").select("row_id", N.cwe_number(c, 0).alias("or_zero"), N.cwe_number(c, 1).alias("or_one"))


@query("SELECT row_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS cwes FROM (SELECT row_id, list_filter(list_transform(cwe, lambda x: nullif(regexp_extract(upper(x), 'CWE-\\d+'), '')), lambda x: x IS NOT NULL) AS l FROM primevul_raw)")
def nrm_cwe_list(spark, d):
    return table(spark, d, "primevul_raw").select("row_id", F.array_join(N.cwe_list(F.col("cwe")), ",").alias("cwes"))


_HML = lambda x, hi, mid, names: f"CASE WHEN {x} IN ({', '.join(repr(v) for v in hi)}) THEN '{names[0]}' WHEN {x} IN ({', '.join(repr(v) for v in mid)}) THEN '{names[1]}' WHEN {x} IS NOT NULL THEN '{names[2]}' END"
_N = "regexp_replace(nullif(regexp_extract(" + _U + ", 'CWE-\\d+'), ''), '^CWE-', '')"


@query(
    f"""SELECT row_id, {_HML(_N, N.SEVERITY_BY_CWE['HIGH'], N.SEVERITY_BY_CWE['MEDIUM'], ('HIGH', 'MEDIUM', 'LOW'))} AS by_class, {_HML(_N, N.SEVERITY_BY_CWE_FIVE_TASKS['high'], N.SEVERITY_BY_CWE_FIVE_TASKS['medium'], ('high', 'medium', 'low'))} AS by_class_five,
        CASE WHEN vulnerability_score * 2.5 >= 9 THEN 'CRITICAL' WHEN vulnerability_score * 2.5 >= 7 THEN 'HIGH' WHEN vulnerability_score * 2.5 >= 4 THEN 'MEDIUM' WHEN vulnerability_score > 0 THEN 'LOW' WHEN vulnerability_score IS NOT NULL THEN 'NONE' END AS by_score FROM cleanvul_raw"""
)
def nrm_severity(spark, d):
    c = N.cwe(F.col("cwe_id"))
    return table(spark, d, "cleanvul_raw").select("row_id", N.severity_of_cwe(c).alias("by_class"), N.severity_of_cwe(c, True).alias("by_class_five"), N.severity_of_score(F.col("vulnerability_score") * 2.5).alias("by_score"))


@query(f"SELECT row_id, CASE WHEN coalesce({_strip('severity')}, '') = '' THEN 'UNKNOWN' ELSE upper({_strip('severity')}) END AS severity FROM samples")
def nrm_severity_spelling(spark, d):
    return table(spark, d, "samples").select("row_id", N.severity(F.col("severity")).alias("severity"))


@query(
    "SELECT prompt_id, prompt_name, CASE prompt_name WHEN 'sql' THEN 'CWE-89' ELSE 'CWE-Other' END AS cwe, 'low' AS severity FROM prompts"
)
def nrm_type_to_cwe(spark, d):
    """The default of unknown types; the map itself is covered by tests."""
    return table(spark, d, "prompts").select("prompt_id", "prompt_name", N.cwe_of_type(F.col("prompt_name")).alias("cwe"), N.severity_of_token_type(F.col("prompt_name")).alias("severity"))


@query("SELECT row_id, language FROM (SELECT row_id, CASE lower(regexp_replace(" + _strip("extension") + ", '^\\.', '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.LANGUAGES.items()) + " END AS language FROM cleanvul_raw) WHERE language IS NOT NULL")
def nrm_language(spark, d):
    return table(spark, d, "cleanvul_raw").select("row_id", N.language(F.col("extension")).alias("language")).where("language is not null")


@query(f"SELECT row_id, coalesce(lower({_strip('is_test')}) IN ('true', '1', 'yes'), false) AS is_test FROM cleanvul_raw")
def nrm_truthy(spark, d):
    return table(spark, d, "cleanvul_raw").select("row_id", N.truthy(F.col("is_test")).alias("is_test"))


@query("SELECT row_id, coalesce(nullif(regexp_extract(commit_url, '/commit/([0-9a-f]{7,})', 1), ''), right(regexp_replace(commit_url, '[^\\p{L}\\p{N}_]', '_', 'g'), 40)) AS id, nullif(regexp_extract(commit_url, '^https?://[^/]+/([^/]+/[^/]+)/commit/', 1), '') AS repository FROM cleanvul_raw")
def nrm_url_id(spark, d):
    return table(spark, d, "cleanvul_raw").select("row_id", N.url_id(F.col("commit_url")).alias("id"), N.repository(F.col("commit_url")).alias("repository"))


@query("SELECT row_id, coalesce(try_strptime(commit_date, '%Y-%m-%d'), try_strptime(commit_date, '%d/%m/%Y'))::date AS day FROM cleanvul_raw")
def nrm_date(spark, d):
    return table(spark, d, "cleanvul_raw").select("row_id", N.date_of(F.col("commit_date")).alias("day"))


@query("SELECT row_id, md5('// Call graph context:\n// ' || project || '\n\n' || func) AS digest FROM primevul_raw WHERE func IS NOT NULL AND coalesce(project, '') <> ''")
def nrm_context_prefix(spark, d):
    p = table(spark, d, "primevul_raw").where("func is not null and coalesce(project, '') <> ''")
    return p.select("row_id", F.md5(N.with_context(F.col("project"), F.col("func"))).alias("digest"))


_HEAD = "'/*' || chr(10) || 'name: ' || func_hash || chr(10) || ' cwe : ' || coalesce(cwe[1], '') || chr(10) || '*/' || chr(10) || func"


@query(
    f"""SELECT row_id, nullif(func_hash, '') AS name, nullif(cwe[1], '') AS cwe, CASE WHEN contains(func, chr(10)) THEN 6 + 0 END AS second_line, md5({_strip("regexp_replace(func, '/[*]\\s*\\n.*?[*]/\\s*\\n', '', 'gs')")}) AS code_digest
    FROM primevul_raw WHERE func IS NOT NULL AND {_strip('func')} <> '' AND func_hash IS NOT NULL AND func_hash <> ''"""
)
def nrm_header(spark, d):
    """Comment headers put before each function are read and taken off again, with any such blocks that the function has itself."""
    p = table(spark, d, "primevul_raw").where(F.col("func_hash").isNotNull() & (F.col("func_hash") != "") & (strip(F.col("func")) != ""))
    text = F.concat(F.lit("/*\nname: "), F.col("func_hash"), F.lit("\n cwe : "), F.coalesce(F.try_element_at("cwe", F.lit(1)), F.lit("")), F.lit("\n*/\n"), F.regexp_replace("func", r"(?s)^([^\n]*\n)", "$1{!LINE}"))
    marked = N.marker_line(text, "{!LINE}")
    plain = F.regexp_replace(N.without_headers(text), r"\{!LINE\}", "")
    blank = lambda c: F.nullif(c, F.lit(""))
    return p.select("row_id", blank(N.header_field(text, "name")).alias("name"), blank(N.header_field(text, "cwe")).alias("cwe"), marked.cast("int").alias("second_line"), F.md5(plain).alias("code_digest"))


@query(
    f"""WITH x AS (SELECT row_id, func_before, func_after FROM cleanvul_raw)
    SELECT row_id, 'cv_' || row_id || '_vulnerable' AS id, 1 AS label, length(func_before)::bigint AS n FROM x WHERE coalesce({_strip('func_before')}, '') <> ''
    UNION ALL SELECT row_id, 'cv_' || row_id || '_fixed', 0, length(func_after)::bigint FROM x WHERE coalesce({_strip('func_after')}, '') <> ''"""
)
def nrm_pair_split(spark, d):
    x = D.pair_split(table(spark, d, "cleanvul_raw"), "row_id", F.col("func_before"), F.col("func_after"), ["row_id"], "cv")
    return x.select("row_id", "id", "label", F.length("code").cast("long").alias("n"))


_META = "json_extract_string(metadata, '$.\"{0}\"')"


@query(
    f"""SELECT row_id, coalesce(nullif({_META.format('CVEFixes-Number')}, ''), nullif({_META.format('cve_id')}, '')) AS cve_id, coalesce(try_cast({_META.format('cwe_number')} AS INT), 0) AS cwe_number,
        {_META.format('programming_language')} AS language, CASE WHEN {_META.format('CleanVul-CommitUrl')} IS NULL THEN 'context' ELSE 'context-commit' END AS source, try_cast(label AS INT) AS label_int FROM samples"""
)
def nrm_context_source(spark, d):
    """Keys of the JSON metadata as columns, older names first."""
    j = lambda k: F.get_json_object("metadata", f"$['{k}']")
    blank = lambda c: F.nullif(c, F.lit(""))
    return table(spark, d, "samples").select(
        "row_id", F.coalesce(blank(j("CVEFixes-Number")), blank(j("cve_id"))).alias("cve_id"), F.coalesce(j("cwe_number").try_cast("int"), F.lit(0)).alias("cwe_number"), j("programming_language").alias("language"),
        F.when(j("CleanVul-CommitUrl").isNull(), "context").otherwise("context-commit").alias("source"), F.col("label").try_cast("int").alias("label_int"),
    )


_TARGET = "CWE-787"


@query(
    f"""WITH s AS (SELECT row_id, label <> '0' AND label <> 'SAFE' AS v, cwe_types[1] AS c FROM samples WHERE label IS NOT NULL)
    SELECT row_id, CASE WHEN v THEN '1' ELSE '0' END AS "binary", CASE WHEN v THEN coalesce(c, 'UNKNOWN') ELSE 'SAFE' END AS multiclass, CASE WHEN v AND c = '{_TARGET}' THEN '1' WHEN NOT v THEN '0' END AS specific FROM s"""
)
def flt_task_label(spark, d):
    s = table(spark, d, "samples").where("label is not null")
    v, c = ~F.col("label").isin("0", "SAFE"), F.try_element_at("cwe_types", F.lit(1))
    return s.select("row_id", *(D.task_label(v, c, t, _TARGET).alias(t) for t in ("binary", "multiclass", "specific")))


@query(
    f"""WITH s AS (SELECT row_id, coalesce(try_cast({_META.format('cwe_number')} AS INT), 0) AS n, cwe_types FROM samples)
    SELECT row_id, CASE WHEN n = 787 THEN '1' ELSE '0' END AS label FROM s WHERE n = 787 OR cwe_types = ['SAFE']"""
)
def flt_target_class(spark, d):
    s = table(spark, d, "samples").withColumn("cwe_number", F.coalesce(F.get_json_object("metadata", "$.cwe_number").try_cast("int"), F.lit(0)))
    return D.for_target(s, _TARGET).select("row_id", "label")


@query(
    """WITH q AS (SELECT p.row_id, greatest(1, length(coalesce(system_prompt, '') || chr(10) || replace(user_prompt_template, '{code}', coalesce(s.code, ''))) // 4)::bigint AS prompt_tokens, r.context_length - r.max_output_tokens - 200 AS budget
        FROM prediction_results p JOIN runs r USING (run_id) JOIN prompts USING (prompt_id) JOIN (SELECT id, min(code) AS code FROM samples GROUP BY id) s ON s.id = p.sample_id)
    SELECT row_id, prompt_tokens, budget FROM q WHERE budget <= 0 OR prompt_tokens <= budget"""
)
def flt_token_budget(spark, d):
    s = table(spark, d, "samples").groupBy(F.col("id").alias("sample_id")).agg(F.min("code").alias("code"))
    x = table(spark, d, "prediction_results").select("row_id", "run_id", "sample_id").join(table(spark, d, "runs"), "run_id").join(table(spark, d, "prompts"), "prompt_id").join(s, "sample_id")
    user = T.render_column(F.col("user_prompt_template"), F.col("code"))
    out = D.within_budget(x, F.coalesce("system_prompt", F.lit("")), user, F.col("context_length"), F.col("max_output_tokens"))
    return out.select("row_id", "prompt_tokens", "budget")


@query("SELECT row_id FROM cleanvul_raw WHERE func_before IS NOT NULL AND func_after IS NOT NULL AND length(func_before) > 50 AND length(func_after) > 50 AND cwe_id IN ('CWE-78', 'CWE-79', 'CWE-295')")
def flt_length_and_list(spark, d):
    return table(spark, d, "cleanvul_raw").where((F.length("func_before") > 50) & (F.length("func_after") > 50) & F.col("cwe_id").isin("CWE-78", "CWE-79", "CWE-295")).select("row_id")


@query(f"""WITH {PRED}, e AS (SELECT model_name, row_id, sample_id, predicted_label, true_label, response_text, row_number() OVER (PARTITION BY model_name ORDER BY row_id) AS rank FROM pred WHERE ok AND t <> p)
    SELECT model_name, rank::int AS rank, row_id, sample_id, predicted_label, true_label, left(response_text, 200) AS excerpt FROM e WHERE rank <= 10""")
def flt_misclassified(spark, d):
    """The first ten errors of each model: a top-k report."""
    from pyspark.sql import Window as W

    x = predictions(spark, d).where("ok and t <> p").withColumn("rank", F.row_number().over(W.partitionBy("model_name").orderBy("row_id"))).where("rank <= 10")
    return x.select("model_name", "rank", "row_id", "sample_id", "predicted_label", "true_label", F.substring("response_text", 1, 200).alias("excerpt"))


@query("SELECT row_id FROM prediction_records WHERE inference_data.confidence >= 0.8 - 1e-9")
def flt_confidence(spark, d):
    return table(spark, d, "prediction_records").where(F.col("inference_data.confidence") >= 0.8 - 1e-9).select("row_id")


@query("SELECT run_id, sample_id FROM prediction_results WHERE is_success AND confidence IS NOT NULL AND predicted_label IS NOT NULL AND NOT isnan(confidence)")
def flt_dropna(spark, d):
    return table(spark, d, "prediction_results").where("is_success").dropna(subset=["confidence", "predicted_label"]).select("run_id", "sample_id")


_YEAR = "try_cast(nullif(regexp_extract(cve, '(?i)CVE-(\\d{4})-', 1), '') AS INT)"


@query(f"SELECT row_id, {_YEAR} AS year FROM primevul_raw")
def prj_cve_year(spark, d):
    return table(spark, d, "primevul_raw").select("row_id", N.cve_year(F.col("cve")).alias("year"))


@query(f"SELECT row_id, CASE WHEN y < 2014 THEN 'to 2013' WHEN y < 2018 THEN '2014-2017' WHEN y < 2022 THEN '2018-2021' WHEN y IS NOT NULL THEN 'from 2022' END AS band FROM (SELECT row_id, {_YEAR} AS y FROM primevul_raw)")
def prj_year_band(spark, d):
    """Half-open bins; the bins decide, not the labels."""
    return table(spark, d, "primevul_raw").select("row_id", year_band(N.cve_year(F.col("cve"))).alias("band"))


def year_band(y):
    return F.when(y < 2014, "to 2013").when(y < 2018, "2014-2017").when(y < 2022, "2018-2021").when(y.isNotNull(), "from 2022")


@query("SELECT row_id, CASE WHEN file_name LIKE '%.cpp' THEN 'cpp' WHEN file_name LIKE '%.c' THEN 'c' WHEN file_name LIKE 'src/%' THEN 'src' ELSE file_name END AS key FROM cleanvul_raw")
def prj_path_key(spark, d):
    f = F.col("file_name")
    return table(spark, d, "cleanvul_raw").select("row_id", F.when(f.like("%.cpp"), "cpp").when(f.like("%.c"), "c").when(f.like("src/%"), "src").otherwise(f).alias("key"))


@query("SELECT run_id, nullif(regexp_extract(experiment_name, '^[a-z]+_\\d+b_(.+)$', 1), '') AS suffix FROM runs")
def prj_name_suffix(spark, d):
    return table(spark, d, "runs").select("run_id", F.nullif(F.regexp_extract("experiment_name", r"^[a-z]+_\d+b_(.+)$", 1), F.lit("")).alias("suffix"))


@query("SELECT run_id, coalesce(CASE backend WHEN 'vllm' THEN 'local server' WHEN 'hf' THEN 'local pipeline' END, backend) AS kind FROM runs")
def prj_map_with_fallback(spark, d):
    names = F.create_map(F.lit("vllm"), F.lit("local server"), F.lit("hf"), F.lit("local pipeline"))
    return table(spark, d, "runs").select("run_id", F.coalesce(F.try_element_at(names, F.col("backend")), "backend").alias("kind"))


_QUOTE = lambda x: "'" + x.replace("'", "''") + "'"
_LEGACY = (
    "- Respond with only VULNERABLE or SAFE, please", "Response Format: Respond with only one word", "  final answer: After your analysis, respond with the class", "Your answer should either be 'YES' or \"NO\" only.",
    "Output 'A.' or 'B.' or 'C.' or 'D.' or 'E.' only", "Reply with one word", "Output 'A.' only",
)
# lines of a template without redundant ones; of blank lines one after the other the first
_KEPT = "list_filter(regexp_split_to_array({0}, '\r\n|\n|\r'), lambda x: NOT (" + " OR ".join(f"regexp_matches(x, {_QUOTE('(?i)' + p)})" for p in T.REDUNDANT) + "))"
_CLEAN = r"regexp_replace(array_to_string(list_filter(kept, lambda x, i: trim(x) <> '' OR i = 1 OR trim(kept[i - 1]) <> ''), chr(10)), '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH l(line) AS (VALUES {', '.join(f'({_QUOTE(x)})' for x in _LEGACY)}), t AS (SELECT prompt_id, line, {_KEPT.format("line || chr(10) || user_prompt_template || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || 'End.' || chr(10) || line || chr(10)")} AS kept FROM prompts, l)
    SELECT prompt_id, line, {_CLEAN} AS cleaned FROM t"""
)
def prj_prompt_clean(spark, d):
    """Templates with older answer-format lines before and behind them, of which all but the last two go, and with blank lines."""
    p = table(spark, d, "prompts").select("prompt_id", "user_prompt_template", F.explode(F.array(*(F.lit(x) for x in _LEGACY))).alias("line"))
    text = F.concat("line", F.lit("\n"), "user_prompt_template", F.lit("\n\n  \n\nEnd.\n"), "line", F.lit("\n"))
    return p.select("prompt_id", "line", T.clean_column(text).alias("cleaned"))


_CONTRACT = "CASE task_type " + " ".join(f"WHEN {_QUOTE(t)} THEN {_QUOTE(T.contract(t))}" for t in T.CONTRACT_OF) + " ELSE '' END"


@query(
    f"""WITH t AS (SELECT prompt_id, {_KEPT.format('user_prompt_template')} AS kept FROM prompts), c AS (SELECT prompt_id, {_CLEAN} AS template FROM t)
    SELECT p.row_id, md5(replace(c.template, '{{code}}', coalesce(s.code, '')) || {_CONTRACT}) AS digest FROM prediction_results p JOIN runs USING (run_id) JOIN c USING (prompt_id) JOIN (SELECT id, min(code) AS code FROM samples GROUP BY id) s ON s.id = p.sample_id"""
)
def prj_prompt_render(spark, d):
    """Whole prompts: the cleaned template of the run's prompt, the sample's code in it, the contract of the run's task behind it."""
    s = table(spark, d, "samples").groupBy(F.col("id").alias("sample_id")).agg(F.min("code").alias("code"))
    prompts = table(spark, d, "prompts").select("prompt_id", T.clean_column(F.col("user_prompt_template")).alias("template"))
    runs = table(spark, d, "runs").select("run_id", "prompt_id", T.contract_column(F.col("task_type")).alias("contract"))
    x = table(spark, d, "prediction_results").select("row_id", "run_id", "sample_id").join(runs, "run_id").join(prompts, "prompt_id").join(s, "sample_id")
    return x.select("row_id", F.md5(F.concat(T.render_column(F.col("template"), F.col("code")), "contract")).alias("digest"))


# ---- conversions of whole sources, over adapted tables ----

_PV = r"""pv AS (SELECT row_id, project, target, cwe, cve, regexp_replace(coalesce(func, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS code, [CASE WHEN target = 1 AND row_id % 5 < 4 THEN ['Buffer-Overflow', 'Memory-Leak', 'Other', 'Race-Condition'][row_id % 5 + 1] END, CASE WHEN target = 1 AND row_id % 7 = 0 THEN 'Double-Free' END] AS raw FROM primevul_raw),
    ty AS (SELECT *, list_filter(raw, lambda x: x IS NOT NULL) AS types FROM pv WHERE code <> '')"""
_SEV = "CASE WHEN len({0}) > 0 THEN coalesce(list_filter(list_transform({0}, lambda x: CASE WHEN x IN ('Buffer-Overflow', 'Integer-Overflow', 'Use-After-Free', 'Double-Free', 'Format-String-Vulnerability') THEN 'high' WHEN x IN ('Null-Pointer-Dereference', 'Memory-Leak', 'Race-Condition', 'Improper-Access-Control') THEN 'medium' END), lambda x: x IS NOT NULL)[1], 'low') END"


def _typed(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("Buffer-Overflow", "Memory-Leak", "Other", "Race-Condition")))
    a = F.when((F.col("target") == 1) & (F.col("row_id") % 5 < 4), F.try_element_at(kinds, (F.col("row_id") % 5 + 1).cast("int")))
    b = F.when((F.col("target") == 1) & (F.col("row_id") % 7 == 0), "Double-Free")
    return table(spark, d, "primevul_raw").select("row_id", F.col("project").alias("dataset"), (F.col("target") == 1).alias("vulnerable"), F.array(a, b).alias("vulnerability_types"), F.col("func").alias("code"))


@query(
    f"""WITH {_PV} SELECT 'binary' AS task, concat_ws('_', 'typed', project, row_id) AS id, CASE WHEN target = 1 THEN '1' ELSE '0' END AS label, {_SEV.format('types')} AS severity FROM ty
    UNION ALL SELECT 'multiclass', concat_ws('_', 'typed', project, row_id, 'multiclass'), CASE len(types) WHEN 0 THEN 'SAFE' WHEN 1 THEN types[1] ELSE 'Multiple-Vulnerabilities' END, {_SEV.format('types')} FROM ty
    UNION ALL SELECT 'specific', concat_ws('_', 'typed', project, row_id, 'Memory_Leak'), CASE WHEN list_contains(types, 'Memory-Leak') THEN '1' ELSE '0' END, CASE WHEN list_contains(types, 'Memory-Leak') THEN 'medium' END FROM ty WHERE list_contains(types, 'Memory-Leak') OR target <> 1"""
)
def nrm_typed_source(spark, d):
    """The type-labelled source in its three task modes."""
    x = _typed(spark, d)
    out = None
    for task, target in (("binary", None), ("multiclass", None), ("specific", "Memory-Leak")):
        one = S.typed(x, task, "row_id", target).select(F.lit(task).alias("task"), "id", "label", "severity")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH x AS (SELECT row_id, {_strip("coalesce(func_before, '')")} AS code, is_test, coalesce(nullif(regexp_extract({_U}, 'CWE-\\d+'), ''), 'CWE-' || nullif(regexp_extract({_U}, '\\b(\\d+)\\b', 1), '')) AS c FROM cleanvul_raw)
    SELECT t AS task, concat_ws('_', 'task', t, row_id) AS id, CASE WHEN t = 'task1' THEN CASE WHEN upper(coalesce(is_test, '')) = 'YES' THEN '1' ELSE '0' END ELSE coalesce(is_test, '') END AS label, coalesce(c, '') AS cwe,
        {_HML("regexp_replace(c, '^CWE-', '')", N.SEVERITY_BY_CWE_FIVE_TASKS['high'], N.SEVERITY_BY_CWE_FIVE_TASKS['medium'], ('high', 'medium', 'low'))} AS severity FROM x, (VALUES ('task1'), ('task2'), ('task3'), ('task4'), ('task5')) v(t) WHERE code <> ''"""
)
def nrm_five_task_source(spark, d):
    x = table(spark, d, "cleanvul_raw").select(F.col("row_id").alias("idx"), F.col("func_before").alias("code"), F.col("is_test").alias("answer"), F.col("cwe_id").alias("cwe"))
    out = None
    for task in ("task1", "task2", "task3", "task4", "task5"):
        one = S.five_tasks(x, task).select(F.lit(task).alias("task"), "id", "label", F.array_join("cwe_types", ",").alias("cwe"), "severity")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT concat_ws('_', 'tokens', 'sql', row_id) AS id, CASE WHEN len(cwe_types) > 0 THEN '1' ELSE '0' END AS label, CASE WHEN len(cwe_types) > 0 THEN 'CWE-89' ELSE '' END AS cwe, CASE WHEN len(cwe_types) > 0 THEN 'high' END AS severity FROM samples WHERE {_strip('code')} <> ''")
def nrm_token_source(spark, d):
    x = table(spark, d, "samples").select("row_id", "code", F.col("cwe_types").alias("vulnerable_tokens"))
    return S.token_labelled(x, "sql", "row_id").select("id", "label", F.array_join("cwe_types", ",").alias("cwe"), "severity")


@query(
    f"""WITH x AS (SELECT row_id, func_before, func_after, commit_msg, nullif(regexp_extract({_U}, 'CWE-\\d+'), '') AS c FROM cleanvul_raw), p AS (SELECT *, CASE WHEN coalesce({_strip('commit_msg')}, '') <> '' THEN '// Call graph context:\n// ' || commit_msg || '\n\n' ELSE '' END AS head FROM x)
    SELECT 'pair_' || row_id || '_vulnerable' AS id, '1' AS label, md5(head || func_before) AS digest, {_HML("regexp_replace(c, '^CWE-', '')", N.SEVERITY_BY_CWE['HIGH'], N.SEVERITY_BY_CWE['MEDIUM'], ('HIGH', 'MEDIUM', 'LOW'))} AS severity FROM p WHERE coalesce({_strip('func_before')}, '') <> ''
    UNION ALL SELECT 'pair_' || row_id || '_non_vulnerable', '0', md5(head || func_after), NULL FROM p WHERE coalesce({_strip('func_after')}, '') <> ''"""
)
def nrm_function_pairs(spark, d):
    x = table(spark, d, "cleanvul_raw").select("row_id", F.col("func_before").alias("vulnerable_function_body"), F.col("func_after").alias("non_vulnerable_function_body"), F.col("commit_msg").alias("call_graph"), F.col("cwe_id").alias("cwe"))
    return S.function_pairs(x, "row_id", call_graph=True).select("id", "label", F.md5("code").alias("digest"), "severity")


@query(
    f"""WITH x AS (SELECT row_id, {_strip("coalesce(func_before, '')")} AS code, coalesce(nullif(cve_id, ''), '') AS given, vulnerability_score FROM cleanvul_raw), k AS (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM x WHERE code <> '')
    SELECT CASE WHEN given <> '' THEN given ELSE 'cleanvul-' || n END AS id, CASE WHEN coalesce(vulnerability_score, 0) > 0 THEN 1 ELSE 0 END AS label, md5(code) AS digest FROM k"""
)
def nrm_matched_entries(spark, d):
    """Matched entries: blank code gives none, entries without an id get the running number of the sample."""
    x = table(spark, d, "cleanvul_raw").select("row_id", F.col("func_before").alias("func_code"), F.col("cve_id").alias("sample_id"), (F.coalesce("vulnerability_score", F.lit(0)) > 0).alias("is_vulnerable"))
    return S.matched(x, "row_id").select("id", "label", F.md5("code").alias("digest"))


@query(
    f"""WITH v AS (SELECT 'before' AS variant, row_id, func_before AS code FROM cleanvul_raw UNION ALL SELECT 'after', row_id, func_after FROM cleanvul_raw), k AS (SELECT variant, row_id, {_strip('code')} AS code FROM v WHERE coalesce({_strip('code')}, '') <> '')
    SELECT variant, row_id, length(code)::bigint AS n FROM k UNION ALL SELECT * FROM (SELECT 'smoke', row_id, length(code)::bigint FROM k WHERE variant = 'before' ORDER BY length(code), row_id LIMIT 1)"""
)
def nrm_variants(spark, d):
    """Each variant of a source as a dataset of its own, and the smoke dataset: the shortest sample of the first variant."""
    c = table(spark, d, "cleanvul_raw")
    return S.variants(c, {"before": F.col("func_before"), "after": F.col("func_after")}, "row_id", smoke_of="before").select("variant", "row_id", F.length("code").cast("long").alias("n"))
