"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import if_small, materialise, table

from . import chunking, encode, leak, near_dup, pairs, spans, syntax, truncation

CODE = {"samples": "code", "primevul_raw": "func", "cleanvul_raw": "func_before"}


def _code(spark: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    out = None
    for name in names:
        t = table(spark, d, name).select(F.lit(name).alias("src"), "row_id", F.col(CODE[name]).alias("text"))
        out = t if out is None else out.unionByName(t)
    return out


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_dup.near_duplicates(_code(spark, d, tuple(CODE)), threshold=0.6, shingle=3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(*_near(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.components(*_near(spark, d))


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return chunking.chunk(table(spark, d, "samples").select("row_id", F.col("code").alias("text")), with_text=with_text)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """By the pieces themselves: 'inside' if one of a text's cuts is inside a line."""
    p = _pieces(spark, d, False).groupBy("row_id").agg(F.bool_or(F.col("cut") == "inside").alias("inside"))
    return p.select("row_id", F.when(F.col("inside"), "inside").otherwise("line").alias("cut_kind"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "primevul_raw").select(F.lit("primevul_raw").alias("src"), "row_id", F.col("project").alias("repository"), F.lit("c").alias("language"), F.col("func").alias("text"))
    repo = F.regexp_extract(F.coalesce("commit_url", F.lit("")), r"^https?://[^/]+/([^/]+/[^/]+)/commit/", 1)
    many = table(spark, d, "cleanvul_raw").select(
        F.lit("cleanvul_raw").alias("src"), "row_id", F.when(repo != "", repo).alias("repository"), syntax.claimed(F.col("extension"), F.col("file_name")).alias("language"), F.col("func_before").alias("text")
    )
    return syntax.check_syntax(c.unionByName(many))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where("not is_valid").select("src", "row_id")


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(_verdicts(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Of each run: its prompt. Runs are few and one of them holds many answers: joined by a broadcast while they are."""
    prompts = table(spark, d, "prompts").select("prompt_id", "prompt_lang", F.col("user_prompt_template").alias("template"))
    return if_small(table(spark, d, "runs").select("run_id", "prompt_id").join(prompts, "prompt_id", "left"))


def _flagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = table(spark, d, "prediction_results").select(F.lit("prediction_results").alias("src"), "row_id", F.lit(0).alias("pos"), "run_id", F.col("response_text").alias("text"))
    many = table(spark, d, "prediction_records").select("row_id", "run_id", F.posexplode("inference_data.responses").alias("pos", "text"))
    many = many.select(F.lit("prediction_records").alias("src"), "row_id", "pos", "run_id", "text")
    answers = one.unionByName(many).join(_questions(spark, d), "run_id", "left").withColumnRenamed("run_id", "source")
    ends = materialise(truncation.endings(answers), "endings")
    hazards = truncation.length_hazards(ends)
    return truncation.flag_truncated(ends, hazards), hazards


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d)[0].where("truncated").select("src", "row_id", "pos")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_flagged(spark, d)[0], table(spark, d, "runs"))


def p4_cut_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d)[1].where("significant").select("source", "unit", "length", "n", "at_risk", F.round("hazard", 6).alias("hazard"))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "prediction_results").select("row_id", "run_id", "sample_id", F.col("response_text").alias("text"))
    answers = answers.join(_questions(spark, d), "run_id", "left").withColumnRenamed("run_id", "source")
    return pairs.broken_pairs(answers, table(spark, d, "samples"), table(spark, d, "documents").select("lang", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("row_id", "defect")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Defects of each prompt: pairs, broken ones by kind."""
    answers = table(spark, d, "prediction_results").select("row_id", "run_id").join(table(spark, d, "runs").select("run_id", "prompt_id"), "run_id", "left")
    joined = answers.join(_broken(spark, d), "row_id", "left")
    kinds = [F.sum((F.coalesce("defect", F.lit("")) == k).cast("long")).alias(k) for k in pairs.DEFECTS]
    return joined.groupBy("prompt_id").agg(F.count("*").alias("pairs"), *kinds)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def _leaks(spark: SparkSession, d: str, **options) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"), **options)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaks of windows of 13 words with up to one edit: those with 13 equal words in a row."""
    return _leaks(spark, d).where("run_words >= 13").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each item: the documents that have 13 of its words in a row, and its longest leaked run. Items that did not leak have 0."""
    per = _leaks(spark, d, max_edits=0).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run_words").alias("longest_run"), F.max("covered_words").alias("covered_words"))
    items = table(spark, d, "eval_items").select("item_id", "benchmark", "kind")
    return items.join(per, "item_id", "left").select("item_id", "benchmark", "kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "longest_run", "covered_words")))


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with up to two word edits in a window of 26 words; shorter items as a whole, with edits in proportion."""
    return _leaks(spark, d, window=26, max_edits=2, sample=10)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spans.span_pairs(docs, *spans.long_spans(docs))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document others have, too; without pairs of documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spans.shared_share(docs, *spans.shared_spans(docs)).drop("n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_flags, p3_rates, p4_found, p4_rates, p4_cut_lengths, p5_found, p5_rates, p6_ids, p7_found, p7_items, p7_edited, p8_found, p8_shared)
}

_BLANK = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
_WINDOWS = """w AS (SELECT doc_id, p, hash(substr(text, p, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS p FROM documents WHERE length(text) >= 400))"""

SQL: dict[str, str] = {
    "p1_found": rf"""
        WITH t AS (SELECT 'samples' AS src, row_id, code AS text FROM samples UNION ALL SELECT 'primevul_raw', row_id, func FROM primevul_raw UNION ALL SELECT 'cleanvul_raw', row_id, func_before FROM cleanvul_raw),
             k AS (SELECT src, row_id, text, regexp_extract_all(text, '[A-Za-z0-9_]+|[^{_BLANK}A-Za-z0-9_]') AS x FROM t WHERE text IS NOT NULL),
             g AS (SELECT DISTINCT src, row_id, hash(unnest(list_transform(range(1, len(x) - 1), lambda i: [x[i], x[i + 1], x[i + 2]]))) AS s FROM k),
             n AS (SELECT src, row_id, count(*) AS n FROM g GROUP BY ALL),
             c AS (SELECT a.src, a.row_id AS key_a, b.row_id AS key_b, count(*) AS c FROM g a JOIN g b ON a.src = b.src AND a.s = b.s AND a.row_id < b.row_id GROUP BY ALL)
        SELECT src, key_a, key_b FROM c JOIN n na USING (src) JOIN n nb USING (src) WHERE na.row_id = key_a AND nb.row_id = key_b AND c >= 0.6::double * (na.n + nb.n - c)
        UNION SELECT a.src, a.row_id, b.row_id FROM k a JOIN k b ON a.src = b.src AND a.text = b.text AND a.row_id < b.row_id WHERE len(a.x) > 0""",
    "p8_found": f"""WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_shared": f"""
        WITH {_WINDOWS}, s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
             c AS (SELECT doc_id, sum(least(400, coalesce(nxt - p, 400)))::bigint AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM w SEMI JOIN s USING (h)) GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0)::int AS n_chars, coalesce(n, 0)::int AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(n, 0)::double / length(text), 6) ELSE 0.0::double END AS shared_share
        FROM documents LEFT JOIN c USING (doc_id)""",
    "p2_found": r"""
        SELECT row_id, CASE WHEN list_max(list_transform(string_split_regex(code, '\r\n|\n|\r'), lambda x: length(x))) > 6000 THEN 'inside' ELSE 'line' END AS cut_kind
        FROM samples WHERE length(code) > 6000""",
    "p7_items": r"""
        WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM documents WHERE text IS NOT NULL
                   UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') FROM eval_items),
             n AS (SELECT k, id, p, list_slice(words, p, p + 12) AS run FROM (SELECT *, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13)),
             m AS (SELECT d.id AS doc_id, i.id AS item_id, d.p AS dp, i.p AS ip FROM n d JOIN n i ON d.run = i.run AND d.k = 'd' AND i.k = 'i'),
             g AS (SELECT *, ip - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY ip) AS g FROM m),
             r AS (SELECT item_id, max(n) + 12 AS longest_run FROM (SELECT item_id, count(*) AS n FROM g GROUP BY doc_id, item_id, dp - ip, g) GROUP BY item_id),
             c AS (SELECT item_id, max(n) AS covered_words, count(*) AS documents FROM (SELECT doc_id, item_id, count(DISTINCT x) AS n FROM (SELECT doc_id, item_id, unnest(range(ip, ip + 13)) AS x FROM m) GROUP BY ALL) GROUP BY item_id)
        SELECT item_id, benchmark, kind, coalesce(documents, 0)::bigint AS documents, coalesce(longest_run, 0)::int AS longest_run, coalesce(covered_words, 0)::int AS covered_words FROM eval_items LEFT JOIN r USING (item_id) LEFT JOIN c USING (item_id)""",
    "p7_found": r"""
        WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM documents WHERE text IS NOT NULL
                   UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') FROM eval_items),
             n AS (SELECT k, id, unnest(list_transform(range(1, len(words) - 11), lambda p: list_slice(words, p, p + 12))) AS run FROM w WHERE len(words) >= 13)
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM n d JOIN n i ON d.run = i.run AND d.k = 'd' AND i.k = 'i'""",
}
