"""Answers that lost their end, from discrete length hazards and from how they end.

The hazard of a length is the share of answers that end there among those at least as long. Cutting at a fixed size raises it
at one length only. For each source and for all answers together, and for lengths in characters and in bytes, the count
at each length is tested (Poisson, one-sided) against the hazards of the ``around`` lengths on either side, with
Benjamini-Hochberg control of the false-discovery rate over all tests. Window functions run over the counts per length,
never over the answers.

The significant lengths come first: an answer with an incomplete ending (broken, marked or open) at a significant length of its source or
of all is cut by a limit ('limit'). An answer off these lengths is cut in transfer ('transfer') only on evidence of its own: its ending
is broken (mid-word, mid-sentence, inside a marker, object, fence or quotation) or a mark stands in place of the rest; a merely open
one (a line without an end mark that may be a note) is none. Answers cut exactly after a complete sentence cannot be told from complete ones and are not flagged.

Results on special input: rows without an id are left out; null and blank answers, error notices, answers that are source text alone and copies of the
question's instruction are not truncated. Repeated rows count each. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.session import if_small, materialise

from ._answers import LINES, ending, is_copy, mostly_code, uncovered, without_instruction, word_runs, words_of

ENDINGS = "src string, row_id long, pos int, source string, ending string, n_chars int, n_bytes int"


def endings(answers: DataFrame) -> DataFrame:
    """(src, row_id, pos, source, ending, n_chars, n_bytes) of answers (src, row_id, pos, source, template, text)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, set] = {}
        for pdf in it:
            kinds = []
            for text, template in zip(pdf.text, pdf.template, strict=True):
                kind = ending(text)
                if kind in ("broken", "marked", "open") and template is not None:
                    if template not in runs:
                        runs[template] = word_runs(template.replace("{code}", " "))
                    w = words_of(text)
                    outside = uncovered(w, runs[template])
                    if is_copy(w, outside) or mostly_code(without_instruction(text, template) if outside < len(w) else LINES.split(text)):
                        kind = "copy"
                kinds.append(kind)
            yield pd.DataFrame(
                {
                    "src": pdf.src, "row_id": pdf.row_id, "pos": pdf.pos, "source": pdf.source, "ending": kinds,
                    "n_chars": [len(t) for t in pdf.text], "n_bytes": [len(t.encode("utf-8", "replace")) for t in pdf.text],
                }
            )

    return answers.where("text is not null and row_id is not null and pos is not null").select("src", "row_id", "pos", "source", "template", "text").mapInPandas(run, ENDINGS)


@F.pandas_udf(DoubleType())
def poisson_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= n) of a Poisson variable; by the normal approximation beyond a mean of 500."""

    def one(k: int, m: float) -> float:
        if k <= 0:
            return 1.0
        if m <= 0:
            return 0.0
        if m > 500:
            return 0.5 * math.erfc((k - 0.5 - m) / math.sqrt(2 * m))
        if k > m + 1:  # sum upwards from k
            term = math.exp(k * math.log(m) - m - math.lgamma(k + 1))
            total, j = term, k
            while term > total * 1e-16:
                j += 1
                term *= m / j
                total += term
            return min(1.0, total)
        j = np.arange(k)
        lg = np.array([math.lgamma(x + 1) for x in range(k)])
        return max(0.0, 1.0 - float(np.exp(j * math.log(m) - m - lg).sum()))

    return pd.Series([one(int(k), float(m)) for k, m in zip(n, mean, strict=True)])


def length_hazards(ends: DataFrame, around: int = 25, least: int = 5, rate: float = 0.01) -> DataFrame:
    """(source, unit, length, n, at_risk, hazard, expected, p_value, significant) of every length; source '*' holds all."""
    long = ends.where("ending not in ('blank', 'error', 'copy', 'code')").select("source", F.expr("stack(2, 'chars', n_chars, 'bytes', n_bytes) as (unit, length)"))
    per = long.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    both = per.unionByName(per.groupBy("unit", "length").agg(F.sum("n").alias("n")).withColumn("source", F.lit("*")))
    w = W.partitionBy("source", "unit").orderBy("length")
    risk = both.withColumn("at_risk", F.sum("n").over(w.rangeBetween(W.currentRow, W.unboundedFollowing)))
    near = w.rangeBetween(-around, around)
    # what ends at the neighbouring lengths, against what could have ended there: each length of the stretch is one trial of all at risk
    n_near = F.sum("n").over(near) - F.col("n")
    ended = F.sum("n").over(w.rangeBetween(-around, around))
    risk = risk.withColumn("n_near", n_near).withColumn("ended", ended)
    trials = (F.col("at_risk") + F.col("n_near") / 2) * (2 * around)
    rated = (
        risk.withColumn("hazard", F.col("n") / F.col("at_risk"))
        .withColumn("expected", F.col("at_risk") * (F.col("n_near") + F.lit(0.5)) / trials)
        .withColumn("p_value", F.when(F.col("n") >= least, poisson_tail(F.col("n"), F.col("expected"))).otherwise(F.lit(1.0)))
    )
    order, everything = W.orderBy("p_value", "source", "unit", "length"), W.partitionBy()
    tested = rated.where(F.col("n") >= least)  # few rows: lengths of at least that many answers of one source
    tested = (
        tested.withColumn("rank", F.row_number().over(order)).withColumn("tests", F.count("*").over(everything))
        .withColumn("reach", F.max(F.when(F.col("p_value") <= F.col("rank") / F.col("tests") * rate, F.col("p_value"))).over(everything))
        .withColumn("significant", F.coalesce(F.col("p_value") <= F.col("reach"), F.lit(False)))
    )
    keep = ["source", "unit", "length", "n", "at_risk", "hazard", "expected", "p_value", "significant"]
    return tested.select(*keep).unionByName(rated.where(F.col("n") < least).withColumn("significant", F.lit(False)).select(*keep))


def flag_truncated(ends: DataFrame, hazards: DataFrame) -> DataFrame:
    """``ends`` with at_cut (its length is significant for its source or for all), cause ('limit', 'transfer' or null) and truncated.

    Significant lengths are few, as many answers end at each: a source's are one row, and its answers are looked up in them, not joined to them.
    """
    cut = materialise(hazards.where("significant").select("source", "unit", "length"), "cuts")
    lists = [F.array_sort(F.collect_set(F.when(F.col("unit") == u, F.col("length")))).alias(f"_{u}") for u in ("chars", "bytes")]
    every = cut.where("source = '*'").agg(*lists)
    of_all = {u: every.select(f"_{u}").scalar() for u in ("chars", "bytes")}
    out = ends.join(if_small(cut.where("source <> '*'").groupBy("source").agg(*lists)), "source", "left")
    own = {u: F.coalesce(F.array_contains(f"_{u}", F.col(f"n_{u}")), F.lit(False)) for u in of_all}
    hit = [x for u in of_all for x in (own[u], F.coalesce(F.array_contains(of_all[u], F.col(f"n_{u}")), F.lit(False)))]
    out = out.withColumn("at_cut", hit[0] | hit[1] | hit[2] | hit[3]).select(*ends.columns, "at_cut")
    out = out.withColumn("cause", F.when(F.col("at_cut") & F.col("ending").isin("broken", "marked", "open"), "limit").when(F.col("ending").isin("broken", "marked"), "transfer"))
    return out.withColumn("truncated", F.col("cause").isNotNull())


def truncation_rates(flagged: DataFrame, dims: DataFrame) -> DataFrame:
    """(src, run_id, model_name, backend, answers, truncated, by_limit, truncated_share); flagged has run_id as its source, dims run_id, model_name, backend."""
    n = flagged.groupBy("src", F.col("source").alias("run_id")).agg(
        F.count("*").alias("answers"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.sum((F.coalesce("cause", F.lit("")) == "limit").cast("long")).alias("by_limit")
    )
    return (
        n.join(dims.select("run_id", "model_name", "backend").dropDuplicates(["run_id"]), "run_id", "left")
        .select("src", "run_id", "model_name", "backend", "answers", "truncated", "by_limit", F.round(F.col("truncated") / F.col("answers"), 6).alias("truncated_share"))
    )
