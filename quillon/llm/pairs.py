"""Broken pairs of question and answer: empty, copied, refused, truncated or in another language.

One pass over the answers notes for each: emptiness, ending, language, verdict, whether it only repeats the instruction, and its
opening (the first eight words, identifiers and numbers masked), and of answers without a verdict also their first sentence and
their first forty words. Openings form a cluster if they are alike, or if answers without a verdict that begin with them have
like first sentences or first forty words, by MinHash with exact verification (runs of five words, similarity 0.8): templates vary
in their ends, in what they go on with and in single words. A cluster is a refusal template if it recurs (``support`` answers on
two samples or more) and at most a share of ``VERDICTS`` of its settled answers has a verdict: answers that analyse share their
openings with answers that conclude, refusals hardly do. No list of phrases takes part, so that refusals of any language are found
where they recur; one that occurs less often than ``support`` times, alone, is not told from an answer without a conclusion.

Answers that look like source text or have five words of their prompt's instruction in a row are held against the code of their
sample, whether or not they seem to have a verdict. Languages are those of character trigrams (see ``_language``).

Each pair has the first defect that holds of: empty, copy, refusal, truncated, language.

Results on special input: rows without an id are left out; null and blank answers are empty; a null template or an unknown sample leaves copy undetected;
a null prompt language or one without labelled texts excludes 'language'. Repeated rows count each. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

from . import truncation
from ._answers import LINES, ending, first_sentence, has_verdict, is_copy, is_empty, mostly_code, opening, uncovered, word_runs, words_of
from ._language import Languages, learn
from .near_dup import components, near_duplicates

VERDICTS = 0.1
LEAD_WORDS = 40
DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
FACTS = "row_id long, sample_id string, prompt_id int, empty boolean, ending string, foreign boolean, unlike boolean, verdict boolean, copy boolean, suspect boolean, opening string, sentence string, lead string, source string, n_chars int, n_bytes int"


def answer_facts(pairs: DataFrame, languages: Languages) -> DataFrame:
    """Facts of pairs (row_id, source, sample_id, prompt_id, prompt_lang, template, text), without the samples' code."""
    shared = pairs.sparkSession.sparkContext.broadcast(languages)  # of a fixed size for each language

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, tuple[set, list]] = {}
        for pdf in it:
            rows = []
            foreign = shared.value.foreign([t or "" for t in pdf.text], list(pdf.prompt_lang))
            for row_id, source, sample_id, prompt, other, unlike, template, text in zip(pdf.row_id, pdf.source, pdf.sample_id, pdf.prompt_id, *foreign, pdf.template, pdf.text, strict=True):
                if is_empty(text):
                    rows.append((row_id, sample_id, prompt, True, "blank", False, False, False, False, False, "", "", "", source, 0, 0))
                    continue
                key = template or ""
                if key not in runs:
                    runs[key] = (word_runs(key.replace("{code}", " ")), [p for x in key.split("{code}") if (p := words_of(x))])
                w = words_of(text)
                outside = uncovered(w, runs[key][0])
                end = ending(text)
                copy = is_copy(w, outside, runs[key][1])
                verdict = not copy and has_verdict(text)
                suspect = False
                if not copy:
                    # nothing may be said besides the instruction and code, which can hold words of a verdict
                    suspect = len(w) >= 5 and (outside < len(w) or end == "code")
                    if not suspect and len(w) >= 5 and not (verdict and end == "complete"):
                        lines = [x for x in LINES.split(text) if x.strip()]
                        suspect = _codelike(lines) or not verdict and mostly_code(lines)
                more = ("", "") if verdict or copy else (first_sentence(text, LEAD_WORDS), opening(text, LEAD_WORDS))
                rows.append((row_id, sample_id, prompt, False, end, bool(other), bool(unlike), verdict, copy, suspect, opening(text), *more, source, len(text), len(text.encode("utf-8", "replace"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return pairs.select("row_id", "source", "sample_id", "prompt_id", "prompt_lang", "template", "text").where("row_id is not null").mapInPandas(run, FACTS)


def _codelike(lines: list[str]) -> bool:
    """Half of the lines end as code does."""
    return len(lines) >= 3 and sum(x.rstrip().endswith((";", "{", "}", ":", ")", ",", "*/")) or x[:1] in " \t>" for x in lines) >= 0.5 * len(lines)


def copies_of_code(suspects: DataFrame, pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """row_ids of the suspects whose answer consists of the question with its sample's code (samples: id, code)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keep = []
            for text, template, code in zip(pdf.text, pdf.template, pdf.code, strict=True):
                w = words_of(text)
                keep.append(is_copy(w, uncovered(w, word_runs((template or "{code}").replace("{code}", f" {code} ") + " \n " + code))))
            yield pdf.loc[keep, ["row_id"]]

    code = samples.select(F.col("id").alias("sample_id"), "code").where("code is not null")
    wanted = suspects.select("row_id", "sample_id").join(pairs.select("row_id", "template", "text"), "row_id")
    code = code.join(wanted.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("sample_id").agg(F.min("code").alias("code"))
    return wanted.join(code, "sample_id").select("row_id", "template", "text", "code").mapInPandas(run, "row_id long").distinct()


def refusal_openings(facts: DataFrame, support: int = 3) -> DataFrame:
    """Openings of refusal templates, with the size of their cluster.

    Cut, empty, copying and foreign answers have no say (those merely unlike the others do: a rare template is); an opening belongs to its cluster of similar openings, and of openings whose answers without a verdict go on alike.
    """
    settled = facts.where("not empty and not copy and not foreign and ending in ('complete', 'open', 'code') and opening <> ''")
    per = materialise(
        settled.groupBy("opening").agg(
            F.count("*").alias("n"), F.sum(F.col("verdict").cast("long")).alias("verdicts"), F.min("sample_id").alias("s1"), F.max("sample_id").alias("s2"), F.min("row_id").alias("row_id")
        ),
        "openings",
    )
    node = per.select("opening", F.col("row_id").alias("node"))
    open_ = settled.where("not verdict").select("opening", "row_id", F.expr("stack(2, 'sentence', sentence, 'lead', lead) as (src, text)")).where("text <> ''")
    more = open_.groupBy("opening", "src", "text").agg(F.min("row_id").alias("row_id")).join(node, "opening").select("src", "row_id", "text", "node")
    texts = materialise(node.select(F.lit("opening").alias("src"), F.col("node").alias("row_id"), F.col("opening").alias("text"), "node").unionByName(more), "openings")
    members, links = near_duplicates(texts, threshold=0.8, shingle=5)
    # links between what the texts are of: the openings
    of = texts.select("src", "row_id", "node")
    alike = links.select("src", "rep_a", "rep_b").unionByName(members.where("row_id <> rep").select("src", F.col("rep").alias("rep_a"), F.col("row_id").alias("rep_b")))
    alike = (
        alike.join(of.select("src", F.col("row_id").alias("rep_a"), F.col("node").alias("a")), ["src", "rep_a"])
        .join(of.select("src", F.col("row_id").alias("rep_b"), F.col("node").alias("b")), ["src", "rep_b"]).where("a <> b")
        .select(F.lit("opening").alias("src"), F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b")).distinct()
    )
    nodes = node.select(F.lit("opening").alias("src"), F.col("node").alias("row_id"), F.col("node").alias("rep"))
    groups = components(nodes, alike).select("row_id", "group_id")
    g = per.join(groups, "row_id")
    refused = (
        g.groupBy("group_id").agg(F.sum("n").alias("cluster_n"), F.sum("verdicts").alias("v"), F.min("s1").alias("a"), F.max("s2").alias("b"))
        .where((F.col("cluster_n") >= support) & (F.col("v") <= F.col("cluster_n") * F.lit(VERDICTS)) & (F.col("a") < F.col("b"))).select("group_id", "cluster_n")
    )
    return g.join(refused, "group_id").select("opening", "cluster_n")


def cut_at_length(facts: DataFrame) -> DataFrame | None:
    """(row_id, at_cut) of the answers with an open ending at a length at which answers are cut; None if no ending is open."""
    ends = facts.select(F.lit("").alias("src"), "row_id", F.lit(0).alias("pos"), "source", "ending", "n_chars", "n_bytes")
    still = ends.where("ending = 'open'")
    if not still.limit(1).count():
        return None
    return truncation.flag_truncated(still, truncation.length_hazards(ends)).where("truncated").select("row_id", F.lit(True).alias("at_cut")).distinct()


def broken_pairs(pairs: DataFrame, samples: DataFrame, labelled: DataFrame, support: int = 3) -> DataFrame:
    """(row_id, defect, cluster_n) of the broken pairs; cluster_n: answers of its refusal template, null for other defects.

    labelled (lang, text): texts of known languages. The languages are learnt from all of these and from all answers.
    """
    languages = learn(labelled, pairs.select(F.col("prompt_lang").alias("lang"), "text"))
    facts = materialise(answer_facts(pairs, languages), "facts")
    copied = copies_of_code(facts.where("suspect"), pairs, samples).withColumn("code_copy", F.lit(True))
    facts = materialise(facts.join(copied, "row_id", "left").withColumn("copy", F.col("copy") | F.coalesce("code_copy", F.lit(False))).drop("code_copy"), "facts")
    refusals = refusal_openings(facts, support)
    cut = cut_at_length(facts)
    facts = facts.join(cut, "row_id", "left").withColumn("ending", F.when(F.col("at_cut"), "broken").otherwise(F.col("ending"))).drop("at_cut") if cut is not None else facts
    settled = F.col("ending").isin("complete", "open")
    defect = (
        F.when(F.col("empty"), "empty").when(F.col("copy"), "copy").when(~F.col("verdict") & settled & F.col("cluster_n").isNotNull(), "refusal")
        .when(F.col("ending").isin("broken", "marked"), "truncated").when(F.col("foreign") | F.col("unlike"), "language")
    )
    out = facts.join(refusals, "opening", "left").withColumn("defect", defect).where("defect is not null")
    return out.select("row_id", "defect", F.when(F.col("defect") == "refusal", F.col("cluster_n")).alias("cluster_n"))
