"""Languages of short texts by character trigrams, learnt from all labelled texts.

A model holds, for each language of the labelled texts, the log-probabilities of hashed trigrams of words; a text has the language
whose mean is highest. A text in a language without labelled texts would get the nearest one. So for each expected language there
is also the set of trigrams that texts expected in it use, and a text of which too few trigrams are among those is in none of the
known languages: fewer than midway between texts of the expected language and texts of others.

Code, quotations, verdict markers and identifiers don't count. A text with fewer than ``LEAST`` trigrams has no language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, LEAST = 17, 12
SMALL = 0.1  # added to each trigram's count
SEEN_IN = 0.01  # of the texts expected in a language must have a trigram (three at least) for it to be among those in use
PART = 1 << 18  # characters whose trigrams are held at a time while learning

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*(?:\"|$)|“[^”\n]*”?|„[^“”\n]*[“”]?|«[^»\n]*»?")
_MARKED = re.compile(r"\[\[[^\[\]\n]*\]\]|\{[^{}]*\}")
_TOKEN = re.compile(r"\w+")


def prose(text: str) -> str:
    """The words of a text that aren't code, quotations, markers or identifiers, in lower case and with a blank around each."""
    if "`" in text:
        text = _FENCE.sub(" ", text)
    if any(c in text for c in "`\"“„«"):
        text = _QUOTED.sub(" ", text)
    if "[[" in text or "{" in text:
        text = _MARKED.sub(" ", text)
    # words with digits or underscores, of capitals alone or with capitals inside are identifiers
    words = [low for w in _TOKEN.findall(text) if w.isalpha() and (w[1:] == (low := w.lower())[1:])]
    return f" {' '.join(words)} " if words else ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts' prose one after the other, where each text's begin, one more than texts)."""
    cleaned = [prose(t) for t in texts]
    n = np.array([len(c) for c in cleaned], np.int64)
    c = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.append(0, np.cumsum(np.maximum(n - 2, 0)))
    if len(c) < 3:
        return np.zeros(0, np.int64), first
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xD1B54A32D192ED03) + c[2:]
    h *= np.uint64(0x9FB21C651E98DF25)
    ends = np.cumsum(n)
    inside = np.ones(len(h), bool)
    for k in (1, 2):  # not across texts
        at = ends[(ends >= k) & (ends - k < len(h))] - k
        inside[at] = False
    return (h[inside] >> np.uint64(64 - BITS)).astype(np.int64), first


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # [trigram, language]
    used: dict[str, np.ndarray]  # by expected language: trigrams in use
    least_used: dict[str, float]

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the best language, -1 for too little text; trigrams; where each text's begin)."""
        g, first = trigrams(texts)
        out = np.full(len(texts), -1)
        full = np.flatnonzero(np.diff(first) >= LEAST)
        if len(self.names) and len(full):
            total = np.zeros((len(g) + 1, len(self.names)))
            np.cumsum(self.log_p[g], axis=0, out=total[1:])
            out[full] = np.argmax(total[first[1:][full]] - total[first[:-1][full]], axis=1)
        return out, g, first

    def familiar(self, g: np.ndarray, first: np.ndarray, expected: str) -> np.ndarray:
        """Of each text: the share of its trigrams in use where that language is expected."""
        hit = np.append(0, np.cumsum(self.used[expected][g]))
        return (hit[first[1:]] - hit[first[:-1]]) / np.maximum(1, np.diff(first))

    def foreign(self, texts: list[str], expected: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(Whether each text is in another one of the known languages than expected, or like no text expected). False for too little text and without an expectation."""
        best, g, first = self.best(texts)
        other, unlike = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for lang in {x for x in expected if x}:
            mine = np.array([x == lang for x in expected])
            if lang in self.names:
                other |= mine & (best >= 0) & (best != self.names.index(lang))
            if lang in self.used:
                unlike |= mine & (np.diff(first) >= LEAST) & (self.familiar(g, first, lang) < self.least_used[lang])
        return other, unlike


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in parts of at most ``PART`` characters or of one text."""
    at = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > PART:
            yield texts[at:i]
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield texts[at:]


def occurrences(texts: list[str]) -> np.ndarray:
    """Of each trigram: how often it occurs; behind them the number of texts."""
    out = np.zeros((1 << BITS) + 1, np.int64)
    for part in _parts(texts):
        out += np.append(np.bincount(trigrams(part)[0], minlength=1 << BITS), len(part))
    return out


def uses(m: Languages, texts: list[str], lang: str) -> np.ndarray:
    """Of each trigram: how many of the texts expected in a language, and in it, have it; behind them the number of these texts."""
    out = np.zeros((1 << BITS) + 1, np.int64)
    for part in _parts(texts):
        best, g, first = m.best(part)
        own = best == m.names.index(lang)
        of = np.repeat(np.arange(len(part)), np.diff(first))
        in_own = np.unique((of[own[of]] << BITS) | g[own[of]]) & ((1 << BITS) - 1)
        out += np.append(np.bincount(in_own, minlength=1 << BITS), own.sum())
    return out


def shares(m: Languages, texts: list[str], lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each text that is long enough: whether it is in the language expected, and the share of its trigrams in use."""
    own, share = [np.zeros(0, bool)], [np.zeros(0)]
    for part in _parts(texts):
        best, g, first = m.best(part)
        own.append(best[best >= 0] == m.names.index(lang))
        share.append(m.familiar(g, first, lang)[best >= 0])
    return np.concatenate(own), np.concatenate(share)


def model(counts: dict[str, np.ndarray]) -> Languages:
    """Of the ``occurrences`` in each language."""
    names = sorted(counts)
    log_p = np.zeros((1 << BITS, len(names)), np.float32)
    for i, name in enumerate(names):
        n = counts[name][:-1]
        log_p[:, i] = np.log((n + SMALL) / (n.sum() + SMALL * (1 << BITS)))
    return Languages(names, log_p, {}, {})


def in_use(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The trigrams in use, of the ``uses`` in each expected language; with too few texts there is nothing to tell unknown languages by."""
    return {lang: n[:-1] >= max(3, SEEN_IN * n[-1]) for lang, n in counts.items() if n[-1] >= 100}


def _bound(m: Languages, medians: dict[tuple[str, bool], float]) -> Languages:
    """``m`` with the least shares midway between the medians, by language and whether of it; what has only one of them is left out."""
    least = {lang: (medians[lang, True] + medians[lang, False]) / 2 for lang in m.used if {(lang, True), (lang, False)} <= medians.keys()}
    return Languages(m.names, m.log_p, {lang: m.used[lang] for lang in least}, least)


def fit(labelled: dict[str, list[str]], expected: dict[str, list[str]]) -> Languages:
    """A model of the labelled texts by language, and of what texts expected in a language use. Without texts it calls nothing foreign."""
    m = model({k: occurrences(v) for k, v in labelled.items() if v})
    m.used = in_use({lang: uses(m, texts, lang) for lang, texts in expected.items() if lang in m.names})
    medians = {}
    for lang in m.used:
        own, share = shares(m, expected[lang], lang)
        medians |= {(lang, k): float(np.median(share[own == k])) for k in (True, False) if (own == k).any()}
    return _bound(m, medians)


def learn(labelled: DataFrame, expected: DataFrame) -> Languages:
    """``fit`` to all rows of two tables (lang, text), without nulls: only sums by language and trigram, and medians, are collected."""
    sc = labelled.sparkSession.sparkContext
    labelled, expected = (t.select("lang", "text").where("lang is not null and text is not null") for t in (labelled, expected))
    m = model(_sums(labelled, lambda texts, _: occurrences(texts)))
    if not m.names:
        return m
    known = sc.broadcast(m)
    m = Languages(m.names, m.log_p, in_use(_sums(expected.where(F.col("lang").isin(m.names)), lambda texts, lang: uses(known.value, texts, lang))), {})
    if not m.used:
        return m
    using = sc.broadcast(m)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for lang, texts in pdf.groupby("lang").text:
                own, share = shares(using.value, list(texts), lang)
                yield pd.DataFrame({"lang": lang, "own": own, "share": share})

    each = expected.where(F.col("lang").isin(list(m.used))).mapInPandas(run, "lang string, own boolean, share double").groupBy("lang", "own", "share").agg(F.count("*").alias("n"))
    kind = Window.partitionBy("lang", "own")
    placed = each.withColumn("upto", F.sum("n").over(kind.orderBy("share"))).withColumn("of", F.sum("n").over(kind))
    middle = placed.where("upto > (of - 1) div 2 and upto - n <= of div 2").groupBy("lang", "own").agg(F.avg("share").alias("share"))
    return _bound(m, {(r.lang, r.own): r.share for r in middle.collect()})


def _sums(texts: DataFrame, count: Callable[[list[str], str], np.ndarray]) -> dict[str, np.ndarray]:
    """By language: the sum of ``count`` over all texts (lang, text). Each task adds up its own first."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in it:
            for lang, some in pdf.groupby("lang").text:
                sums[lang] = sums.get(lang, 0) + count(list(some), lang)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "at": at, "n": n[at]})

    rows = texts.mapInPandas(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = {}
    for lang, part in rows.groupby("lang"):
        out[lang] = np.zeros((1 << BITS) + 1, np.int64)
        out[lang][part["at"]] = part["n"]
    return out
