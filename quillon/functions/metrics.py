"""Classification metrics as expressions over confusion counts.

``zero_div`` says what an undefined ratio is: 'zero' or 'null'. NaN is never produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

COUNTS = ("tp", "tn", "fp", "fn")


def binary_label(label: Column) -> Column:
    """1 for '1' and weakness classes, 0 for '0' and SAFE, else null."""
    return F.when(label.isin("0", "SAFE"), 0).when((label == "1") | label.startswith("CWE-"), 1)


def confusion_counts(true: Column, pred: Column, weight: Column | None = None) -> list[Column]:
    """tp, tn, fp, fn (bigint) in one pass."""
    w = F.lit(1) if weight is None else weight
    cell = lambda t, p, name: F.coalesce(F.sum(F.when((true == t) & (pred == p), w)), F.lit(0)).cast("long").alias(name)
    return [cell(1, 1, "tp"), cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn")]


def ratio(a: Column, b: Column, zero_div: str = "zero") -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(r, F.lit(0.0)) if zero_div == "zero" else r


def metric_columns(zero_div: str = "zero", digits: int | None = None) -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c).cast("double") for c in COUNTS)
    r = lambda a, b: ratio(a, b, zero_div)
    recall, spec, prec = r(tp, tp + fn), r(tn, tn + fp), r(tp, tp + fp)
    out = {
        "accuracy": r(tp + tn, tp + tn + fp + fn), "precision": prec, "recall": recall, "f1": r(2 * tp, 2 * tp + fp + fn), "specificity": spec,
        "fnr": 1 - recall, "fpr": 1 - spec, "balanced_accuracy": (recall + spec) / 2, "youden_j": recall + spec - 1,
        "mcc": r(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    return {k: F.round(v, digits) if digits is not None else v for k, v in out.items()}


def with_metrics(counts: DataFrame, names: list[str] | None = None, zero_div: str = "zero", digits: int | None = None) -> DataFrame:
    cols = metric_columns(zero_div, digits)
    return counts.withColumns({k: cols[k] for k in (names or cols)})


def token_recall(pred: Column, true: Column) -> Column:
    """Share of the true identifiers that the prediction has; 1 if both have none, 0 if only the truth has none."""
    # identifiers are whole Unicode words of ASCII characters: written so that no engine's idea of a word edge matters
    whole = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = lambda c: F.array_distinct(F.filter(whole(c), lambda w: w.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$")))
    return _overlap(words(pred), words(true))


def line_recall(pred: Column, true: Column) -> Column:
    rows = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""))
    return _overlap(rows(pred), rows(true))


def _overlap(a: Column, b: Column) -> Column:
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(F.when(F.size(a) == 0, 1.0).otherwise(0.0))


def detectable(p: Column, n: Column, groups: int = 1) -> Column:
    """Smallest effect of a share p that n observations can show (80 % power, 5 % level); null where p is 0 or 1."""
    return F.when(p * (1 - p) > 0, F.lit(2.802) * F.sqrt(F.lit(float(groups)) / (n * 4 * p * (1 - p))))


def token_probability(logprobs: Column) -> Column:
    """Geometric mean of token probabilities."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logprobs) > 0, F.exp(total / F.size(logprobs)))


def two_label_probability(p_positive: Column, p_negative: Column) -> Column:
    return F.when((p_positive + p_negative) > 0, p_positive / (p_positive + p_negative))
