"""Comparisons of configurations: deltas, winners, coverage, calibration, paired tests, bootstrap, cost."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.metrics import confusion_counts, ratio
from quillon.functions.significance import chi2_tail, normal_two_sided, sign_test


def delta_to_baseline(metrics: DataFrame, keys: list[str], config: str, baseline: str, names: list[str], digits: int = 6) -> DataFrame:
    """Each configuration's metrics minus those of the baseline of the same key; null where the key has no baseline."""
    base = metrics.where(F.col(config) == baseline).select(*keys, *(F.col(n).alias(f"_b_{n}") for n in names))
    out = metrics.join(base, keys, "left")
    return out.select(*keys, config, *(F.round(F.col(n) - F.col(f"_b_{n}"), digits).alias(f"d_{n}") for n in names))


def paired_delta(metrics: DataFrame, keys: list[str], side: str, a: str, b: str, names: list[str], digits: int = 6) -> DataFrame:
    """Metrics of side a minus side b for keys that have both; one row per key and side is expected."""
    pick = lambda n, s: F.max(F.when(F.col(side) == s, F.col(n)))
    out = metrics.where(F.col(side).isin(a, b)).groupBy(*keys).agg(F.count_distinct(side).alias("_n"), *(F.round(pick(n, a) - pick(n, b), digits).alias(f"d_{n}") for n in names))
    return out.where("_n = 2").drop("_n")


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; name a last column that breaks all ties."""
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dividing(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Rows of the keys that have n different values (relational division)."""
    full = df.groupBy(key).agg(F.count_distinct(value).alias("_n")).where(F.col("_n") == n).select(key)
    return df.join(full, key, "left_semi")


def coverage(votes: DataFrame, keys: list[str], thresholds: list[float], digits: int = 6) -> DataFrame:
    """For each confidence threshold: how many samples have at least it, and the confusion counts of those. One pass over the votes.

    votes: keys, true, pred (0 or 1), votes and total of the winning label; the comparison is of integers up to an epsilon of 1e-9.
    """
    ts = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    x = votes.select(*keys, "true", "pred", "votes", "total", ts)
    kept = F.col("votes") / F.col("total") >= F.col("threshold") - 1e-9
    t, p = F.when(kept, F.col("true")), F.when(kept, F.col("pred"))
    out = x.groupBy(*keys, "threshold").agg(F.count("*").alias("n"), F.sum(kept.cast("long")).alias("kept"), *confusion_counts(t, p))
    return out.withColumn("coverage", F.round(F.col("kept") / F.col("n"), digits))


def calibration(votes: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Accuracy, n and FNR (null without positives) of each level of (votes, total)."""
    fn = F.sum(((F.col("true") == 1) & (F.col("pred") == 0)).cast("long"))
    out = votes.groupBy(*keys, "votes", "total").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("true") == F.col("pred")).cast("double")), digits).alias("accuracy"), F.round(ratio(fn, F.sum((F.col("true") == 1).cast("long")), "null"), digits).alias("fnr")
    )
    return out.withColumn("confidence", F.round(F.col("votes") / F.col("total"), digits))


def confidence_histogram(votes: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """The share of samples at each confidence level of a common grid; 0 where a key has none."""
    n = votes.groupBy(*keys, "votes", "total").agg(F.count("*").alias("n"))
    levels = F.collect_set(F.struct("votes", "total")).over(W.partitionBy(F.lit(0)))  # over the counts: a row per key and level
    grid = n.select(*keys, levels.alias("l")).dropDuplicates(keys).select(*keys, F.explode("l").alias("x")).select(*keys, "x.votes", "x.total")
    dense = grid.join(n, [*keys, "votes", "total"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*keys)), digits))


def discordant(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, both, only_a, only_b, neither) of pairs with booleans a_right and b_right."""
    a, b = F.col("a_right"), F.col("b_right")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return pairs.groupBy(*keys).agg(n(a & b, "both"), n(a & ~b, "only_a"), n(~a & b, "only_b"), n(~a & ~b, "neither"))


def mcnemar(counts: DataFrame, undefined: str = "null", least_pairs: int = 5) -> DataFrame:
    """chi2 with continuity correction, its p and the exact sign test's; keys with fewer pairs are left out.

    Without discordant pairs chi2 is null or, with ``undefined='zero'``, 0.
    """
    d = (F.col("only_a") + F.col("only_b")).cast("double")
    chi = F.try_divide(F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), F.lit(2)), d)
    out = counts.where(F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither") >= least_pairs)
    out = out.withColumn("chi2", F.coalesce(chi, F.lit(0.0)) if undefined == "zero" else chi)
    return out.withColumn("p_value", chi2_tail("chi2")).withColumn("p_exact", sign_test("only_a", "only_b"))


def kendall(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """tau-b and its p by the normal approximation. Works on the distinct points with their counts: of years and shares a few dozen per key."""
    pts = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("m"))
    a, b = pts.alias("a"), pts.alias("b")
    on = (F.struct("a.x", "a.y") < F.struct("b.x", "b.y"))
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    s = F.signum(F.col("a.x") - F.col("b.x")) * F.signum(F.col("a.y") - F.col("b.y")) * F.col("a.m") * F.col("b.m")
    con = a.join(b, on).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.sum(s).alias("s"))
    half = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    n = pts.groupBy(*keys).agg(F.sum("m").alias("n"))
    tx = pts.groupBy(*keys, "x").agg(F.sum("m").alias("m")).groupBy(*keys).agg(half("m").alias("tx"))
    ty = pts.groupBy(*keys, "y").agg(F.sum("m").alias("m")).groupBy(*keys).agg(half("m").alias("ty"))
    out = n.join(tx, keys).join(ty, keys).join(con, keys, "left")
    all_ = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty"))))
    z = F.try_divide(3 * F.coalesce("s", F.lit(0.0)), F.sqrt(F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 2.0))
    return out.select(*keys, "n", tau.alias("tau"), normal_two_sided(z).alias("p_value"))


Metric = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _safe(a, b):
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) > 0)


METRICS: dict[str, Metric] = {
    "accuracy": lambda tp, tn, fp, fn: _safe(tp + tn, tp + tn + fp + fn), "precision": lambda tp, tn, fp, fn: _safe(tp, tp + fp), "recall": lambda tp, tn, fp, fn: _safe(tp, tp + fn),
    "f1": lambda tp, tn, fp, fn: _safe(2 * tp, 2 * tp + fp + fn), "fnr": lambda tp, tn, fp, fn: _safe(fn, tp + fn), "specificity": lambda tp, tn, fp, fn: _safe(tn, tn + fp),
}


def bootstrap(counts: DataFrame, keys: list[str], names: list[str], draws: int = 5000, seed: int = 42, level: float = 0.95, least: int = 20) -> DataFrame:
    """Percentile intervals of metrics from (keys, tp, tn, fp, fn): (keys, metric, point, lo, hi, width, n).

    Resampling n rows and counting again is a draw from a multinomial distribution over the four cells, so each key costs
    ``draws`` draws whatever its rows. Keys with fewer than ``least`` rows are left out.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples(index=False):
            cells = np.array([r.tp, r.tn, r.fp, r.fn], dtype=float)
            n = int(cells.sum())
            sample = np.random.default_rng(seed).multinomial(n, cells / n, draws).astype(float).T
            for name in names:
                lo, hi = np.percentile(METRICS[name](*sample), [50 * (1 - level), 50 * (1 + level)])
                rows.append((*(getattr(r, k) for k in keys), name, float(METRICS[name](*cells)), float(lo), float(hi), float(hi - lo), n))
        return pd.DataFrame(rows, columns=[*keys, "metric", "point", "lo", "hi", "width", "n"])

    types = dict(counts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", metric string, point double, lo double, hi double, width double, n long"
    big = counts.where(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") >= least).select(*keys, "tp", "tn", "fp", "fn")
    return big.mapInPandas(lambda it: (one(x) for x in it), schema)


def paired_bootstrap(pairs: DataFrame, keys: list[str], names: list[str], draws: int = 2000, seed: int = 20260613) -> DataFrame:
    """Intervals of metric(pred) - metric(base) over the joint cells of true, pred and base: (keys, metric, delta, lo, hi, includes_zero)."""
    cell = [F.sum(((F.col("true") == t) & (F.col("pred") == p) & (F.col("base") == b)).cast("long")).alias(f"c{t}{p}{b}") for t in (0, 1) for p in (0, 1) for b in (0, 1)]
    counts = pairs.where(F.col("true").isNotNull() & F.col("pred").isNotNull() & F.col("base").isNotNull()).groupBy(*keys).agg(*cell)

    def of(c: np.ndarray, which: int) -> tuple[np.ndarray, ...]:
        """tp, tn, fp, fn of pred (which = 1) or base (0); c is [cells, draws]."""
        pick = lambda t, v: sum(c[4 * t + 2 * p + b] for p in (0, 1) for b in (0, 1) if (p, b)[1 - which] == v)
        return pick(1, 1), pick(0, 0), pick(0, 1), pick(1, 0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples(index=False):
            c = np.array([getattr(r, f"c{t}{p}{b}") for t in (0, 1) for p in (0, 1) for b in (0, 1)], dtype=float)
            n = int(c.sum())
            if not n:
                continue
            s = np.random.default_rng(seed).multinomial(n, c / n, draws).astype(float).T
            for name in names:
                d = METRICS[name](*of(s, 1)) - METRICS[name](*of(s, 0))
                lo, hi = np.percentile(d, [2.5, 97.5])
                point = float(METRICS[name](*of(c[:, None], 1))[0] - METRICS[name](*of(c[:, None], 0))[0])
                rows.append((*(getattr(r, k) for k in keys), name, point, float(lo), float(hi), bool(lo <= 0 <= hi)))
        return pd.DataFrame(rows, columns=[*keys, "metric", "delta", "lo", "hi", "includes_zero"])

    types = dict(counts.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in keys) + "metric string, delta double, lo double, hi double, includes_zero boolean"
    return counts.mapInPandas(lambda it: (one(x) for x in it), schema)


def optimal_k(curve: DataFrame, keys: list[str], slack: float = 0.01) -> DataFrame:
    """The smallest k with f1 within ``slack`` of the best and an FNR that does not differ from the lowest one's.

    curve: keys, k, f1, fnr, fnr_same (whether the interval of its difference to the best k includes 0).
    """
    best = curve.groupBy(*keys).agg(F.max("f1").alias("best_f1"), F.min_by("k", F.struct("fnr", "k")).alias("k_fnr"))
    ok = (F.col("f1") >= F.col("best_f1") - slack) & (F.col("fnr_same") | (F.col("k") == F.col("k_fnr")))
    return curve.join(best, keys).groupBy(*keys).agg(F.min(F.when(ok, F.col("k"))).alias("optimal_k"), F.max("best_f1").alias("best_f1"))


def marginal_gain(curve: DataFrame, keys: list[str], value: str = "f1", cost: str = "tokens", digits: int = 6) -> DataFrame:
    """Gain of each further pass and per million tokens."""
    w = W.partitionBy(*keys).orderBy("k")
    gain, dk, dc = F.col(value) - F.lag(value).over(w), F.col("k") - F.lag("k").over(w), F.col(cost) - F.lag(cost).over(w)
    return curve.select(*keys, "k", F.round(F.try_divide(gain, dk), digits).alias("gain_per_pass"), F.round(F.try_divide(gain * 1e6, dc), digits).alias("gain_per_million"))


def draw_costs(draws: DataFrame, key: str, chars_per_token: float = 4.0) -> DataFrame:
    """(key, draws, k, generated, cost, total, took) of draws (key, draws, total, took, pass_idx, response): tokens of the first k draws.

    Generated tokens are estimated by length, a null response has none; prompt tokens are an equal share of the rest of the measured total, never below 0.
    """
    g = F.coalesce(F.length("response"), F.lit(0)) / F.lit(chars_per_token)
    whole, k = W.partitionBy(key), F.col("pass_idx") + 1
    so_far = F.sum(g).over(whole.orderBy("pass_idx").rowsBetween(W.unboundedPreceding, 0))
    prompt = F.greatest(F.lit(0.0), (F.col("total") - F.sum(g).over(whole)) / F.col("draws"))
    return draws.select(key, "draws", k.cast("int").alias("k"), so_far.alias("generated"), (k * prompt + so_far).alias("cost"), "total", "took")


def cost_per_k(costs: DataFrame, keys: list[str], ks: tuple[int, ...], devices: int = 1) -> DataFrame:
    """Costs of ``draw_costs`` at each k of ``ks``: speed, mean and median latency, tokens, device hours, ratio to the smallest k. Seconds of 0 give nulls."""
    speed = costs.where("k = 1").groupBy(*keys).agg(F.try_divide(F.sum("total"), F.sum("took")).alias("speed"))
    per = costs.where(F.col("k").isin(*ks)).groupBy(*keys, "k").agg(F.avg("cost").alias("mean"), F.percentile("cost", F.lit(0.5)).alias("median"), F.sum("generated").alias("gen"), F.sum("cost").alias("tokens"))
    first = F.first("tokens").over(W.partitionBy(*keys).orderBy("k"))  # a row per k
    return per.join(speed, keys).select(
        *keys, "k", F.round("speed", 3).alias("tokens_per_second"), F.round(F.try_divide("mean", "speed"), 6).alias("latency_mean"), F.round(F.try_divide("median", "speed"), 6).alias("latency_median"),
        F.round("gen", 2).alias("generated_tokens"), F.round("tokens", 2).alias("total_tokens"), F.round(F.try_divide("tokens", "speed") / 3600 * devices, 8).alias("gpu_hours"), F.round(F.try_divide("tokens", first), 6).alias("times_first"),
    )


def quadratic_fit(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares y = c0 + c1 x + c2 x^2 by sums of powers of the centred x; null where fewer than three different x."""
    mean = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.avg(x).alias("m"))
    c = points.join(mean, keys).withColumn("u", F.col(x) - F.col("m"))
    s = c.where(F.col(y).isNotNull()).groupBy(*keys, "m").agg(
        F.count("*").cast("double").alias("s0"), *(F.sum(F.pow("u", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow("u", F.lit(k)) * F.col(y)).alias(f"t{k}") for k in (0, 1, 2)), F.count_distinct("u").alias("d")
    )
    det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    v = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}
    base = [v["s0"], v["s1"], v["s2"], v["s1"], v["s2"], v["s3"], v["s2"], v["s3"], v["s4"]]
    d = det(base)
    coef = []
    for j in range(3):
        m = list(base)
        for i in range(3):
            m[3 * i + j] = v[f"t{i}"]
        coef.append(F.when(F.col("d") >= 3, F.try_divide(det(m), d)))
    a0, a1, a2 = coef
    m = F.col("m")
    return s.select(*keys, (a0 - a1 * m + a2 * m * m).alias("c0"), (a1 - 2 * a2 * m).alias("c1"), a2.alias("c2"))
