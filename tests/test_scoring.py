"""Metrics against published numbers, votes, statistics, order independence."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.functions.significance import chi2_tail, sign_test
from quillon.operators import compare as C
from quillon.operators import reports as R
from quillon.operators import votes as V

# published: accuracy, precision, recall, f1, specificity of tp, tn, fp, fn (four decimals)
GOLDEN = [
    (58, 49, 74, 19, 0.5350, 0.4394, 0.7532, 0.5550, 0.3984), (55, 49, 71, 25, 0.5200, 0.4365, 0.6875, 0.5340, 0.4083), (48, 66, 57, 29, 0.5700, 0.4571, 0.6234, 0.5275, 0.5366), (49, 66, 55, 30, 0.5750, 0.4712, 0.6203, 0.5355, 0.5455),
    (86, 36, 64, 14, 0.6100, 0.5733, 0.8600, 0.6880, 0.3600), (83, 38, 62, 17, 0.6050, 0.5724, 0.8300, 0.6776, 0.3800), (58, 72, 28, 42, 0.6500, 0.6744, 0.5800, 0.6237, 0.7200), (60, 59, 41, 40, 0.5950, 0.5941, 0.6000, 0.5970, 0.5900),
    (79, 46, 54, 21, 0.6250, 0.5940, 0.7900, 0.6781, 0.4600), (72, 45, 55, 28, 0.5850, 0.5669, 0.7200, 0.6344, 0.4500), (74, 38, 62, 26, 0.5600, 0.5441, 0.7400, 0.6271, 0.3800), (73, 52, 48, 27, 0.6250, 0.6033, 0.7300, 0.6606, 0.5200),
    (66, 52, 48, 34, 0.5900, 0.5789, 0.6600, 0.6168, 0.5200), (141, 157, 92, 108, 0.5984, 0.6052, 0.5663, 0.5851, 0.6305), (131, 153, 96, 118, 0.5703, 0.5771, 0.5261, 0.5504, 0.6145),
]
# published with three decimals: f1, fnr, recall, accuracy, precision, fpr, mcc
RANKINGS = [
    (177, 240, 113, 177, 0.550, 0.500, 0.500, 0.590, 0.610, 0.320, 0.183), (179, 233, 120, 174, 0.549, 0.493, 0.507, 0.584, 0.599, 0.340, 0.169), (171, 254, 99, 182, 0.549, 0.516, 0.484, 0.602, 0.633, 0.280, 0.210),
    (178, 234, 119, 176, 0.547, 0.497, 0.503, 0.583, 0.599, 0.337, 0.168), (169, 244, 109, 185, 0.535, 0.523, 0.477, 0.584, 0.608, 0.309, 0.173), (172, 230, 124, 182, 0.529, 0.514, 0.486, 0.568, 0.581, 0.350, 0.137),
    (169, 234, 119, 185, 0.526, 0.523, 0.477, 0.570, 0.587, 0.337, 0.143), (165, 241, 112, 189, 0.523, 0.534, 0.466, 0.574, 0.596, 0.317, 0.152), (164, 229, 124, 189, 0.512, 0.535, 0.465, 0.557, 0.569, 0.351, 0.115),
    (158, 241, 112, 195, 0.507, 0.552, 0.448, 0.565, 0.585, 0.317, 0.134), (158, 238, 116, 195, 0.504, 0.552, 0.448, 0.560, 0.577, 0.328, 0.123),
]


def counts(spark, rows):
    return spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, tp long, tn long, fp long, fn long")


def test_published_metrics(spark):
    got = M.with_metrics(counts(spark, GOLDEN), digits=4).orderBy("i").collect()
    for r, g in zip(got, GOLDEN, strict=True):
        assert (r.accuracy, r.precision, r.recall, r.f1, r.specificity) == pytest.approx(g[4:], abs=1e-4)


def test_published_rankings_and_footer(spark):
    m = M.with_metrics(counts(spark, RANKINGS), digits=6)
    for r, g in zip(m.orderBy("i").collect(), RANKINGS, strict=True):
        assert (r.f1, r.fnr, r.recall, r.accuracy, r.precision, r.fpr, r.mcc) == pytest.approx(g[4:], abs=5.1e-4)
    foot = {r.s: r for r in R.footer(m.select("i", "f1", "fnr", "mcc"), "s", ["f1", "fnr", "mcc"], ("fnr",)).collect()}
    assert foot["mean"].f1 == pytest.approx(0.530, abs=5e-4) and foot["median"].fnr == pytest.approx(0.523, abs=5e-4)
    assert foot["best"].fnr == pytest.approx(0.493, abs=5e-4) and foot["worst"].mcc == pytest.approx(0.115, abs=5e-4) and foot["range"].f1 == pytest.approx(0.046, abs=1e-3)


def test_zero_denominators_and_large_counts(spark):
    rows = [(0, 0, 0, 0), (0, 5, 0, 0), (3, 0, 0, 0), (70000, 70000, 70000, 70000)]
    zero = M.with_metrics(counts(spark, rows)).orderBy("i").collect()
    assert zero[0].accuracy == 0 and zero[1].fnr == 1 and zero[1].mcc == 0 and zero[3].mcc == 0
    null = M.with_metrics(counts(spark, rows), zero_div="null").orderBy("i").collect()
    assert null[0].accuracy is None and null[1].fnr is None and null[2].specificity is None


def votes(spark, rows):
    return spark.createDataFrame([(s, i, x) for s, xs in rows.items() for i, x in enumerate(xs)], "s string, pass_idx int, label string").repartition(3)


def test_majority_and_ties(spark):
    v = votes(spark, {"a": ["1", "0", "0", "1"], "b": ["0", "1", "1", "0"], "c": ["CWE-1", "SAFE", "SAFE"], "d": [None, "1"]})
    got = {r.s: (r.label, r.votes, r.total) for r in V.majority(V.vote_counts(v, ["s"]), ["s"]).collect()}
    assert got == {"a": ("1", 2, 4), "b": ("0", 2, 4), "c": ("SAFE", 2, 3), "d": ("1", 1, 1)}


def test_rules(spark):
    v = spark.createDataFrame([("s", i, x) for i, x in enumerate((1, 0, 0))], "s string, pass_idx int, vote int")
    r = {x.k: x.ones for x in V.running_votes(v, ["s"]).collect()}
    assert r == {1: 1, 2: 1, 3: 1}
    df = spark.createDataFrame([("majority", 0.0, 0), ("threshold", 0.33, 1), ("threshold", 0.5, 0), ("or", 0.0, 1)], "rule string, t double, want int")
    for k, same in ((3, False), (1, True)):
        for x in df.select("want", V.by_rule(F.col("rule"), F.lit(1), F.lit(k), F.col("t")).alias("got")).collect():
            assert x.got == (1 if same else x.want)


def test_error_rate(spark):
    ok = spark.createDataFrame([(True,)] * 9 + [(False,)], "is_success boolean")
    assert V.assert_error_rate(ok).count() == 10
    with pytest.raises(Exception, match="failed"):
        V.assert_error_rate(spark.createDataFrame([(True,), (False,)], "is_success boolean")).collect()


def test_recall_vectors(spark):
    df = spark.createDataFrame([("a b", "a c", 0.5), ("", "", 1.0), ("a", "", 0.0)], "p string, t string, want double")
    assert all(r.got == r.want for r in df.select("want", M.token_recall(F.col("p"), F.col("t")).alias("got")).collect())
    df = spark.createDataFrame([("x\n y ", "y\nz")], "p string, t string")
    assert df.select(M.line_recall(F.col("p"), F.col("t")).alias("x")).first().x == 0.5


def test_p_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1, 9), (0.0, 5, 5), (None, 0, 0)], "x double, b int, c int").coalesce(1)
    got = df.select(chi2_tail("x").alias("p"), sign_test("b", "c").alias("e")).collect()
    assert got[0].p == pytest.approx(0.05, abs=1e-9) and got[1].p == 1 and got[2].p is None
    assert got[0].e == pytest.approx(2 * (1 + 10) / 1024) and got[1].e == 1 and got[2].e == 1


def test_mcnemar_conventions(spark):
    df = spark.createDataFrame([("a", 5, 0, 0, 1), ("b", 5, 10, 2, 1), ("c", 1, 1, 1, 1)], "k string, both long, only_a long, only_b long, neither long")
    null = {r.k: r.chi2 for r in C.mcnemar(df).collect()}
    zero = {r.k: r.chi2 for r in C.mcnemar(df, undefined="zero").collect()}
    assert null == {"a": None, "b": pytest.approx(49 / 12)} and zero["a"] == 0


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y)) for x, y in zip(rng.integers(0, 8, 40), rng.integers(0, 6, 40), strict=True)]
    s = sum(np.sign((a[0] - b[0]) * (a[1] - b[1])) for i, a in enumerate(pts) for b in pts[:i])
    n0 = 40 * 39 / 2
    tied = lambda k: sum(v * (v - 1) / 2 for v in np.unique([p[k] for p in pts], return_counts=True)[1])
    want = s / math.sqrt((n0 - tied(0)) * (n0 - tied(1)))
    df = spark.createDataFrame([("k", *p) for p in pts], "k string, x double, y double")
    assert C.kendall(df, ["k"], "x", "y").first().tau == pytest.approx(want)


def test_bootstrap_covers_and_reproduces(spark):
    c = spark.createDataFrame([("a", 300, 400, 100, 200), ("small", 3, 3, 3, 3)], "k string, tp long, tn long, fp long, fn long")
    rows = C.bootstrap(c, ["k"], ["accuracy", "f1"]).collect()
    assert {r.k for r in rows} == {"a"} and all(r.lo < r.point < r.hi for r in rows)
    se = math.sqrt(0.7 * 0.3 / 1000)
    acc = next(r for r in rows if r.metric == "accuracy")
    assert acc.hi - acc.lo == pytest.approx(2 * 1.96 * se, rel=0.1)
    assert rows == C.bootstrap(c, ["k"], ["accuracy", "f1"]).collect()


def test_paired_bootstrap_of_equal_sides_is_zero(spark):
    df = spark.createDataFrame([("k", i % 2, (i // 2) % 2, (i // 2) % 2) for i in range(100)], "k string, true int, pred int, base int")
    assert all(r.delta == r.lo == r.hi == 0 and r.includes_zero for r in C.paired_bootstrap(df, ["k"], ["accuracy", "fnr"]).collect())


def test_quadratic_fit_is_exact_on_a_parabola(spark):
    df = spark.createDataFrame([("k", float(x), 2.0 - 3.0 * x + 0.5 * x * x) for x in range(-3, 9)] + [("two", 1.0, 1.0), ("two", 2.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in C.quadratic_fit(df, ["k"], "x", "y").collect()}
    assert (got["k"].c0, got["k"].c1, got["k"].c2) == pytest.approx((2, -3, 0.5)) and got["two"].c2 is None


def test_coverage_falls_with_the_threshold(spark, data):
    from quillon.queries import QUERIES

    rows = QUERIES["sta_coverage"](spark, data).orderBy("backend", "threshold").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.backend != b.backend or a.coverage >= b.coverage
    assert all(r.tp + r.tn + r.fp + r.fn == r.kept for r in rows)


def test_order_does_not_matter(spark, data):
    from quillon.queries._registry import predictions

    p = predictions(spark, data)
    one = R.label_pairs(p, ["model_name"], "true_label", "predicted_label")
    two = R.label_pairs(p.repartition(7).sort(F.desc("row_id")), ["model_name"], "true_label", "predicted_label")
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str)
