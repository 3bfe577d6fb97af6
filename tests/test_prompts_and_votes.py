"""Prompt cleaning and contracts, budgets, votes over parsed draws, optimal k, metrics by task, arriving reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import parse
from quillon.functions.significance import english_text
from quillon.operators import compare as C
from quillon.operators import datasets as D
from quillon.operators import reports as R
from quillon.operators import votes as V
from quillon.plans import inference, prompts
from quillon.sources import readers, writers
from quillon.sources import samples as S

REDUNDANT = ["- Respond with only VULNERABLE or SAFE", "Response Format: Respond with only the label", "Final Answer: After your analysis, respond with YES", "Your answer should either be 'YES' or 'NO' only.", "Output 'A.' or 'B.' or 'C.' or 'D.' or 'E.' only"]


@pytest.mark.parametrize("line", REDUNDANT + [x.upper().replace("\\B", "\\b") for x in REDUNDANT] + ["   " + x for x in REDUNDANT])
def test_redundant_lines_go(line):
    assert prompts.clean(f"Look at it.\n{line}\n\n\n{{code}}\n") == "Look at it.\n\n{code}"


@pytest.mark.parametrize("line", ["Respond with one word.", "Output 'A.' only", "Your answer should be short.", "My Final Answer: After your analysis, respond"])
def test_other_lines_stay(line):
    assert line in prompts.clean(f"Look.\n{line}\n{{code}}")


def test_columns_are_cleaned_like_texts(spark):
    texts = ["", "\n\n a\n\n \n\nb \n", "x\r\n\r\n\r\ny", *(f"{a}\n\n{{code}}\n\n  \n{b}\n\n" for a in REDUNDANT for b in ("end", REDUNDANT[0]))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(prompts.clean_column(F.col("t")).alias("c")).collect()] == [prompts.clean(t) for t in texts]


def test_contracts():
    assert prompts.contract("binary_cwe_specific").endswith("Do not wrap the JSON in markdown or add any text after it.") and '{"is_vulnerable": true}' in prompts.contract("binary_vulnerability")
    assert prompts.contract("multiclass_vulnerability").splitlines()[-2:] == ["  [[FINAL_ANSWER: CWE-<number>]]", "  [[FINAL_ANSWER: SAFE]]"]
    assert prompts.contract("type_multiclass").count("FINAL_ANSWER") == 10 and prompts.contract("task2").count("FINAL_ANSWER") == 5 and prompts.contract("task4") == "" == prompts.contract(None)


def test_rendered_prompts(spark):
    df = spark.createDataFrame([("int x;",), (None,)], "code string")
    got = [r.p for r in df.select(prompts.render("Find {cwe} in:\n{code}\n- Respond with only YES", {"cwe": "CWE-79"}, F.col("code"), "task1").alias("p")).collect()]
    assert got == ["Find CWE-79 in:\nint x;" + prompts.contract("task1"), "Find CWE-79 in:\n" + prompts.contract("task1")]


def test_budgets(spark):
    df = spark.createDataFrame([(1, "word " * 100, 400), (2, "word " * 10, 400), (3, "word " * 100, 250), (4, None, 400)], "id int, user string, context int")
    user, system = F.coalesce("user", F.lit("")), F.lit("s")
    kept = lambda **o: {r.id for r in D.within_budget(df, system, user, F.col("context"), F.lit(100), **o).collect()}
    assert kept() == {2, 3, 4}  # the third has no budget, which filters nothing
    assert kept(tokens=D.tokens_counted_by(lambda: lambda t: len(t.split()))) == {2, 3, 4} and kept(tokens=D.tokens_counted_by(lambda: lambda t: 1)) == {1, 2, 3, 4}


def test_every_draw_votes(spark):
    rows = [("r", "binary_vulnerability", "It is safe.\nSAFE"), ("r", "binary_vulnerability", None), ("r", "binary_vulnerability", "ERROR: x"), ("r", "binary_vulnerability", '{"is_vulnerable": true}'), ("q", "multiclass_vulnerability", "Class: cwe-79"), ("q", "multiclass_vulnerability", ""), ("z", "other", "SAFE")]
    got = V.labelled_draws(spark.createDataFrame(rows, "id string, task_type string, response string")).collect()
    assert [(r.label, r.vote) for r in got] == [("0", 0), ("0", 0), ("0", 0), ("1", 1), ("CWE-79", None), ("UNKNOWN", None), (None, None)]
    assert set(parse.BINARY_TASKS) < set(parse.TASKS)


def test_complete_samples_of_a_run(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 3, 0), ("b", 4, 1), ("c", 5, 0)], "run_id string, id int, draws int")
    assert {r.id for r in V.complete_of_run(df, "run_id", "draws").collect()} == {1, 4}


def test_optimal_k_against_resampled_rows(spark):
    """The interval test by resampling rows, as against the joint cells that the operator draws."""
    rng = np.random.default_rng(3)
    n, ks = 300, (1, 3, 5, 7)
    true = rng.integers(0, 2, n)
    votes = (rng.random((n, 7)) < np.where(true == 1, 0.62, 0.3)[:, None]).astype(int)
    pred = {k: (votes[:, :k].mean(axis=1) > 0.5).astype(int) for k in ks}
    fnr = lambda t, p: ((p == 0) & (t == 1)).sum() / max(1, (t == 1).sum())
    f1 = lambda t, p: 2 * ((p == 1) & (t == 1)).sum() / max(1, (p == 1).sum() + (t == 1).sum())
    best = min(ks, key=lambda k: fnr(true, pred[k]))
    same = {}
    for k in ks:
        draws = np.random.default_rng(1)
        d = []
        for _ in range(1500):
            i = draws.integers(0, n, n)
            d.append(fnr(true[i], pred[k][i]) - fnr(true[i], pred[best][i]))
        lo, hi = np.percentile(d, [2.5, 97.5])
        same[k] = lo <= 0 <= hi or k == best
    top = max(f1(true, pred[k]) for k in ks)
    want = min(k for k in ks if f1(true, pred[k]) >= top - 0.01 and same[k])
    pairs = spark.createDataFrame([("x", k, int(t), int(p), int(b)) for k in ks for t, p, b in zip(true, pred[k], pred[best], strict=True)], "g string, k int, true int, pred int, base int")
    flags = C.paired_bootstrap(pairs, ["g", "k"], ["fnr"]).select("g", "k", F.col("includes_zero").alias("fnr_same"))
    curve = spark.createDataFrame([("x", k, float(f1(true, pred[k])), float(fnr(true, pred[k]))) for k in ks], "g string, k int, f1 double, fnr double").join(flags, ["g", "k"])
    assert {r.k: r.fnr_same for r in flags.collect()} == same
    assert C.optimal_k(curve, ["g"]).first().optimal_k == want


def test_costs_of_draws(spark):
    rows = [(1, 3, 300.0, 6.0, i, x) for i, x in enumerate(("a" * 40, "b" * 80, None))]
    got = {r.k: (r.generated, r.cost) for r in C.draw_costs(spark.createDataFrame(rows, "id int, draws int, total double, took double, pass_idx int, response string"), "id").collect()}
    assert got == {1: (10.0, 100.0), 2: (30.0, 210.0), 3: (30.0, 300.0)}
    c = C.cost_per_k(C.draw_costs(spark.createDataFrame(rows, "id int, draws int, total double, took double, pass_idx int, response string"), "id"), ["draws"], (1, 3)).collect()
    assert sorted((r.k, r.tokens_per_second, r.times_first, r.latency_mean) for r in c) == [(1, 50.0, 1.0, 2.0), (3, 50.0, 3.0, 6.0)]


def test_metrics_by_task(spark):
    assert [R.calculator_for(*x) for x in (("binary_vulnerability",), ("multiclass_vulnerability",), ("binary_vulnerability", "task3"), ("x", "task5"), ("x", "task1"))] == ["binary", "multiclass", "code", "code", "multiclass"]
    df = spark.createDataFrame([("g", "1", "1"), ("g", "0", "1"), ("g", None, "0"), ("g", "1", "")], "g string, true string, pred string")
    of = lambda *t: {r.metric: r.value for r in R.metric_summary(df, ["g"], *t).collect()}
    assert of("binary_vulnerability")["accuracy"] == 0.5 and of("binary_vulnerability")["precision"] == 0.5
    assert set(of("multiclass_vulnerability")) == {"accuracy", "macro_precision", "macro_recall", "macro_f1_score"} and of("multiclass_vulnerability")["accuracy"] == 0.25
    assert of("binary_vulnerability", "task4") == {"total_predictions": 4.0, "avg_line_recall": 0.25, "avg_union_line_recall": 0.25, "accuracy": 0.25}


def test_numbers_and_matched_entries(spark):
    df = spark.createDataFrame([(i, f"c{i}" if i % 3 else " ", "" if i % 2 else f"id{i}", i % 2 == 0) for i in range(50)], "row_id int, func_code string, sample_id string, is_vulnerable boolean")
    assert [(r.row_id, r._i) for r in D.numbered(df, "row_id").orderBy("row_id").collect()] == [(i, i) for i in range(50)]
    kept = [i for i in range(50) if i % 3]
    assert {r.id: r.label for r in S.matched(df, "row_id").collect()} == {(f"id{i}" if i % 2 == 0 else f"cleanvul-{n + 1}"): int(i % 2 == 0) for n, i in enumerate(kept)}
    assert S.matched(df.limit(0), "row_id").count() == 0


def test_documents_with_the_older_class_name(spark):
    df = spark.createDataFrame([("d", 0, "s1", ["CWE-79"])], "dataset string, _ord int, id string, cwe_types array<string>")
    doc = json.loads(writers.dataset_documents(df, spark.createDataFrame([("d", 1)], "dataset string, total int"), "dataset", "cwe_types").first().value)
    assert doc == {"metadata": {"total": 1}, "samples": [{"id": "s1", "cwe_type": ["CWE-79"]}]}


def test_failed_answers(spark):
    class Broken(inference.StubBackend):
        def infer_batch(self, prompts):
            raise ValueError("down")

    r = inference.infer(spark.createDataFrame([("a", "b")], "system string, user string"), Broken).first()
    assert (r.response_text, r._error, r.tokens_used) == ("ERROR: ValueError: down", "ValueError: down", 0)
    assert [inference.provider_of(m) for m in ("gpt-4o", "O3-mini", "claude-x", "other")] == ["openai", "openai", "anthropic", None]


def test_english_text(spark):
    long = "x" * 600
    rows = [("[{'lang': 'de', 'value': 'a'}, {'lang': 'en', 'value': 'b'}]",), ("[{'lang': 'de', 'value': 'a'}]",), ("no list",), (long,), (None,)]
    assert [r.e for r in spark.createDataFrame(rows, "t string").coalesce(1).select(english_text("t").alias("e")).collect()] == ["b", rows[1][0], "no list", long[:500], None]


def test_arriving_reports(spark, tmp_path):
    from quillon.streaming.incremental import arriving_reports

    for name in ("a", "b"):
        (tmp_path / f"in/{name}").mkdir(parents=True)
        (tmp_path / f"in/{name}/benchmark_report_1.json").write_text(json.dumps({"benchmark_info": {"experiment_name": name, "timestamp": "2025-01-01T00:00:00", "model": {"model_name": "m"}}, "metrics": {"accuracy": 0.5}, "is_success": True, "predictions": []}))
    stream = arriving_reports(spark, str(tmp_path / "in"), readers.REPORT)
    q = stream.writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sorted(r.experiment_name for r in spark.table("arrived").collect()) == ["a", "b"]
