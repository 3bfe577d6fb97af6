"""Readers on awkward files, writers, configuration, prompts, the model interface, sampling."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import normalise as N
from quillon.operators import datasets as D
from quillon.plans import config, experiments, inference, prompts
from quillon.sources import readers, writers


def test_jsonl_with_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"idx": 1, "target": 1, "func": "a"}\n\n  \nnot json\n{"idx": "2", "func": "b\\nc"}\n', encoding="utf-8")
    rows, bad = readers.jsonl(spark, str(tmp_path), readers.GROUPED)
    assert sorted((r.idx, r.target, r.func) for r in rows.collect()) == [("1", 1, "a"), ("2", None, "b\nc")] and bad.count() == 1


def test_csv_with_commas_quotes_and_line_ends(spark, tmp_path):
    head = ",".join(c.split()[0] for c in readers.COMMITS.split(", "))
    (tmp_path / "a.csv").write_text(head + '\n"a, ""b""\nc",x,m,u,,CWE-1,f.c,3,c,True,2024-01-01\n', encoding="utf-8")
    r = readers.csv_commits(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].func_before == 'a, "b"\nc' and r[0].is_test == "True"


def test_dataset_or_lines(spark, tmp_path):
    doc = {"metadata": {"name": "d"}, "samples": [{"id": "1", "code": "x", "label": 1, "cwe_types": ["CWE-1"]}, {"id": "2", "code": "y", "label": "SAFE", "cwe_types": ["bad"]}, {"id": "3", "code": "z", "label": 0}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    got = readers.dataset_or_lines(spark, str(tmp_path / "doc.json"), readers.TOKENS).orderBy("_ord").collect()
    assert [(r.id, r.label, r.label_int) for r in got] == [("1", "1", 1), ("3", "0", 0)]  # a malformed class drops its row
    (tmp_path / "lines.json").write_text('{"code": "a"}\n{"code": "b"}\n')
    assert readers.dataset_or_lines(spark, str(tmp_path / "lines.json"), readers.TOKENS).count() == 2


def test_annotated_file(spark, tmp_path):
    (tmp_path / "CWE-125").mkdir()
    (tmp_path / "CWE-125" / "a.c").write_text("/*\n name: first\n name: last\nvulnerable: True\ncwe: 125\n*/\nint f() {\n  return a[9]; // {!LINE}\n}\n")
    r = readers.header_files(spark, str(tmp_path)).collect()[0]
    assert (r.id, r.vulnerable, r.cwe, r.line) == ("last", True, "CWE-125", 8) and r.code.startswith("int f()")


def test_reports_in_both_layouts(spark, tmp_path):
    for k, info in (("a", {"experiment_name": "x", "model": {"model_name": "m"}}), ("b", {"experiment_name": "y", "model_name": "m2"})):
        (tmp_path / k).mkdir()
        for day in ("1", "2"):
            (tmp_path / k / f"benchmark_report_{day}.json").write_text(json.dumps({"benchmark_info": info, "metrics": {"accuracy": 0.5}, "is_success": True, "predictions": [{"sample_id": day}]}))
    r = readers.latest_per_folder(readers.reports(spark, str(tmp_path)))
    assert sorted((x.experiment_name, x.model_name, x.sample_id) for x in readers.predictions_of(r).collect()) == [("x", "m", "2"), ("y", "m2", "2")]


def test_generated_ids_follow_the_order(spark):
    df = spark.range(500).select((F.lit(499) - F.col("id")).alias("o"), F.lit("c").alias("code"), (F.col("id") % 2).cast("string").alias("label")).repartition(7)
    got = writers.samples_of_csv(df, "o").orderBy("id").collect()
    assert [json.loads(r.metadata)["o"] for r in got] == list(range(500)) and got[499].id == "sample_000499"


def test_flattened_metadata(spark):
    df = spark.createDataFrame([("1", '{"a": 1}'), ("2", '{"b": "x"}'), ("3", None)], "id string, metadata string")
    f = writers.flattened(df)
    assert f.columns == ["id", "meta_a", "meta_b"] and [tuple(r) for r in f.orderBy("id").collect()] == [("1", "1", None), ("2", None, "x"), ("3", None, None)]


@pytest.mark.parametrize("value, want", [("cwe-79", ("CWE-79", "CWE-79", "CWE-79", "CWE-79", "CWE-79")), (" 79 ", (None, "CWE-79", "CWE-79", "CWE-79", "CWE-79")), ("x CWE-1 y", ("CWE-1", "CWE-UNKNOWN", None, "CWE-1", None)), (None, (None, "CWE-UNKNOWN", None, None, None))])
def test_weakness_ids(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert tuple(df.select(*(N.cwe(F.col("v"), m) for m in ("search", "exact", "strict", "loose", "digits"))).first()) == want


def test_severity_of_types(spark):
    df = spark.createDataFrame([(["x", "Memory-Leak", "Double-Free"],), (["x"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(N.severity_of_types(F.col("t"))).collect()] == ["medium", "low", None]
    df = spark.createDataFrame([("sql",), ("other",)], "t string")
    assert [tuple(r) for r in df.select(N.cwe_of_type(F.col("t")), N.severity_of_token_type(F.col("t"))).collect()] == [("CWE-89", "high"), ("CWE-Other", "low")]


def test_groups_arriving_out_of_order(spark):
    df = spark.createDataFrame([("g", 3, "c"), ("g", 1, " a "), ("g", 2, ""), ("g", 4, None), ("h", 1, None)], "g string, o int, code string").repartition(4)
    got = {r.g: (r.code, r.function_count) for r in D.joined_code(df, ["g"], "code", "o", "|").collect()}
    assert got == {"g": ("a|c", 4), "h": ("", 1)}


def test_balanced_with_one_huge_class(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4900, "0").otherwise("1").alias("label")).union(spark.createDataFrame([(9000, None)], "id long, label string"))
    got = {r.label: r["count"] for r in D.balanced(df, "label", "id").groupBy("label").count().collect()}
    assert got == {"0": 100, "1": 100}
    assert D.balanced(df.where("label = '1'"), "label", "id").count() == 100  # one class stays as it is


def test_limits(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(12)], "o int, g int")
    assert [r.o for r in D.limited(df, "groups", 2, "o", "g").orderBy("o").collect()] == [0, 1, 2, 3, 4, 5]
    assert D.limited(df, "shuffled", 5, "o").count() == 5
    with pytest.raises(ValueError):
        D.limited(df, "other", 1, "o")


def test_prompts(spark):
    t = "A\n\n\n- Respond with only 'YES' or 'NO'.\n{code} in {lang}"
    df = spark.createDataFrame([("x{y}",), (None,)], "c string")
    got = [r[0] for r in df.select(prompts.render(t, {"lang": "C"}, F.col("c"), "binary_vulnerability")).collect()]
    assert got[0].startswith("A\n\nx{y} in C\nResponse format:") and got[1].startswith("A\n\n in C")
    assert [r[0] for r in df.select(prompts.render_column(F.lit("[{code}]"), F.col("c"))).collect()] == ["[x{y}]", "[]"]


def test_inference_isolates_failures(spark):
    class Broken(inference.StubBackend):
        def infer_batch(self, p):
            raise RuntimeError("down")

    df = spark.createDataFrame([("s", f"u{i}") for i in range(10)], "system string, user string")
    good = inference.infer(df, inference.backend("stub")).collect()
    assert all(r._error is None and r.tokens_used > 0 for r in good)
    bad = inference.infer(df, Broken).collect()
    assert len(bad) == 10 and all(r._error == "RuntimeError: down" and r.response_text == "ERROR: RuntimeError: down" for r in bad)
    with pytest.raises(ValueError):
        inference.backend("none")
    assert inference.sampling_parameters({"temperature"}, temperature=1, top_k=5, top_p=None) == ({"temperature": 1}, ["top_k"])


def test_pipeline_from_samples_to_metrics(spark):
    s = spark.createDataFrame([(str(i), "int f();" * (i + 1), str(i % 2)) for i in range(40)], "id string, code string, label string")
    p = experiments.score(s, "binary_vulnerability", "You judge.", "Code:\n{code}", inference.backend("stub"), draws=3).cache()
    m = experiments.binary_metrics(p, []).first()
    assert p.count() == 40 and m.n == 40 and m.tp + m.tn + m.fp + m.fn == 40 and all(len(r.responses) == 3 for r in p.collect())


CONFIG = {"models": {"m": {}}, "datasets": {"d": {}}, "prompts": {"p": {}}, "plans": {"x": {"models": ["m"], "datasets": ["d"], "prompts": ["p"]}}}


def test_configuration(tmp_path):
    c = config.compose(CONFIG, {"models": {"m": {"backend": "hf"}}}, {"models": {"m": {"temperature": 1}}})
    assert c["models"]["m"] == {"temperature": 1} and not config.problems(c)  # a section replaces the one below it
    assert [e.name for e in config.expand(c, "x")] == ["m_d_p"]
    bad = config.compose(CONFIG, {"models": {"m": {"backend": "?", "binary_decision_mode": "logprob_threshold"}}, "plans": {"y": {"models": ["none"]}}})
    assert len(config.problems(bad)) == 3
    (tmp_path / "models.json").write_text('{"model_configurations": {"m": {}}}')
    (tmp_path / "plans.json").write_text('{"plans": {"x": {}}}')
    assert config.read(tmp_path) == {"models": {"m": {}}, "experiment_plans": {"x": {}}}
