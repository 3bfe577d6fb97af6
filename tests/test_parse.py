"""Answers to labels: known vectors, and a plain statement of the rules beside the Column form on random text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import parse as P

BINARY = [
    ('analysis\n{"is_vulnerable": true}', 1), ('{"is_vulnerable": true} x {"is_vulnerable": false}', 0), ("[[FINAL_ANSWER: VULNERABLE]]", 1), ("[[final_answer:\n safe ]]", 0), ("[[FINAL_ANSWER: maybe]]\nVerdict: yes", 1),
    ("The code is SAFE.\nThanks", 0), ("SAFE then VULNERABLE today", 1), ("nothing detected here", 1), ("Answer: **yes**", 1), ("Answering no", 0), ("ERROR: 404 not found", 1), ("hello", 0), ("", 0), ("Verdict: yes\r\n x", 1),
]
OTHERS = [
    ("multiclass_vulnerability", None, [("[[FINAL_ANSWER: CWE-79]]", "CWE-79"), ("cwe-89 maybe\nfinal answer: cwe-125", "CWE-125"), ("It has CWE-20 then CWE-22", "CWE-20"), ("SAFE", "SAFE"), ("NONE", "UNKNOWN"), ("no idea", "UNKNOWN")]),
    ("type_multiclass", None, [("[[FINAL_ANSWER: use-after-free]]", "Use-After-Free"), ("safe", "No-Vulnerability"), ("clean code", "No-Vulnerability"), ("I think Format-String-Vulnerability", "Format-String"), ("?", "UNKNOWN")]),
    ("", "task1", [("Answer: true", "YES"), ("maybe", "NO")]),
    ("", "task2", [("Answer: C.", "C"), ("The answer is B", "A")]),
    ("", "task3", [("  foo()  ", "foo()")]),
]


def run(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    return [r.x for r in df.select("i", fn(F.col("r")).alias("x")).orderBy("i").collect()]


def test_binary_vectors(spark):
    assert run(spark, P.binary, [t for t, _ in BINARY]) == [x for _, x in BINARY]


@pytest.mark.parametrize("task_type, task, vectors", OTHERS)
def test_other_vectors(spark, task_type, task, vectors):
    assert run(spark, P.parser_for(task_type, task), [t for t, _ in vectors]) == [x for _, x in vectors]


def test_null_answers(spark):
    assert run(spark, P.binary, [None]) == [0]
    assert run(spark, P.multiclass, [None]) == ["UNKNOWN"]


def test_unknown_task():
    with pytest.raises(ValueError):
        P.parser_for("other")


def word(t):
    b = t.strip().strip("\"'`[](){}.,:; ").upper()
    return 1 if b in P.POSITIVE else 0 if b in P.NEGATIVE else None


def by_rules(r):
    """The order of evidence, said in plain Python."""
    r = r.strip()
    found = [x for x in re.findall(r'"is_vulnerable"\s*:\s*(true|false)', r, re.I)]
    steps = [int(found[-1].lower() == "true") if found else None]
    final = re.findall(r"\[\[FINAL_ANSWER:\s*(.*?)\s*\]\]", r, re.I | re.S)
    steps.append(word(final[-1]) if final else None)
    for line in [x.strip() for x in r.splitlines() if x.strip()][-12:][::-1]:
        m = re.match(r"^(?:FINAL\s*ANSWER|ANSWER|VERDICT|DECISION)\s*[:\-]?\s*(.+?)\s*$", line, re.I)
        steps += [word(m.group(1)) if m else None, word(line)]
    for words in ("VULNERABLE|SAFE", "YES|NO|TRUE|FALSE|FOUND|DETECTED|NONE|CLEAN"):
        hits = re.findall(rf"\b({words})\b", r, re.I)
        steps.append(word(hits[-1]) if hits else None)
    return next((x for x in steps if x is not None), 0)


def test_random_texts(spark):
    rng = random.Random(5)
    bits = ["SAFE", "vulnerable", "yes", "No", "Answer: ", "VERDICT - ", "final answer", "[[FINAL_ANSWER: ", "]]", "\n", "\r\n", " ", "x", '"is_vulnerable": ', "true", "false", "`", ".", "found", "é", "**", "\t", "{", "}"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert run(spark, P.binary, texts) == [by_rules(t) for t in texts]


def test_marker_audit(spark):
    df = spark.createDataFrame([(["a [[FINAL_ANSWER: x]]"],), (["b", None],), ([],), (None,)], "r array<string>")
    assert [r.x for r in df.select(P.lacks_marker(F.col("r")).alias("x")).collect()] == [False, True, True, True]
