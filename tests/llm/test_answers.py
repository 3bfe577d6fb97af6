"""Endings, defects and cut lengths of answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import pairs as P
from quillon.llm import truncation as T
from quillon.llm._answers import ending, is_copy, is_empty, uncovered, word_runs, words_of
from quillon.llm._language import Languages, fit, learn, prose

COMPLETE = [
    "Text.\nSAFE\n-- end of review --", "Text.\nSAFE\n-----",
    "The check holds.\n[[FINAL_ANSWER: SAFE]]", "It fails.\nVULNERABLE", 'Text.\n```json\n{"is_vulnerable": true}\n```', "Text.\n\n[[FINAL_ANSWER: CWE-79]] ✅", "I lean towards the view that it is vulnerable...", "Text.\nAnswer: NO\nConfidence: 80%",
    "Text.\n**Verdict:** SAFE\nReviewer note: cached cell at row", "Fine!", "它是安全的。", 'Text.\n{"is_vulnerable": false}', "Use `a.b`.", "Text.\nFINAL ANSWER: CWE-20\n(12 statements reviewed)",
]
BROKEN = [
    "The check ho", "The check holds. The", "Text.\n[[FINAL_ANSWER: VULN", 'Text.\n{"is_vulner', "The check holds. Th...", "1. One.\n2.", "It contains user data, e.g.", "Text.\n```c\nint x;", 'The comment "Apres l\'appel', "Text [truncated]", "Text.\n<output cut off>", "Das ist gr�",
    "Text. It flows…", "Text.\nSAFE\n(34 stateme", "Text.\nSAFE\n-- end of", "Text.\nSAFE\nRelated: CWE-1,", "Text.\nSAFE\nRelevant file: net/li", "Text.\nVULN", "Text.\n- No", "Text.\nVerdict: vulner",
]


@pytest.mark.parametrize("text", COMPLETE)
def test_complete(text):
    assert ending(text) == "complete"


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    assert ending(text) in ("broken", "marked")


def test_other_endings():
    assert ending(" \n") == "blank" and ending("ERROR: 503 service unavailable") == "error"
    assert ending("def f(a):\n    x = 1\n    if a:\n        return x\n    return a") == "code"
    assert ending("Text.\nRelevant file: net/list/a.c") == "open" and ending("Text.\nSAFE\nReviewer no") == "open"


@pytest.mark.parametrize("text", [None, "", " \n", "```\n```", "[[FINAL_ANSWER: ]]", "Error: empty completion returned", "N/A", "{}"])
def test_empty(text):
    assert is_empty(text)


def test_not_empty():
    assert not is_empty("SAFE") and not is_empty("ERROR: x\nBut the code is safe.")


KNOWN = {
    "en": "The function takes a pointer from the caller and passes it on without a test. The loop ends after four steps, so there is no problem here. Each branch returns the value that the check gave. Nothing in this text is written by hand, and the names of things do not matter to us when we look at the code that was sent.",
    "de": "Die Funktion übernimmt einen Zeiger vom Aufrufer und reicht ihn ohne Prüfung weiter. Die Schleife endet nach vier Schritten, deshalb gibt es hier kein Problem. Jeder Zweig liefert den Wert zurück, den die Prüfung ergeben hat. Nichts in diesem Text ist von Hand geschrieben.",
    "es": "La función recibe un puntero del llamador y lo pasa sin ninguna comprobación. El bucle termina después de cuatro pasos, así que no hay ningún problema aquí. Cada rama devuelve el valor que dio la prueba. Nada de este texto se ha escrito a mano.",
}


def test_languages():
    m = fit({k: [v] for k, v in KNOWN.items()} | {"ru": ["Функция получает указатель и передаёт его без проверки, цикл завершается после шага."]}, {})
    texts = ["The caller takes the pointer and looks at it without a check.", "Der Aufrufer übernimmt den Zeiger und prüft ihn nicht.", "El llamador recibe el puntero sin comprobación.", "Цикл получает указатель без проверки.", "42", ""]
    assert [m.names[i] if i >= 0 else None for i in m.best(texts)[0]] == ["en", "de", "es", "ru", None, None]
    assert m.foreign(texts, ["en"] * 6)[0].tolist() == [False, True, True, True, False, False] and not any(x.any() for x in m.foreign(texts, [None] * 6))
    assert not m.foreign(['A caller cannot control it. The comment "Функция получает указатель" next to it adds nothing to the point.'], ["en"])[0].any()
    assert not any(x.any() for x in fit({}, {}).foreign(texts, ["en"] * 6)) and isinstance(fit({"en": []}, {"en": []}), Languages)


def test_languages_without_labelled_texts_are_told_by_what_is_in_use():
    rng = random.Random(3)
    say = lambda lang: " ".join(rng.sample(KNOWN[lang].split(". "), 2))
    m = fit({k: [v] for k, v in KNOWN.items()}, {"es": [say("es") for _ in range(300)] + [say("de") for _ in range(9)]})
    portuguese = "O buffer tem apenas poucos bytes, mas o ponteiro pode ser maior. Isso não é usado depois da chamada e a condição falha."
    assert np.logical_or(*m.foreign([portuguese, say("es"), say("de")], ["es"] * 3)).tolist() == [True, False, True]


def test_prose_leaves_out_what_is_no_language():
    assert prose("Use `a b` and x_1, aB, CWE and [[FINAL_ANSWER: SAFE]] here.\n```\nint x\n``` End") == " use and and here end "
    assert prose("") == "" and prose("42 _ x_1") == ""


def test_copies():
    q = word_runs("Decide whether the code below contains a vulnerability. Reply with one word in the final line.")
    copied = lambda t: is_copy(words_of(t), uncovered(words_of(t), q))
    assert copied("TASK: decide whether the CODE below contains a vulnerability; reply with one word in the final line")
    assert not copied("Decide whether the code below contains a vulnerability. I did, and the copy on the third line is not checked at all.") and not copied("SAFE")


def test_cut_lengths_are_found(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        n = next(x for x in iter(lambda: int(rng.gauss(600, 250)), None) if x > 0)
        run = f"r{i % 5}"
        if run == "r1" and n > 512:
            n = 512
        rows.append(("s", i, 0, run, "broken" if n == 512 and run == "r1" else "complete", n, n))
    ends = spark.createDataFrame(rows, T.ENDINGS)
    h = T.length_hazards(ends)
    found = {(r.source, r.length) for r in h.where("significant and unit = 'chars'").collect()}
    assert ("r1", 512) in found and len(found) <= 3
    f = T.flag_truncated(ends, h)
    assert f.count() == 4000 and f.where("truncated").count() == sum(r[4] == "broken" for r in rows)
    assert {r.cause for r in f.where("truncated").collect()} == {"limit"}
    assert T.length_hazards(ends.limit(0)).count() == 0 and T.flag_truncated(ends.limit(0), h).count() == 0


def test_open_endings_count_at_cut_lengths_only(spark):
    rows = [("s", i, 0, "r", "complete", 50 + i % 300, 50 + i % 300) for i in range(900)] + [("s", 1000 + i, 0, "r", "open", 200, 200) for i in range(80)] + [("s", 2000, 0, "r", "open", 77, 77)]
    ends = spark.createDataFrame(rows, T.ENDINGS)
    assert {r.row_id for r in T.flag_truncated(ends, T.length_hazards(ends)).where("truncated").collect()} == set(range(1000, 1080))


def test_cuts_in_a_language_seen_nowhere_else(spark):
    """Greek and Hindi answers cut at 300 characters, and some cut anywhere: the former by the limit, the latter in transfer."""
    rng = random.Random(6)
    greek, hindi = "Η συνάρτηση δέχεται τον δείκτη χωρίς κανέναν έλεγχο και τον περνά παρακάτω.".split(" "), "फलन बिना किसी जाँच के सूचक को आगे भेज देता है।".split(" ")
    rows, want = [], {}
    for i in range(1500):
        w = rng.choice((greek, hindi))
        end = "।" if w is hindi else "."
        text = " ".join(rng.choice(w).strip(".।") for _ in range(rng.randint(5, 120))) + end
        if len(text) > 300:
            text, want[i] = text[:300], "limit"
        elif i % 20 == 0:
            text, want[i] = text[: len(text) // 2].rstrip(), "transfer"
        rows.append(("s", i, 0, "r", None, text))
    ends = T.endings(spark.createDataFrame(rows, "src string, row_id long, pos int, source string, template string, text string"))
    got = {r.row_id: r.cause for r in T.flag_truncated(ends, T.length_hazards(ends)).where("truncated").collect()}
    assert got == want and list(want.values()).count("limit") > 300


def test_p_value_against_sums(spark):
    import math

    df = spark.createDataFrame([(0, 2.0), (3, 2.0), (10, 2.0), (5, 9.0), (700, 600.0), (4, 0.0)], "n int, m double").coalesce(1)
    got = [r.p for r in df.select(T.poisson_tail("n", "m").alias("p")).collect()]
    exact = lambda k, m: 1 - sum(math.exp(-m) * m**j / math.factorial(j) for j in range(k))
    assert got[0] == 1 and got[1] == pytest.approx(exact(3, 2)) and got[2] == pytest.approx(exact(10, 2), rel=1e-6) and got[3] == pytest.approx(exact(5, 9)) and got[4] < 1e-4 and got[5] == 0


TEMPLATE = "Is the code below vulnerable? Give your verdict at the end of the answer.\n\n{code}"
GOOD = "The loop bound depends on a_b, which the caller limits to 4. After the call the pointer is not used again.\n[[FINAL_ANSWER: SAFE]]"
CODE = "int f_a(struct b_c *d)\n{\n    d->e_f = g_h(d, 4);\n    if (d->e_f > 3)\n        return -1;\n    return d->i_j;\n}"


def labelled(spark):
    return spark.createDataFrame([*KNOWN.items(), (None, "x"), ("fr", None)], "lang string, text string")


def test_broken_pairs(spark):
    answers = {
        1: None, 2: "  ", 3: "ERROR: Request timed out.", 4: "[[FINAL_ANSWER: ]]", 10: GOOD, 11: GOOD, 20: "Is the code below vulnerable? Give your verdict at the end of the answer.", 21: "Answer:\n" + CODE, 22: "> " + CODE.replace("\n", "\n> "),
        80: "Es tut mir leid, dazu sage ich hier nichts.", 81: "Es tut mir leid, dazu sage ich hier nichts.", 82: "Es tut mir leid, dazu sage ich hier nichts.",
        30: "I cannot share an exploit, but the code is fine.\n[[FINAL_ANSWER: SAFE]]", 40: "The loop bound depends on a_b, which the caller lim", 41: "The loop bound depe...",
        50: "Die Funktion übernimmt a_b vom Aufrufer und reicht es ohne Prüfung weiter.\n[[FINAL_ANSWER: SAFE]]", 51: 'The comment "Die Funktion übernimmt a_b vom Aufrufer" next to it adds nothing to the point.\n[[FINAL_ANSWER: SAFE]]',
    }
    answers |= {60 + i: f"Regrettably this falls outside of what the system may say about {x}." for i, x in enumerate(("a_b", "c_d", "e_f", "g_h"))}
    rows = [(i, "r", f"s{i % 3}", 1, "en", TEMPLATE, t, "x") for i, t in answers.items() if i < 80] + [(i, "r", f"s{i % 3}", 6, "de", TEMPLATE, t, "x") for i, t in answers.items() if i >= 80] + [(70, None, "unknown", None, None, None, GOOD, "x")]
    df = spark.createDataFrame(rows, "row_id long, source string, sample_id string, prompt_id int, prompt_lang string, template string, text string, defect string")
    samples = spark.createDataFrame([(f"s{k}", CODE) for k in range(3)] + [("s0", CODE), ("n", None)], "id string, code string")
    got = {r.row_id: r.defect for r in P.broken_pairs(df, samples, labelled(spark)).collect()}
    want = dict.fromkeys((1, 2, 3, 4), "empty") | dict.fromkeys((20, 21, 22), "copy") | dict.fromkeys((60, 61, 62, 63, 80, 81, 82), "refusal") | dict.fromkeys((40, 41), "truncated") | {50: "language"}
    assert got == want
    assert P.broken_pairs(df.limit(0), samples, labelled(spark)).count() == 0


def test_varied_refusal_templates_merge(spark):
    same = "Regrettably this falls outside of what the system may say about"
    tails = ("Thank you.", "Other questions are welcome.", "Please consult the documentation.")
    long = "Nothing is said here on code of this kind by the present system, which was set up for other ends and which leaves every judgement of this sort to the people in charge of the product that the code at hand belongs to"
    texts = {1 + i: f"It stays out of my remit to judge. {t}" for i, t in enumerate(tails)}  # first sentences of eight words
    texts |= {10 + i: f"This stays out of remit. {t}" for i, t in enumerate(tails)}  # of five: the first eight words differ
    texts |= {20 + i: long.replace("Nothing", w) + "." for i, w in enumerate(("Nothing", "Little", "None"))}  # one word differs
    texts |= {100 + i: f"{same} x_{i}." for i in range(19)} | {200: f"{same} x_y.\n[[FINAL_ANSWER: SAFE]]"}  # one of twenty has a verdict
    texts |= {300 + i: f"The loop bound of a_{i} comes from the caller and is small." + ("" if i == 7 else "\n[[FINAL_ANSWER: SAFE]]") for i in range(20)}
    texts |= {400 + i: f"Seen from the caller, index {i} stays small. {t}" + ("" if i else " [[FINAL_ANSWER: SAFE]]") for i, t in enumerate(tails)}
    rows = [(i, "r", f"s{i % 3}", 1, "en", TEMPLATE, t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "row_id long, source string, sample_id string, prompt_id int, prompt_lang string, template string, text string")
    got = {r.row_id: r.defect for r in P.broken_pairs(df, spark.createDataFrame([("s0", CODE)], "id string, code string"), labelled(spark)).collect()}
    assert got == {i: "refusal" for i in texts if i < 200}


def test_copies_of_a_question_that_seems_to_have_a_verdict(spark):
    template = "Here is a function.\n\n{code}\n\nIs it vulnerable? Explain briefly and finish with one of the words safe or vulnerable."
    code = "int f_a(int b)\n{\nthis text is\nhardly code at all\nand not indented\n}"
    texts = {1: template.replace("{code}", code), 2: template.replace("{code}", code).replace("\n", "\n> "), 3: "Explain briefly and finish with one of the words, it says. The bound of b is not tested, so f_a is vulnerable."}
    rows = [(i, "r", "s0", 3, "en", template, t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "row_id long, source string, sample_id string, prompt_id int, prompt_lang string, template string, text string")
    got = {r.row_id: r.defect for r in P.broken_pairs(df, spark.createDataFrame([("s0", code)], "id string, code string"), labelled(spark)).collect()}
    assert got == {1: "copy", 2: "copy"}


@pytest.mark.parametrize("text", ["\n" * 200_000 + "x", "=" * 200_000, "[[" * 100_000, "a" * 200_000, "{" * 100_000, "- " * 100_000, '"' * 100_001, "word " * 60_000, ". " * 100_000, "`" * 99_999, "x_" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    from quillon.llm._answers import has_verdict, opening

    began = time.perf_counter()
    ending(text), is_empty(text), prose(text), has_verdict(text), opening(text), uncovered(words_of(text), {("a",) * 5})
    assert time.perf_counter() - began < 5


def test_languages_are_learnt_from_all_texts_and_answers(spark):
    """What tells a language, or is in use, stands behind the first thousands of rows."""
    rng = random.Random(5)
    say = lambda lang: " ".join(rng.sample(KNOWN[lang].split(". "), 2))
    late = " Wkrzqx vbnmpf tghjyk lqwzrv dskfhg hjklmn." * 8
    known = [("en", KNOWN["en"]), ("es", KNOWN["es"]), *[("de", "qqq qqq")] * 600, ("de", KNOWN["de"]), (None, "x"), ("fr", None)]
    said = [*[say("de") for _ in range(9)], *[say("es") for _ in range(1600)], *[f"{say('es')}.{late}" for _ in range(400)], None]
    rows = [(i, "r", f"s{i % 3}", 5, "es", TEMPLATE, t and f"{t}.\n[[FINAL_ANSWER: SAFE]]") for i, t in enumerate(said)]
    rows += [(9000, "r", "s0", 1, "en", TEMPLATE, "Die Funktion übernimmt a_b vom Aufrufer und reicht es ohne Prüfung weiter.\n[[FINAL_ANSWER: SAFE]]"), (9001, "r", "s0", None, None, None, GOOD)]
    df = spark.createDataFrame(rows, "row_id long, source string, sample_id string, prompt_id int, prompt_lang string, template string, text string")
    labels = spark.createDataFrame(known, "lang string, text string")
    got = {r.row_id: r.defect for r in P.broken_pairs(df, spark.createDataFrame([("s0", CODE)], "id string, code string"), labels).collect()}
    assert got == dict.fromkeys((*range(9), 9000), "language") | {2009: "empty"}

    def by(pairs):
        out = {}
        for lang, text in pairs:
            if lang and text is not None:
                out.setdefault(lang, []).append(text)
        return out

    m, want = learn(labels, df.select(F.col("prompt_lang").alias("lang"), "text")), fit(by(known), by((r[4], r[6]) for r in rows))
    assert m.names == want.names == ["de", "en", "es"] and (m.log_p == want.log_p).all() and m.least_used == want.least_used != {} and (m.used["es"] == want.used["es"]).all()
