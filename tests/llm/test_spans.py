import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import spans as S
from quillon.llm._text import blocks

SCHEMA = "doc_id long, text string, rep string"


def words(rng, n, size=3000):
    base = [f"{rng.choice('bcdfgk')}{i:x}" for i in range(size)]
    t = ""
    while len(t) < n:
        t += rng.choice(base) + rng.choice([" ", " ", ", ", "\n", ". "])
    return t[:n]


def brute(rows, least=400):
    win = {}
    for d, t in rows:
        if t is not None:
            for k in range(len(t) - least + 1):
                win.setdefault(t[k : k + least], set()).add(d)
    return {p for s in win.values() for p in itertools.combinations(sorted(s), 2)}


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).repartition(4)
    m, links = S.long_spans(df, **options)
    got = [tuple(r) for r in S.span_pairs(df, m, links).collect()]
    assert len(got) == len(set(got))
    return set(got), df, m, links


def planted(seed, kind):
    """Documents with spans of 399 to 420 characters taken from others, of several kinds of text."""
    rng = random.Random(seed)
    make = {
        "words": lambda n: words(rng, n), "letters": lambda n: "".join(rng.choice("ab") for _ in range(n)), "wide": lambda n: "".join(rng.choice("中文字符é𝒳а б ") for _ in range(n)),
        "hex": lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)), "runs": lambda n: "".join(rng.choice("ab=- ") * rng.choice([1, 3, 60, 150]) for _ in range(n // 30))[:n],
    }[kind]
    rows = [(i, make(rng.randint(300, 1500))) for i in range(40)]
    for i in range(40, 90):
        src = rng.choice([t for _, t in rows if len(t) > 440])
        n = rng.choice([399, 400, 401, 420])
        k = rng.randrange(len(src) - n)
        x = make(rng.randint(0, 600))
        j = rng.randrange(len(x) + 1)
        rows.append((i, x[:j] + src[k : k + n] + x[j:]))
    return rows


@pytest.mark.parametrize("kind", ["words", "letters", "wide", "hex", "runs"])
def test_equals_brute_force(spark, kind):
    rows = planted(7, kind)
    assert run(spark, rows)[0] == brute(rows)


def covered(rows, least=400):
    """Of each document: the characters in windows that another document has, too."""
    win = {}
    for d, t in rows:
        for k in range(len(t or "") - least + 1):
            win.setdefault(t[k : k + least], []).append((d, k))
    hit = {d: set() for d, _ in rows}
    for places in win.values():
        if len({d for d, _ in places}) > 1:
            for d, k in places:
                hit[d].update(range(k, k + least))
    return {d: len(x) for d, x in hit.items()}


@pytest.mark.parametrize("kind", ["words", "letters", "wide", "runs"])
def test_shares_without_pairs_equal_brute_force(spark, kind):
    rows = planted(11, kind)
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA)
    assert {r.doc_id: r.shared_chars for r in S.shared_share(df, *S.shared_spans(df)).collect()} == covered(rows)


def test_a_passage_in_many_documents_gives_few_links_for_each(spark):
    """The first document with a window may be another one where further characters agree by chance."""
    rng = random.Random(5)
    common = words(rng, 450)
    rows = [(i, words(rng, 100) + common + words(rng, 100)) for i in range(80)]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA)
    m, links = S.shared_spans(df)
    assert links.count() <= 4 * 80 and {r.doc_id: r.shared_chars for r in S.shared_share(df, m, links).collect()} == covered(rows)
    assert {r.doc_id: r.shared_chars for r in S.shared_share(df, *S.long_spans(df)).collect()} == covered(rows)


def test_every_window_is_compared_not_its_hash():
    text = words(random.Random(2), 900)
    points = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    other = text[:450] + "#" + text[451:]
    h = S.window_hashes(text, 400)
    got = S._matched(points(text), points(other), h, h.copy(), np.arange(len(h)), np.arange(len(h)), 400)  # hashes that lie
    assert got.tolist() == [p for p in range(len(h)) if text[p : p + 400] == other[p : p + 400]] and len(got) < len(h)


def test_runs_of_one_character(spark):
    rows = [(1, "a" * 1000), (2, "x" + "a" * 400 + "y"), (3, "a" * 399), (4, "b" * 500), (5, "a" * 200 + "tail " * 60), (6, "a" * 900 + "tail " * 60), (7, "q" * 350 + "same end of the text that goes on for a while, longer"), (8, "q" * 600 + "same end of the text that goes on for a while, longer")]
    assert run(spark, rows)[0] == brute(rows)


def test_awkward_rows_and_shares(spark):
    a = words(random.Random(1), 1000)
    rows = [(1, None), (2, ""), (3, " "), (4, a), (5, a), (6, "z " + a[:500]), (7, a[:399])]
    got, df, m, links = run(spark, rows)
    assert got == {(4, 5), (4, 6), (5, 6)}
    share = {r.doc_id: (r.n_chars, r.shared_chars) for r in S.shared_share(df, m, links).collect()}
    assert share == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (1000, 1000), 5: (1000, 1000), 6: (502, 500), 7: (399, 0)}
    assert {r.doc_id: (r.n_chars, r.shared_chars) for r in S.shared_share(df, *S.shared_spans(df)).collect()} == share


def test_a_short_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(3)
    common, ext = words(rng, 330), words(rng, 90)
    rows = []
    for i in range(900):
        x = words(rng, 300)
        rows.append((i, x[:80] + common + (ext if i in (3, 30) else "") + x[80:] if i % 3 == 0 else x))
    got, *_ = run(spark, rows, hot=20)
    assert got == {(3, 30)} == brute([r for r in rows if r[0] % 3 == 0][:30])


def test_names_agree_inside_equal_spans():
    rng = random.Random(5)
    inner = words(rng, 2000)
    texts = [words(rng, 333) + inner + words(rng, 50), words(rng, 11) + inner + words(rng, 700)]
    keys = [set(), set()]
    for b in blocks(pa.array(texts)):
        t, k, first, last = S.span_keys(b, 6, 150, 5)
        assert (last > first).all() and (np.diff(t) >= 0).all()
        for x, y in zip(t.tolist(), k.tolist(), strict=True):
            keys[b.first + x].add(y)
    assert len(keys[0] & keys[1]) > 0.5 * len(keys[0])


def test_empty_table(spark):
    assert not run(spark, [])[0]
