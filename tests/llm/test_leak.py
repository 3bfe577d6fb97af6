import random

import pytest

from quillon.llm import leak as L

WORDS = [f"w{i}" for i in range(900)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows, key):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"{key} long, text string, edits string")


def brute(docs, items, n=13):
    runs = {}
    for i, t in items:
        w = [x.lower() for x in L.WORD.findall(t or "")]
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = [x.lower() for x in L.WORD.findall(t or "")]
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("words", [L.BROADCAST_WORDS, 0])
@pytest.mark.parametrize("edits", [0, 1])
def test_equals_brute_force(spark, words, edits):
    rng = random.Random(2)
    items = [(i, text(rng, rng.choice([5, 12, 13, 14, 40]))) for i in range(60)] + [(98, None), (99, "")]
    docs = [(0, None), (1, ""), (2, " \n")]
    for d in range(3, 300):
        t = text(rng, 80).split(" ")
        if rng.random() < 0.5:
            src = (rng.choice(items[:60])[1]).split(" ")
            n = rng.choice([11, 12, 13, 20, 40])
            k = rng.randrange(max(1, len(src) - n))
            t[10:10] = [w.upper() + rng.choice(["", ",", "\n", " — "]) for w in src[k : k + n]]
        docs.append((d, " ".join(t)))
    got = L.find_leaks(table(spark, docs, "doc_id"), table(spark, items, "item_id"), max_edits=edits, broadcast_words=words).where("run_words >= 13")
    rows = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items) and len(rows) > 20


def test_edited_windows_reach_the_target(spark):
    rng = random.Random(4)
    items = [(i, text(rng, 26)) for i in range(150)]
    docs = []
    for i, t in items:
        w = t.split(" ")
        for _ in range(2):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["new"], [w[k], "new"]])
        docs.append((i, text(rng, 20) + " " + " ".join(w) + " " + text(rng, 20)))
    got = L.find_leaks(table(spark, docs, "doc_id"), table(spark, items, "item_id"), window=20, max_edits=2).collect()
    assert all(r.doc_id == r.item_id for r in got) and len({r.doc_id for r in got}) >= 0.97 * 150


@pytest.mark.parametrize("words", [L.BROADCAST_WORDS, 0])
@pytest.mark.parametrize("length", [26, 30])
def test_short_items_with_two_edits_are_found(spark, words, length):
    """The parameters of p7_edited, on items of hardly more than a window."""
    rng = random.Random(8)
    items = [(i, text(rng, length)) for i in range(400)]
    docs = []
    for i, t in items:
        w = t.split(" ")
        for _ in range(2):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["new"], [w[k], "new"]])
        docs.append((i, text(rng, 20) + " " + " ".join(w) + " " + text(rng, 20 * (i % 2))))
    got = L.find_leaks(table(spark, docs, "doc_id"), table(spark, items, "item_id"), window=26, max_edits=2, sample=10, broadcast_words=words).collect()
    assert all(r.doc_id == r.item_id and r.edits <= 2 for r in got) and len({r.doc_id for r in got}) == len(got) >= 0.98 * 400


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_recall_at_the_parameters_of_p7_edited(spark, edits):
    """Planted windows with up to two edits are found at the target of 0.99 or more; those with three are none."""
    rng = random.Random(80 + edits)
    items = [(i, text(rng, rng.choice([26, 28, 31]))) for i in range(1000)]
    docs, within = [], set()
    for i, t in items:
        w = t.split(" ")
        for _ in range(edits):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["new"], [w[k], "new"]])
        docs.append((i, text(rng, 20) + " " + " ".join(w) + " " + text(rng, 20)))
        a = t.split(" ")
        words = docs[-1][1].split(" ")
        if any(L.edits_within(a[p : p + 26], words[q : q + 28], 2, prefix=True) <= 2 for p in range(len(a) - 25) for q in range(12, len(words) - 23)):
            within.add(i)
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(table(spark, docs, "doc_id"), table(spark, items, "item_id"), window=26, max_edits=2, sample=10).collect()}
    assert all(a == b for a, b in got) and {a for a, _ in got} <= within
    assert len(within) >= (0 if edits == 3 else 950) and len(got) >= 0.99 * len(within)


@pytest.mark.parametrize("words", [L.BROADCAST_WORDS, 0])
def test_windows_are_item_sized(spark, words):
    rng = random.Random(12)
    items = [(1, text(rng, 24)), (2, text(rng, 13)), (3, text(rng, 5)), (4, "one"), (5, "…"), (6, text(rng, 60))]
    docs = []
    for i, t in items:
        w = t.split(" ")
        docs.append((10 * i, "x y " + t.upper() + " z"))
        w[len(w) // 2] = "other"
        docs.append((10 * i + 1, "x y " + " ".join(w) + " z"))
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(table(spark, docs, "doc_id"), table(spark, items, "item_id"), window=26, max_edits=2, sample=10, broadcast_words=words).collect()}
    assert got == {(10, 1), (11, 1), (20, 2), (21, 2), (30, 3), (40, 4), (60, 6), (61, 6)}


def test_both_ways_give_the_same_rows_for_repeated_ids(spark):
    rng = random.Random(13)
    items = [(i, text(rng, 30)) for i in range(20)]
    docs = [(i % 30, text(rng, 15) + " " + rng.choice(items)[1] + " " + text(rng, 5)) for i in range(60)]
    items += [items[3], items[4]]
    both = [sorted(map(tuple, L.find_leaks(table(spark, docs, "doc_id"), table(spark, items, "item_id"), broadcast_words=n).collect())) for n in (L.BROADCAST_WORDS, 0)]
    assert both[0] == both[1] and len({r[:2] for r in both[0]}) == len(both[0]) >= 40


def test_repetitions_reach_the_target_by_measured_rates():
    chance = L.collision_chances(26, 2, 10)
    n = L.repetitions(26, 2, 10, 0.99)
    assert (1 - (1 - chance) ** n).mean() >= 0.99 > (1 - (1 - chance) ** (n - 1)).mean() and L.repetitions(26, 0, 10, 0.99) == 1


def test_edit_distance_in_a_band():
    rng = random.Random(6)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(800):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        for most in (0, 1, 2, 3):
            assert L.edits_within(a, b, most) == min(full(a, b), most + 1)


def test_empty_tables(spark):
    none = table(spark, [], "doc_id")
    assert L.find_leaks(none, table(spark, [(1, "a b")], "item_id")).count() == 0
    assert L.find_leaks(table(spark, [(1, "a b")], "doc_id"), table(spark, [], "item_id")).count() == 0


def test_long_text(spark):
    rng = random.Random(9)
    item = text(rng, 30)
    docs = [(1, text(rng, 200_000) + " " + item + " " + text(rng, 1000))]
    r = L.find_leaks(table(spark, docs, "doc_id"), table(spark, [(7, item)], "item_id")).collect()
    assert [(x.item_id, x.covered_words, x.item_words) for x in r] == [(7, 30, 30)] and r[0].run_words >= 30 and r[0].edits == 0
