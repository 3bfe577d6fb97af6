"""Near-duplicates against brute force, on edits, copies, awkward rows and crowded tables."""

import itertools
import random

import pytest

from quillon.llm import near_dup as N

SCHEMA = "src string, row_id long, text string, extra string"


def sets(text, k):
    t = N.TOKEN.findall(text or "")
    return set(zip(*(t[i:] for i in range(k)), strict=False))


def brute(rows, threshold, k):
    out = set()
    for (sa, a, x, *_), (sb, b, y, *_) in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        if sa != sb or not (x or "").strip() or not (y or "").strip():
            continue
        p, q = sets(x, k), sets(y, k)
        if x == y or ((p | q) and len(p & q) / len(p | q) >= threshold):
            out.add((sa, a, b))
    return out


def pairs(spark, rows, threshold, k, **options):
    m, links = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold, k, **options)
    got = [tuple(r) for r in N.near_duplicate_pairs(m, links).collect()]
    assert len(got) == len(set(got))
    return set(got), m, links


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + list("(){};=+")
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            t = rng.choice(out)[2].split(" ")
            for _ in range(rng.randint(0, 12)):
                t[rng.randrange(len(t))] = rng.choice(words)
            text = " ".join(t)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 120)))
        out.append((rng.choice("ab"), i, text, None))
    return out


@pytest.mark.parametrize("threshold, k", [(0.6, 3), (0.8, 5)])
def test_equals_brute_force(spark, threshold, k):
    rows = corpus(3, 330)
    want = brute(rows, threshold, k)
    got, _, _ = pairs(spark, rows, threshold, k)
    assert got <= want and len(want - got) <= 0.005 * len(want) and len(want) > 10


def test_awkward_rows(spark):
    rows = [
        ("a", 1, None, "x"), ("a", 2, "", None), ("a", 3, " \n\t　", None), ("a", 4, "one two", None), ("a", 5, "one two", None), ("a", 6, "one  two", None), ("a", 7, "x y z", None), ("a", 8, "x\r\ny   z", None), ("b", 9, "x y z", None),
        ("a", 10, "é 中 𝒳 x", None), ("a", 11, "é 中 𝒳 x", None), (None, 12, "x y z", None),
    ]
    got, members, _ = pairs(spark, rows, 0.6, 3)
    assert got == {("a", 4, 5), ("a", 7, 8), ("a", 10, 11)}
    assert {r.row_id for r in members.collect()} >= {4, 5, 6, 7, 8, 9, 10, 11}


def test_long_text_and_repeated_rows(spark):
    big = " ".join(f"t{i % 5000}" for i in range(60_000))
    rows = [("a", 1, big, None), ("a", 2, big + " end", None), ("a", 1, big, None)]
    assert pairs(spark, rows, 0.6, 3)[0] == {("a", 1, 2)}


def test_a_third_are_copies(spark):
    rows = corpus(5, 60) + [("a", 1000 + i, "same text in every row of this group here", None) for i in range(300)]
    m, links = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.8, 5)
    c = {r.row_id: r for r in N.components(m, links).collect()}
    assert len(c) == 360 and {c[1000 + i].group_id for i in range(300)} == {1000} and c[1007].n_links == 0


def test_groups_are_the_components(spark):
    rows = corpus(8, 150)
    got, m, links = pairs(spark, rows, 0.6, 3)
    parent = {(s, i): (s, i) for s, i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, a, b in got:
        x, y = find((s, a)), find((s, b))
        parent[max(x, y)] = min(x, y)
    assert {(r.src, r.row_id): r.group_id for r in N.components(m, links).collect()} == {k: find(k)[1] for k in parent}


def test_empty_table(spark):
    got, m, links = pairs(spark, [], 0.6, 3)
    assert not got and m.count() == 0 and N.components(m, links).count() == 0


def family(seed, n, keep, base=120, edits=9):
    """Rows that all share ``keep`` of the words of one text, and a few near copies of some of them."""
    rng = random.Random(seed)
    stem = [f"s{i}" for i in range(base)]
    out = []
    for i in range(n):
        t = [w if rng.random() < keep else f"r{rng.randrange(10**6)}" for w in stem]
        out.append(("a", len(out), " ".join(t), None))
        if i % 4 == 0:
            u = list(t)
            for _ in range(rng.randint(1, edits)):
                u[rng.randrange(base)] = f"r{rng.randrange(10**6)}"
            out.append(("a", len(out), " ".join(u), None))
    return out


@pytest.mark.parametrize("crowd", [4, 64])
@pytest.mark.parametrize("threshold, k, keep", [(0.6, 3, 0.86), (0.8, 5, 0.93)])
def test_recall_in_a_family_of_half_alike_rows(spark, threshold, k, keep, crowd):
    """Everything meets everything at the shortest prefix: leaves are longer, and the recall stays."""
    rows = family(2, 260, keep, edits=9 if threshold < 0.8 else 3)
    want = brute(rows, threshold, k)
    got, _, _ = pairs(spark, rows, threshold, k, crowd=crowd)
    assert got <= want and len(want) > 40 and len(got) >= 0.99 * len(want)


def test_prefixes_shorten_until_each_class_reaches_the_target(spark):
    from pyspark.sql import functions as F

    rows = family(4, 200, 0.9)
    depth = N.depth_for(0.6, 64, 0.999)
    texts = spark.createDataFrame(rows, SCHEMA).select("src", "row_id", "text")
    node = texts.mapInArrow(N._signatures(3, 64, depth), N.SIGNATURE).select("src", "row_id", "n", "s1", "s2", F.explode("keys").alias("key"))
    leaves = N.crowded_leaves(node, 0.6, depth, 64, 0.999).collect()
    used = {}
    for r in leaves:
        used.setdefault(r.row_id, []).append(depth + r.level)
    assert len(leaves) == 64 * len(rows)
    for d in used.values():  # shortened no further than the target needs, but far enough
        miss = 1.0
        for x in d:
            miss *= 1 - 0.6**x
        assert 1 - miss >= 0.999
    longer = sum(x > depth for d in used.values() for x in d)
    assert 0.05 * len(leaves) < longer < 0.7 * len(leaves)
    # labels that have much company end up longer than those that have little
    sizes = {r.node: r.m for r in node.groupBy(N._node(0)).agg(F.count("*").alias("m")).collect()}
    by = {0: [], 1: []}
    for r in leaves:
        by[r.level > 0].append(sizes[r.node >> (N.BITS * r.level) if r.node >= 0 else (r.node % 2**64) >> (N.BITS * r.level)])
    assert sum(by[1]) / len(by[1]) > sum(by[0]) / len(by[0])


def test_prefixes_of_the_target():
    assert N.depth_for(0.6, 64, 0.999) == 4 and N.depth_for(0.8, 64, 0.999) == 10 and N.depth_for(0.6, 64, 0.9999999) < 4 and N.depth_for(0.1, 64, 0.999) == 1
    assert N.found_chance(0.6, 4, 64) >= 0.999 > N.found_chance(0.6, 5, 64)
