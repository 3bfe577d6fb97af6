"""Near-duplicate records by a MinHash LSH forest with exact verification.

Every text becomes the set of its runs of ``shingle`` consecutive tokens. Texts with the same set form a class and only
the class's first row goes on. A class gets 128 MinHash values, and in each of ``trees`` tries a label, a sequence of such values.
Two classes are candidates if their labels have a leaf of some trie in common.

A label is one number: first a hash of the values that every leaf needs (the shortest prefix, at which all tries together find a pair at
the threshold with the target chance), then ``LEVELS`` further values of four bits each, so that prefixes of any length are cut from
it by a shift. Where a node at the shortest prefix holds more than ``crowd`` classes, each of them begins at the longest prefix that still has
company in it, and its prefixes are shortened, the one with the least additional company first, until the chance that its own leaves find a pair at the
threshold reaches the target again: tries with few alike make up for those with many. A node is a leaf if one of its classes asks for it.
The chance of every class is thus at least the target, whatever the data, and no class is dropped from a crowded node.

A 128-bit sketch drops hopeless candidates (a true pair is lost with chance under 1e-5); the rest is verified on the whole texts.

Results on special input: null and blank texts and rows without src or id belong to no group and no pair. Texts with fewer than ``shingle`` tokens
have no run and are alike only if they are equal. Equal texts are alike whatever their length. Repeated row ids count
once. Empty tables give empty results. Only the two named columns are read, so further ones may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, only_ids

from ._text import U64, BLOCK_BYTES, blocks, hash_ranges, mix, tokens

PERMUTATIONS = 128
LEVELS, BITS = 6, 4  # further values of a label and the bits of each
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def found_chance(similarity, depth: int, trees: int):
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int, target: float) -> int:
    """The longest prefix at which ``trees`` tries find a pair of that similarity with the target chance; 1 if none does."""
    d = 1
    while found_chance(threshold, d + 1, trees) >= target and threshold < 1:
        d += 1
    return d


def _selections(trees: int, depth: int) -> np.ndarray:
    """Which MinHash values each trie uses, in order: every value about equally often."""
    rng = np.random.default_rng(11)
    rounds = math.ceil(trees * depth / PERMUTATIONS)
    order = np.concatenate([rng.permutation(PERMUTATIONS) for _ in range(rounds)])
    # depth by depth, so that short prefixes of different tries share no value as long as possible
    return order[: trees * depth].reshape(depth, trees).T


def shingle_sets(b, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (upper 44 bits are the text, so they are sorted by text), first index of each text, tokens of each."""
    t = tokens(b)
    n = np.diff(t.first)
    if len(t.hash) < shingle:
        return np.zeros(0, U64), np.zeros(b.n + 1, np.int64), n
    h = t.hash[: len(t.hash) - shingle + 1].copy()
    for k in range(1, shingle):
        h *= U64(0x9FB21C651E98DF25)
        h += t.hash[k : len(t.hash) - shingle + 1 + k]
    h = mix(h)
    whole = t.text[: len(h)] == t.text[shingle - 1 :]
    h, of = h[whole], t.text[: len(whole)][whole].astype(U64)
    h = np.sort((of << U64(44)) | (h >> U64(20)))
    if len(h):
        h = h[np.append(True, h[1:] != h[:-1])]
    return h, np.searchsorted(h, np.arange(b.n + 1, dtype=U64) << U64(44)), n


def _signatures(shingle: int, trees: int, depth: int):
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    c = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
    pick = _selections(trees, depth + LEVELS)
    salt = mix(rng.integers(1, 1 << 63, trees, dtype=U64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            src, ids, texts = batch.column(0), batch.column(1), batch.column(2)
            for b in blocks(texts, BLOCK_BYTES // 2):
                h, first, n_tokens = shingle_sets(b, shingle)
                size = np.diff(first)
                full = np.flatnonzero(size)
                low = (h & U64((1 << 44) - 1)) if len(h) else h
                sig = np.zeros((b.n, PERMUTATIONS), np.uint32)
                print1 = hash_ranges(b, b.starts[:-1], b.starts[1:]) if len(b.data) else np.zeros(b.n, U64)
                print2 = np.full(b.n, U64(1))
                if len(full):
                    v = (low & U64(0xFFFFFFFF)).astype(np.uint32)
                    at = first[:-1][full]
                    for k in range(PERMUTATIONS):
                        x = v * a[k]
                        x ^= x >> np.uint32(15)
                        x += c[k]
                        sig[full, k] = np.minimum.reduceat(x, at)
                    # classes: a hash of the set, independent of order
                    print1[full] = np.add.reduceat(mix(low), at)
                    print2[full] = np.add.reduceat(mix(low ^ U64(0xABCDEF12345)), at) | U64(1)
                key = np.tile(salt, (b.n, 1))
                for d in range(depth):
                    key = mix(key * U64(0x9FB21C651E98DF25) + sig[:, pick[:, d]].astype(U64))
                for d in range(depth, depth + LEVELS):
                    key = (key << U64(BITS)) | ((sig[:, pick[:, d]] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(U64)
                bits = np.packbits(((sig * np.uint32(0x85EBCA6B)) >> np.uint32(17) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
                has = size > 0
                keys = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.where(has, trees, 0))).astype(np.int32)), pa.array(key[has].reshape(-1).view(np.int64))
                )
                part = slice(b.first, b.first + b.n)
                known = n_tokens > 0  # not null, not blank
                yield pa.RecordBatch.from_arrays(
                    [src[part], ids[part], pa.array(print1.view(np.int64)), pa.array(np.where(has, print2, U64(0)).view(np.int64)), pa.array(size.astype(np.int32))]
                    + [pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), keys],
                    names=["src", "row_id", "f1", "f2", "n", "s1", "s2", "keys"],
                ).filter(pa.array(known))

    return run


SIGNATURE = "src string, row_id long, f1 long, f2 long, n int, s1 long, s2 long, keys array<long>"  # keys: a label for each trie


def _sketch_slack(threshold: float) -> int:
    """Differing sketch bits of 128 that a pair at the threshold exceeds with a chance under 1e-5 (4.5 deviations)."""
    p = (1 - threshold) / 2
    return math.ceil(128 * p + 4.5 * math.sqrt(128 * p * (1 - p)))


def _verify(shingle: int, threshold: float):
    def of(text: str) -> set:
        t = TOKEN.findall(text)
        return set(zip(*(t[k:] for k in range(shingle)), strict=False))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            kept: dict[int, set] = {}
            sim = np.zeros(len(pdf))
            for i, (a, ta, tb) in enumerate(zip(pdf.rep_a, pdf.text_a, pdf.text_b, strict=True)):
                if a not in kept:
                    kept = {a: of(ta)}
                x, y = kept[a], of(tb)
                both = len(x & y)
                sim[i] = both / (len(x) + len(y) - both) if both else 0.0
            keep = sim >= threshold
            yield pd.DataFrame({"src": pdf.src[keep], "rep_a": pdf.rep_a[keep], "rep_b": pdf.rep_b[keep], "similarity": sim[keep]})

    return run


def _node(level: int):
    return F.shiftrightunsigned("key", BITS * (LEVELS - level)).alias("node")


def _asks(threshold: float, depth: int, trees: int, target: float):
    """Of each class: the level it asks for in each trie whose node is crowded, from (src, row_id, labels [(key, company at each level)])."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for src, row_id, labels in zip(pdf.src, pdf.row_id, pdf.labels, strict=True):
                company = np.array([x["company"] for x in labels], np.int64)
                # the longest prefix with company; alone everywhere: the first level at which it is alone
                level = np.maximum((company > 1).sum(axis=1) - 1, 0)
                miss = np.log1p(-(threshold ** (depth + np.arange(LEVELS + 1.0))))
                others = (trees - len(labels)) * miss[0]
                at = np.arange(len(labels))
                while others + miss[level].sum() > math.log1p(-target) and level.any():
                    more = np.where(level > 0, company[at, level - 1] - company[at, level], np.iinfo(np.int64).max)
                    k = int(np.argmin(more))
                    level[k] -= 1
                out += [(src, row_id, x["key"], int(j)) for x, j in zip(labels, level, strict=True)]
            yield pd.DataFrame(out, columns=["src", "row_id", "key", "ask"])

    return run


def crowded_leaves(crowded: DataFrame, threshold: float, depth: int, trees: int, target: float) -> DataFrame:
    """(src, row_id, n, s1, s2, level, node): the leaf of each label of ``crowded`` (src, row_id, n, s1, s2, key), labels of crowded nodes."""
    levels = F.explode(F.array(*(F.struct(F.lit(j).alias("level"), _node(j)) for j in range(LEVELS + 1)))).alias("x")
    company = crowded.select("src", levels).groupBy("src", "x").agg(F.count("*").alias("company"))
    each = crowded.select("src", "row_id", "key", levels).join(company, ["src", "x"])
    labels = each.groupBy("src", "row_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.level", "company"))), lambda e: e["company"]).alias("company"))
    labels = labels.groupBy("src", "row_id").agg(F.collect_list(F.struct("key", "company")).alias("labels"))  # a row's labels: one for each trie
    asks = labels.mapInPandas(_asks(threshold, depth, trees, target), "src string, row_id long, key long, ask int")
    leaf = materialise(asks.select("src", "ask", *(F.when(F.col("ask") == j, _node(j)).alias(f"n{j}") for j in range(LEVELS + 1))).select("src", F.col("ask").alias("level"), F.coalesce(*(f"n{j}" for j in range(LEVELS + 1))).alias("node")).distinct(), "leaves")
    under = crowded.select("src", "row_id", "n", "s1", "s2", "key", levels).select("src", "row_id", "n", "s1", "s2", "key", "x.level", "x.node").join(leaf, ["src", "level", "node"])
    return under.groupBy("src", "row_id", "key", "n", "s1", "s2").agg(F.min_by(F.struct("level", "node"), "level").alias("x")).select("src", "row_id", "n", "s1", "s2", "x.level", "x.node")


def _pairs_within(rows: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(src, rep_a < rep_b) of the rows (src, row_id, n, s1, s2, and the columns ``on``) that meet and may be alike."""
    a, b = (rows.select("src", *on, *(F.col(c).alias(f"{c}_{x}") for c in ("row_id", "n", "s1", "s2"))) for x in "ab")
    far = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    j = a.join(b, ["src", *on]).where((F.col("row_id_a") < F.col("row_id_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold)) & (far <= _sketch_slack(threshold)))
    return j.select("src", F.col("row_id_a").alias("rep_a"), F.col("row_id_b").alias("rep_b"))


def candidates(node: DataFrame, threshold: float, depth: int, trees: int, target: float, crowd: int) -> DataFrame:
    """(src, rep_a < rep_b) of classes that share a leaf; node: src, row_id, n, s1, s2, key, a row for each label.

    Most nodes hold one class and end in the aggregate; those of two are pairs already, of which the aggregate has the sketches'
    difference; only the others are joined, crowded ones by their leaves.
    """
    per = materialise(
        node.groupBy("src", _node(0)).agg(
            F.count("*").alias("m"), F.min("row_id").alias("rep_a"), F.max("row_id").alias("rep_b"), F.min("n").alias("n1"), F.max("n").alias("n2"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2")
        ).where("m > 1 and rep_a < rep_b"),
        "nodes",
    )
    close = (F.bit_count("x1") + F.bit_count("x2") <= _sketch_slack(threshold)) & (F.col("n1") >= F.col("n2") * F.lit(threshold))
    two = per.where((F.col("m") == 2) & close).select("src", "rep_a", "rep_b")
    here = node.select("src", "row_id", "n", "s1", "s2", "key", _node(0))
    some = _pairs_within(only_ids(here, per.where((F.col("m") > 2) & (F.col("m") <= crowd)), ["src", "node"]), ["node"], threshold)
    out = two.unionByName(some)
    many = per.where(F.col("m") > crowd)
    if many.limit(1).count():
        crowded = materialise(only_ids(here, many, ["src", "node"]).drop("node"), "crowded")
        out = out.unionByName(_pairs_within(crowded_leaves(crowded, threshold, depth, trees, target), ["level", "node"], threshold))
    return out.distinct()


def near_duplicates(
    texts: DataFrame, threshold: float = 0.8, shingle: int = 5, trees: int = 64, target_recall: float = 0.999, crowd: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``texts`` (src string, row_id long, text string).

    members: src, row_id, rep, n - every row with a token and the first row of its class; links: src, rep_a < rep_b, similarity -
    class representatives alike by the threshold or more. Nothing is expanded into pairs of copies.
    """
    texts = texts.select("src", F.col("row_id").cast("long").alias("row_id"), "text").where("src is not null and row_id is not null")
    depth = depth_for(threshold, trees, target_recall)
    sig = materialise(texts.where(F.col("text").isNotNull()).mapInArrow(_signatures(shingle, trees, depth), SIGNATURE), "forest")
    reps = sig.groupBy("src", "f1", "f2").agg(F.min("row_id").alias("rep"))
    members = sig.select("src", "row_id", "f1", "f2", "n").join(reps, ["src", "f1", "f2"]).select("src", "row_id", "rep", "n").dropDuplicates()
    # copies are few beside all rows: taking them out costs less than picking the others
    copies = members.where("row_id <> rep").select("src", "row_id")
    node = sig.where("n > 0").join(copies, ["src", "row_id"], "left_anti").dropDuplicates(["src", "row_id"]).select("src", "row_id", "n", "s1", "s2", F.explode("keys").alias("key"))
    pairs = materialise(candidates(node, threshold, depth, trees, target_recall, crowd), "candidates")
    wanted = only_ids(texts, pairs.select("src", F.col("rep_a").alias("row_id")).union(pairs.select("src", "rep_b")), ["src", "row_id"])
    ta = wanted.select("src", F.col("row_id").alias("rep_a"), F.col("text").alias("text_a"))
    tb = wanted.select("src", F.col("row_id").alias("rep_b"), F.col("text").alias("text_b"))
    links = (
        pairs.join(ta, ["src", "rep_a"]).join(tb, ["src", "rep_b"])
        .mapInPandas(_verify(shingle, threshold), "src string, rep_a long, rep_b long, similarity double").dropDuplicates(["src", "rep_a", "rep_b"])
    )
    return members, materialise(links, "links")


def near_duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of alike rows (src, key_a < key_b): the classes' members joined to the links and to each other."""
    m = members.select("src", "rep", "row_id")
    across = (
        links.join(m.select("src", F.col("rep").alias("rep_a"), F.col("row_id").alias("x")), ["src", "rep_a"])
        .join(m.select("src", F.col("rep").alias("rep_b"), F.col("row_id").alias("y")), ["src", "rep_b"])
        .select("src", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    )
    within = m.join(m.select("src", "rep", F.col("row_id").alias("y")), ["src", "rep"]).where("row_id < y")
    return across.unionByName(within.select("src", F.col("row_id").alias("key_a"), F.col("y").alias("key_b")))


def components(members: DataFrame, links: DataFrame) -> DataFrame:
    """(src, row_id, rep, group_id, n_links): the smallest row id reachable over links, by hooking and pointer jumping.

    Rows without a like one are groups of one. n_links counts the alike representatives of the row's class.
    """
    spark = links.sparkSession
    edges = materialise(
        links.select("src", F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(links.select("src", F.col("rep_b").alias("u"), F.col("rep_a").alias("v"))), "edges"
    )
    label = edges.select("src", "u").distinct().withColumn("g", F.col("u"))
    before = -1
    while True:
        near = edges.join(label.select("src", F.col("u").alias("v"), "g"), ["src", "v"]).groupBy("src", "u").agg(F.min("g").alias("m"))
        label = label.join(near, ["src", "u"]).select("src", "u", F.least("g", "m").alias("g"))
        jump = label.select("src", F.col("u").alias("g"), F.col("g").alias("gg"))
        label = materialise(label.join(jump, ["src", "g"]).select("src", "u", F.least("g", "gg").alias("g")), "labels")
        now = label.agg(F.sum(F.col("g").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    degree = edges.groupBy("src", "u").agg(F.count("*").alias("n_links"))
    return (
        members.join(label.select("src", F.col("u").alias("rep"), "g"), ["src", "rep"], "left")
        .join(degree.select("src", F.col("u").alias("rep"), "n_links"), ["src", "rep"], "left")
        .select("src", "row_id", "rep", F.coalesce("g", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
