"""Long spans that texts share character for character, found by recompression.

A text begins as a sequence of tokens (words and single other characters, white space in runs) named by 64-bit hashes of
their bytes. Each round names runs of a repeated symbol (block compression), then pairs of a left and a right symbol, the
side being a bit of the symbol's name and the round (pair compression). A name is a hash of what it stands for, so the
rounds need no dictionary and agree over all tasks: equal substrings get equal symbols except for a few at their borders.
Repetitions of more than ``RUN_BYTES`` bytes are named alike whatever their length, since a shared span may cut them, and
have keys of their own.

From each symbol of the last round on, the shortest sequence of symbols of at least ``cover`` characters is a key. A shared
span of ``least`` characters keeps such a sequence inside after its borders are taken off. Texts with a key in common are candidates; an exact check on
the whole texts (hashes of all windows of ``least`` characters, then the characters themselves) gives the spans.

Equal texts form a class whose first document goes on; classes are expanded into pairs at the end, if pairs are asked for.

Pairs of documents with a span in common are all made where they are the result asked for (``long_spans``). How much of each document is
shared needs none of them (``shared_spans``): documents meet on their whole windows around common keys, and each window links its
documents to the first one that has it, so that a passage in N documents gives N links.

Results on special input: null texts, rows without an id and texts below ``least`` characters share nothing. Characters are code points, compared exactly.
Repeated ids count once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, only_ids

from ._text import U64, CONT, WORD, Block, blocks, classes, hash_ranges, mix

RUN_BYTES = 48
UNSPLIT = 64
_M1, _M2 = U64(0x9FB21C651E98DF25), U64(0xD1B54A32D192ED03)


def base_symbols(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(names, byte starts) of the tokens of a block, every byte covered; runs of one character within a token are cut out."""
    n = len(b.data)
    c = classes(b)
    new = np.ones(n, bool)
    same = c[1:] == c[:-1]
    new[1:] = ~((c[1:] == CONT) | (same & (c[1:] <= WORD)))
    # a stretch of 8 or more equal bytes stands alone
    if n > 8:
        edge = np.flatnonzero(np.append(True, b.data[1:] != b.data[:-1]))
        long = np.diff(np.append(edge, n)) >= 8
        at = edge[long]
        at = at[b.data[at] < 128]
        new[at] = True
        stop = (np.append(edge, n)[1:])[long]
        stop = stop[(stop < n) & (b.data[edge[long]] < 128)]
        new[stop] = True
        new[stop[c[stop] == CONT]] = False
    begins = b.starts[:-1]
    new[begins[begins < n]] = True
    at = np.flatnonzero(new)
    # a long token would leave too little of a span inside: cut it after bytes that a hash of 8 bytes picks, and a
    # stretch without any into single characters (a repeated pattern has none or many)
    size = np.diff(np.append(at, n))
    extra = []
    for k in np.flatnonzero(size > 24):
        s, e = int(at[k]), int(at[k] + size[k])
        if (b.data[s:e] == b.data[s]).all():
            continue
        p = np.arange(s + 8, e)
        p = p[c[p] != CONT]
        p = p[(hash_ranges(Block(0, b.data[s:e], b.starts), p - s - 8, p - s) & U64(3)) == 0]
        edges = np.concatenate([[s], p, [e]])
        for i in np.flatnonzero(np.diff(edges) > UNSPLIT):
            q = np.arange(edges[i] + 1, edges[i + 1])
            extra.append(q[c[q] != CONT])
        extra.append(p)
    if extra:
        at = np.sort(np.concatenate([at, *extra]))
    stop = np.append(at[1:], n)
    names = hash_ranges(b, at, stop)
    for k in np.flatnonzero(stop - at >= RUN_BYTES):
        if (b.data[at[k] : stop[k]] == b.data[at[k]]).all():
            names[k] = _run_name(int(b.data[at[k]]))
    return names, at


def _run_name(byte: int) -> np.uint64:
    return mix(np.full(1, byte, U64) * _M2 + U64(77))[0]


def compress(names: np.ndarray, at: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Symbols after the rounds: names, byte starts, texts, weights; then texts, names, first and last bytes of the long repetitions met.

    A weight is a symbol's length in characters, with long repetitions counted as if cut where their name stops telling lengths apart.
    """
    long: list[tuple[np.ndarray, ...]] = []
    for r in range(rounds):
        if len(names) < 2:
            break
        # runs
        same = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
        if same.any():
            head = np.flatnonzero(np.append(True, ~same))
            reps = np.diff(np.append(head, len(names)))
            ends = np.append(at, n)
            size = (ends[1:] - ends[:-1])[head]
            most = RUN_BYTES // size + 1
            runs = np.flatnonzero(reps > 1)
            names, text, weight = names[head], text[head], weight[head]
            stop = ends[head + reps]
            at = at[head]
            names[runs] = mix(names[runs] * _M2 + np.minimum(reps, most)[runs].astype(U64))
            weight[runs] *= np.minimum(reps, most)[runs]
            big = runs[(reps >= most)[runs]]
            if len(big):
                need = (most * size)[big]
                long.append((text[big], names[big], stop[big] - need, at[big] + need))
        # pairs
        side = (names >> U64(r % 60)) & U64(1)
        k = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1) & (text[1:] == text[:-1]))
        names[k] = mix(names[k] * _M1 + names[k + 1] * _M2 + U64(r + 1))
        weight[k] += weight[k + 1]
        keep = np.ones(len(names), bool)
        keep[k + 1] = False
        names, at, text, weight = names[keep], at[keep], text[keep], weight[keep]
    none = np.zeros(0, np.int64)
    cols = zip(*long, strict=True) if long else ()
    return names, at, text, weight, *([np.concatenate(c) for c in cols] or [none, none.astype(U64), none, none])


def _winnowed(key: np.ndarray, text: np.ndarray, place: np.ndarray, w: int, reach: int) -> np.ndarray:
    """Indices of the smallest key of each window of at most ``w`` consecutive ones that begin within ``reach`` of each other."""
    n = len(key)
    low = key.copy()
    within = [None]
    for k in range(1, min(w, n)):
        ok = (text[k:] == text[:-k]) & (place[k:] - place[:-k] < reach)
        within.append(ok)
        near = low[: n - k]
        near[ok] = np.minimum(near[ok], key[k:][ok])
    keep = key == low
    for k in range(1, min(w, n)):
        keep[k:] |= within[k] & (key[k:] == low[: n - k])
    return np.flatnonzero(keep)


def span_keys(b: Block, rounds: int, cover: int, winnow: int, distinct: bool = True) -> tuple[np.ndarray, ...]:
    """(text of the block, key, first and last place in characters that a span must hold), by text and key."""
    n = len(b.data)
    names, at = base_symbols(b)
    text = np.searchsorted(b.starts, at, "right") - 1
    chars = np.zeros(n + 1, np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=chars[1:])
    stop = np.append(at[1:], n)
    weight = chars[stop] - chars[at]
    # stretches of one character have a key of their own, as other long repetitions: a shared span may cut them anywhere
    long = np.flatnonzero(stop - at >= RUN_BYTES)
    long = long[[bool((b.data[at[k] : stop[k]] == b.data[at[k]]).all()) for k in long]] if len(long) else long
    weight[long] = np.minimum(weight[long], RUN_BYTES)
    run = [text[long], names[long], stop[long] - RUN_BYTES, at[long] + RUN_BYTES]
    names, at, text, weight, *more = compress(names, at, text, weight, n, rounds)
    run = [np.concatenate(x) for x in zip(run, more, strict=True)]
    at_char = chars[np.append(at, n)]
    total_w = np.append(0, np.cumsum(weight))
    j = np.searchsorted(total_w, total_w[:-1] + cover)
    i = np.flatnonzero(j <= len(at))
    i = i[text[i] == text[j[i] - 1]]
    j = j[i]
    pw, inv = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(names), m)])) for m in (_M1, U64(pow(int(_M1), -1, 1 << 64))))
    total = np.zeros(len(names) + 1, U64)
    np.cumsum(mix(names) * pw[: len(names)], out=total[1:])
    key = mix((total[j] - total[i]) * inv[i])
    some = _winnowed(key, text[i], total_w[i], winnow, cover // 2)
    i, j, key = i[some], j[some], key[some]
    t, k = np.concatenate([text[i], run[0]]), np.concatenate([key, run[1]])
    # the outer symbols of a key may be repetitions longer than their names tell: only what they must have counts
    first, last = np.concatenate([at_char[i + 1] - weight[i], chars[run[2]]]), np.concatenate([at_char[j - 1] + weight[j - 1], chars[run[3]]])
    order = np.lexsort((k, t))
    t, k, first, last = t[order], k[order], first[order], last[order]
    if len(t) and distinct:
        keep = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        t, k, first, last = t[keep], k[keep], first[keep], last[keep]
    begin = chars[b.starts[t]]
    return t, k, first - begin, last - begin


def _keys(rounds: int, cover: int, winnow: int, least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in blocks(batch.column(1)):
                if not len(b.data):
                    continue
                t, k, _, _ = span_keys(b, rounds, cover, winnow)
                f1 = hash_ranges(b, b.starts[:-1], b.starts[1:])
                size = np.diff(b.starts)
                first = np.searchsorted(t, np.arange(b.n + 1))
                keep = size >= least  # bytes, so never more than those that count
                keys = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(k.view(np.int64)))
                f2 = mix(f1 * _M1 + size.astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), pa.array(f1.view(np.int64)), pa.array(size.astype(np.int64)), keys], names=["doc_id", "f1", "size", "keys"]
                ).filter(pa.array(keep))

    return run


def _windows(rounds: int, cover: int, winnow: int, least: int):
    """(doc_id, h): hashes of the windows of ``least`` characters that hold an occurrence of one of the row's keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, wanted = batch.column(0), batch.column(2)
            for b in blocks(batch.column(1)):
                t, k, first, last = span_keys(b, rounds, cover, winnow, distinct=False)
                for d in range(b.n):
                    lo, hi = np.searchsorted(t, (d, d + 1))
                    hot = np.flatnonzero(np.isin(k[lo:hi].view(np.int64), np.array(wanted[b.first + d].as_py(), np.int64))) + lo
                    h = window_hashes(batch.column(1)[b.first + d].as_py(), least)
                    if not len(hot) or not len(h):
                        continue
                    edge = np.zeros(len(h) + 1, np.int64)  # windows between an occurrence's last end and its first start
                    np.add.at(edge, np.clip(last[hot] - least, 0, len(h)), 1)
                    np.add.at(edge, np.clip(first[hot] + 1, 0, len(h)), -1)
                    some = np.unique(h[np.cumsum(edge[:-1]) > 0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), ids[b.first + d].as_py(), np.int64)), pa.array(some.view(np.int64))], names=["doc_id", "key"])

    return run


def window_hashes(text: str, least: int) -> np.ndarray:
    from ._text import _powers

    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    if len(c) < least:
        return np.zeros(0, U64)
    pw, inv = _powers(len(c) + 1)
    total = np.zeros(len(c) + 1, U64)
    np.cumsum(mix(c + U64(1)) * pw[: len(c)], out=total[1:])
    return mix((total[least:] - total[:-least]) * inv[: len(c) + 1 - least])


def _places(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where ``h`` has a value of the sorted ``among``."""
    if not len(among):
        return np.zeros(0, np.int64)
    return np.flatnonzero(among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h)


def _spans(places: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows that begin at the places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > least)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + least).tolist(), strict=True))


def _matched(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, px: np.ndarray, py: np.ndarray, least: int) -> np.ndarray:
    """Of the places ``px``: those whose window of characters is in ``y``, compared character by character.

    Windows one after the other that are so in both texts are compared as one stretch; a window that differs at the first place with its hash is tried at the others.
    """
    if not len(px) or not len(py):
        return px[:0]
    order = py[np.argsort(hy[py], kind="stable")]
    lo, hi = (np.searchsorted(hy[order], hx[px], side) for side in ("left", "right"))
    ok = np.zeros(len(px), bool)
    held = np.flatnonzero(hi > lo)
    q = order[lo[held]]
    cut = np.flatnonzero((np.diff(px[held]) != 1) | (np.diff(q) != 1)) + 1
    for i, j in zip(np.append(0, cut), np.append(cut, len(held)), strict=True):
        if i < j:
            p0, q0, n = px[held[i]], q[i], j - i - 1 + least
            bad = np.cumsum(np.append(0, x[p0 : p0 + n] != y[q0 : q0 + n]))
            ok[held[i:j]] = bad[least:] == bad[: j - i]
    for k in np.flatnonzero(~ok & (hi - lo > 1)):
        w = x[px[k] : px[k] + least]
        ok[k] = any(np.array_equal(w, y[r : r + least]) for r in order[lo[k] : hi[k]])
    return px[ok]


def _verify(least: int):
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows, held, hx, sx, x = [], None, None, None, None
            for a, b, text_a, text_b in zip(pdf.rep_a, pdf.rep_b, pdf.text_a, pdf.text_b, strict=True):
                if held != a:
                    held, hx, x = a, window_hashes(text_a, least), points(text_a)
                    sx = np.sort(hx)
                hy, y = window_hashes(text_b, least), points(text_b)
                py = _places(hy, sx)
                px = _places(hx, np.sort(hy[py])) if len(py) else py
                px, py = _matched(x, y, hx, hy, px, py, least), _matched(y, x, hy, hx, py, px, least)
                if len(px):
                    rows.append((a, b, _spans(px, least), _spans(py, least)))
            yield pd.DataFrame(
                {
                    "rep_a": [r[0] for r in rows], "rep_b": [r[1] for r in rows],
                    **{c: pd.Series([[{"s": s, "e": e} for s, e in r[k]] for r in rows], dtype=object) for c, k in (("spans_a", 2), ("spans_b", 3))},
                }
            )

    return run


_SPANS = "array<struct<s:int,e:int>>"


def _meet(node: DataFrame, hot: int | None) -> tuple[DataFrame, DataFrame]:
    """(pairs of documents with a key in common, keys of more than ``hot`` documents, which give no pairs here).

    Most keys are of one document and end in the aggregate; those of two are pairs already; only the rest is joined.
    """
    per = _common(node)
    most = F.lit(True) if hot is None else F.col("n") <= hot
    few = only_ids(node, per.where((F.col("n") > 2) & most), "key")
    a, b = few.select(F.col("doc_id").alias("rep_a"), "key"), few.select(F.col("doc_id").alias("rep_b"), "key")
    pairs = per.where("n = 2").select("rep_a", "rep_b").unionByName(a.join(b, "key").where("rep_a < rep_b").select("rep_a", "rep_b"))
    return pairs, per.where(~most).select("key")


def _common(node: DataFrame) -> DataFrame:
    """(key, n, rep_a, rep_b): keys of two documents or more, and the first and last of these."""
    return materialise(node.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep_a"), F.max("doc_id").alias("rep_b")).where("n > 1 and rep_a < rep_b"), "keys")


def _keyed(docs: DataFrame, least: int, rounds: int, cover: int, winnow: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, members, (doc_id, key) of the first document of each class)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    keyed = materialise(docs.mapInArrow(_keys(rounds, cover, winnow, least), "doc_id long, f1 long, size long, keys array<long>"), "spans")
    reps = keyed.groupBy("f1", "size").agg(F.min("doc_id").alias("rep"))
    members = keyed.select("doc_id", "f1", "size").join(reps, ["f1", "size"]).select("doc_id", "rep").dropDuplicates(["doc_id"])
    # copies are few beside all documents: taking them out costs less than picking the others
    return docs, members, keyed.join(members.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))


def _whole_windows(docs: DataFrame, node: DataFrame, keys: DataFrame, least: int, rounds: int, cover: int, winnow: int) -> DataFrame:
    """(doc_id, key): hashes of the whole windows around the places where documents have one of the keys."""
    held = only_ids(node, keys, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    return docs.join(held, "doc_id").select("doc_id", "text", "keys").mapInArrow(_windows(rounds, cover, winnow, least), "doc_id long, key long")


def _verified(docs: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    pairs = materialise(pairs.distinct(), "candidates")
    wanted = only_ids(docs, pairs.select(F.col("rep_a").alias("doc_id")).union(pairs.select("rep_b")), "doc_id")
    ta, tb = (wanted.select(F.col("doc_id").alias(f"rep_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return (
        pairs.join(ta, "rep_a").join(tb, "rep_b").select("rep_a", "rep_b", "text_a", "text_b")
        .mapInPandas(_verify(least), f"rep_a long, rep_b long, spans_a {_SPANS}, spans_b {_SPANS}").dropDuplicates(["rep_a", "rep_b"])
    )


def long_spans(docs: DataFrame, least: int = 400, rounds: int = 6, cover: int = 150, winnow: int = 5, hot: int = 256) -> tuple[DataFrame, DataFrame]:
    """(members, links) of docs (doc_id long, text string).

    members: doc_id, rep - every document of at least ``least`` bytes and the first one with the same text;
    links: rep_a < rep_b, spans_a, spans_b - maximal intervals of characters that windows of ``least`` shared characters cover, of every pair that has some.
    """
    docs, members, node = _keyed(docs, least, rounds, cover, winnow)
    pairs, crowded = _meet(node, hot)
    if crowded.limit(1).count():
        # a passage shorter than asked for may be in very many documents: those meet on whole windows instead, which only true cases share
        pairs = pairs.unionByName(_meet(materialise(_whole_windows(docs, node, crowded, least, rounds, cover, winnow), "windows"), None)[0])
    return members, _verified(docs, pairs, least)


def shared_spans(docs: DataFrame, least: int = 400, rounds: int = 6, cover: int = 150, winnow: int = 5) -> tuple[DataFrame, DataFrame]:
    """The same, with links of each document to the first one that has a window in common with it only: their spans cover all that is shared."""
    docs, members, node = _keyed(docs, least, rounds, cover, winnow)
    windows = materialise(_whole_windows(docs, node, _common(node).select("key"), least, rounds, cover, winnow), "windows")
    first = _common(windows)
    star = windows.join(first.select("key", "rep_a"), "key").where("doc_id > rep_a").select("rep_a", F.col("doc_id").alias("rep_b"))
    return members, _verified(docs, star, least)


def span_pairs(docs: DataFrame, members: DataFrame, links: DataFrame, least: int = 400) -> DataFrame:
    """Every pair doc_a < doc_b that shares a span, copies of whole texts included."""
    long = docs.where(F.length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"))
    m = members.join(long, "doc_id", "left_semi")
    across = (
        links.select("rep_a", "rep_b").join(m.select(F.col("rep").alias("rep_a"), F.col("doc_id").alias("x")), "rep_a")
        .join(m.select(F.col("rep").alias("rep_b"), F.col("doc_id").alias("y")), "rep_b")
        .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    )
    within = m.join(m.select("rep", F.col("doc_id").alias("y")), "rep").where("doc_id < y").select(F.col("doc_id").alias("doc_a"), F.col("y").alias("doc_b"))
    return across.unionByName(within)


def shared_share(docs: DataFrame, members: DataFrame, links: DataFrame, least: int = 400) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, n_links): how much of each document some other has, too. Null text: 0 of 0."""
    both = links.select(F.col("rep_a").alias("rep"), F.col("spans_a").alias("spans")).unionByName(links.select(F.col("rep_b").alias("rep"), F.col("spans_b").alias("spans")))
    # union of intervals: sort by start, add what reaches beyond the furthest end so far
    union = F.expr(
        "aggregate(array_sort(flatten(all)), named_struct('n', 0, 'e', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.e)), 'e', greatest(a.e, x.e))).n"
    )
    cover = both.groupBy("rep").agg(F.collect_list("spans").alias("all"), F.count("*").alias("n_links")).select("rep", union.alias("covered"), "n_links")
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    n = F.coalesce(F.length("text"), F.lit(0))
    per = members.join(copies, "rep").join(cover, "rep", "left")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_chars"))
    shared = F.when((F.col("copies") > 1) & (F.col("n_chars") >= least), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return (
        d.join(per, "doc_id", "left").withColumn("shared_chars", shared)
        .select("doc_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_share"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
