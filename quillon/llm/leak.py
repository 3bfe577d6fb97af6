"""Evaluation texts inside a corpus: CGK embedding, bit-sampling LSH over windows of words, exact verification.

A text is the sequence of its words: maximal runs of ASCII letters, digits and underscores, without case. Every window of
``window`` words is embedded by a random walk: in each of 3 * window steps the walk emits the word it stands on (a filler past
the end) and a random bit of that word and step says whether it moves on. Windows that differ by few edits give emitted
sequences that differ in few places, and equal windows equal ones. A repetition makes a walk of its own and samples ``sample`` of its places; windows
with equal samples are candidates. There are as many repetitions as the target recall at ``max_edits`` edits needs by the
collision rates measured on windows with so many random edits: one for none. Candidates are verified on the words themselves.

Windows are item-sized: an item of fewer words than ``window`` is one window, with edits in proportion.

Of max_edits + 1 equal pieces of a window, ``max_edits`` edits leave one as it is. Only windows around a run of
``window // (max_edits + 1)`` words that some item has are walked; no window within ``max_edits`` edits is left out by that.

The items' windows go to every executor, as one broadcast, if the items hold at most ``BROADCAST_WORDS`` words (measured first);
otherwise documents and items meet in a shuffle on the sampled keys, of documents only those of windows that a bitmap of the
items' runs (of bounded size) lets through. Both ways give the same rows.

Results on special input: null, empty and blank texts and rows without an id contain nothing; items without a word cannot leak.
Rows with one id are one document or item: each pair of ids gives one row. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, only_ids

from ._text import U64, blocks, mix, tokens

WORD = re.compile(r"[A-Za-z0-9_]+")
BROADCAST_WORDS = 4_000_000
BITMAP_BITS = 27  # most bits of the runs' bitmap, as a power of two
FILLER = U64(0x5BD1E9955BD1E995)


def sampled_steps(window: int, sample: int, reps: int, fuzzy: bool) -> np.ndarray:
    rng = np.random.default_rng(99)
    # exact windows are equal in every step: early steps suffice and need the shortest walk
    span = 3 * window if fuzzy else min(3 * window, 2 * sample + 2)
    return np.stack([np.sort(rng.choice(span, sample, replace=False)) for _ in range(reps)])


def _walk(h: np.ndarray, at: np.ndarray, limit: np.ndarray, steps: int, r: int) -> Iterator[np.ndarray]:
    """What the walks of repetition ``r`` from ``at`` emit in each step; past ``limit`` a filler."""
    padded, place = np.append(h, FILLER), at.copy()
    for k in range(steps):
        if k % 61 == 0:  # bits of a word last for 61 steps
            walk = np.append(mix(h ^ mix(np.array([r * 1000 + k], U64) + U64(0xC3A5C85C97CB3127))), U64(0))
        inside = np.where(place < limit, place, len(h))
        yield padded[inside]
        place += ((walk[inside] >> U64(k % 61)) & U64(1)).astype(np.int64)


@lru_cache(maxsize=64)
def collision_chances(window: int, max_edits: int, sample: int, cases: int = 400, walks: int = 150) -> np.ndarray:
    """Of ``cases`` random windows with ``max_edits`` random edits: the chance that one repetition makes them candidates, over ``walks`` walks."""
    rng = np.random.default_rng(5)
    both = []
    for _ in range(cases):
        a = list(rng.integers(1, 1 << 63, window, dtype=U64))
        b = [*a]
        for _ in range(max_edits):
            k = rng.integers(len(b))
            new = rng.integers(1, 1 << 63, dtype=U64)
            b[k : k + 1] = ([], [new], [b[k], new])[rng.integers(3)]
        both += [a, [*b, *rng.integers(1, 1 << 63, window, dtype=U64)][:window]]
    h, at = mix(np.array(both, U64).reshape(-1)), np.arange(2 * cases) * window
    chance, n = np.zeros(cases), 3 * window
    for r in range(walks):
        same = np.zeros(cases)
        for out in _walk(h, at, at + window, n, r):
            same += out[::2] == out[1::2]
        chance += np.prod([np.maximum(same - i, 0) / (n - i) for i in range(sample)], axis=0)
    return chance / walks


def repetitions(window: int, max_edits: int, sample: int, target: float) -> int:
    """How often to walk and sample, so that windows with ``max_edits`` edits are candidates with the target chance on average."""
    if not max_edits:
        return 1
    chance = collision_chances(window, max_edits, sample)
    most = next((n for n in (1 << k for k in range(14)) if np.mean(1 - (1 - chance) ** n) >= target), 1 << 13)
    return next(n for n in range(most // 2, most + 1) if n == most or np.mean(1 - (1 - chance) ** n) >= target)


def run_keys(h: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, keys) of the runs of ``n`` words inside of texts."""
    at = np.flatnonzero(np.arange(len(h)) + n <= ends)
    keys = np.zeros(len(at), U64)
    for k in range(n):
        keys = keys * U64(0x9FB21C651E98DF25) + h[at + k]
    return at, mix(keys)


def windows_near(runs: np.ndarray, ends: np.ndarray, window: int, max_edits: int) -> np.ndarray:
    """Starts of the windows that may be within ``max_edits`` edits of one with a run that begins at ``runs``; at the end of a text they may lack as many words."""
    n, first = len(ends), window - window // (max_edits + 1) + max_edits
    turns = np.bincount(np.maximum(runs - first, 0), minlength=n + 1) - np.bincount(np.minimum(runs + max_edits + 1, n), minlength=n + 1)
    return np.flatnonzero((np.cumsum(turns[:n]) > 0) & (np.arange(n) + window - max_edits <= ends))


def window_keys(h: np.ndarray, ends: np.ndarray, window: int, steps: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows, keys [repetition, window]) of word hashes ``h``; ``ends``: for each word, where its text ends; ``at``: the starts if not all."""
    whole = at is None
    if whole:
        at = np.flatnonzero(np.arange(len(h)) + window <= ends)
    keys = np.zeros((len(steps), len(at)), U64)
    if not len(at):
        return at, keys
    limit, start, held = np.minimum(at + window, ends[at]), at, h
    if not whole:  # only the words of the windows asked for
        used = np.cumsum(np.bincount(at, minlength=len(h) + 1) - np.bincount(limit, minlength=len(h) + 1))[: len(h)] > 0
        start, held = (np.cumsum(used) - 1)[at], h[used]
    for r, s in enumerate(steps):
        wanted = set(s.tolist())
        for k, out in enumerate(_walk(held, start, start + limit - at, int(s.max()) + 1, r)):
            if k in wanted:
                keys[r] = keys[r] * U64(0x9FB21C651E98DF25) + out
    return at, mix(keys ^ np.arange(len(steps), dtype=U64)[:, None])


def edits_within(a: list, b: list, most: int, prefix: bool = False) -> int:
    """Edit distance of two word lists if it is at most ``most``, else most + 1; with ``prefix``, of ``a`` and the beginning of ``b`` nearest to it.

    For each number of edits and diagonal (place in b less place in a), the furthest place in a that is reached.
    """
    n, m, reach = len(a), len(b), {0: 0}
    for e in range(most + 1):
        after: dict[int, int] = {}
        for k, i in reach.items():
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            if i == n and (prefix or i + k == m):
                return e
            for kk, ii in ((k, i + 1), (k - 1, i + 1), (k + 1, i)):
                if ii <= n and ii + kk <= m and ii > after.get(kk, -1):
                    after[kk] = ii
        reach = after
    return most + 1


class _Lookup:
    """Sorted keys with a table of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U64(64 - max(10, min(26, int(len(keys)).bit_length() + 5)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(keys >> self.shift).astype(np.int64)] = True

    def ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``keys`` are held, from, to)."""
        some = np.flatnonzero(self.seen[(keys >> self.shift).astype(np.int64)])
        lo, hi = (np.searchsorted(self.keys, keys[some], side) for side in ("left", "right"))
        held = hi > lo
        return some[held], lo[held], hi[held]


@dataclass(frozen=True)
class Plan:
    """How windows of one size are searched for: the items of exactly ``window`` words (``least`` or more for the largest window)."""

    window: int
    max_edits: int
    steps: np.ndarray
    largest: bool

    @property
    def run(self) -> int:
        """Words in a row that a window within ``max_edits`` edits has in common with the item's."""
        return max(1, self.window // (self.max_edits + 1))


def plans(sizes: list[int], window: int, max_edits: int, sample: int, target: float) -> list[Plan]:
    out = []
    for n in sorted({min(n, window) for n in sizes if n}):
        edits = max_edits * n // window
        some = min(sample, 3 * n)
        out.append(Plan(n, edits, sampled_steps(n, some, repetitions(n, edits, some, target), bool(edits)), n == window))
    return out


class _Items:
    """The windows of a plan's items by key."""

    def __init__(self, items: list[tuple[int, str]], plan: Plan):
        words = [(i, t, WORD.findall(t.lower()) if t.isascii() else [w.lower() for w in WORD.findall(t)]) for i, t in items]
        words = [x for x in words if (len(x[2]) >= plan.window if plan.largest else len(x[2]) == plan.window)]
        self.plan, self.words, self.ids = plan, [w for *_, w in words], [i for i, *_ in words]
        keys, item, place, runs = [], [], [], []
        for b in blocks(pa.array([t for _, t, _ in words], pa.string())):
            t = tokens(b, words_only=True, lower=True)
            ends = t.first[1:][t.text]
            at, k = window_keys(t.hash, ends, plan.window, plan.steps)
            runs.append(run_keys(t.hash, ends, plan.run)[1])
            for r in range(len(plan.steps)):
                keys.append(k[r])
                item.append(t.text[at] + b.first)
                place.append(at - t.first[t.text[at]])
        keys, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        self.windows, self.item, self.place = _Lookup(keys[order].astype(U64)), self.item[order], self.place[order]
        self.runs = _Lookup(np.unique(np.concatenate(runs)) if runs else np.zeros(0, U64))


def verified(words: list[str], at: int, item: list[str], place: int, window: int, max_edits: int) -> int:
    """Edits between the document's window and the item's (max_edits + 1 if more)."""
    a, b = words[at : at + window], item[place : place + window]
    if a == b:
        return 0
    return edits_within(b, words[at : at + window + max_edits], max_edits, prefix=True) if max_edits else 1


def longest_run(words: list[str], at: int, item: list[str], place: int) -> int:
    """Equal consecutive words around a pair of places."""
    left = 0
    while left < min(at, place) and words[at - left - 1] == item[place - left - 1]:
        left += 1
    right = 0
    while at + right < len(words) and place + right < len(item) and words[at + right] == item[place + right]:
        right += 1
    return left + right if right else 0


_held: dict[str, list[_Items]] = {}  # of the last search that this worker took part in


def judged(words: list[str], item: list[str], places: Iterable[tuple[int, int]], window: int, max_edits: int) -> tuple[int, int, int, int] | None:
    """(fewest edits, longest run, words of the item covered, its words) of the pairs of places that are within the edits; None if none is."""
    best, longest, covered = max_edits + 1, 0, set()
    for at, place in places:
        e = verified(words, at, item, place, window, max_edits)
        if e <= max_edits:
            best, longest = min(best, e), max(longest, longest_run(words, at, item, place))
            covered.update(range(place, place + window))
    return (best, longest, len(covered), len(item)) if best <= max_edits else None


def _search(shared, name: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _held:
            _held.clear()
            items, some = shared.value
            _held[name] = [_Items(items, p) for p in some]
        for batch in it:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            for b in blocks(texts):
                t = tokens(b, words_only=True, lower=True)
                ends = t.first[1:][t.text]
                for have in _held[name]:
                    p = have.plan
                    hits: dict[int, set] = defaultdict(set)
                    runs, k = run_keys(t.hash, ends, p.run)
                    at = windows_near(runs[have.runs.ranges(k)[0]], ends, p.window, p.max_edits)
                    if not len(at):
                        continue
                    at, keys = window_keys(t.hash, ends, p.window, p.steps, at)
                    for r in range(len(p.steps)):
                        for k, lo, hi in zip(*have.windows.ranges(keys[r]), strict=True):
                            w = at[k]
                            d = t.text[w]
                            hits[d].update((int(w - t.first[d]), x) for x in range(lo, hi))
                    for d, found in hits.items():
                        words = [w.lower() for w in WORD.findall(texts[b.first + int(d)].as_py())]
                        of: dict[int, list] = defaultdict(list)
                        for w, x in found:
                            of[int(have.item[x])].append((w, int(have.place[x])))
                        doc = ids[b.first + int(d)].as_py()
                        for i, places in of.items():
                            if got := judged(words, have.words[i], places, p.window, p.max_edits):
                                rows.append((doc, have.ids[i], *got))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "item_id", "edits", "run_words", "covered_words", "item_words"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
LEAKS = "doc_id long, item_id long, edits int, run_words int, covered_words int, item_words int"


KEYED = "id long, key long, place int"


def _keyed(ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32))], names=["id", "key", "place"])


def _bits_of(run: int, bits: int):
    """(word, mask): the bitmap's words that a batch's runs of ``run`` words set."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in blocks(batch.column(1)):
                t = tokens(b, words_only=True, lower=True)
                at = np.unique(run_keys(t.hash, t.first[1:][t.text], run)[1] >> U64(64 - bits))
                word, first = np.unique(at >> U64(6), return_index=True)
                mask = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    return go


def bitmap(items: DataFrame, run: int, words: int) -> tuple[np.ndarray, int]:
    """(bitmap, its number of bits as a power of two) of the items' runs: eight bits for each word of the items, at most 2 ** ``BITMAP_BITS``."""
    bits = min(BITMAP_BITS, max(10, (8 * words).bit_length()))
    got = items.mapInArrow(_bits_of(run, bits), "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(U64)
    return out, bits


def _keys_of(plan: Plan, shared=None, bits: int = 0):
    """(id, key, place) of every window of every text, or of the windows near runs that the bitmap has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = np.asarray(batch.column(0))
            for b in blocks(batch.column(1)):
                t = tokens(b, words_only=True, lower=True)
                near, ends = None, t.first[1:][t.text]
                if shared is not None:
                    runs, k = run_keys(t.hash, ends, plan.run)
                    k >>= U64(64 - bits)
                    held = (shared.value[(k >> U64(6)).astype(np.int64)] >> (k & U64(63))) & U64(1)
                    near = windows_near(runs[held == 1], ends, plan.window, plan.max_edits)
                at, keys = window_keys(t.hash, ends, plan.window, plan.steps, near)
                d = t.text[at]
                for r in range(len(plan.steps)):
                    yield _keyed(ids[d + b.first], keys[r], at - t.first[d])

    return run


def _verify_rows(plan: Plan):
    import pandas as pd

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for doc, item, text, question, places in zip(pdf.doc_id, pdf.item_id, pdf.text, pdf.item_text, pdf.places, strict=True):
                words, other = ([w.lower() for w in WORD.findall(x)] for x in (text, question))
                if got := judged(words, other, ((p["w"], p["p"]) for p in places), plan.window, plan.max_edits):
                    rows.append((doc, item, *got))
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


def _through_shuffle(docs: DataFrame, items: DataFrame, plan: Plan) -> DataFrame:
    """The leaks of one plan where its items are too many to send: only sampled keys, then candidates' texts, are shuffled."""
    n = F.size(F.regexp_extract_all("text", F.lit(f"({WORD.pattern})"), F.lit(1)))
    items = items.where(n >= plan.window if plan.largest else n == plan.window)
    words = items.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    held, bits = bitmap(items, plan.run, words)
    shared = docs.sparkSession.sparkContext.broadcast(held)
    d = docs.mapInArrow(_keys_of(plan, shared, bits), KEYED).select(F.col("id").alias("doc_id"), "key", F.col("place").alias("w"))
    i = items.mapInArrow(_keys_of(plan), KEYED).select(F.col("id").alias("item_id"), "key", F.col("place").alias("p"))
    meet = materialise(d.join(i, "key").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("w", "p")).alias("places")), "meet")
    return (
        meet.join(only_ids(docs, meet, "doc_id"), "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")
        .select("doc_id", "item_id", "text", "item_text", "places").mapInPandas(_verify_rows(plan), LEAKS)
    )


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = 13, max_edits: int = 1, sample: int = 7, target_recall: float = 0.99, broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """Documents (doc_id, text) with windows of items (item_id, text) within ``max_edits`` edits.

    doc_id, item_id, edits (fewest of a window), run_words (longest run of equal words), covered_words of item_words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").dropDuplicates(["item_id"])
    n = F.size(F.regexp_extract_all("text", F.lit(f"({WORD.pattern})"), F.lit(1)))
    sizes = items.groupBy(F.least(n, F.lit(window)).alias("n")).agg(F.sum(n).alias("words")).collect()  # at most window + 1 rows
    some = plans([r.n for r in sizes], window, max_edits, sample, target_recall)
    if sum(r.words * len(p.steps) for r in sizes for p in some if p.window == r.n) <= broadcast_words:
        shared = docs.sparkSession.sparkContext.broadcast(([(r.item_id, r.text) for r in items.collect()] if some else [], some))
        found = docs.mapInArrow(_search(shared, uuid.uuid4().hex), LEAKS)
    else:
        found = reduce(DataFrame.unionByName, [_through_shuffle(docs, items, p) for p in some])
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), *(F.max(c).alias(c) for c in ("run_words", "covered_words", "item_words")))
