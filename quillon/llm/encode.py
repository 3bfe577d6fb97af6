"""Encoding of texts with a public byte-level BPE vocabulary.

Short texts are encoded as they are, in one narrow pass. A text with more than ``cut`` characters is cut into pieces that
are encoded in parallel on any executor and concatenated again as a tree, level by level, the joins of a level on any executor, too: where two pieces meet, a window around the join
is decoded and encoded again, growing on both sides until its first token equals the left piece's token there and its last
token the right piece's. A BPE encoding is valid exactly if all adjacent tokens are, so the joined list is then the encoding
of the whole. The same joining, within one pass, encodes runs without a split point that are longer than ``cut``.

Pieces are cut in halves at the place nearest the middle where the vocabulary's pattern always splits (before white space
that follows a visible character). A text without such a place is halved anywhere and the joins do the rest.

Results on special input: null and empty texts have the empty list; blank texts are encoded as they are; text that looks like a
special token is plain text. A repeated id gives a row for each row. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

#: Fixed value: the split pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY_DIR = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
#: A place that the pattern always splits: before ASCII white space, after what is visible by any definition of white space.
_BREAK = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b\ufeff])(?=[ \t\n\r])")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding of a vocabulary file of ranks, once for each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def halves(text: str, cut: int) -> list[str]:
    """Cut until no piece is longer than ``cut``: in the middle, or at the always-splitting place nearest to it within a quarter."""
    if len(text) <= cut:
        return [text]
    mid, reach = len(text) // 2, max(1, len(text) // 4)
    right = _BREAK.search(text, mid, min(len(text), mid + reach))
    left = None
    for size in (64, 1024, reach):
        for m in _BREAK.finditer(text, max(1, mid - min(size, reach)), mid):
            left = m
        if left:
            break
    at = min((m.start() for m in (left, right) if m), key=lambda p: abs(p - mid), default=mid)
    return halves(text[:at], cut) + halves(text[at:], cut)


def _pretokens_agree(text: str) -> bool:
    """Whether the text is one piece for the pattern."""
    m = regex.match(PATTERN, text)
    return bool(m) and m.end() == len(text)


def join(enc, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
    """The encoding of ``left + right`` from the encodings of both.

    Works on the bytes of the two pieces that meet: everything before the last certain split of ``left`` and after the first
    of ``right`` stays. Between them the window grows until both of its ends agree.
    """
    if not a or not b:
        return a + b
    if _BREAK.match(left[-1] + right[0], 1):
        return a + b
    # the stretch around the join in which the pattern's splits can change: up to the nearest certain splits
    at = max((m.start() for m in _BREAK.finditer(left, max(0, len(left) - 256))), default=None)
    if at is None:
        at = max((m.start() for m in _BREAK.finditer(left)), default=0)
    m = _BREAK.search(right)
    end = m.start() if m else len(right)
    mid = left[at:] + right[:end]
    na, nb = _count(enc, a, len(left[at:].encode()), True), _count(enc, b, len(right[:end].encode()), False)
    if na is None or nb is None:
        return enc.encode_ordinary(left + right)
    inner = None
    if len(mid) > 512 and _pretokens_agree(mid):
        inner = _window(enc, a[len(a) - na :], b[:nb])
    if inner is None:
        inner = enc.encode_ordinary(mid)
    return a[: len(a) - na] + inner + b[nb:]


def _count(enc, ids: list[int], n_bytes: int, from_end: bool) -> int | None:
    """How many tokens of one end make up ``n_bytes``, if a token ends there."""
    k = 0
    while n_bytes > 0 and k < len(ids):
        n_bytes -= len(enc.decode_single_token_bytes(ids[-1 - k] if from_end else ids[k]))
        k += 1
    return k if n_bytes == 0 else None


def _window(enc, a: list[int], b: list[int]) -> list[int] | None:
    """Join two encodings within one unsplit piece, encoding growing windows until both sides agree."""
    k = 4
    while True:
        ka, kb = min(k, len(a)), min(k, len(b))
        window = enc.decode_bytes(a[len(a) - ka :] + b[:kb])
        ids = enc._core_bpe.encode_single_piece(window)
        left_ok = ka == len(a) or (ids and ids[0] == a[len(a) - ka])
        right_ok = kb == len(b) or (ids and ids[-1] == b[kb - 1])
        if left_ok and right_ok and (len(ids) > 1 or (ka == len(a) and kb == len(b))):
            return a[: len(a) - ka] + list(ids) + b[kb:]
        if ka == len(a) and kb == len(b):
            return list(ids)
        k *= 2


def fold(enc, parts: list[tuple[str, list[int]]]) -> list[int]:
    """Concatenate neighbouring pieces two by two until one is left."""
    while len(parts) > 1:
        parts = [
            (parts[i][0] + parts[i + 1][0], join(enc, *parts[i], *parts[i + 1])) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
        ]
    return parts[0][1] if parts else []


def encode_text(enc, text: str, cut: int) -> list[int]:
    """One text; runs without white space beyond ``cut`` go through the tree, as BPE on a long run is slow."""
    if len(text) <= cut:
        return enc.encode_ordinary(text)
    out: list[int] = []
    begin = 0
    for m in _BREAK.finditer(text):
        if m.start() - begin >= cut:
            out += fold(enc, [(p, enc.encode_ordinary(p)) for p in halves(text[begin : m.start()], cut)])
            begin = m.start()
    rest = text[begin:]
    return out + fold(enc, [(p, enc.encode_ordinary(p)) for p in halves(rest, cut)])


def _lists(rows: list[list[int]]) -> pa.Array:
    off = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=off[1:])
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(off[-1]))
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _encode(path: str, cut: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [encode_text(enc, t, cut) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(rows)], names=["doc_id", "ids"])

    return run


def _pieces(cut: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for uid, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                parts = halves(text, cut)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * len(some), pa.int64()), pa.array([doc] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some, pa.string())],
                        names=["uid", "doc_id", "pos", "piece"],
                    )

    return run


def _encode_pieces(path: str, cut: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            rows = [encode_text(enc, t, min(cut, 4096)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(rows)], names=["uid", "doc_id", "pos", "piece", "ids"])

    return run


PIECE = "uid long, doc_id long, pos int, piece string, ids array<int>"
FAN = 8  # neighbouring pieces that one task joins at each level


def _join_pieces(path: str):
    """The pieces of one group, FAN neighbours at most, as one."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path)
        pdf = pdf.sort_values("pos")
        ids = fold(enc, [(p, [int(x) for x in i]) for p, i in zip(pdf.piece, pdf.ids, strict=True)])
        return pd.DataFrame({"uid": pdf.uid.iloc[:1], "doc_id": pdf.doc_id.iloc[:1], "pos": pdf.pos.iloc[:1] // FAN, "piece": ["".join(pdf.piece)], "ids": [ids]})

    return run


def encode_corpus(texts: DataFrame, vocabulary: str = "byte_bpe_50k", vocabulary_dir: str = VOCABULARY_DIR, run_cut: int = 4096, text_cut: int = 1 << 17) -> DataFrame:
    """(doc_id, ids array<int>) of texts (doc_id, text).

    ``run_cut``: characters without a certain split that are encoded at once; ``text_cut``: longer texts are spread over tasks.
    """
    path = os.path.join(vocabulary_dir, f"{vocabulary}.tiktoken")
    t = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") > text_cut, F.lit(False))
    short = t.where(~long).mapInArrow(_encode(path, run_cut), "doc_id long, ids array<int>")
    # long texts are few: the second look at the table reads the texts' lengths, and writes the pieces of those that are
    pieces = materialise(
        t.where(long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
        .mapInArrow(_pieces(text_cut // 2), "uid long, doc_id long, pos int, piece string")
        .repartition("uid", "pos").mapInArrow(_encode_pieces(path, run_cut), PIECE),
        "pieces",
    )
    most = pieces.agg(F.max("pos")).first()[0]
    if most is None:
        return short
    while most > 0:
        pieces = pieces.groupBy("uid", F.floor(F.col("pos") / FAN).alias("level")).applyInPandas(_join_pieces(path), PIECE)
        most //= FAN
    return short.unionByName(pieces.select("doc_id", "ids"))
