"""Content-defined chunking of long texts at natural boundaries.

A rolling hash over 32 characters marks landmarks. From where a piece begins, the first landmark between the minimum and the
maximum size is taken (the place of the smallest hash if there is none) and snapped to the strongest natural boundary near
it: the end of a function, else a blank line, else a line end. Landmarks depend on the 32 characters alone, so that an edit
alters only the pieces around it. Within a line a piece ends only if no line end lies within the maximum.

Consecutive pieces share exactly ``overlap`` characters. A boundary is where the shared characters end or, if the line behind it
would not fit into a piece otherwise, where they begin: every line of at most ``limit`` characters is whole in some piece, and a
piece is cut inside a line only if the line is longer. Own parts (pieces without the shared characters before them) concatenated give the text.

Results on special input: null texts, rows without an id and texts of at most ``limit`` characters give no pieces. Lines end with LF, CRLF or a lone CR;
a CRLF is never cut. Characters are code points. Repeated ids give pieces for each row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, _powers, mix

LINE_END = re.compile(r"\r\n|\n|\r")
WINDOW, SPACING = 32, 768
INSIDE, LINE, BLANK_LINE, FUNCTION = 0, 1, 2, 3
NAMES = ("inside", "line", "blank", "function")
_CLOSING = re.compile(r"[ \t]*(?:[})\]]|#|else\b|catch\b|finally\b|except\b|elif\b)")


def natural_boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places after line ends, the strength of each, where the lines end without their line end (one more), and the length of the longest line."""
    at, kind, stops, longest, begin = [], [], [], 0, 0
    before_blank, before_close, before_indent = False, False, False
    for m in LINE_END.finditer(text):
        longest = max(longest, m.start() - begin)
        stops.append(m.start())
        line = text[begin : m.start()]
        blank = not line.strip()
        before_close = line.startswith("}") if not blank else before_close
        before_indent = line[:1] in (" ", "\t") if not blank else before_indent
        before_blank = blank
        begin = m.end()
        if begin < len(text):
            top = text[begin] not in " \t\r\n" and not _CLOSING.match(text, begin)
            at.append(begin)
            kind.append(FUNCTION if top and (before_close or before_indent) else BLANK_LINE if before_blank else LINE)
    if len(stops) == len(at):
        stops.append(len(text))
    return np.array(at, np.int64), np.array(kind, np.int64), np.array(stops, np.int64), max(longest, len(text) - begin)


def rolling(text: str) -> np.ndarray:
    """A hash of the WINDOW characters before each place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    pw, inv = _powers(len(c) + 1)
    total = np.zeros(len(c) + 1, U64)
    np.cumsum(mix(c + U64(1)) * pw[: len(c)], out=total[1:])
    h = np.full(len(c) + 1, ~U64(0))
    if len(c) >= WINDOW:
        h[WINDOW:] = mix((total[WINDOW:] - total[:-WINDOW]) * inv[: len(c) + 1 - WINDOW])
    return h


def cut_text(text: str, limit: int = 6000, overlap: int = 200, least: int = 1500, near: int = 700) -> tuple[list[tuple[int, int, int]], int]:
    """[(begin of the own part, its end, kind of the boundary at its end)] and the longest line's length."""
    places, kinds, stops, longest = natural_boundaries(text)
    h = rolling(text)
    marks = np.flatnonzero(h < U64((1 << 64) // SPACING))
    n, parts = len(text), []
    starts, ends = np.append(0, places), np.append(places, n)
    # lines that fit into a piece, but only into one that begins with them
    wide = (ends - starts > limit - overlap) & (stops - starts <= limit)
    begin = at = 0  # of the own part and of the piece
    while True:
        most = at + limit
        if most >= n:
            parts.append((begin, n, -1))
            return parts, longest
        low = max(at + least, begin + 1)
        i, j = np.searchsorted(marks, (low, most + 1))
        mark = int(marks[i]) if i < j else low + int(np.argmin(h[low : most + 1]))
        i, j = np.searchsorted(places, (low, most + 1))
        if i < j:
            p, k = places[i:j], kinds[i:j]
            far = np.abs(p - mark)
            # stronger boundaries win while they are near; beyond that the nearest does
            cut = i + int(np.lexsort((p, far, np.where(far <= near, -k, 0)))[0])
        else:
            cut = i - 1  # the last one before the least size, if it is in the own part
        line = int(np.searchsorted(starts, begin, "right")) - 1  # the one in which the own part begins
        if cut >= 0 and places[cut] > begin:
            end, kind = int(places[cut]), int(kinds[cut])
            if (wide[cut + 1] or end < overlap) and end + overlap <= most:
                end += overlap  # the next piece begins at the boundary
        elif wide[line] and begin < stops[line] <= most:
            end, kind = int(stops[line]), LINE  # only its line end has no room
        elif wide[line] and begin == starts[line] > at:
            end, kind = begin + overlap, int(kinds[line - 1])  # a short piece, behind which the line begins one
        else:
            blanks = [m for m in (text.rfind(" ", mark - 100, mark), text.find(" ", mark, mark + 100)) if low < m < most]
            end, kind = (min(blanks, key=lambda m: abs(m - mark)) + 1 if blanks else mark - (text[mark - 1 : mark + 1] == "\r\n")), INSIDE
        parts.append((begin, end, kind))
        begin, at = end, end - overlap


def chunk(texts: DataFrame, limit: int = 6000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces of texts (row_id long, text string) of more than ``limit`` characters.

    row_id, piece, n_pieces, char_begin and char_end of the piece, own_begin (= char_begin + overlap but in the first),
    cut (kind of the boundary at its end or where the next piece begins, 'end' for the last), longest_line of the text, text of the piece.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: list[tuple] = []
            for row_id, text in zip(pdf.row_id, pdf.text, strict=True):
                parts, longest = cut_text(text, limit, overlap, least=min(1500, limit // 4), near=limit // 9)
                for k, (begin, end, kind) in enumerate(parts):
                    at = begin - overlap if k else 0
                    rows.append((row_id, k, len(parts), at, end, begin, NAMES[kind] if kind >= 0 else "end", longest, text[at:end] if with_text else None))
                if len(rows) > 2000:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)

    long = texts.select(F.col("row_id").cast("long").alias("row_id"), "text").where((F.length("text") > limit) & F.col("row_id").isNotNull())
    return long.mapInPandas(run, SCHEMA)


COLUMNS = ["row_id", "piece", "n_pieces", "char_begin", "char_end", "own_begin", "cut", "longest_line", "text"]
SCHEMA = "row_id long, piece int, n_pieces int, char_begin int, char_end int, own_begin int, cut string, longest_line int, text string"
