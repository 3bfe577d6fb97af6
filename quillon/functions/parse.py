"""Free-text answers to labels, as Column expressions without Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract, last_match, lines, strip, strip_chars

# Forms of answers and label words.
FINAL_ANSWER = r"(?is)\[\[FINAL_ANSWER:\s*(.*?)\s*\]\]"
IS_VULNERABLE = r"(?i)\"is_vulnerable\"\s*:\s*(true|false)"
PREFIXED = r"(?i)^(?:FINAL\s*ANSWER|ANSWER|VERDICT|DECISION)\s*[:\-]?\s*(.+?)\s*$"
CWE = r"(?i)\bCWE-\d+\b"
KEYWORD = r"(?i)\b(VULNERABLE|SAFE)\b"
FALLBACK = r"(?i)\b(YES|NO|TRUE|FALSE|FOUND|DETECTED|NONE|CLEAN)\b"
CHOICE = r"^(?:FINAL\s*ANSWER|ANSWER|OPTION|CHOICE|VERDICT)?\s*[:\-]?\s*([ABCDE])(?:[.:])?$"
STRIPPED = "\"'`[](){}.,:; "
POSITIVE, NEGATIVE = ("VULNERABLE", "YES", "TRUE", "FOUND", "DETECTED"), ("SAFE", "NO", "FALSE", "NONE", "CLEAN")
TYPE_LABELS = (
    "Integer-Overflow", "Buffer-Overflow", "Null-Pointer-Dereference", "Use-After-Free", "Double-Free", "Memory-Leak", "Format-String", "Race-Condition", "Improper-Access-Control", "No-Vulnerability",
)


def bare(c: Column) -> Column:
    """Upper case without quotes, brackets and punctuation at the ends."""
    return F.upper(strip_chars(strip(c), STRIPPED))


def binary_word(c: Column) -> Column:
    """1 or 0 for a label word, else null."""
    b = bare(c)
    return F.when(b.isin(*POSITIVE), 1).when(b.isin(*NEGATIVE), 0)


def _tail(c: Column, one: Callable[[Column], Column]) -> Column:
    """The first non-null value of ``one`` over the last twelve lines, from the end."""
    last = F.slice(F.reverse(lines(c)), 1, 12)
    return F.try_element_at(F.filter(F.transform(last, one), lambda x: x.isNotNull()), F.lit(1))


def _candidate(line: Column) -> Column:
    return F.coalesce(extract(line, PREFIXED), line)


def final_answer(c: Column) -> Column:
    return last_match(c, FINAL_ANSWER)


def binary_tail(c: Column) -> Column:
    return _tail(c, lambda x: F.coalesce(binary_word(extract(x, PREFIXED)), binary_word(x)))


def binary(response: Column) -> Column:
    """JSON verdict, final-answer marker, last lines, last keyword, last fallback word, else 0."""
    r = strip(response)
    json = F.when(F.lower(last_match(r, IS_VULNERABLE)) == "true", 1).when(last_match(r, IS_VULNERABLE).isNotNull(), 0)
    word = F.upper(last_match(r, KEYWORD))
    keyword = F.when(word == "VULNERABLE", 1).when(word.isNotNull(), 0)
    return F.coalesce(json, binary_word(final_answer(r)), binary_tail(r), keyword, binary_word(last_match(r, FALLBACK)), F.lit(0))


def _class_line(line: Column) -> Column:
    c = _candidate(line)
    return F.coalesce(F.upper(extract(c, CWE, 0)), F.when(bare(c) == "SAFE", "SAFE"))


def multiclass(response: Column) -> Column:
    """Marker, last lines, last label anywhere, else UNKNOWN."""
    r = strip(response)
    anywhere = F.upper(last_match(r, r"(?i)\bCWE-\d+\b|\bSAFE\b", 0))
    return F.coalesce(_tail(final_answer(r), _class_line), _tail(r, _class_line), anywhere, F.lit("UNKNOWN"))


def type_label(c: Column) -> Column:
    """The canonical name of a vulnerability type, SAFE as No-Vulnerability, else null."""
    b = bare(c)
    out = F.when(b == "SAFE", "No-Vulnerability")
    for name in TYPE_LABELS:
        out = out.when(b == name.upper(), name)
    return out


def type_multiclass(response: Column) -> Column:
    r = strip(response)
    either = lambda x: F.coalesce(F.upper(extract(x, CWE, 0)), type_label(x))
    names = "|".join(sorted(TYPE_LABELS, key=lambda n: -len(n)))
    safe = F.when(F.regexp_like(r, F.lit(r"(?i)\b(?:SAFE|NO-VULNERABILITY|CLEAN)\b")), "No-Vulnerability")
    return F.coalesce(either(final_answer(r)), _tail(r, lambda x: either(_candidate(x))), type_label(last_match(r, f"(?i)({names})")), safe, F.lit("UNKNOWN"))


def yes_no(response: Column) -> Column:
    """YES or NO, NO by default."""
    r = strip(response)
    as_word = lambda b: F.when(b == 1, "YES").when(b == 0, "NO")
    return F.coalesce(as_word(binary_word(final_answer(r))), as_word(binary_tail(r)), F.upper(last_match(r, r"(?i)\b(YES|NO)\b")), F.lit("NO"))


def _choice_line(line: Column) -> Column:
    return extract(F.upper(strip(_candidate(line))), CHOICE)


def choice(response: Column) -> Column:
    """One of A to E, A by default."""
    r = strip(response)
    return F.coalesce(_tail(final_answer(r), _choice_line), _tail(r, _choice_line), F.lit("A"))


BINARY_TASKS = ("binary_vulnerability", "binary_cwe_specific", "binary_vulnerability_specific")
TASKS: dict[str, Callable[[Column], Column]] = dict.fromkeys(BINARY_TASKS, binary) | {"multiclass_vulnerability": multiclass, "type_multiclass": type_multiclass}


def parser_for(task_type: str, task: str | None = None) -> Callable[[Column], Column]:
    """The parser of a task type; tasks 1 to 5 of the five-task source by ``task``."""
    if task:
        return {"task1": yes_no, "task2": choice}.get(task, strip)
    if task_type not in TASKS:
        raise ValueError(f"no parser for task type {task_type!r}")
    return TASKS[task_type]


def lacks_marker(responses: Column, marker: str = "[[FINAL_ANSWER: ") -> Column:
    """Whether no response of the list has the marker; a missing or empty list counts as lacking."""
    return ~F.coalesce(F.exists(responses, lambda r: F.coalesce(F.contains(r, F.lit(marker)), F.lit(False))), F.lit(False))
