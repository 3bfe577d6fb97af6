"""What a single model answer looks like: its ending, verdict, opening. Plain functions of whole texts."""

from __future__ import annotations

import re

# Forms of a verdict that close an answer.
LABEL = r"(?:SAFE|VULNERABLE|YES|NO|TRUE|FALSE|NONE|UNKNOWN|CWE-\d+|No-Vulnerability)"
BARE = r"(?-i:SAFE|VULNERABLE|YES|NO|CWE-\d+)"
VERDICT_LINE = re.compile(
    rf"""\W*(?:
        \[\[\s*FINAL_ANSWER\s*:\s*[^\[\]\n]*[^\s\[\]][^\[\]\n]*\]\] |
        (?:FINAL[ ]ANSWER|ANSWER|VERDICT|DECISION|URTEIL|VEREDICTO)\W{{1,6}}{LABEL} |
        {BARE}
    )\W*""",
    re.I | re.X,
)
VERDICT_ANYWHERE = re.compile(
    rf"""\[\[\s*FINAL_ANSWER\s*:\s*[\w*"'] | "is_vulnerable"\s*:\s*(?:true|false) |
    ^[^\w\n]*(?:FINAL[ ]ANSWER|ANSWER|VERDICT|DECISION|URTEIL|VEREDICTO)\W{{1,6}}{LABEL}\b | ^[^\w\n]*{BARE}[^\w\n]*$""",
    re.I | re.X | re.M,
)
VERDICT_WORD = re.compile(
    r"\b(?:safe|unsafe|vulnerable|insecure|verwundbar|sicher|unsicher|segur[ao]|insegur[ao]|vulnerables?|vulnérable|sûre?|vulnerável|vulnerabile|sicura)\b|уязвим|безопасн|安全的?。|有漏洞|存在漏洞", re.I
)
ERROR_NOTICE = re.compile(r"\W*(?:error|exception|fatal|traceback|http(?: error)? \d{3}|timeout|timed out)\b[^\n]{0,240}", re.I)
CUT_MARK = re.compile(
    r"""(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|[\[(<{*_-]{1,3}\s*(?:(?:output|text|response|answer|message|content)\s+)?
    (?:truncated|cut(?:[ -]off)?|clipped|shortened|snip(?:ped)?|continued|abgeschnitten|gekürzt|cortado|truncado)\b[^\n]{0,30}[\])>}*_-]{1,3})\s*$""",
    re.I | re.X,
)
JSON_BEGIN = re.compile(r"^[ \t]*\{\s*(?:\"|\Z)", re.M)  # an object with a key, not a block of code
DOTS = re.compile(r"(?:\.{3,}|…)$")
ABBREVIATION = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|z\. ?B|d\. ?h|p\. ?ej|bzw|vs|etc|cf|resp|approx|incl|Nr|No)\.$", re.I)
TERMINAL = re.compile(r"[.!?。！？؟।][\"'”’»«“)\]*_`]*$")
NOTE = re.compile(r"[-*(# ]*[^\W\d_][\w ]{1,30}:\s|\(|--|[-=*_]{2,}")
LIST_NUMBER = re.compile(r"\s*(?:[-*+]|\d+[.)]|[a-z][.)])\s*")
LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
CODE_LINE = re.compile(r"\s*(?:[{}]|[^\s].*[;{}]$|//|/\*|\*/|#\s*(?:include|define|if|else|endif)|(?:def|class|return|if|for|while|try|except|raise|import|from|else|elif|with|async|public|private|static|function|const|let|var)\b.*|[\w.\[\]\"']+\s*[-+*/|&^]?=\s.*|@\w+.*|[\w.]+\(.*\)|\w+:$|\"\"\")")


def mostly_code(lines: list[str]) -> bool:
    """Source text alone, as an echo of the question's code is: nearly every line has the shape of code and several are indented."""
    lines = [re.sub(r"^> ?", "", x) for x in lines]
    if len(lines) < 3 or any(x.lstrip().startswith("```") for x in lines):
        return False
    shaped = sum(bool(CODE_LINE.fullmatch(x.rstrip())) or x[:1] in (" ", "\t") for x in lines)
    return shaped >= 0.9 * len(lines) and sum(x[:1] in (" ", "\t") for x in lines) >= 0.3 * len(lines)


def ending(text: str) -> str:
    """'blank', 'error', 'code', 'complete', 'marked' (a mark in place of the rest), 'broken' (in the middle of something) or 'open' (no end mark, but not clearly broken)."""
    s = text.rstrip()
    if not s:
        return "blank"
    if ERROR_NOTICE.fullmatch(s):
        return "error"
    lines = [x for x in LINES.split(s) if x.strip()]
    last = lines[-1].rstrip()
    bare = last.strip()
    if CUT_MARK.search(s):
        return "marked"
    if s[-1] == "�":
        return "broken"
    if m := DOTS.search(s):
        before = s[: m.start()]
        sentence = re.split(r"(?<=[.!?。])\s+|\n", before)[-1]
        words = re.findall(r"[^\W\d_]+", sentence)
        if m.group().startswith("....") or not (len(words) >= 4 and VERDICT_WORD.fullmatch(words[-1])):
            return "marked"
        return "complete"
    if s.count("```") % 2:
        return "broken"
    if s.rfind("[[") > s.rfind("]]"):
        return "broken"
    if bare == "```" or VERDICT_LINE.fullmatch(bare):
        return "complete"
    if mostly_code(lines):
        return "code"
    if at := [m.start() for m in JSON_BEGIN.finditer(s)]:
        tail = s[at[-1] :]
        if tail.count("{") > tail.count("}"):
            return "broken"
    if bare.endswith(("}", "]")):
        return "complete"
    closed = bool(VERDICT_ANYWHERE.search("\n".join(lines[-5:-1])))
    quotes = bare.count('"') % 2 or bare.count("`") % 2 or bare.count("“") > bare.count("”") or bare.count("«") > bare.count("»")
    if TERMINAL.search(bare):
        if ABBREVIATION.search(bare) or LIST_NUMBER.fullmatch(bare) or quotes:
            return "complete" if closed else "broken"
        return "complete"
    if closed:  # a note behind the verdict
        if re.fullmatch(r"([-=*_~])\1+ .+ ([-=*_~])\2+|([-=*_~])\3+", bare):
            return "complete"
        if bare.count("(") > bare.count(")") or bare.startswith("--") or bare[-1] in ",-/:" or re.search(r"/\w+$", bare):
            return "broken"
        return "complete" if re.match(r"[-*# ]*[^\W\d_][\w ]{1,30}:\s+\S|\(.*\)$", bare) else "open"
    if not bare[-1].isascii() and not bare[-1].isalnum() and not bare[-1].isspace() and ord(bare[-1]) > 0x2190:
        return "complete"
    if NOTE.match(bare) and not LIST_NUMBER.match(bare) and len(lines) > 1 and not re.match(r"\W*(?:FINAL|ANSWER|VERDICT|DECISION)", bare, re.I):
        return "open"
    return "broken"


def is_empty(text: str | None) -> bool:
    """Null, blank, an empty marker, fence or object, or only a backend's error notice."""
    if text is None:
        return True
    s = text.strip()
    if not s or ERROR_NOTICE.fullmatch(s):
        return True
    s = re.sub(r"```\w*|\[\[\s*FINAL_ANSWER\s*:?\s*\]\]|^[^\w\n]*(?:FINAL ANSWER|ANSWER|VERDICT)[^\w\n]*$|\b(?:null|none|n/?a|empty|undefined)\b", " ", s, flags=re.I | re.M)
    return not re.search(r"\w", s)


def has_verdict(text: str) -> bool:
    """A verdict line, marker or object anywhere, or a verdict word in the last clause of one of the last two sentences."""
    if VERDICT_ANYWHERE.search(text):
        return True
    last = [x for x in re.split(r"(?<=[.!?。])\s+|\n+", text.strip()) if x.strip()][-2:]
    return any(VERDICT_WORD.search(re.split(r"[,;:–—]\s", x)[-1]) for x in last)


_HEADING = re.compile(r"\W*(?:\*\*[^\n]*?\*\*|#+[^\n]*|\w+:[^\S\n]*(?=\n))\s*")
_WORD = re.compile(r"[\w'’-]+")
_NAME = re.compile(r"_|\d|[a-z][A-Z]")


def opening(text: str, words: int = 8) -> str:
    """The first words of an answer behind its headings, without marks and markup, identifiers and numbers replaced by #."""
    at = 0
    while (m := _HEADING.match(text, at)) and m.end() > at:
        at = m.end()
    out = []
    for m in _WORD.finditer(text, at):
        w = m.group().replace("’", "'").strip("'-")
        out.append("#" if _NAME.search(w) else w.lower())
        if len(out) == words:
            break
    return " ".join(out)


_SENTENCE_END = re.compile(r"(?<=[.!?。])\s+|\n")


def first_sentence(text: str, words: int = 40) -> str:
    """The opening that is the first sentence, or nothing if that has fewer than five words."""
    text = text.strip()
    end = _SENTENCE_END.search(text)
    s = opening(text[: end.start()] if end else text, words)
    return s if s.count(" ") >= 4 else ""


def without_instruction(text: str, template: str) -> list[str]:
    """The non-blank lines of an answer that the template doesn't hold word for word."""
    held = " " + " ".join(words_of(template)) + " "
    fenced = "```" in template
    lines = [re.sub(r"^> ?", "", x) for x in LINES.split(text)]
    return [x for x in lines if x.strip() and not (fenced and x.strip() == "```") and (not (w := words_of(x)) or f" {' '.join(w)} " not in held)]


_W = re.compile(r"\w+")


def uncovered(answer: list[str], runs: set, n: int = 5) -> int:
    """How many words of the answer are outside of the runs of n words that the question has."""
    left, covered = 0, 0
    for i, run in enumerate(zip(*(answer[k:] for k in range(n)), strict=False)):
        if run in runs:
            left += max(0, i - covered)
            covered = i + n
    return left + max(0, len(answer) - covered)


def word_runs(text: str, n: int = 5) -> set:
    w = [x.lower() for x in _W.findall(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def words_of(text: str) -> list[str]:
    return [x.lower() for x in _W.findall(text)]


def is_copy(answer: list[str], outside: int, short: list[list[str]] = ()) -> bool:
    """Whether an answer (its words, and how many of them are ``uncovered``) has nothing but words of the question, up to a lead-in of four words (or a fiftieth of the answer)."""
    if answer in short:
        return True
    return len(answer) >= 5 and outside <= min(max(4, len(answer) // 50), (len(answer) - 1) // 2)
