"""Whether a text is valid source of a language: C, C++, Java, C#, JavaScript by bracket reduction over token classes, Python by its own parser.

A text becomes a string with one character for each token: its class. Innermost brackets are then replaced, level by level, by
one character that says what their contents can be (expressions, parameters, a loop header, statements, an initialiser, members).
What contents can be is decided by regular expressions over flat strings and a short statement matcher; as the same contents
recur all the time, the decisions are kept in a cache. Names, types and macros need no declaration.
"""

from __future__ import annotations

import ast
import re
import warnings
from functools import lru_cache

# Characters of brackets already reduced: base + bits of what the contents can be.
PAREN, SQUARE, BRACE = 0x4E00, 0x5000, 0x5200
EXPR, PARAMS, HEADER, TYPEARG = 1, 2, 4, 8  # of round brackets
INDEX, EMPTY, LIST = 1, 2, 4  # of square brackets
BLOCK, INIT, MEMBERS, OBJECT = 1, 2, 4, 8  # of braces


def _any(base: int, bit: int) -> str:
    return "[" + "".join(chr(base + k) for k in range(1, 16) if k & bit) + "]"


P_E, P_P, P_F = _any(PAREN, EXPR), _any(PAREN, PARAMS), _any(PAREN, HEADER)
P_ANY = "[" + "".join(chr(PAREN + k) for k in range(1, 16)) + "]"
S_I, S_E, S_L = _any(SQUARE, INDEX), _any(SQUARE, EMPTY), _any(SQUARE, LIST)
S_ANY = "[" + "".join(chr(SQUARE + k) for k in range(1, 16)) + "]"
B_B, B_I, B_M, B_O = (_any(BRACE, x) for x in (BLOCK, INIT, MEMBERS, OBJECT))
INNERMOST = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")

# Words of the languages and the classes used for them.
_CONTROL = {"if": "I", "else": "L", "while": "W", "for": "F", "do": "D", "switch": "S", "case": "C", "default": "O", "return": "R", "break": "K", "continue": "K"}
_C_TYPES = "void char short int long float double signed unsigned static extern register auto const volatile inline restrict _Bool _Complex _Atomic _Noreturn _Thread_local __inline __inline__ __volatile__ __const __restrict __extension__ typedef".split()
_OPS = {
    "+": "a", "-": "a", "*": "*", "&": "&", "&&": "A", "!": "u", "~": "u", "++": "p", "--": "p", "/": "b", "%": "b", "==": "b", "!=": "b", "<=": "b", ">=": "b", "||": "b", "^": "b", "|": "b",
    "<<": "b", "<": "<", ">": ">", "=": "=", "+=": "o", "-=": "o", "*=": "o", "/=": "o", "%=": "o", "&=": "o", "|=": "o", "^=": "o", "<<=": "o", ">>=": "o", "?": "?", ":": ":", ",": ",", ";": ";",
    ".": ".", "->": ".", "::": "d", "...": "E", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
}
_IDENT, _NUMBER = r"[^\W\d][\w$]*", r"\.?\d(?:[eEpP][+-]|[\w.]|'(?=\w))*"
_STRING, _CHAR = r'"(?:[^"\\\n\r]|\\(?:\r\n|.|\n))*"', r"'(?:[^'\\\n\r]|\\(?:\r\n|.|\n))+'"
_COMMENT = r"//(?:[^\n\\]|\\(?:\r\n|.|\n))*|/\*(?s:.*?)\*/"


class Grammar:
    """A language over token classes. Subclasses set ``words``, ``ops`` and ``scanner`` and say what brackets hold."""

    words: dict[str, str]
    ops: dict[str, str]
    scanner: re.Pattern

    def classes(self, text: str) -> str | None:
        return self.classed(self.scanner.findall(text))

    def classed(self, found: list[str]) -> str | None:
        """The classes of tokens; short tokens are remembered, as most recur."""
        known = self.__dict__.setdefault("_known", self.ops | self.words)
        out = []
        for t in found:
            c = known.get(t)
            if c is None:
                c = self.token(t)
                if c is None:
                    return None  # a character that the language doesn't have here
                if len(t) < 32:
                    if len(known) > 200_000:
                        known.clear()
                        known.update(self.ops | self.words)
                    known[t] = c
            out.append(c)
        return "".join(out)

    def token(self, t: str) -> str | None:
        h = t[0]
        if h.isspace():
            return self.space(t)
        if h == "/" and t[:2] in ("//", "/*"):
            return self.space(t) if "\n" in t and t[1] == "*" else ""
        if h.isalpha() or h == "_" or h == "$":
            return "n" if t[-1] in "\"'" else "i"
        if h.isdigit() or (h == "." and len(t) > 1) or len(t) > 1 and t[-1] in "\"'`/" or len(t) > 2:
            return "n"
        return None

    def space(self, t: str) -> str:
        return ""

    def prepare(self, text: str) -> str | None:
        return text

    def simplify(self, s: str) -> str:
        return s

    def fails_early(self, text: str) -> bool:
        """Whether the first closed bracket already holds what the language doesn't have there: then the rest need not be read."""
        first = []
        for m in self.scanner.finditer(text):
            first.append(m.group())
            if first[-1] in (")", "]", "}"):
                break
        s = self.classed(first)
        m = s and INNERMOST.search(s)
        return s is None or bool(m) and not self.kind(m.group())

    def valid(self, text: str, foreign: bool = False) -> bool:
        t = self.prepare(text)
        if t is None or foreign and self.fails_early(t):
            return False
        s = self.classes(t)
        if not s or not s.strip("N"):
            return False
        reduce = self._reduce
        while True:
            n = len(s)
            try:
                s = INNERMOST.sub(reduce, s)
            except _Invalid:
                return False
            if len(s) == n:
                break
        if any(c in s for c in "()[]{}"):
            return False
        return self.top(self.simplify(s))

    def _reduce(self, m: re.Match) -> str:
        c = self.kind(m.group())
        if not c:
            raise _Invalid
        return c

    @lru_cache(maxsize=200_000)  # noqa: B019 - grammars live as long as the process
    def kind(self, group: str) -> str:
        """The character that stands for a bracket with flat contents; '' if it can't be anything."""
        body = self.simplify(group[1:-1])
        if group[0] == "(":
            bits = self.round(body)
            return chr(PAREN + bits) if bits else ""
        if group[0] == "[":
            bits = self.square(body)
            return chr(SQUARE + bits) if bits else ""
        bits = self.curly(body)
        return chr(BRACE + bits) if bits else ""

    def round(self, s: str) -> int:
        raise NotImplementedError

    def square(self, s: str) -> int:
        raise NotImplementedError

    def curly(self, s: str) -> int:
        raise NotImplementedError

    def top(self, s: str) -> bool:
        raise NotImplementedError


class _Invalid(Exception):
    pass


# ---- C and C++ ----

_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)")


def preprocessed(text: str) -> str | None:
    """Without directives and without #elif and #else branches; None if conditionals aren't closed."""
    if "#" not in text:
        return text
    if not re.search(r"^[ \t]*#", text, re.M):
        return text
    out, depth, skip, inside, continued = [], 0, 0, False, False
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        m = None if inside else _DIRECTIVE.match(line)
        if continued:
            continued = body.endswith("\\")
            out.append("\n")
            continue
        if m:
            word = m.group(1)
            if word in ("if", "ifdef", "ifndef"):
                depth += 1
                skip += bool(skip)
            elif word in ("else", "elif", "elifdef", "elifndef"):
                if not depth:
                    return None
                skip = skip or 1
            elif word == "endif":
                if not depth:
                    return None
                depth -= 1
                skip -= bool(skip)
            elif word not in ("define", "undef", "include", "include_next", "import", "pragma", "line", "error", "warning", "ident", "region", "endregion", "nullable", ""):
                return None
            continued = body.endswith("\\")
            out.append("\n")
            continue
        if not skip:
            out.append(line)
        # a directive inside of a block comment is none
        if "/*" in line or inside:
            rest, inside = body, inside
            while True:
                if inside:
                    k = rest.find("*/")
                    if k < 0:
                        break
                    rest, inside = rest[k + 2 :], False
                else:
                    m2 = re.search(r'"(?:[^"\\]|\\.)*"|//.*|/\*', rest)
                    if not m2:
                        break
                    inside = m2.group() == "/*"
                    rest = rest[m2.end() :]
    return None if depth else "".join(out)


class CFamily(Grammar):
    """C; C++ adds to it."""

    cpp = False
    words = _CONTROL | dict.fromkeys(_C_TYPES, "t") | {
        "struct": "s", "union": "s", "enum": "s", "goto": "G", "sizeof": "z", "_Alignof": "z", "__alignof__": "z", "typeof": "q", "__typeof__": "q", "__typeof": "q",
        "__attribute__": "q", "__attribute": "q", "__declspec": "q", "_Alignas": "q", "_Static_assert": "i", "asm": "m", "__asm__": "m", "__asm": "m",
    }
    ops = _OPS
    scanner = re.compile(rf"{_COMMENT}|(?:u8|[LuU])?{_STRING}|(?:u8|[LuU])?{_CHAR}|{_IDENT}|{_NUMBER}|\.\.\.|<<=|>>=|->|\+\+|--|<<|&&|\|\||[-+*/%&|^=!<>]=|\s+|.", re.S)

    def __init__(self):
        t, more = "t", ""
        self.attr = re.compile(rf"q{P_ANY}")
        self.generic = None
        ident = "i"
        self.unit = unit = (
            rf"(?:[aup*&A]|{P_P}(?=[aup*&Ainzwc{P_ANY[1:-1]}{S_ANY[1:-1]}]|{B_I})|z(?!{P_ANY})|{more}w)*+"
            rf"(?:z{P_ANY}|i|n(?:i?n)*+|{P_E}|{P_P}{B_I})(?:{P_E}|{S_I}|{S_E}|\.[iu]*i|p)*+(?:{B_I})?+"
        )
        self._finish(unit, ident, t)

    def _finish(self, unit: str, ident: str, t: str) -> None:
        op = r"(?:[ab*&A<=o,]|>>?)" if False else r"(?:[ab*&A<=o]|>{1,2})"
        flat = rf"(?:{unit})(?:{op}(?:{unit}))*+"
        self.expr = expr = rf"(?:{flat}(?:\?(?:{flat})?:{flat})*+)"
        self.exprs = exprs = rf"{expr}(?:,{expr})*+"
        spec = self.spec = rf"(?:t|s(?:{ident})?(?:{B_B}|{B_I})?|{ident}(?=[tsi*&A]|{P_ANY}?[i*&A]))"
        name = self.name = rf"(?:{ident}|{P_P}|{P_E})"
        suffix = rf"(?:{S_ANY}|{P_P}|{P_E})*+(?:m{P_ANY})?(?:i(?={P_ANY}){P_ANY}|i(?=[,;=]))?"
        start = rf"(?:={expr}|={B_I}|:{expr})?"
        one = rf"[*&At]*+(?:{name})(?:{suffix}){start}"
        self.decl = rf"(?:(?:{spec})+{one}(?:,{one})*+|t+|t*s{ident}?(?:{B_B}|{B_I})?t*)"
        self.type_ = rf"t*(?:s{ident}|t|{ident})t*[*&At]*+(?:{P_P}|{S_ANY})*"
        self.re_expr = re.compile(rf"(?:{exprs})\Z")
        arg = rf"(?:{expr}|{self.type_}|{B_I}|{B_B})"
        self.re_args = re.compile(rf"(?:{arg}(?:,{arg})*,?)?\Z")
        param = rf"(?:(?:t|s{ident}|{ident})+[*&AtE]*+(?:{name}(?:{S_ANY}|{P_P}|{P_E})*+)?(?:={expr}|={B_I})?|E)"
        self.re_params = re.compile(rf"(?:{param}(?:,{param})*)?\Z")
        self.re_for = re.compile(rf"(?:(?:{self.decl}|{exprs})?;(?:{self.decl}|{exprs})?;(?:{exprs})?|{self.range_(ident, expr)})\Z")
        field = rf"(?:(?:\.i|{S_I})+=?)?(?:i:)?(?:{expr}|{B_I})"
        self.re_init = re.compile(rf"(?:{field}(?:,{field})*,?)?\Z")
        self.re_simple = re.compile(rf"(?:{self.decl}|{exprs}|R(?:{expr}|{B_I})?|Gi|G\*?{expr}|K|m[tG]*{P_ANY})?;")
        self.re_cond = re.compile(rf"(?:{self.decl}|{exprs})(?:;(?:{exprs}))?\Z")
        self.re_case = re.compile(rf"(?:C{flat}(?:E{flat})?|O):")
        self.re_head = re.compile(self.heads(ident, name))
        self.re_top_decl = re.compile(rf"(?:{self.decl})?;")
        self.re_old = re.compile(rf"(?:{self.decl});")

    def range_(self, ident: str, expr: str) -> str:
        return r"(?!)"

    def heads(self, ident: str, name: str) -> str:
        # a function's head up to its body; old-style parameter declarations are matched apart
        return rf"(?:t|s{ident}|{ident}(?=[ts*i])|[*])*+{name}{P_ANY}(?:i(?={P_ANY}|{B_B})(?:{P_ANY})?)*"

    def prepare(self, text: str) -> str | None:
        return preprocessed(text)

    def simplify(self, s: str) -> str:
        if "q" in s:
            s = re.sub(rf"q(?:{P_ANY}|{S_ANY})", lambda m: "", s) if not self._typeof(s) else s
        return s

    def _typeof(self, s: str) -> bool:
        return False

    def round(self, s: str) -> int:
        bits = 0
        if self.re_args.match(s):
            bits |= EXPR
        if self.re_params.match(s):
            bits |= PARAMS
        if (";" in s or ":" in s) and self.re_for.match(s):
            bits |= HEADER
        if not bits & EXPR and self.re_cond.match(s):
            bits |= TYPEARG
        return bits

    def square(self, s: str) -> int:
        if not s:
            return EMPTY
        return INDEX if self.re_expr.match(s) or re.fullmatch("t*(?:E|\\*)?", s) or self.re_params.match(s) else 0

    def curly(self, s: str) -> int:
        bits = 0
        if self.block(s):
            bits |= BLOCK
        if self.re_init.match(s):
            bits |= INIT
        return bits

    def block(self, s: str) -> bool:
        p, n = 0, len(s)
        while p < n:
            p = self.statement(s, p)
            if p < 0:
                return False
        return True

    def statement(self, s: str, p: int) -> int:
        """Where the statement at p ends, -1 if there is none."""
        if p >= len(s):
            return -1
        c = s[p]
        code = ord(c)
        if BRACE < code < BRACE + 16:
            return p + 1 if (code - BRACE) & BLOCK else -1
        if c in "IWSF":
            q = p + 1
            if c in "IF" and s[q : q + 1] == "t":  # if constexpr
                q += 1
            if not (q < len(s) and PAREN < ord(s[q]) < PAREN + 16):
                return -1
            bits = ord(s[q]) - PAREN
            if not bits & (HEADER if c == "F" else EXPR | TYPEARG):
                if not (c == "I" and bits & HEADER):
                    return -1
            p = self.statement(s, q + 1)
            if c == "I" and 0 <= p < len(s) and s[p] == "L":
                return self.statement(s, p + 1)
            return p
        if c == "D":
            p = self.statement(s, p + 1)
            if p < 0 or s[p : p + 1] != "W" or p + 1 >= len(s) or not PAREN < ord(s[p + 1]) < PAREN + 16 or s[p + 2 : p + 3] != ";":
                return -1
            return p + 3
        if c in "CO":
            m = self.re_case.match(s, p)
            return m.end() if m else -1
        if c == "i" and s[p + 1 : p + 2] == ":" and s[p + 2 : p + 3] != ":":
            return p + 2
        if (q := self.special(s, p)) != 0:
            return q
        m = self.re_simple.match(s, p)
        if m:
            return m.end()
        # a macro that stands for a loop or a statement
        if c == "i" and p + 1 < len(s) and PAREN < ord(s[p + 1]) < PAREN + 16:
            if p + 2 == len(s):
                return p + 2
            return self.statement(s, p + 2) if s[p + 2] != ";" or (ord(s[p + 1]) - PAREN) & EXPR else -1
        return -1

    def special(self, s: str, p: int) -> int:
        return 0

    def top(self, s: str) -> bool:
        p, n = 0, len(s)
        while p < n:
            q = self.external(s, p)
            if q < 0:
                return False
            p = q
        return True

    def external(self, s: str, p: int) -> int:
        m = self.re_head.match(s, p)
        if m:
            q = m.end()
            while (d := self.re_old.match(s, q)) and d.end() < len(s):  # old-style parameters
                q = d.end()
            q = self.after_head(s, q)
            if q < len(s) and BRACE < ord(s[q]) < BRACE + 16 and (ord(s[q]) - BRACE) & BLOCK:
                q += 1
                return q + 1 if s[q : q + 1] == ";" else q
            if self.cpp and (m2 := re.compile(r"(?:=[nOw])?;").match(s, q)):  # declared, defaulted or deleted member
                return m2.end()
        m = self.re_top_decl.match(s, p)
        if m:
            return m.end()
        # a macro used at top level without a semicolon
        if s[p] == "i" and p + 1 < len(s) and PAREN < ord(s[p + 1]) < PAREN + 16 and p + 2 < len(s):
            return p + 2
        return -1

    def after_head(self, s: str, q: int) -> int:
        return q


class Cpp(CFamily):
    cpp = True
    words = CFamily.words | dict.fromkeys("bool wchar_t char8_t char16_t char32_t constexpr consteval constinit mutable virtual explicit friend thread_local typename noexcept override final".split(), "t") | {
        "class": "s", "namespace": "V", "template": "T", "using": "U", "new": "w", "delete": "w", "throw": "R", "try": "Y", "catch": "H", "public": "Q", "private": "Q", "protected": "Q",
        "operator": "j", "co_return": "R", "co_await": "u", "co_yield": "R", "static_cast": "c", "dynamic_cast": "c", "const_cast": "c", "reinterpret_cast": "c", "decltype": "i",
        "alignas": "q", "alignof": "z", "typeid": "z", "and": "A", "or": "b", "not": "u", "this": "i", "nullptr": "n", "true": "n", "false": "n", "restrict": "i",
    }
    ops = _OPS | {"->": ".", "<=>": "b", ".*": "b", "->*": "b"}
    scanner = re.compile(
        rf"{_COMMENT}|(?:u8|[LuU])?R\"([^\s()\\]{{0,16}})\((?s:.*?)\)\1\"|(?:u8|[LuU])?{_STRING}|(?:u8|[LuU])?{_CHAR}|{_IDENT}|{_NUMBER}|\.\.\.|<=>|->\*|<<=|>>=|->|\+\+|--|<<|&&|\|\||::|[-+*/%&|^=!<>]=|\s+|.", re.S
    )
    _args = re.compile(rf"([ic]|T)<((?:i|t|s|n|,|d|[*&AE]|{P_ANY}|{S_ANY}|=)*)>")

    plain = re.compile(scanner.pattern.replace(rf"(?:u8|[LuU])?R\"([^\s()\\]{{0,16}})\((?s:.*?)\)\1\"|", ""), re.S)

    def classes(self, text: str) -> str | None:
        # the scanner has a group for the raw string's delimiter
        s = self.classed([m.group() for m in self.scanner.finditer(text)] if 'R"' in text else self.plain.findall(text))
        return s and self.simplify(s)

    def token(self, t: str) -> str | None:
        h = t[0]
        if h.isspace() or t[:2] in ("//", "/*") and len(t) > 1:
            return ""
        if h.isalpha() or h == "_" or h == "$":
            return "n" if t[-1] in "\"'" else "i"
        if h.isdigit() or (h == "." and len(t) > 1) or len(t) > 1 and t[-1] in "\"'":
            return "n"
        return None

    def __init__(self):
        lam = rf"(?:{S_ANY}(?:{P_ANY})?t*(?:\.(?:t|i)+[*&]*)?{B_B})"
        self.unit = unit = (
            rf"(?:[aup*&A]|{P_P}(?=[aup*&Ainzwcd{P_ANY[1:-1]}{S_ANY[1:-1]}]|{B_I})|z(?!{P_ANY})|w(?:{S_E})?|d)*+"
            rf"(?:z{P_ANY}|c{P_ANY}|{lam}|i|t+(?={P_E}|{B_I})|n(?:i?n)*+|{P_E}|{P_P}{B_I})(?:{P_E}|{S_I}|{S_E}|\.[iu]*i|p|di|E)*+(?:{B_I})?+"
        )
        self._finish(unit, "i", "t")
        self.re_ctor = re.compile(rf":i(?:{P_ANY}|{B_I})E?(?:,i(?:{P_ANY}|{B_I})E?)*")
        self.re_using = re.compile(r"U(?:V)?(?:t|i)+(?:=[^;]*)?;")
        self.re_class = re.compile(rf"t*s(?:{S_ANY})?i(?:t)?(?::[Qt]*i(?:,[Qt]*i)*)?")

    def range_(self, ident: str, expr: str) -> str:
        return rf"(?:t|s{ident}|{ident})+[*&At]*(?:{ident}|{S_ANY}):(?:{expr}|{B_I})"

    def heads(self, ident: str, name: str) -> str:
        return rf"(?:t|s{ident}|{ident}(?=[ts*i&Auj])|[*&A])*+(?:{name}|u?i|j(?:[ab*&A<>=oup,.]+|t|i|w{S_ANY}?|{P_ANY}|{S_ANY}))?{P_ANY}(?:t|i|{P_ANY}|[&A]|\.(?:t|i)+[*&]*)*"

    def simplify(self, s: str) -> str:
        s = super().simplify(s)
        if "<" in s:
            while True:
                s, k = self._args.subn(lambda m: m.group(1) if m.group(1) != "T" else "", s)
                if not k:
                    break
        if "d" in s:
            s = re.sub(r"(?:id)+(?:u?i|j)|(?:id)+(?=\*)", "i", s)
            s = re.sub(r"(?<![i])d(?=i)", "", s)
        return s

    def special(self, s: str, p: int) -> int:
        c = s[p]
        if c == "Y":
            p = self.statement(s, p + 1)
            if p < 0 or s[p : p + 1] != "H":
                return -1
            while s[p : p + 1] == "H":
                if not (p + 2 < len(s) and PAREN < ord(s[p + 1]) < PAREN + 16):
                    return -1
                p = self.statement(s, p + 2)
                if p < 0:
                    return -1
            return p
        if c == "U":
            m = self.re_using.match(s, p)
            return m.end() if m else -1
        if c == "Q":
            return p + 2 if s[p + 1 : p + 2] == ":" else -1
        return 0

    def square(self, s: str) -> int:
        return super().square(s) or (INDEX if re.fullmatch(r"(?:[=&]|[=&*]?(?:i|E)(?:=[^,]*)?)(?:,[=&*]?(?:i|E)(?:=[^,]*)?)*", s) else 0)

    def curly(self, s: str) -> int:
        bits = super().curly(s)
        if not bits & BLOCK and self.top(s):
            bits |= MEMBERS
        return bits

    def after_head(self, s: str, q: int) -> int:
        m = self.re_ctor.match(s, q)
        if m:
            return m.end()
        return q

    def external(self, s: str, p: int) -> int:
        c = s[p]
        if c == "T":
            return self.external(s, p + 1) if p + 1 < len(s) else -1
        if c == "Q":
            return p + 2 if s[p + 1 : p + 2] == ":" else -1
        if c == "U":
            m = self.re_using.match(s, p)
            return m.end() if m else -1
        if c == "V":
            m = re.compile(rf"V(?:i)?(?:{B_B}|{B_M}|{B_I})").match(s, p)
            return m.end() if m else -1
        m = self.re_class.match(s, p)
        if m and m.end() < len(s) and BRACE < ord(s[m.end()]) < BRACE + 16:
            k = s.find(";", m.end())
            return k + 1 if 0 <= k else -1
        return super().external(s, p)


# ---- Java and C# ----


class JavaFamily(Grammar):
    """Java; C# changes parts."""

    words = _CONTROL | dict.fromkeys("public private protected static final abstract native synchronized transient volatile strictfp sealed".split(), "t") | dict.fromkeys(
        "boolean byte short int long float double char void var".split(), "v"
    ) | {
        "throw": "X", "try": "Y", "catch": "H", "finally": "Z", "synchronized": "y", "new": "w", "instanceof": "x", "throws": "h", "extends": "e", "implements": "e", "class": "s", "interface": "s", "enum": "s", "record": "i",
        "import": "M", "package": "M", "assert": "R", "true": "n", "false": "n", "null": "n", "this": "i", "super": "i", "yield": "i", "goto": "!", "const": "!",
    }
    ops = {k: v for k, v in _OPS.items() if k not in ("->", "...")} | {"->": "l", "...": "E", ">>>=": "o", "@": "@", "&&": "b", "&": "b", "*": "b"}
    scanner = re.compile(rf'{_COMMENT}|"""(?s:.*?)"""|{_STRING}|{_CHAR}|{_IDENT}|{_NUMBER}|\.\.\.|<<=|>>=|>>>=|->|\+\+|--|<<|&&|\|\||::|[-+*/%&|^=!<>]=|\s+|.', re.S)
    _args = re.compile(rf"(?<=[i.])<(?:i|v|,|\?|e|b|\.|{S_E}|@i)*>")
    marks = rf"(?:@i{P_ANY}?)"

    def __init__(self):
        self.build()

    def simplify(self, s: str) -> str:
        if "@" in s:
            s = re.sub(rf"@i(?:\.i)*(?:{P_ANY})?", "", s)
        if "<" in s:
            while True:
                s, k = self._args.subn("", s)
                if not k:
                    break
        return s

    def build(self):
        dots = r"i(?:\.i)*+"
        typ = self.typ = rf"(?:v|{dots})(?:{S_E})*+"
        lam = rf"(?:(?:{P_ANY}|i)l(?:{B_B}))"
        lam_head = rf"(?:(?:{P_ANY}|i)l(?!{B_B}))"
        unit = rf"(?:[au]|p|{P_P}(?=[auinpwv{P_ANY[1:-1]}]))*+(?:{lam}|w(?:v|{dots})(?:{S_ANY})*+(?:{P_E}(?:{B_M})?|{B_I})?+|i|n|v(?={S_E}|\.)|{P_E}|S{P_E}{B_B})(?:{P_E}|{S_I}|{S_E}|\.(?:i|w{dots}{P_E}|s)|p|d(?:i|w))*+"
        op = r"(?:[ab<=o]|>{1,3})"
        flat = rf"(?:{lam_head})*+{unit}(?:x(?:t*{typ}(?:i)?|{unit})|{op}(?:{lam_head})*+{unit})*+"
        self.flat = flat
        self.expr = expr = rf"(?:{flat}(?:\?{flat}:{flat})*+)"
        exprs = rf"{expr}(?:,{expr})*+"
        one = rf"i(?:{S_E})*+(?:=(?:{expr}|{B_I}))?"
        self.decl = rf"t*{typ}{one}(?:,{one})*+"
        self.re_args = re.compile(rf"(?:(?:{expr}|{typ}(?:b{typ})*)(?:,{expr})*)?\Z")
        param = rf"t*{typ}(?:b{typ})*(?:E)?i?(?:{S_E})*"
        self.re_params = re.compile(rf"(?:{param}(?:,{param})*)?\Z")
        self.re_for = re.compile(rf"(?:(?:{self.decl}|{exprs})?;(?:{expr})?;(?:{exprs})?|t*{typ}i:{expr})\Z")
        self.re_resource = re.compile(rf"(?:t*{typ}i={expr}|{dots})(?:;(?:t*{typ}i={expr}|{dots}))*;?\Z")
        self.re_init = re.compile(rf"(?:(?:{expr}|{B_I})(?:,(?:{expr}|{B_I}))*,?)?\Z")
        self.re_index = re.compile(rf"{expr}\Z")
        self.re_simple = re.compile(rf"(?:{self.decl}|{exprs}|R(?:{expr}(?::{expr})?)?|X{expr}|Ki?|t*s[^;]*)?;")
        self.re_case = re.compile(rf"(?:C(?:{flat}|t*{typ}i)(?:,(?:{flat}|O))*|O)(?::|l)")
        head = rf"t*(?:<[^>]*>)?t*(?:{typ})?i{P_P}(?:{S_E})*(?:h{dots}(?:,{dots})*)?"
        self.re_method = re.compile(rf"(?:{head})(?:({B_B})|O?[^;]{{0,40}};)")
        self.re_field = re.compile(rf"{self.decl};|;")
        self.re_class = re.compile(rf"t*s i?".replace(" ", "") + rf"i(?:{P_P})?(?:e(?:{dots})(?:[,b]{dots})*)*(?:i(?:{dots})(?:,{dots})*)?(?:{B_M}|{B_I}|{B_B})")
        self.re_import = re.compile(r"Mt?i(?:\.i)*(?:\.b)?;")
        self.re_enum_head = re.compile(rf"(?:i(?:{P_E})?(?:{B_M})?(?:,i(?:{P_E})?(?:{B_M})?)*,?)?(?:;|\Z)")

    def round(self, s: str) -> int:
        bits = EXPR * bool(self.re_args.match(s)) | PARAMS * bool(self.re_params.match(s))
        if ";" in s or ":" in s or "N" in s:
            bits |= HEADER * bool(self.re_for.match(s))
        if "=" in s or ";" in s:
            bits |= TYPEARG * bool(self.re_resource.match(s))
        return bits

    def square(self, s: str) -> int:
        if not s:
            return EMPTY
        return INDEX if self.re_index.match(s) else 0

    def curly(self, s: str) -> int:
        bits = 0
        if self.block(s):
            bits |= BLOCK
        if self.re_init.match(s):
            bits |= INIT
        if self.members(s) or (m := self.re_enum_head.match(s)) and m.end() and self.members(s[m.end() :]):
            bits |= MEMBERS
        return bits

    block = CFamily.block

    def statement(self, s: str, p: int) -> int:
        if p >= len(s):
            return -1
        c = s[p]
        code = ord(c)
        if BRACE < code < BRACE + 16:
            return p + 1 if (code - BRACE) & BLOCK else -1
        if c in self.guarded:
            q = p + 1
            if not (q < len(s) and PAREN < ord(s[q]) < PAREN + 16):
                return -1 if c not in "y" else self.simple(s, p)
            bits = ord(s[q]) - PAREN
            if not bits & self.guarded[c]:
                return -1
            p = self.statement(s, q + 1)
            if c == "I" and 0 <= p < len(s) and s[p] == "L":
                return self.statement(s, p + 1)
            return p
        if c == "D":
            p = self.statement(s, p + 1)
            if p < 0 or s[p : p + 1] != "W" or p + 2 >= len(s) or not PAREN < ord(s[p + 1]) < PAREN + 16 or s[p + 2] != ";":
                return -1
            return p + 3
        if c == "Y":
            return self.try_(s, p)
        if c in "CO":
            m = self.re_case.match(s, p)
            return m.end() if m else self.simple(s, p)
        if c == "i" and s[p + 1 : p + 2] == ":":
            return self.statement(s, p + 2)
        return self.simple(s, p)

    guarded = {"I": EXPR, "W": EXPR, "S": EXPR, "F": HEADER, "y": EXPR}

    def simple(self, s: str, p: int) -> int:
        m = self.re_simple.match(s, p)
        if m:
            return m.end()
        m = self.re_class.match(s, p)
        return m.end() if m else -1

    def try_(self, s: str, p: int) -> int:
        p += 1
        resources = p < len(s) and PAREN < ord(s[p]) < PAREN + 16 and (ord(s[p]) - PAREN) & TYPEARG
        p = self.statement(s, p + bool(resources))
        if p < 0:
            return -1
        n = 0
        while s[p : p + 1] == "H":
            p = self.catch(s, p + 1)
            if p < 0:
                return -1
            n += 1
        if s[p : p + 1] == "Z":
            p = self.statement(s, p + 1)
            n += 1
        return p if n or resources else -1

    def catch(self, s: str, p: int) -> int:
        if not (p < len(s) and PAREN < ord(s[p]) < PAREN + 16 and (ord(s[p]) - PAREN) & PARAMS):
            return -1
        return self.statement(s, p + 1)

    def members(self, s: str) -> bool:
        p, n = 0, len(s)
        while p < n:
            q = self.member(s, p)
            if q < 0:
                return False
            p = q
        return True

    def member(self, s: str, p: int) -> int:
        for r in (self.re_method, self.re_field, self.re_class, self.re_import):
            m = r.match(s, p)
            if m:
                return m.end()
        m = re.compile(rf"t?{B_B}").match(s, p)
        return m.end() if m else -1

    def top(self, s: str) -> bool:
        return self.members(s)


class CSharp(JavaFamily):
    words = _CONTROL | dict.fromkeys("public private protected internal static readonly sealed abstract virtual override async extern unsafe volatile const partial ref out in params required".split(), "t") | dict.fromkeys(
        "bool byte sbyte short ushort int uint long ulong float double decimal char string object void var dynamic".split(), "v"
    ) | {
        "foreach": "f", "throw": "X", "try": "Y", "catch": "H", "finally": "Z", "lock": "y", "using": "y", "fixed": "y", "checked": "k", "unchecked": "k", "new": "w", "is": "x", "as": "x", "class": "s", "interface": "s", "struct": "s",
        "enum": "s", "namespace": "s", "goto": "G", "yield": "i", "await": "u", "true": "n", "false": "n", "null": "n", "this": "i", "base": "i", "typeof": "i", "sizeof": "i", "nameof": "i", "where": "g", "when": "g", "operator": "j", "delegate": "q",
        "event": "t", "in": "N", "stackalloc": "w", "get": "i", "set": "i", "from": "i", "select": "i",
    }
    ops = _OPS | {"=>": "l", "??": "b", "??=": "o", "?.": ".", "->": ".", "&&": "b", "&": "b", "*": "b", "..": "b"}
    _INTER = r'\$"(?:[^"\\{}\n]|\\.|\{\{|\}\}|\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\})*"'
    scanner = re.compile(
        rf'{_COMMENT}|\$*"""(?s:.*?)"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|{_INTER}|{_STRING}|{_CHAR}|@?{_IDENT}|{_NUMBER}|<<=|>>=|\?\?=|\?\?|\?\.(?!\d)|=>|->|\+\+|--|<<|&&|\|\||::|\.\.|[-+*/%&|^=!<>]=|\s+|.', re.S
    )
    _args = re.compile(rf"(?<=[i.])<(?:i|v|t|,|\?|\.|{S_E}|{P_ANY})*>")
    guarded = {"I": EXPR, "W": EXPR, "S": EXPR, "F": HEADER, "f": HEADER, "y": EXPR | TYPEARG}

    def prepare(self, text: str) -> str | None:
        return preprocessed(text.replace("@$", "$@"))

    def build(self):
        dots = r"i(?:[.d]i)*+"
        typ = self.typ = rf"(?:v|{dots}|{P_P}(?=i))\??(?:{S_E}\??)*+"
        unit = (
            rf"(?:[au]|p|{P_P}(?=[auinpwv{P_ANY[1:-1]}]))*+(?:(?:t*(?:{P_ANY}|i)l|q{P_ANY}?){B_B}|w(?:v|{dots})?\??(?:{S_ANY})*+(?:{P_E})?+(?:{B_I}|{B_B})?+|i|n|v(?=\.)|{P_E}|X{P_ANY}|O(?:{P_ANY})?)"
            rf"(?:{P_E}|{S_I}|{S_E}|\.i|di|p|u(?![inv]))*+(?:S{B_I})?"
        )
        head = rf"(?:t*(?:{P_ANY}|i)l(?!{B_B}))"
        op = r"(?:[ab<=o]|>{1,3})"
        piece = rf"(?:{head})*+(?:X)?{unit}"
        pattern = rf"(?:u|i)?(?:{typ}(?:i)?(?:{B_I})?|{unit}|{B_I}i?)"
        flat = self.flat = rf"{piece}(?:x{pattern}(?:(?:i)(?:{pattern}))*|{op}{piece})*+"
        self.expr = expr = rf"(?:{flat}(?:\?{flat}:{flat})*+)"
        exprs = rf"{expr}(?:,{expr})*+"
        one = rf"i(?:=(?:{expr}|{B_I}))?"
        self.decl = rf"t*{typ}{one}(?:,{one})*+"
        arg = rf"(?:i:)?t*(?:v(?:i)?|{typ}i|{expr})"
        self.re_args = re.compile(rf"(?:(?:{arg})(?:,(?:{arg}))*|{typ})?\Z")
        param = rf"t*(?:{typ})?(?:i)?(?:={expr})?"
        self.re_params = re.compile(rf"(?:{param}(?:,{param})*)?\Z")
        self.re_for = re.compile(rf"(?:(?:{self.decl}|{exprs})?;(?:{expr})?;(?:{exprs})?|t*{typ}(?:i|{P_ANY})?N{expr})\Z")
        self.re_resource = re.compile(rf"{self.decl}\Z")
        field = rf"(?:(?:{S_I}|i)=(?:{expr}|{B_I})|{expr}|{B_I}|i:{expr}|{flat}l{expr})"
        self.re_init = re.compile(rf"(?:{field}(?:,{field})*,?)?\Z")
        self.re_index = re.compile(rf",*{exprs}\Z|,+\Z")
        self.re_simple = re.compile(rf"(?:y?{self.decl}|{exprs}|i?R(?:{expr})?|X(?:{expr})?|i?K|G(?:i|C{expr}|O))?;")
        self.re_case = re.compile(rf"(?:C(?:{flat}|{typ}i?)(?:g{expr})?|O):")
        where = rf"(?:gi:(?:{typ}|s|w{P_ANY})(?:,(?:{typ}|s|w{P_ANY}))*)*"
        header = rf"t*(?:{typ})?(?:u?{dots}|j(?:[ab<>=oup]+|{typ}))(?:{P_P}){where}(?::i{P_ANY})?"
        self.re_method = re.compile(rf"{header}(?:({B_B})|l{expr};|;)")
        self.re_local = re.compile(rf"t*{typ}i{P_P}{where}(?:{B_B}|l{expr};)")
        self.re_field = re.compile(rf"{self.decl};|t*{typ}i(?:(?:{B_M}|{B_B}|{B_I})(?:={expr};)?|l{expr};)|t*{typ}i{S_ANY}(?:{B_M}|{B_B})|;")
        self.re_class = re.compile(rf"t*s{dots}(?:{P_P})?(?::{typ}(?:,{typ})*)?{where}(?:{B_M}|{B_B}|{B_I})")
        self.re_import = re.compile(r"yt?(?:i=)?i(?:\.i)*;")
        self.re_enum_head = re.compile(rf"(?:i(?:={expr})?(?:,i(?:={expr})?)*,?)?\Z")

    def simplify(self, s: str) -> str:
        # attributes before members and parameters
        s = re.sub(rf"(?:(?<=^)|(?<=[;,]))(?:{S_I})+(?=[tvi])", "", s)
        if "<" in s:
            while True:
                s, k = self._args.subn("", s)
                if not k:
                    break
        return s

    def simple(self, s: str, p: int) -> int:
        m = self.re_simple.match(s, p) or self.re_local.match(s, p)
        if m:
            return m.end()
        if s[p] == "k" and p + 1 < len(s):
            return self.statement(s, p + 1)
        return -1

    def catch(self, s: str, p: int) -> int:
        if p < len(s) and PAREN < ord(s[p]) < PAREN + 16:
            if not (ord(s[p]) - PAREN) & PARAMS:
                return -1
            p += 1
        if s[p : p + 1] == "g":
            p += 2
        return self.statement(s, p)


# ---- JavaScript ----


class JavaScript(Grammar):
    words = _CONTROL | {
        "throw": "X", "try": "Y", "catch": "H", "finally": "Z", "new": "w", "instanceof": "x", "in": "x", "of": "i", "function": "f", "var": "v", "let": "v", "const": "v", "class": "s", "extends": "e",
        "typeof": "u", "void": "u", "delete": "u", "await": "u", "yield": "y", "async": "k", "import": "M", "export": "P", "true": "n", "false": "n", "null": "n", "this": "i", "super": "i", "static": "i", "get": "i", "set": "i",
        "enum": "!", "with": "W", "debugger": "K",
    }
    ops = _OPS | {"=>": "l", "===": "b", "!==": "b", "**": "b", "??": "b", "?.": ".", "&&=": "o", "||=": "o", "??=": "o", "**=": "o", ">>>=": "o", "...": "E", "&&": "b", "&": "b", "*": "*"}
    _REGEX = r"(?:(?<=[(,=:\[!&|?{};\n])|(?<=return)|(?<=typeof))[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    _TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
    scanner = re.compile(
        rf"{_REGEX}|{_COMMENT}|{_STRING}|'(?:[^'\\\n\r]|\\(?:\r\n|.|\n))*'|{_TEMPLATE}|[#]?(?:[^\W\d]|\$)[\w$]*|{_NUMBER}|\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|>>>=|<<=|>>=|\?\?|\?\.(?!\d)|=>|\*\*|\+\+|--|<<|&&|\|\||[-+*/%&|^=!<>]=|\s+|.", re.S
    )

    def space(self, t: str) -> str:
        return "N" if "\n" in t or "\r" in t else ""

    def token(self, t: str) -> str | None:
        h = t[0]
        if h.isspace():
            return "n" if t.strip().startswith("/") and len(t.strip()) > 1 else self.space(t)
        if h == "/" and t[:2] in ("//", "/*"):
            return self.space(t)
        if h.isalpha() or h in "_$#":
            return None if t == "#" else "i"
        if h.isdigit() or (h == "." and len(t) > 1) or (len(t) > 1 and h in "\"'`/"):
            return "n"
        return None

    def classed(self, found: list[str]) -> str | None:
        known = self.__dict__.setdefault("_known", self.ops | self.words)
        special = self.ops.keys() | self.words.keys()
        out, dotted = [], False
        for t in found:
            c = known.get(t)
            if c is None:
                c = self.token(t)
                if c is None:
                    return None
                if len(t) < 32:
                    if len(known) > 200_000:
                        known.clear()
                        known.update(self.ops | self.words)
                    known[t] = c
            elif dotted and c.isalpha() and t in special:
                c = "i"  # a keyword is a name after a dot
            if c:
                dotted = c == "." or (dotted and c == "N")
            out.append(c)
        s = re.sub("N+", "N", "".join(out))
        # a line end stays only where a statement can end and another begin
        s = re.sub(r"N(?=[.,;)\]}=o?:b*<>lxa&])|(?<=[.,;(\[{=o?:b*<>lxaueE!&])N", "", s)
        return s

    def __init__(self):
        fn = rf"k?f\*?i?{P_P}{B_B}"
        arrow = rf"k?(?:{P_P}|i)l"
        cls = rf"si?(?:e(?:i(?:\.i)*)(?:{P_E})?)?{B_M}"
        unit = (
            rf"(?:[aup]|w(?!\.)|y\*?|E|{arrow}N?(?!{B_B}))*+(?:{arrow}N?{B_B}|{fn}|{cls}|i|n|y|k|{P_E}|{S_L}|{B_O}|M{P_E})(?:N?\.i|{P_E}|{S_I}|\.(?:{P_E}|{S_I})|n|p)*+"
        )
        op = r"(?:[ab*<=ox]|&|>{1,3})N?"
        flat = rf"{unit}(?:{op}{unit})*+"
        self.expr = expr = rf"(?:{flat}(?:\?N?{flat}N?:N?{flat})*+)"
        # conditional with arrow functions or nested conditionals in the middle
        exprs = self.exprs = rf"{expr}(?:,N?{expr})*+"
        target = rf"(?:i|{B_O}|{S_L}|{S_I})"
        self.decl = rf"v{target}(?:=N?{expr})?(?:,N?{target}(?:=N?{expr})?)*+"
        item = rf"(?:E?{expr})"
        self.re_args = re.compile(rf"N?(?:{item}N?(?:,N?{item}N?)*,?N?)?\Z")
        self.re_list = re.compile(rf"N?,*(?:{item}N?(?:,+N?{item}N?)*,*N?)?\Z")
        param = rf"(?:E?{target}(?:={expr})?)"
        self.re_params = re.compile(rf"N?(?:{param}N?(?:,N?{param}N?)*,?N?)?\Z")
        self.re_for = re.compile(rf"(?:(?:{self.decl}|{exprs})?;(?:{exprs})?;(?:{exprs})?|v?{target}(?:x|i){expr})\Z")
        self.re_in = re.compile(rf"v?{target}(?:\.i)*x{expr}\Z")
        key = rf"(?:i|n|[ILWFDSCORKXYHZwxfvseuyMPk]|{S_I}|{S_L})"
        prop = rf"(?:{key}N?:N?{expr}|(?:k|i)?\*?{key}{P_P}{B_B}|i(?:=N?{expr})?|k|E{expr})"
        self.re_object = re.compile(rf"N?(?:{prop}N?(?:,N?{prop}N?)*,?N?)?\Z")
        self.re_member = re.compile(rf"(?:;|N|(?:i(?!{P_ANY}|=|;|N|\Z))?(?:k)?\*?(?:i(?=\*?{key}))?\*?{key}{P_P}{B_B}|i?{key}(?:=N?{expr})?(?:;|N|\Z)|i{B_B})")
        self.re_simple = re.compile(rf"(?:{self.decl}|{exprs}|R(?:{exprs})?|X{exprs}|Ki?|M[^;N]*|P[^;N]*(?:{B_O})?[^;N]*)?(?:N?;|N|\Z)")
        self.re_fn = re.compile(rf"(?:P(?:O)?)?{fn}")
        self.re_cls = re.compile(rf"(?:P(?:O)?)?{cls}")
        self.re_case = re.compile(rf"(?:C{exprs}|O):")
        self.re_method = re.compile(rf"N?(?:i(?=[ik*{S_ANY[1:-1]}]))?k?\*?{key}{P_P}{B_B}N?")

    def round(self, s: str) -> int:
        bits = EXPR * bool(self.re_args.match(s)) | PARAMS * bool(self.re_params.match(s))
        t = s.replace("N", "")
        if self.re_for.match(t) or self.re_in.match(t):
            bits |= HEADER
        if not bits and "," in s and re.match(rf"{self.exprs}\Z", t):
            bits |= EXPR
        return bits

    def square(self, s: str) -> int:
        return (LIST if self.re_list.match(s) else 0) | (INDEX if s and re.match(rf"{self.exprs}\Z", s.replace("N", "")) else 0)

    def curly(self, s: str) -> int:
        return BLOCK * bool(self.block(s)) | OBJECT * bool(self.re_object.match(s)) | MEMBERS * bool(self.members(s))

    def members(self, s: str) -> bool:
        p = 0
        while p < len(s):
            m = self.re_member.match(s, p)
            if not m or m.end() == p:
                return False
            p = m.end()
        return True

    def block(self, s: str) -> bool:
        p, n = 0, len(s)
        while p < n:
            if s[p] in "N;":
                p += 1
                continue
            p = self.statement(s, p)
            if p < 0:
                return False
        return True

    def statement(self, s: str, p: int) -> int:
        while s[p : p + 1] == "N":
            p += 1
        if p >= len(s):
            return -1
        c = s[p]
        code = ord(c)
        if BRACE < code < BRACE + 16 and (code - BRACE) & BLOCK:
            return p + 1
        if c in "IWSF":
            q = p + 1
            if c == "F" and s[q : q + 1] == "u":
                q += 1
            if not (q < len(s) and PAREN < ord(s[q]) < PAREN + 16 and (ord(s[q]) - PAREN) & (HEADER if c == "F" else EXPR)):
                return -1
            p = self.statement(s, q + 1)
            if c == "I" and p >= 0:
                q = p
                while s[q : q + 1] == "N":
                    q += 1
                if s[q : q + 1] == "L":
                    return self.statement(s, q + 1)
            return p
        if c == "D":
            p = self.statement(s, p + 1)
            while p >= 0 and s[p : p + 1] == "N":
                p += 1
            if p < 0 or s[p : p + 1] != "W" or p + 1 >= len(s) or not PAREN < ord(s[p + 1]) < PAREN + 16:
                return -1
            return p + 3 if s[p + 2 : p + 3] == ";" else p + 2
        if c == "Y":
            p = self.statement(s, p + 1)
            n = 0
            for word in "HZ":
                q = p
                while 0 <= q < len(s) and s[q] == "N":
                    q += 1
                if q >= 0 and s[q : q + 1] == word:
                    q += 1
                    if word == "H" and q < len(s) and PAREN < ord(s[q]) < PAREN + 16:
                        if not (ord(s[q]) - PAREN) & PARAMS:
                            return -1
                        q += 1
                    p = self.statement(s, q)
                    n += 1
            return p if n else -1
        if c in "CO":
            m = self.re_case.match(s, p)
            return m.end() if m else -1
        if c == "i" and s[p + 1 : p + 2] == ":":
            return self.statement(s, p + 2)
        m = self.re_fn.match(s, p) or self.re_cls.match(s, p)
        if m:
            return m.end()
        m = self.re_simple.match(s, p)
        return m.end() if m and m.end() > p else -1

    def top(self, s: str) -> bool:
        return self.block(s) or self.members(s) and bool(self.re_method.match(s))


# ---- Python ----


class Python(Grammar):
    def valid(self, text: str, foreign: bool = False) -> bool:
        for t in (text, "if 1:\n" + text):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    return bool(ast.parse(t).body)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                if text.lstrip("\r\n")[:1] not in (" ", "\t"):
                    return False
        return False


GRAMMARS: dict[str, Grammar] = {"c": CFamily(), "cpp": Cpp(), "java": JavaFamily(), "cs": CSharp(), "js": JavaScript(), "py": Python()}

# Tokens that speak for a language.
TELLING = {
    "c": "struct unsigned sizeof typedef static const char void int goto NULL -> #include #define".split(),
    "cpp": "std :: template namespace class public: const auto nullptr static_cast virtual this delete".split(),
    "java": "public private final throws String extends implements import new null this static List Map IOException".split(),
    "cs": "public private internal var string using namespace foreach async await out ref null this override List Dictionary".split(),
    "js": "function const let var => === async await require undefined null this typeof export console".split(),
    "py": "def self import None elif except raise with lambda print True False in not and or".split(),
}
_TOKEN = re.compile(r"\w+|=>|===|->|::|#\w+|\S")


def ranked(text: str) -> list[str]:
    """Languages by the share of tokens that speak for them, each weighted by how few languages it speaks for."""
    seen = set(_TOKEN.findall(text))
    spread: dict[str, int] = {}
    for words in TELLING.values():
        for w in words:
            spread[w] = spread.get(w, 0) + 1
    score = {lang: sum(1 / spread[w] for w in words if w in seen) for lang, words in TELLING.items()}
    return sorted(score, key=lambda k: (-score[k], k))


def valid(language: str, text: str, foreign: bool = False) -> bool:
    """Whether the text is valid; ``foreign`` says that it probably isn't, which changes the time it takes only."""
    return GRAMMARS[language].valid(text, foreign)
