"""Row-level normalisers of the raw sources as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract, strip

# Severity classes of weaknesses and types, languages of extensions, weaknesses of types, the separator of joined functions.
SEVERITY_BY_CWE = {"HIGH": ("78", "79", "89", "94", "352", "434", "611"), "MEDIUM": ("125", "190", "787", "476", "416", "502")}
SEVERITY_BY_CWE_FIVE_TASKS = {
    "high": ("78", "79", "89", "94", "119", "120", "121", "122", "123", "124", "787", "788", "416", "415", "400"),
    "medium": ("125", "190", "476", "401", "403", "404", "502", "611", "776"),
}
SEVERITY_BY_TYPE = {
    "high": ("Buffer-Overflow", "Integer-Overflow", "Use-After-Free", "Double-Free", "Format-String-Vulnerability"),
    "medium": ("Null-Pointer-Dereference", "Memory-Leak", "Race-Condition", "Improper-Access-Control"),
}
SEVERITY_BY_TOKEN_TYPE = {"high": ("sql", "command_injection", "remote_code_execution", "xss"), "medium": ("xsrf", "open_redirect")}
LANGUAGES = {"c": "C", "cpp": "C++", "java": "Java", "py": "Python", "js": "JavaScript", "cs": "C#"}
TYPE_TO_CWE = {"sql": "CWE-89", "xss": "CWE-79", "command_injection": "CWE-78", "xsrf": "CWE-352", "path_disclosure": "CWE-200", "open_redirect": "CWE-601", "remote_code_execution": "CWE-94"}
FUNCTION_SEPARATOR = "\n\n/* ---- next function ---- */\n\n"


def cwe(value: Column, mode: str = "search") -> Column:
    """A weakness id in canonical form.

    search: the first CWE-<digits> anywhere, null if none; exact: prefix or digits, CWE-UNKNOWN otherwise; strict: prefix or digits, null
    otherwise; loose: CWE-<digits> or the first number; digits: only a value that ends with digits after an optional prefix.
    """
    v = F.upper(strip(value))
    number = lambda n: F.when(n.isNotNull(), F.concat(F.lit("CWE-"), n))
    if mode == "search":
        return extract(v, r"CWE-\d+", 0)
    if mode in ("exact", "strict"):
        found = F.when(v.rlike(r"^CWE-"), v).when(v.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), v))
        return F.coalesce(found, F.lit("CWE-UNKNOWN")) if mode == "exact" else found
    if mode == "loose":
        return F.coalesce(extract(v, r"CWE-\d+", 0), number(extract(v, r"\b(\d+)\b")))
    if mode == "digits":
        return number(extract(v, r"^(?:CWE[-_ ]?)?(\d+)$"))
    raise ValueError(f"unknown mode {mode!r}")


def cwe_list(values: Column, mode: str = "search") -> Column:
    """Normalised ids of an array, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: cwe(v, mode)), lambda v: v.isNotNull()))


def cwe_number(value: Column, default: int | None = 0) -> Column:
    """The first number of a value; ``default`` where there is none."""
    return F.coalesce(extract(value, r"(\d+)").try_cast("int"), F.lit(default))


def severity_of_cwe(c: Column, five_tasks: bool = False) -> Column:
    """The class of a weakness id; null for null."""
    n = F.regexp_replace(c, "^CWE-", "")
    high, medium, low = ("high", "medium", "low") if five_tasks else ("HIGH", "MEDIUM", "LOW")
    table = SEVERITY_BY_CWE_FIVE_TASKS if five_tasks else SEVERITY_BY_CWE
    return F.when(n.isin(*table[high]), high).when(n.isin(*table[medium]), medium).when(n.isNotNull(), low)


def severity_of_types(types: Column) -> Column:
    """Of the first type in a list that is classed high or medium, low if none is; null for an empty list."""
    rank = lambda t: F.when(t.isin(*SEVERITY_BY_TYPE["high"]), "high").when(t.isin(*SEVERITY_BY_TYPE["medium"]), "medium")
    first = F.try_element_at(F.filter(F.transform(types, rank), lambda x: x.isNotNull()), F.lit(1))
    return F.when(F.size(types) > 0, F.coalesce(first, F.lit("low")))


def severity_of_token_type(kind: Column) -> Column:
    return F.when(kind.isin(*SEVERITY_BY_TOKEN_TYPE["high"]), "high").when(kind.isin(*SEVERITY_BY_TOKEN_TYPE["medium"]), "medium").otherwise("low")


def severity_of_score(score: Column) -> Column:
    """CVSS bands."""
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").when(score.isNotNull(), "NONE")


def severity(value: Column) -> Column:
    """Canonical spelling; blank and null as UNKNOWN."""
    v = F.upper(strip(value))
    return F.when(F.coalesce(v, F.lit("")) == "", "UNKNOWN").otherwise(v)


def cwe_of_type(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in TYPE_TO_CWE.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(strip(kind))), F.lit("CWE-Other"))


def language(extension: Column) -> Column:
    """The language of a file extension; null for unknown ones."""
    e = F.lower(F.regexp_replace(strip(extension), r"^\.", ""))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), e)


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value)).isin("true", "1", "yes"), F.lit(False))


def url_id(url: Column) -> Column:
    """The commit hash of a URL, else its last 40 characters with other characters replaced."""
    return F.coalesce(extract(url, r"/commit/([0-9a-f]{7,})"), F.right(F.regexp_replace(url, r"[^\p{L}\p{N}_]", "_"), F.lit(40)))


def repository(url: Column) -> Column:
    return extract(url, r"^https?://[^/]+/([^/]+/[^/]+)/commit/")


def date_of(value: Column) -> Column:
    """ISO or day/month/year dates; null otherwise."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd/MM/yyyy"))


def cve_year(cve: Column) -> Column:
    return extract(cve, r"(?i)CVE-(\d{4})-").try_cast("int")


def header_field(text: Column, key: str) -> Column:
    """A field of the first comment block ``/*`` newline ``key: value`` ...; the last one if a key is repeated."""
    block = extract(text, r"(?s)/\*\s*\n(.*?)\*/")
    return F.try_element_at(F.regexp_extract_all(block, F.lit(rf"(?m)^\s*{key}\s*:[ \t]*(.*?)\s*$"), F.lit(1)), F.lit(-1))


def without_headers(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)/\*\s*\n.*?\*/\s*\n", ""))


def marker_line(text: Column, marker: str) -> Column:
    """The 1-based line that holds the marker; null if none does."""
    at = F.array_position(F.transform(F.split(text, "\n"), lambda x: F.contains(x, F.lit(marker))), F.lit(True))
    return F.when(at > 0, at)


def with_context(prefix: Column, code: Column) -> Column:
    """Code after a call-graph prefix, where there is one."""
    return F.when(F.coalesce(strip(prefix), F.lit("")) != "", F.concat(F.lit("// Call graph context:\n// "), prefix, F.lit("\n\n"), code)).otherwise(code)
