"""Prompt rendering: templates are cleaned once on the driver, rows only get their code put in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import LINE_BREAK, strip

# Answer-format lines of older templates, now replaced by one contract per task (without case).
REDUNDANT = (
    r"^\s*-\s*Respond with only\b.*$",
    r"^\s*Response Format:\s*Respond with only\b.*$",
    r"^\s*Final Answer:\s*After your analysis, respond\b.*$",
    r"^\s*Your answer should either be ['\"]YES['\"] or ['\"]NO['\"] only\.?\s*$",
    r"^\s*Output ['\"]A\.['\"] or ['\"]B\.['\"] or ['\"]C\.['\"] or ['\"]D\.['\"] or ['\"]E\.['\"] only\.?\s*$",
)
# The contracts put behind the prompts of each kind of task.
_LAST_LINE = (
    "\nIMPORTANT output rule:\n"
    "- You may think step by step if needed.\n"
    "- DO NOT USE the final label anywhere except the last non-empty line.\n"
    "- The last non-empty line must be EXACTLY ONE OF:\n"
)
CONTRACTS = {
    "binary": (
        "\nResponse format:\n"
        "- You may reason step by step first.\n"
        "- After your analysis, output your verdict as a single JSON object on the last line and nothing after it.\n"
        "- The last line must be EXACTLY one of:\n"
        '  {"is_vulnerable": true}\n'
        '  {"is_vulnerable": false}\n'
        "- Use true only if the code contains a real, exploitable vulnerability; otherwise use false.\n"
        "- Do not wrap the JSON in markdown or add any text after it."
    ),
    "multiclass": _LAST_LINE + "  [[FINAL_ANSWER: CWE-<number>]]\n  [[FINAL_ANSWER: SAFE]]",
    "types": _LAST_LINE
    + "  [[FINAL_ANSWER: Integer-Overflow]]\n"
    "  [[FINAL_ANSWER: Buffer-Overflow]]\n"
    "  [[FINAL_ANSWER: Null-Pointer-Dereference]]\n"
    "  [[FINAL_ANSWER: Use-After-Free]]\n"
    "  [[FINAL_ANSWER: Double-Free]]\n"
    "  [[FINAL_ANSWER: Memory-Leak]]\n"
    "  [[FINAL_ANSWER: Format-String]]\n"
    "  [[FINAL_ANSWER: Race-Condition]]\n"
    "  [[FINAL_ANSWER: Improper-Access-Control]]\n"
    "  [[FINAL_ANSWER: No-Vulnerability]]",
    "yes_no": _LAST_LINE + "  [[FINAL_ANSWER: YES]]\n  [[FINAL_ANSWER: NO]]",
    "choice": _LAST_LINE + "  [[FINAL_ANSWER: A]]\n  [[FINAL_ANSWER: B]]\n  [[FINAL_ANSWER: C]]\n  [[FINAL_ANSWER: D]]\n  [[FINAL_ANSWER: E]]",
}
CONTRACT_OF = {"binary_vulnerability": "binary", "binary_cwe_specific": "binary", "binary_vulnerability_specific": "binary", "multiclass_vulnerability": "multiclass", "type_multiclass": "types", "task1": "yes_no", "task2": "choice"}
_REDUNDANT = [re.compile(p, re.I) for p in REDUNDANT]


def clean(template: str) -> str:
    """Without redundant answer-format lines; of several blank lines the first one; nothing blank at the ends."""
    kept = [x for x in template.splitlines() if not any(p.match(x) for p in _REDUNDANT)]
    return "\n".join(x for i, x in enumerate(kept) if x.strip() or not i or kept[i - 1].strip()).strip()


def clean_column(template: Column) -> Column:
    """The same for templates that are a column."""
    kept = F.filter(F.split(template, LINE_BREAK), lambda x: ~F.rlike(x, F.lit("(?i)" + "|".join(f"(?:{p})" for p in REDUNDANT))))
    says = lambda x: strip(x) != ""
    return strip(F.array_join(F.filter(kept, lambda x, i: says(x) | F.coalesce(says(F.get(kept, i - 1)), F.lit(True))), "\n"))


def contract(task: str | None) -> str:
    return CONTRACTS.get(CONTRACT_OF.get(task or "", ""), "")


def contract_column(task: Column) -> Column:
    """The contract of a column of tasks; nothing for tasks without one."""
    out = F.when(F.lit(False), "")
    for t in CONTRACT_OF:
        out = out.when(task == t, contract(t))
    return out.otherwise("")


def render(template: str, values: dict[str, str], code: Column, task: str | None = None, with_contract: bool = True) -> Column:
    """The prompt of each row: the cleaned template, named values put in on the driver, ``{code}`` per row, the task's contract behind it."""
    text = clean(template)
    for k, v in values.items():
        text = text.replace("{" + k + "}", v)
    head, found, tail = text.partition("{code}")
    end = contract(task) if with_contract else ""
    if not found:
        return F.lit(text + end)
    return F.concat(F.lit(head), F.coalesce(code, F.lit("")), F.lit(tail + end))


def render_column(template: Column, code: Column) -> Column:
    """``{code}`` of templates that are a column, replaced where it first occurs."""
    at = F.locate("{code}", template)
    c = F.coalesce(code, F.lit(""))
    return F.when(at == 0, template).otherwise(F.concat(F.substring(template, F.lit(1), at - 1), c, F.substring(template, at + 6, F.length(template))))
