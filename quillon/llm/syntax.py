"""Source files that do not parse.

Each text is parsed by all grammars, in the order of how many of its tokens speak for each language. Whether it is valid is decided by that of
the language it claims. If that fails, the first other success in that order names the language of a wrong extension; if every grammar
fails, the text is corrupt. ``accepted`` lists the languages that take the text. Equal texts of a partition's batch are parsed once.

Results on special input: null and blank texts, rows without an id and unknown languages are not judged (no row). Line ends and indentation of the whole do not
matter. Repeated rows count each. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._grammars import GRAMMARS, ranked, valid

#: Endings of file names and the grammar for them.
ENDINGS = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "cs": "cs", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "py": "py", "pyi": "py",
}
SCHEMA = "src string, row_id long, repository string, language string, is_valid boolean, parsed_as string, problem string, accepted array<string>"


def claimed(extension: Column, file_name: Column) -> Column:
    """The language of an extension without blanks, leading dot and case; of the file name's ending where the extension is null or blank."""
    ext = F.lower(F.regexp_replace(F.trim(F.regexp_replace(extension, r"\s+", " ")), r"^\.|\s", ""))
    ending = F.lower(F.regexp_extract(F.trim(file_name), r"\.([^./\\]+)$", 1))
    e = F.when(F.coalesce(ext, F.lit("")) == "", ending).otherwise(ext)
    langs = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    return F.try_element_at(langs, e)


def judge(language: str, text: str) -> tuple[bool, str | None, str | None, list[str]]:
    """(valid, language it parses as, problem: null, 'wrong_extension' or 'corrupt', all languages that take it in the order of its tokens)."""
    accepted = [x for x in ranked(text) if valid(x, text, foreign=x != language)]
    if language in accepted:
        return True, language, None, accepted
    return (False, accepted[0], "wrong_extension", accepted) if accepted else (False, None, "corrupt", accepted)


def check_syntax(texts: DataFrame) -> DataFrame:
    """Verdicts on texts (src, row_id, repository, language, text)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            seen: dict[tuple, tuple] = {}
            out = []
            for lang, text in zip(pdf.language, pdf.text, strict=True):
                key = (lang, text)
                if key not in seen:
                    seen[key] = judge(lang, text)
                out.append(seen[key])
            yield pd.DataFrame(
                {
                    "src": pdf.src, "row_id": pdf.row_id, "repository": pdf.repository, "language": pdf.language,
                    "is_valid": [x[0] for x in out], "parsed_as": [x[1] for x in out], "problem": [x[2] for x in out], "accepted": [x[3] for x in out],
                }
            )

    judged = texts.where(F.col("row_id").isNotNull() & F.col("text").rlike(r"\S") & F.col("language").isin(*GRAMMARS))
    return judged.select("src", "row_id", "repository", "language", "text").mapInPandas(run, SCHEMA)


def syntax_rates(verdicts: DataFrame) -> DataFrame:
    """(src, repository, language, files, invalid, wrong_extension, corrupt, invalid_share) of each repository and language."""
    n = lambda c: F.sum(c.cast("long"))
    g = verdicts.groupBy("src", "repository", "language").agg(
        F.count("*").alias("files"), n(~F.col("is_valid")).alias("invalid"),
        n(F.coalesce(F.col("problem") == "wrong_extension", F.lit(False))).alias("wrong_extension"), n(F.coalesce(F.col("problem") == "corrupt", F.lit(False))).alias("corrupt"),
    )
    return g.withColumn("invalid_share", F.round(F.col("invalid") / F.col("files"), 6))
