"""Queries over the test tables, one for each operator, with their SQL."""

from . import comparing, flow, parsing, profiling, relations, scoring, streams  # noqa: F401
from ._registry import QUERIES, SQL  # noqa: F401
