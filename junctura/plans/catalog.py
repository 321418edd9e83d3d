"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from . import queries_candidates, queries_events, queries_formats, queries_outcomes  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
