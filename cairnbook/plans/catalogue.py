"""Every registered query of the bookkeeping engine with its reference SQL."""

from __future__ import annotations

from cairnbook.plans import bills, chains, cues, dedupe, evaluation, exports, fields, lifecycle, mapped, outline, questions, scalars, search, sources, staging, trees, verified  # noqa: F401
from cairnbook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
