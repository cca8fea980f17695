"""All queries over the standard tables, and the SQL that gives the same rows."""

from ..operators import analytics, assessment, cleaning, editor, events, evidence, formulas, grading, intake, layout, markup, pages, payloads, projection, question_bank, ranking, reconstruction, relational, similarity, wordfiles  # noqa: F401  each registers its queries
from ..operators.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
