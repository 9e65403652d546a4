"""All registered queries over the reference tables."""

from __future__ import annotations

from tesserae.plans import code, curating, evaluation, files, records, tables, tensors, textual, variants  # noqa: F401
from tesserae.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
