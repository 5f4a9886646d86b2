"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import contracts, documents, lifecycle, search  # noqa: F401  registers
from .plans.registry import ORACLE, QUERIES
from .streaming import twins  # noqa: F401  registers

__all__ = ["ORACLE", "QUERIES"]
