"""The engine's own queries and their DuckDB counterparts."""
from __future__ import annotations

from .plans import calibration, decisions, evidence, references, studies  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
