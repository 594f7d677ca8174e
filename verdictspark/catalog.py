"""All queries of the library proper, with their SQL twins."""

from __future__ import annotations

from verdictspark.plans import design, generation, inference, rates, readings, simulated, text

_PARTS = (rates, inference, design, text, generation, readings, simulated)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
