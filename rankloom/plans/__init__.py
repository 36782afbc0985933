"""Registered queries by topic."""

from rankloom.plans import basics, further, learned, models, profile, scorers, texts, windows  # noqa: F401
from rankloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
