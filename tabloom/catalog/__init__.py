"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from .base import ORACLES, QUERIES
from . import files, models, profile, rules, streams, transforms  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
