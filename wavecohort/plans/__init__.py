"""Queries over the given tables, one or more for each operator."""

from . import cohorts, decisions, evaluation, signals, tables, thresholds  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
