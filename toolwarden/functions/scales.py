"""Severity ranks, penalties and grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

SEVERITY_NAMES = tuple(name for name, _, _ in C.SEVERITIES)
RANKS = {name: rank for name, rank, _ in C.SEVERITIES}


def _ladder(severity: Column, field: int) -> Column:
    col = F.lit(0)
    for row in reversed(C.SEVERITIES):
        col = F.when(severity == row[0], F.lit(row[field])).otherwise(col)
    return col


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 0 for info and anything unknown."""
    return _ladder(severity, 1)


def penalty(severity: Column) -> Column:
    """Points one finding of this severity can subtract."""
    return _ladder(severity, 2)


def severity_name(rank: Column) -> Column:
    col = F.lit(C.SEVERITIES[-1][0])
    for name, value, _ in C.SEVERITIES:
        col = F.when(rank == value, F.lit(name)).otherwise(col)
    return col


def grade(score: Column) -> Column:
    col = F.lit(C.LOWEST_GRADE)
    for letter, floor in reversed(C.GRADE_FLOORS):
        col = F.when(score >= floor, F.lit(letter)).otherwise(col)
    return col
