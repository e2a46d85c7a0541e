"""Row predicates: six comparisons and their combination by AND and OR."""

from __future__ import annotations

from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"EQ": eq, "NE": ne, "GT": gt, "GE": ge, "LT": lt, "LE": le, "=": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}


def compare(left: Column, op: str, right: Column) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison: {op}")
    return COMPARISONS[op](left, right)


def all_of(*conditions: Column) -> Column:
    """True where every condition holds; without conditions, everywhere."""
    return reduce(and_, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    """True where some condition holds; without conditions, nowhere."""
    return reduce(or_, conditions, F.lit(False))


def inside(column: Column, low, high) -> Column:
    """Strictly between the bounds."""
    return (column > low) & (column < high)
