"""Scalar lookup functions: f(key) is the value that a table holds for the key.

A predicate f(column) = value can run opaquely (a vectorised function with the
table as a dictionary) or inlined (a join with the table, which Catalyst can
optimise).  Both agree where keys are unique, which inlining checks.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, CatalogError

#: Entries of a lookup table that may be sent to every task as a dictionary.
OPAQUE_ENTRIES = 1_000_000


@dataclass(frozen=True)
class LookupFunction:
    name: str
    table: str
    key: str
    value: str


class FunctionRegistry:
    def __init__(self) -> None:
        self._functions: dict[str, LookupFunction] = {}

    def register(self, function: LookupFunction) -> None:
        if function.name in self._functions:
            raise CatalogError(f"function exists already: {function.name}")
        self._functions[function.name] = function

    def get(self, name: str) -> LookupFunction:
        if name not in self._functions:
            raise CatalogError(f"unknown function: {name}")
        return self._functions[name]


def filter_opaque(df: DataFrame, column: str, value: str, function: LookupFunction, catalog: Catalog) -> DataFrame:
    """Keep rows with f(column) = value, evaluated row by row; an unknown key never matches."""
    table = catalog.table(function.table).rows().select(function.key, function.value)
    rows = table.limit(OPAQUE_ENTRIES + 1).collect()
    if len(rows) > OPAQUE_ENTRIES:
        raise CatalogError(f"{function.table} is too large for a dictionary; inline {function.name}")
    known = {r[0]: str(r[1]) for r in rows}

    @F.pandas_udf("boolean")
    def matches(keys: pd.Series) -> pd.Series:
        return keys.map(known).eq(value)

    return df.filter(matches(F.col(column)))


def filter_inlined(df: DataFrame, column: str, value: str, function: LookupFunction, catalog: Catalog, check_unique: bool = True) -> DataFrame:
    """The same rows by a join with the filtered lookup table."""
    table = catalog.table(function.table).rows()
    if check_unique and not table.groupBy(function.key).count().filter("count > 1").isEmpty():
        raise CatalogError(f"{function.table}.{function.key} is not unique, so {function.name} cannot be inlined")
    chosen = table.filter(F.col(function.value).cast("string") == value).select(F.col(function.key).alias("__lookup"))
    return df.join(chosen, F.col(column) == F.col("__lookup")).drop("__lookup")
