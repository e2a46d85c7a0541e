"""Tables known to an engine: a name, a declared schema, and how to get the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Type names of table declarations.
TYPES: dict[str, T.DataType] = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "STRING": T.StringType()}


class CatalogError(ValueError):
    """An unknown or duplicate table or column."""


@dataclass
class Table:
    name: str
    schema: T.StructType
    rows: Callable[[], DataFrame]
    key: str | None = None
    indexes: set[str] = field(default_factory=set)


class Catalog:
    """Tables by name.  Names are case-sensitive."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, Table] = {}

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        catalog = cls(spark)
        for name in names:
            catalog.register(name, spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))
        return catalog

    def register(self, name: str, rows: DataFrame, key: str | None = None) -> Table:
        return self._add(Table(name, rows.schema, lambda: rows, key))

    def create(self, name: str, columns: list[tuple[str, str]], key: str | None = None) -> Table:
        """Create an empty table from (column, type name) pairs."""
        unknown = [t for _, t in columns if t.upper() not in TYPES]
        if unknown:
            raise CatalogError(f"unknown column types: {unknown}")
        schema = T.StructType([T.StructField(c, TYPES[t.upper()]) for c, t in columns])
        return self._add(Table(name, schema, lambda: self.spark.createDataFrame([], schema), key))

    def _add(self, table: Table) -> Table:
        if table.name in self._tables:
            raise CatalogError(f"table exists already: {table.name}")
        self._tables[table.name] = table
        return table

    def table(self, name: str) -> Table:
        if name not in self._tables:
            raise CatalogError(f"unknown table: {name}")
        return self._tables[name]

    def replace_rows(self, name: str, rows: Callable[[], DataFrame]) -> None:
        self.table(name).rows = rows

    def names(self) -> list[str]:
        return sorted(self._tables)

    def column(self, table: str, name: str) -> T.StructField:
        """A column by name, or by its 0-based position written in digits."""
        schema = self.table(table).schema
        if name.isdigit() and int(name) < len(schema):
            return schema[int(name)]
        if name not in schema.names:
            raise CatalogError(f"unknown column: {table}.{name}")
        return schema[name]

    def build_index(self, table: str, column: str) -> None:
        """Note that lookups by a column are common.  Spark prunes files by itself, so this only informs EXPLAIN."""
        self.table(table).indexes.add(self.column(table, column).name)


def literal(text: str, kind: T.DataType):
    """A literal's text as a value of a column's type; raises if it is none."""
    value = text[1:-1] if len(text) >= 2 and text[0] == text[-1] == "'" else text
    try:
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, T.FractionalType):
            return float(value)
    except ValueError:
        raise CatalogError(f"not a value of type {kind.simpleString()}: {text}") from None
    return value
