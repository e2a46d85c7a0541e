"""Readers for line-oriented text: bar-separated tables, number pairs, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, CatalogError


def read_tables(spark: SparkSession, path: str, catalog: Catalog) -> list[str]:
    """Load ``name|v1|v2`` lines into the catalog's tables and return their names.

    ``TABLE|name|column:TYPE|...`` lines create tables first; others must exist.
    Empty lines and lines that begin with ``#`` are skipped.  A line with the
    wrong number of values, or of an unknown table, is an error.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line != '' and not startswith(line, '#')")
    parts = lines.select(F.split("line", "[|]", -1).alias("p"))
    for row in parts.filter("p[0] = 'TABLE'").collect():  # one line a table
        name, *columns = row["p"][1:]
        catalog.create(name, [tuple(c.split(":", 1)) for c in columns])
    rows = parts.filter("p[0] != 'TABLE'").select(F.element_at("p", 1).alias("table"), F.slice("p", 2, 10_000).alias("v"))
    shapes = rows.groupBy("table", F.size("v").alias("width")).count().collect()  # a row a table
    for shape in shapes:
        if shape["width"] != len(catalog.table(shape["table"]).schema):
            raise CatalogError(f"{shape['count']} lines of {shape['table']} have {shape['width']} values")
    names = sorted({s["table"] for s in shapes})
    for name in names:
        schema = catalog.table(name).schema
        own = rows.filter(F.col("table") == name)
        typed = own.select(*(F.element_at("v", i + 1).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))
        catalog.replace_rows(name, lambda typed=typed: typed)
    return names


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("key", "value")) -> DataFrame:
    """Two whole numbers a line, between blanks."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) != ''").select(fields[0].cast("int").alias(names[0]), fields[1].cast("int").alias(names[1]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A document a line: doc_id (unique and ascending within a file, not gapless) and text."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def write_tables(df: DataFrame, name: str, path: str) -> None:
    """Write rows as ``name|v1|v2`` lines."""
    df.select(F.concat_ws("|", F.lit(name), *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in df.columns)).alias("value")).write.text(path)


def write_columns(df: DataFrame, path: str, block_rows: int = 1 << 20) -> None:
    """Columnar file with dictionary, delta and bit-packed pages as Parquet has them."""
    df.write.option("parquet.enable.dictionary", "true").option("parquet.writer.version", "v2").option("parquet.block.size", str(block_rows * 8)).parquet(path)
