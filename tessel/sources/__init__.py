"""Reading documents and tables, and writing outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shapes.algebra import Shape, to_ddl


def json_lines(spark: SparkSession, path: str, *, column: str = "json") -> DataFrame:
    """JSON Lines as text, one document per line, with its file as key; empty lines are left out."""
    rows = spark.read.text(path).select(F.col("value").alias(column), F.input_file_name().alias("file"))
    return rows.where(F.length(F.trim(column)) > 0)


def json_documents(spark: SparkSession, path: str, *, column: str = "json") -> DataFrame:
    """Whole files, one document each."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias(column), F.input_file_name().alias("file"))


def json_table(spark: SparkSession, path: str, shape: Shape, *, multi_line: bool = False) -> DataFrame:
    """JSON records read with the schema that an inferred input shape asks for: other fields are never decoded.

    The shape is that of a record, or of an array of records (the rows).
    """
    from ..shapes.algebra import Arr

    record = shape.item if isinstance(shape, Arr) else shape
    ddl = to_ddl(record)
    if not ddl.startswith("STRUCT<"):
        raise ValueError(f"{shape} is not the shape of records")
    return spark.read.schema(ddl[len("STRUCT<") : -1].replace("`: ", "` ")).option("multiLine", multi_line).json(path)


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables by name, each read from folder/name.parquet."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def write_json_lines(df: DataFrame, path: str, *, column: str = "value", mode: str = "error") -> None:
    """Outputs as lines of JSON text."""
    c = F.col(column)
    kind = df.schema[column].dataType.typeName()
    text = c if kind == "string" else F.to_json(c) if kind in ("struct", "array", "map", "variant") else F.to_json(c.cast("variant"))
    df.where(c.isNotNull()).select(text.alias("value")).write.mode(mode).text(path)
