"""Shapes over data: checking rows against an inferred shape, and observing the shape of data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shapes.algebra import BLOB, BOOL, NULL, NUMBER, STRING, Arr, Obj, Shape, render
from ..shapes.check import check_column


def _report(df: DataFrame, mismatch, keys: list[str]) -> DataFrame:
    """Rows with a mismatch. As a generator's rows they are computed once; a where and a select would each check the document."""
    found = F.filter(F.array(mismatch), lambda m: m.isNotNull())
    return df.select(*[F.col(f"`{k}`") for k in keys], F.inline(found)).select(*keys, "path", "expected", "got")


def check_json(df: DataFrame, shape: Shape, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, path, expected, got) of the documents in a JSON text column that don't conform.

    A text that isn't JSON is reported at its root; a null text isn't checked.
    """
    df = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("_text")).withColumn("_parsed", F.try_parse_json("_text"))
    text, parsed = F.col("_text"), F.col("_parsed")
    broken = F.struct(F.lit(".").alias("path"), F.lit(render(shape, False)).alias("expected"), text.alias("got"))
    return _report(df, F.when(text.isNull(), None).when(parsed.isNull(), broken).otherwise(check_column(shape, parsed)), keys)


def check_rows(df: DataFrame, shape: Shape, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """The same for rows as documents. Only the columns that the shape asks for are read."""
    wanted = [k for k, _ in shape.fields] if isinstance(shape, Obj) else columns or df.columns
    present = [c for c in (columns or df.columns) if c in wanted]
    fields = [F.coalesce(F.col(f"`{c}`").cast("variant"), F.parse_json(F.lit("null"))).alias(c) if not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{c}`") for c in present]
    if not fields:
        fields = [F.lit(True).alias("_")]
    row = F.to_variant_object(F.struct(*fields)) if hasattr(F, "to_variant_object") else F.call_function("to_variant_object", F.struct(*fields))
    return _report(df, check_column(shape, row), keys)


def observed_type(df: DataFrame, text_col: str) -> DataFrame:
    """One row with the type of all documents of a JSON text column (partial aggregation, any number of rows)."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{text_col}`"))).alias("type"))


def observed_shape(type_text: str) -> Shape:
    """The shape that an observed type stands for."""
    text = type_text.replace("OBJECT<", "STRUCT<")
    return _of_type(T.DataType.fromDDL(text))


def _of_type(t: T.DataType) -> Shape:
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.NullType):
        return NULL
    if isinstance(t, T.ArrayType):
        return Arr(_of_type(t.elementType))
    if isinstance(t, T.StructType):
        return Obj(tuple((f.name, _of_type(f.dataType)) for f in t.fields))
    return BLOB
