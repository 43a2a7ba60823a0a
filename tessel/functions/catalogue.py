"""The builtins as a table: name, arity, and the tiers that have a form for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def functions(spark: SparkSession) -> DataFrame:
    """(name, arity, typed, interpreter, result shape where inference knows it)."""
    from ..plans.column_functions import FUNCTIONS
    from ..shapes.direct import SIGNATURES
    from .natives import NATIVES

    rows = [(name, arity, (name, arity) in FUNCTIONS, (name, arity) in NATIVES, str(SIGNATURES[name, arity][1]) if (name, arity) in SIGNATURES else None) for name, arity in sorted(NATIVES.keys() | FUNCTIONS.keys())]
    return spark.createDataFrame(rows, "name string, arity int, typed boolean, interpreter boolean, result string")
