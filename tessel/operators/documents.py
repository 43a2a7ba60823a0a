"""Programs over rows as documents.

Every output is a row (key columns, ord, value, error). Three tiers are tried:
typed columns, JSON text read with the schema the program needs, and the
interpreter in Arrow batches, which computes loops of numbers for a whole batch
at once; explain tells which one a program takes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import ast as A
from ..plans.batches import column_kinds, columns_used
from ..plans.columns import Columns, Val, condition, of_column
from ..plans.failures import Failures, collecting

ERROR = "struct<code string, message string>"
RECURSION = 20_000


def row_value(df: DataFrame, columns: list[str] | None = None) -> Val:
    """The row as a record of its columns."""
    fields = {f.name: of_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if columns is None or f.name in columns}
    return Val(fields=fields)


def run_documents(df: DataFrame, node: A.Node, keys: list[str]) -> DataFrame:
    """Tier 1: outputs of the program for every row, whose columns are the document's fields.

    A program with one output adds no rows; one with several explodes its array
    of outputs, ord counting from 0. A failure of the only output is the row's
    error; rows that may fail otherwise go to the interpreter. Raises
    LoweringError where the program has no typed form.
    """
    with collecting() as failures:
        good, (out, error) = _typed(df, node, keys, failures)
    if not failures.items or error is not None:
        return good
    with collecting():
        good, _ = _typed(df.where(~failures.any()), node, keys, None)
    return with_interpreted(good, run_json(df.where(failures.any()).withColumn("_document", document_text(df)), node, "_document", keys))


def _typed(df: DataFrame, node: A.Node, keys: list[str], failures: Failures | None) -> tuple[DataFrame, tuple[Val, Column | None]]:
    """Outputs as rows, with their value and the error column, if all failures of the only output make one."""
    cols = Columns()
    df, node, v = narrowed(df, node, row_value(df), cols)
    kept, error = [F.col(f"`{k}`") for k in keys], F.lit(None).cast(ERROR)
    in_selects = len(failures.items) if failures else 0
    if cols.is_many(node, {}):
        items = cols.many(node, v, {})
        return df.select(*kept, F.posexplode(items.column).alias("ord", "value")).withColumn("error", error), (items, None)
    out = cols.one(node, v, {})
    value, native = out.to_column(), None
    if failures and failures.items and not in_selects and failures.plain():
        native = failures.error().cast(ERROR)
        value, error = F.when(native.isNull(), value), native
    return df.select(*kept, F.lit(0).alias("ord"), value.alias("value"), error.alias("error")), (out, native)


def document_text(df: DataFrame) -> Column:
    """The row as JSON text."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})


def with_interpreted(typed: DataFrame, interpreted: DataFrame) -> DataFrame:
    """Both, the interpreter's JSON texts read as the typed value's type."""
    t = typed.schema["value"].dataType
    if isinstance(t, T.NullType):
        value = F.lit(None)
    else:
        value = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), T.StructType([T.StructField("v", t)]))["v"]
    return typed.unionByName(interpreted.withColumn("value", value))


def narrowed(df: DataFrame, node: A.Node, v: Val, cols: Columns) -> tuple[DataFrame, A.Node, Val]:
    """Take leading selects out of a program as where clauses, which the scan can use."""
    while True:
        match node:
            case A.Call("select", (test,)):
                node = A.Pipe(node, A.Identity())
            case A.Pipe(A.Call("select", (test,)), rest) if not cols.is_many(test, {}):
                df, node = df.where(condition(cols.one(test, v, {}))), rest
            case A.Pipe(left, right) if not cols.is_many(left, {}) and cols.is_many(right, {}):
                v, node = cols.one(left, v, {}), right
            case _:
                return df, node, v


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores if the input has too few splits for them: the interpreter is bound by the processor.

    Spark's own size estimate decides, so a large input is never shuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split // 4 else df


def _interpret(node: A.Node, n_keys: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..plans.interpreter import Env, Interpreter
        from ..values import Failure, from_json, to_json

        sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))
        ip = Interpreter()
        error = pa.struct([("code", pa.string()), ("message", pa.string())])
        for batch in batches:
            texts = batch.column(n_keys).to_pylist()
            take, ord_, value, failed = [], [], [], []
            for i, text in enumerate(texts):
                if text is None:
                    continue
                try:
                    outputs = ip.outputs(node, from_json(text), Env())
                except ValueError:
                    outputs = iter([Failure("json", "the document is not valid JSON")])
                for k, out in enumerate(outputs):
                    bad = isinstance(out, Failure)
                    take.append(i)
                    ord_.append(k)
                    value.append(None if bad else to_json(out))
                    failed.append({"code": out.code, "message": out.message} if bad else None)
            rows = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in range(n_keys)), pa.array(ord_, pa.int32()), pa.array(value, pa.string()), pa.array(failed, error)],
                names=[*batch.schema.names[:n_keys], "ord", "value", "error"],
            )

    return run


def run_json(df: DataFrame, node: A.Node, text_col: str, keys: list[str]) -> DataFrame:
    """Tier 3: the interpreter over a column of JSON texts; value is JSON text, a null text has no outputs."""
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").cast("string").alias("_json"))
    return rows.mapInArrow(_interpret(node, len(keys)), _output_schema(df, keys))


def _output_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), T.StructField("ord", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("error", T.DataType.fromDDL(ERROR))])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16, size: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """Larger batches, of that many rows or bytes: a loop's last rounds cost the same for many rows as for few."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _compute(node: A.Node, n_keys: int, kinds: dict[str, str]) -> Callable:
    interpret = _interpret(node, n_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..plans.batches import BOOLEAN, lowered

        compute = lowered(node, kinds)
        error = pa.struct([("code", pa.string()), ("message", pa.string())])
        for batch in _gathered(batches):
            texts = batch.column(n_keys)
            if texts.null_count < len(texts):
                yield from interpret(iter([batch.filter(texts.is_valid())]))
                batch = batch.filter(texts.is_null())
            n = batch.num_rows
            if n:
                columns = {name: batch.column(n_keys + 1 + i).to_numpy(zero_copy_only=False).astype(bool if kind == BOOLEAN else float) for i, (name, kind) in enumerate(kinds.items())}
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(n_keys)), pa.array([0] * n, pa.int32()), compute(columns, n), pa.nulls(n, error)],
                    names=[*batch.schema.names[:n_keys], "ord", "value", "error"],
                )

    return run


def run_batches(df: DataFrame, node: A.Node, keys: list[str]) -> DataFrame:
    """Tier 3 for programs of numbers: whole batches at once, rows with a null or a number that JSON doesn't have per document.

    Raises NotBatched where the program needs the interpreter for all rows.
    """
    kinds = column_kinds(df.schema)
    kinds = {name: kinds[name] for name in columns_used(node, kinds)}
    df = spread(df)
    odd = F.lit(False)
    for name in kinds:
        c = F.col(f"`{name}`")
        odd = odd | c.isNull()
        if isinstance(df.schema[name].dataType, T.DoubleType):
            odd = odd | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.when(odd, document_text(df)).alias("_json"), *[F.col(f"`{name}`").alias(f"_column{i}") for i, name in enumerate(kinds)])
    return rows.mapInArrow(_compute(node, len(keys), kinds), _output_schema(df, keys))
