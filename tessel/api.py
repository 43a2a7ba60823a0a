"""compile(text) gives a Program that runs, infers, checks and explains."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang import ast as A
from .lang.modules import Library, parse_with_modules
from .operators.documents import ERROR, document_text, run_batches, run_documents, run_json, spread, with_interpreted
from .operators.shape_ops import check_json, check_rows
from .plans.batches import NotBatched
from .plans.columns import Columns, LoweringError, of_column
from .plans.failures import collecting
from .plans.relational import Relational
from .plans.rewrite import simplified
from .shapes import ConstraintInference, DirectInference, Shape, ill_typed
from .shapes.algebra import Clash, to_ddl
from .shapes.check import Mismatch, check_column
from .shapes.check import check as check_value


@dataclass
class Program:
    text: str
    node: A.Node
    _shapes: dict[str, tuple] = field(default_factory=dict, repr=False)

    # -- shapes
    def infer(self, method: str = "direct") -> tuple[Shape, list[Shape]]:
        """(input shape, output shapes), by method direct or constraint."""
        if method not in ("direct", "constraint"):
            raise ValueError(f"the method is direct or constraint, not {method!r}")
        if method not in self._shapes:
            self._shapes[method] = (DirectInference if method == "direct" else ConstraintInference)().infer(self.node)
        return self._shapes[method]

    def ill_typed(self) -> Clash | None:
        """A type error that no input can avoid."""
        given, outputs = self.infer()
        return next((c for s in (given, *outputs) if (c := ill_typed(s))), None)

    def check_value(self, value: Any) -> Mismatch | None:
        return check_value(self.infer()[0], value)

    def check(self, df: DataFrame, *, keys: list[str] | None = None, json: str | None = None) -> DataFrame:
        """(keys, path, expected, got) of the documents that disagree with the program."""
        keys = _keys(df, keys, json)
        return check_json(df, self.infer()[0], json, keys) if json else check_rows(df, self.infer()[0], keys, [c for c in df.columns])

    # -- evaluation
    def values(self, value: Any, variables: dict | None = None, inputs: Iterable[Any] | None = None) -> list[Any]:
        """All outputs for one value: values and Failures. inputs are the values that input and inputs go on to."""
        from .plans.interpreter import run_program

        return run_program(self.node, value, variables, inputs)

    def plan(self, df: DataFrame, json: str | None = None) -> str:
        """The tier that run takes: typed, json, batch, or interpreter."""
        return self._run(df, _keys(df, None, json), json)[0]

    def explain(self, df: DataFrame, json: str | None = None) -> str:
        """The tier, the inferred shapes and Spark's plan."""
        tier, out = self._run(df, _keys(df, None, json), json)
        given, outputs = self.infer()
        return f"tier: {tier}\ninput: {given}\noutputs: {', '.join(map(str, outputs))}\n{out._jdf.queryExecution().toString()}"

    def run(self, df: DataFrame, *, keys: list[str] | None = None, json: str | None = None, tier: str | None = None) -> DataFrame:
        """Rows (keys, ord, value, error), one for every output of every document.

        A document is a row of df, or with json the text in that column. Without
        keys all other columns but the document's are kept for JSON texts, and
        none for rows. Value is a typed column, or JSON text from the interpreter.
        """
        return self._run(df, _keys(df, keys, json), json, tier)[1]

    def _run(self, df: DataFrame, keys: list[str], json: str | None, tier: str | None = None) -> tuple[str, DataFrame]:
        node = simplified(self.node)
        if tier in (None, "typed", "json"):
            try:
                return ("json", self._json_tier(df, node, json, keys)) if json else ("typed", run_documents(df, node, keys))
            except LoweringError:
                if tier:
                    raise
        if tier is None and not json:
            try:
                return "batch", run_batches(df, node, keys)
            except NotBatched:
                pass
        df = spread(df)
        if json:
            return "interpreter", run_json(df, node, json, keys)
        return "interpreter", run_json(df.withColumn("_document", document_text(df)), node, "_document", keys)

    def _json_tier(self, df: DataFrame, node: A.Node, json: str, keys: list[str]) -> DataFrame:
        """JSON text read with the schema the program's input shape asks for, and typed from there on."""
        ddl = to_ddl(self.infer()[0])
        t = T.DataType.fromDDL(f"v {ddl}")["v"].dataType
        if not ddl.startswith(("STRUCT", "ARRAY")):
            raise LoweringError("scalar documents are left to the interpreter")
        text = F.col(f"`{json}`")
        source = df.select(*[F.col(f"`{k}`") for k in keys], text.alias("_text"), F.from_json(text, ddl).alias("_d"), F.try_parse_json(text).alias("_parsed"))
        # Documents that don't have the shape become error rows that say where and why.
        source = source.select("*", check_column(self.infer()[0], F.col("_parsed")).alias("_m"))
        bad = F.col("_m").isNotNull() | F.col("_parsed").isNull()
        message = F.coalesce(F.concat(F.lit("at "), F.col("_m.path"), F.lit(", expected "), F.col("_m.expected"), F.lit(", got "), F.col("_m.got")), F.lit("the document is not valid JSON"))
        error = F.when(bad, F.struct(F.lit("shape").alias("code"), message.alias("message"))).cast(ERROR)
        source = source.where(F.col("_text").isNotNull()).withColumn("_bad", bad).withColumn("_error", error)
        # The shape excludes nulls where a value is needed; texts that don't parse and the like are left to the interpreter.
        with collecting(nulls=False) as failures:
            good = self._json_outputs(source, node, t, keys)
        if not failures.items:
            return good
        failing = ~F.col("_bad") & failures.any()
        with collecting(nulls=False):
            good = self._json_outputs(source.where(~failing), node, t, keys)
        return with_interpreted(good, run_json(source.where(failing), node, "_text", keys))

    @staticmethod
    def _json_outputs(source: DataFrame, node: A.Node, t: T.DataType, keys: list[str]) -> DataFrame:
        """Outputs for documents of type t in _d; _bad ones give their _error."""
        cols, v, bad = Columns(), of_column(F.col("_d"), t), F.col("_bad")
        kept = [F.col(f"`{k}`") for k in keys]
        if not cols.is_many(node, {}):
            return source.select(*kept, F.lit(0).alias("ord"), F.when(~bad, cols.one(node, v, {}).to_column()).alias("value"), F.col("_error").alias("error"))
        items = cols.many(node, v, {})
        out = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("value", items.type.elementType), T.StructField("error", T.DataType.fromDDL(ERROR))])
        good = F.transform(items.column, lambda x, i: F.struct(i, x, F.lit(None).cast(ERROR))).cast(T.ArrayType(out))
        rows = F.when(bad, F.array(F.struct(F.lit(0), F.lit(None), F.col("_error"))).cast(T.ArrayType(out))).otherwise(good)
        return source.select(*kept, F.explode(rows).alias("_o")).select(*keys, "_o.ord", "_o.value", "_o.error")

    def over(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The program over named tables as one DataFrame plan."""
        return Relational(tables).lower(simplified(self.node))


def _keys(df: DataFrame, keys: list[str] | None, json: str | None) -> list[str]:
    return keys if keys is not None else [c for c in df.columns if c != json] if json else []


def compile(text: str, *, modules: Mapping[str, str] | str | Path | None = None) -> Program:  # noqa: A001
    """Parse a program. Raises lang.ParseError; other faults show when it is used.

    modules is a folder with modules as .jq files, or their texts by path.
    """
    return Program(text, parse_with_modules(text, Library(modules)))


__all__ = ["Program", "compile"]
