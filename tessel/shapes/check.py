"""Holding values against shapes: one value in Python, whole columns in Spark."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import show, type_of
from .algebra import Arr, Blob, Both, Clash, Neg, Null, Obj, Scalar, Shape, Tup, TVar, Union, arms, parts, render

_KINDS = {"bool": "boolean", "number": "number", "string": "string"}


@dataclass(frozen=True)
class Mismatch:
    """The place where a value is not what the program needs."""

    path: str
    expected: str
    got: str

    def __str__(self) -> str:
        return f"at {self.path}, expected {self.expected}, got {self.got}"


def _fails(shape: Shape, v: Any, path: str) -> Mismatch | None:
    miss = Mismatch(path or ".", render(shape, False), show(v))
    kind = type_of(v)
    match shape:
        case TVar() | Blob():
            return None
        case Null():
            return None if v is None else miss
        case Scalar(k, value):
            return None if kind == _KINDS[k] and (value is None or v == value[0]) else miss
        case Arr(item, _):
            if kind != "array":
                return miss
            return next((m for i, x in enumerate(v) if (m := _fails(item, x, f"{path}[{i}]"))), None)
        case Tup(items):
            if kind != "array" or len(v) < len(items):
                return miss
            return next((m for i, s in enumerate(items) if (m := _fails(s, v[i], f"{path}[{i}]"))), None)
        case Obj(fields):
            if kind != "object" or any(k not in v for k, _ in fields):
                return miss
            return next((m for k, s in fields if (m := _fails(s, v[k], f"{path}.{k}"))), None)
        case Union():
            found = [_fails(arm, v, path) for arm in arms(shape)]
            return None if None in found else Mismatch(found[0].path, render(shape, False), found[0].got)
        case Both(a, b):
            return _fails(a, v, path) or _fails(b, v, path)
        case Neg(body):
            return miss if _fails(body, v, path) is None else None
    return miss


def check(shape: Shape, v: Any) -> Mismatch | None:
    """The first mismatch of a value, or None if it conforms."""
    return _fails(shape, v, "")


def ill_typed(shape: Shape) -> Clash | None:
    """The first type error inside a shape: the program can't work on any input."""
    if isinstance(shape, Clash):
        return shape
    return None if isinstance(shape, Neg) else next((c for p in parts(shape) if (c := ill_typed(p))), None)


RESULT = "struct<path string, expected string, got string>"


def check_column(shape: Shape, variant: Column) -> Column:
    """The same check as a column: null, or struct<path, expected, got>, of a VARIANT column.

    Everything is made of built-in functions, so it runs inside the scan's stage.
    """
    return _column(shape, variant, F.lit(""))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _kind(v: Column) -> Column:
    """Type name of a variant; a missing one (SQL null) has kind missing."""

    def named(s: Column) -> Column:
        number = s.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | s.startswith("DECIMAL")
        return F.when(s.isNull(), "missing").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(number, "number").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("other")

    return _let(F.schema_of_variant(v), named)


def _column(shape: Shape, v: Column, path: Column) -> Column:
    if isinstance(shape, (TVar, Blob)):
        return F.lit(None).cast(RESULT)
    return _let(v, lambda x: _tested(shape, x, path))


def _tested(shape: Shape, v: Column, path: Column) -> Column:
    none = F.lit(None).cast(RESULT)
    miss = F.struct(F.when(path == "", ".").otherwise(path).alias("path"), F.lit(render(shape, False)).alias("expected"), F.to_json(v).alias("got")).cast(RESULT)
    kind = _kind(v)
    match shape:
        case Null():
            return F.when(kind == "null", none).otherwise(miss)
        case Scalar(k, value):
            good = kind == _KINDS[k]
            if value is not None:
                type_ = {"bool": "boolean", "number": "double", "string": "string"}[k]
                good = good & F.coalesce(F.try_variant_get(v, "$", type_) == F.lit(value[0]), F.lit(False))
            return F.when(good, none).otherwise(miss)
        case Arr(item, _):
            inner = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _column(item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.when(kind != "array", miss).otherwise(F.get(F.filter(inner, lambda m: m.isNotNull()), F.lit(0)))
        case Tup(items):
            all_ = F.try_variant_get(v, "$", "array<variant>")
            inner = F.coalesce(none, *[_column(s, F.get(all_, F.lit(i)), F.concat(path, F.lit(f"[{i}]"))) for i, s in enumerate(items)])
            return F.when((kind != "array") | (F.size(all_) < len(items)), miss).otherwise(inner)
        case Obj(fields):
            at = {k: F.try_variant_get(v, f"$[{_quoted(k)}]", "variant") for k, _ in fields}
            absent = F.lit(False)
            for c in at.values():
                absent = absent | c.isNull()
            inner = F.coalesce(none, *[_column(s, at[k], F.concat(path, F.lit(f".{k}"))) for k, s in fields])
            return F.when((kind != "object") | absent, miss).otherwise(inner)
        case Union():
            found = [_column(arm, v, path) for arm in arms(shape)]
            good = F.lit(False)
            for f in found:
                good = good | f.isNull()
            return F.when(good, none).otherwise(F.struct(found[0]["path"].alias("path"), F.lit(render(shape, False)).alias("expected"), found[0]["got"].alias("got")))
        case Both(a, b):
            return F.coalesce(_column(a, v, path), _column(b, v, path))
        case Neg(body):
            return F.when(_column(body, v, path).isNull(), miss).otherwise(none)
    return miss


def _quoted(key: str) -> str:
    return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'
