"""Programs of numbers over whole batches of rows, as numpy arrays.

Programs that only compute with numbers, booleans and arrays of fixed length, and
loop with until, give one output a row and never fail. They run on all rows of a
batch at once; until goes on with the rows that aren't done. lowered decides from
the kinds of the columns alone, before anything runs. Values are those of the
interpreter: 64-bit floats, NaN before all numbers, x / 0 and x % 0 as in IEEE.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from ..lang import ast as A
from ..values import number_text

#: A kind is NUMBER, BOOLEAN, the tuple of an array's kinds, or the dict of a row's.
Kind = Any
#: Values of a kind for n rows: arrays of n items (or one item for all rows), in tuples and dicts like the kind.
Value = Any
Compute = Callable[[Value, int], Value]

NUMBER, BOOLEAN = "number", "boolean"


class NotBatched(Exception):
    """The program needs the per-document interpreter."""


def column_kinds(schema: T.StructType) -> dict[str, str]:
    """Columns that batches hold as the interpreter does; others are read from JSON text."""
    kinds = {f.name: BOOLEAN if isinstance(f.dataType, T.BooleanType) else NUMBER for f in schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType))}
    return {name: kind for name, kind in kinds.items() if schema.names.count(name) == 1}


def columns_used(node: A.Node, kinds: dict[str, str]) -> list[str]:
    """Columns that the program reads. Raises NotBatched if it can't run over batches."""
    used: set[str] = set()

    class Noting(dict):
        def __getitem__(self, name: str) -> str:
            used.add(name)
            return super().__getitem__(name)

    lowered(node, Noting(kinds))
    return sorted(used)


def lowered(node: A.Node, kinds: dict[str, str]) -> Callable[[dict[str, np.ndarray], int], pa.Array]:
    """A function from columns of n rows to the outputs as JSON texts. Raises NotBatched."""
    kind, compute = _lower(node, kinds)
    if _holds_row(kind):
        raise NotBatched

    def run(columns: dict[str, np.ndarray], n: int) -> pa.Array:
        with np.errstate(all="ignore"):
            return _texts(_whole(compute(columns, n), n), n)

    return run


# -- values
def _mapped(f: Callable, *values: Value) -> Value:
    """f of the arrays at the same place of values of one kind."""
    first = values[0]
    if isinstance(first, tuple):
        return tuple(_mapped(f, *items) for items in zip(*values))
    if isinstance(first, dict):
        return {k: _mapped(f, *(v[k] for v in values)) for k in first}
    return f(*values)


def _whole(v: Value, n: int) -> Value:
    return _mapped(lambda x: x if np.ndim(x) else np.full(n, x), v)


def _taken(v: Value, at: np.ndarray) -> Value:
    return _mapped(lambda x: x[at] if np.ndim(x) else x, v)


def _empty(kind: Kind, n: int) -> Value:
    return _mapped(lambda k: np.empty(n, np.bool_ if k == BOOLEAN else np.float64), kind)


def _put(out: Value, at: np.ndarray, v: Value) -> None:
    _mapped(lambda o, x: o.__setitem__(at, x), out, v)


def _texts(v: Value, n: int) -> pa.Array:
    if isinstance(v, tuple):
        items = [_texts(x, n).to_pylist() for x in v]
        return pa.array([f"[{','.join(row)}]" for row in zip(*items)] if items else ["[]"] * n, pa.string())
    if v.dtype != np.bool_:
        if not ((np.abs(v) < 1e17) & (v == np.floor(v))).all():
            return pa.array(map(number_text, v.tolist()), pa.string())
        v = v.astype(np.int64)
    return pa.array(v).cast(pa.string())


# -- programs
def _remainder(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """fmod, by whole numbers where all are: that is many times quicker and as exact. The sign is that of a, for zeros too."""
    m, d = np.abs(a), np.abs(b)
    if ((m < 2.0**53) & (m == np.floor(m))).all() and ((0 < d) & (d < 2.0**53) & (d == np.floor(d))).all():
        m, d = m.astype(np.int64), d.astype(np.int64)
        return np.copysign(m - m // d * d, a)
    return np.fmod(a, b)


ARITHMETIC = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": _remainder}
EQUALITY = {"==": np.equal, "!=": np.not_equal}
ORDER = {
    "<": lambda a, b: np.isnan(a) | (a < b),
    "<=": lambda a, b: np.isnan(a) | (a <= b),
    ">": lambda a, b: np.isnan(b) | (a > b),
    ">=": lambda a, b: np.isnan(b) | (a >= b),
}


def _lower(node: A.Node, kind: Kind) -> tuple[Kind, Compute]:
    match node:
        case A.Identity():
            return kind, lambda v, n: v
        case A.Literal(bool() as c):
            return BOOLEAN, lambda v, n: np.bool_(c)
        case A.Literal(float() as c):
            return NUMBER, lambda v, n: np.float64(c)
        case A.Index(target, A.Literal(key)):
            return _index(*_lower(target, kind), key)
        case A.Index(target, A.Negate(A.Literal(float() as key))):
            return _index(*_lower(target, kind), -key)
        case A.Negate(body):
            compute = _of_kind(NUMBER, body, kind)
            return NUMBER, lambda v, n: -compute(v, n)
        case A.Binary(op, left, right) if op in ARITHMETIC or op in EQUALITY or op in ORDER:
            return _binary(op, _lower(left, kind), _lower(right, kind))
        case A.Logic(op, left, right):
            known = A.Literal(op == "or")
            then, otherwise = (known, right) if op == "or" else (right, known)
            return BOOLEAN, _chosen(BOOLEAN, _truth(left, kind), _truth(then, kind), _truth(otherwise, kind), _loops(right))
        case A.If(test, then, otherwise):
            (made, a), (other, b) = _lower(then, kind), _lower(otherwise, kind)
            if made != other or _holds_row(made):
                raise NotBatched
            chosen = _chosen(made, _truth(test, kind), a, b, _loops(then) or _loops(otherwise))
            return made, chosen if not isinstance(made, tuple) or _loops(node) else _chosen_items(node, kind, chosen)
        case A.Pipe(left, right):
            between, a = _lower(left, kind)
            made, b = _lower(right, between)
            return made, lambda v, n: b(a(v, n), n)
        case A.ArrayOf(body):
            parts = [_lower(part, kind) for part in _commas(body)] if body else []
            return tuple(k for k, _ in parts), lambda v, n: tuple(f(v, n) for _, f in parts)
        case A.Call("until", (test, step)) if not _holds_row(kind):
            return kind, _until(kind, _truth(test, kind), _of_kind(kind, step, kind))
    raise NotBatched


def _commas(node: A.Node) -> list[A.Node]:
    return _commas(node.left) + _commas(node.right) if isinstance(node, A.Comma) else [node]


def _holds_row(kind: Kind) -> bool:
    return isinstance(kind, dict) or isinstance(kind, tuple) and any(map(_holds_row, kind))


def _loops(node: A.Node) -> bool:
    return isinstance(node, A.Call) or any(map(_loops, node.children()))


def _of_kind(wanted: Kind, node: A.Node, kind: Kind) -> Compute:
    made, compute = _lower(node, kind)
    if made != wanted:
        raise NotBatched
    return compute


def _truth(node: A.Node, kind: Kind) -> Compute:
    """Only false is not true: there are no nulls here."""
    made, compute = _lower(node, kind)
    return compute if made == BOOLEAN else lambda v, n: np.True_


def _index(kind: Kind, target: Compute, key: Any) -> tuple[Kind, Compute]:
    if isinstance(kind, dict) and isinstance(key, str) and key in kind:
        return kind[key], lambda v, n: target(v, n)[key]
    if isinstance(kind, tuple) and isinstance(key, float) and math.isfinite(key) and key == int(key) and -len(kind) <= key < len(kind):
        at = int(key)
        return kind[at], lambda v, n: target(v, n)[at]
    raise NotBatched


def _binary(op: str, left: tuple[Kind, Compute], right: tuple[Kind, Compute]) -> tuple[Kind, Compute]:
    (ka, a), (kb, b) = left, right
    if ka != kb or ka not in ((NUMBER, BOOLEAN) if op in EQUALITY else (NUMBER,)):
        raise NotBatched
    compute = ARITHMETIC.get(op) or EQUALITY.get(op) or ORDER[op]
    return NUMBER if op in ARITHMETIC else BOOLEAN, lambda v, n: compute(a(v, n), b(v, n))


def _chosen(kind: Kind, test: Compute, then: Compute, otherwise: Compute, loops: bool) -> Compute:
    """Both branches for all rows; if one loops, each for its own rows only, since it may not end for others."""

    def both(v: Value, n: int) -> Value:
        c = test(v, n)
        return _mapped(lambda a, b: np.where(c, a, b), then(v, n), otherwise(v, n))

    def parted(v: Value, n: int) -> Value:
        c = np.broadcast_to(test(v, n), n)
        out = _empty(kind, n)
        for branch, at in ((then, np.flatnonzero(c)), (otherwise, np.flatnonzero(~c))):
            if len(at):
                _put(out, at, branch(_taken(v, at), len(at)))
        return out

    return parted if loops else both


def _chosen_items(node: A.If, kind: Kind, whole: Compute) -> Compute:
    """Arrays whose items are chosen one by one, those that both branches write alike only computed; else the whole choice."""
    sides = [_commas(b.body) if isinstance(b, A.ArrayOf) and b.body else None for b in (node.then, node.otherwise)]
    if None in sides:
        return whole
    test = _truth(node.condition, kind)
    items = [(_lower(x, kind)[1], None if x == y else _lower(y, kind)[1]) for x, y in zip(*sides)]

    def run(v: Value, n: int) -> Value:
        c = test(v, n)
        return tuple(a(v, n) if b is None else _mapped(lambda x, y: np.where(c, x, y), a(v, n), b(v, n)) for a, b in items)

    return run


def _until(kind: Kind, test: Compute, step: Compute) -> Compute:
    def run(v: Value, n: int) -> Value:
        out, at, state = _empty(kind, n), np.arange(n), _whole(v, n)
        while len(at):
            ends = np.broadcast_to(test(state, len(at)), len(at))
            done = np.flatnonzero(ends)
            if len(done):
                _put(out, at[done], _taken(state, done))
                left = np.flatnonzero(~ends)
                at, state = at[left], _taken(state, left)
            state = _whole(step(state, len(at)), len(at))
        return out

    return run
