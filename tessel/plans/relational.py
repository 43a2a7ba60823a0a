"""Lowering of whole programs over tables to DataFrame plans.

A table's name stands for the array of its rows. Array idioms become relational
operators: T[] scans, select filters, map projects, group_by(f) | map(...)
aggregates, unique and unique_by remove duplicates, sort_by, reverse and slices
order and limit, nested bindings with a select join, select(any(T[]; ...)) and
its negation semi- and anti-join, T1 + T2 and T1 - T2 are set operations.
[T[] | select(.k == $a.k) | f] | aggregate inside a row's program is a join with
the aggregate by key, or with an inequality and max_by or min_by an as-of join.
reduce over rows is an aggregate, foreach over sorted rows a running window, and
$arr[$i + 1] over a range of indexes lead or lag.

The order of group_by, unique and unique_by holds for later steps that ask for
one (slices, first, reverse); the result is sorted only if the program sorts.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import ast as A
from .columns import BOOLEAN, DOUBLE, LONG, Columns, LoweringError, Val, array_of, as_array, as_number, cast, common_type, condition, element, literal, of_column, truthy


@dataclass
class Rows:
    """A stream with a value per row of df; pending holds sides of a join that wait for their condition."""

    df: DataFrame
    val: Val
    env: dict = field(default_factory=dict)
    pending: DataFrame | None = None
    order: list[tuple[Column, bool]] = field(default_factory=list)
    asked: bool = False


@dataclass
class Table:
    """One array whose items are the rows of df, in the given order; asked tells that the program sorted them."""

    df: DataFrame
    val: Val
    env: dict = field(default_factory=dict)
    order: list[tuple[Column, bool]] = field(default_factory=list)
    asked: bool = False


@dataclass
class Beside(Table):
    """A table whose rows, once iterated, are joined to the rows of left."""

    left: Rows | None = None


@dataclass
class Groups:
    """The array of groups of a table by a key; once iterated, a part applies to each group."""

    table: Table
    key_node: A.Node
    key: Val
    iterated: bool = False


class Relational:
    """lower(program) over named tables."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables, self.columns, self.count = tables, Columns(frozenset(tables)), 0

    def lower(self, program: A.Node) -> DataFrame:
        return self.result(self.run(program, None, {}))

    def result(self, state) -> DataFrame:
        if isinstance(state, Groups):
            raise LoweringError("groups must be mapped to something")
        state = self.settled(state)
        df = state.df
        if state.order and state.asked:
            df = df.orderBy(*sorting(state.order))
        if state.val.fields is not None:
            return df.select(*[v.to_column().alias(k) for k, v in state.val.fields.items()])
        return df.select(state.val.to_column().alias("value"))

    # -- helpers
    def table(self, name: str) -> Table:
        """The table under fresh column names, so that any two uses can be joined."""
        df = self.tables[name]
        self.count += 1
        renamed = df.select(*[F.col(f"`{f.name}`").alias(f"{f.name}__{self.count}") for f in df.schema.fields])
        fields = {f.name: of_column(F.col(f"`{f.name}__{self.count}`"), f.dataType) for f in df.schema.fields}
        return Table(renamed, Val(fields=fields))

    def is_table(self, node: A.Node, env: dict) -> bool:
        return isinstance(node, A.Call) and not node.args and node.name in self.tables and (node.name, 0) not in env

    def settled(self, state):
        """Any join that found no condition is a product: what the program says, but seldom what it means."""
        if isinstance(state, Rows) and state.pending is not None:
            warnings.warn("two tables are bound without a condition right after them: every row meets every row", stacklevel=2)
            return replace(state, df=state.df.crossJoin(state.pending), pending=None)
        return state

    def materialised(self, val: Val, df: DataFrame) -> tuple[DataFrame, Val]:
        """The value as plain columns of df, for operators that need them by name."""
        fields = val.fields if val.fields is not None else {"value": val}
        self.count += 1
        names = {k: f"{k}__{self.count}" for k in fields}
        out = df.select(*[v.to_column().alias(names[k]) for k, v in fields.items()])
        made = {k: of_column(F.col(f"`{names[k]}`"), out.schema[names[k]].dataType) for k in fields}
        return out, Val(fields=made) if val.fields is not None else made["value"]

    # -- statements
    def run(self, node: A.Node, state, env: dict):
        if isinstance(node, A.Define):
            return self.run(node.rest, state, env | {(node.name, len(node.params)): (node.params, node.body, env)})
        if isinstance(node, A.Pipe):
            return self.pipe(node, state, env)
        if self.is_table(node, env):
            table = self.table(node.name)
            return self.beside(state, table) if isinstance(state, Rows) else table
        if isinstance(node, A.Iterate):
            inner = self.run(node.target, state, env) if not isinstance(node.target, A.Identity) else state
            return self.iterate(inner, env)
        if isinstance(node, A.Bind):
            return self.bind(node, state, env)
        if not isinstance(state, (Rows, Groups)):
            if isinstance(node, A.Call) and (node.name, len(node.args)) in CUTS and (node.name, len(node.args)) not in env:
                return self.cut(node, self.run(node.args[-1], state, env), env)
            if isinstance(node, (A.Reduce, A.Foreach)):
                return self.over_rows(node, state, env)
        if isinstance(node, A.Slice) and not isinstance(state, Rows):
            return self.slice(self.run(node.target, state, env), node)
        if isinstance(node, A.ArrayOf) and node.body is not None and not isinstance(state, Rows):
            return self.as_table(self.run(node.body, state, env))
        if isinstance(node, A.Binary) and node.op in ("+", "-") and not isinstance(state, Rows):
            return self.set_operation(node, state, env)
        if isinstance(node, A.Identity):
            return state
        if isinstance(state, Rows):
            return self.on_row(node, state, env)
        if isinstance(state, Groups):
            return self.on_groups(node, state, env)
        if isinstance(state, Table):
            return self.on_table(node, state, env)
        if isinstance(node, A.Call) and (node.name, len(node.args)) in env:
            return self.columns.called(node, env[node.name, len(node.args)], env, lambda body, inner: self.run(body, state, inner))
        raise LoweringError(f"a program over tables can't start with {type(node).__name__}")

    def pipe(self, node: A.Pipe, state, env: dict):
        if isinstance(state, Rows) and not self.touches_table(node, env):
            scalar = self.scalar(node, state, env)
            if scalar is not None:
                return scalar
        left = self.run(node.left, state, env)
        return self.run(node.right, left, {k: v for k, v in env.items()})

    def touches_table(self, node: A.Node, env: dict) -> bool:
        return self.is_table(node, env) or any(self.touches_table(c, env) for c in node.children())

    def scalar(self, node: A.Node, state: Rows, env: dict) -> Rows | None:
        """The part as one column per row, if it has exactly one output."""
        if self.columns.is_many(node, env | state.env):
            return None
        return replace(state, val=self.columns.one(node, state.val, env | state.env))

    def iterate(self, state, env: dict):
        if isinstance(state, Beside):
            return Rows(state.left.df, state.val, state.left.env, pending=state.df, order=state.left.order, asked=state.left.asked)
        if isinstance(state, Table):
            return Rows(state.df, state.val, state.env, order=state.order, asked=state.asked)
        if isinstance(state, Rows):
            items = as_array(state.val)
            self.count += 1
            name = f"item__{self.count}"
            state = self.settled(state)
            df = state.df.select("*", F.posexplode(items.column).alias(f"pos__{self.count}", name))
            return replace(state, df=df, val=of_column(F.col(name), element(items)))
        if isinstance(state, Groups) and not state.iterated:
            return replace(state, iterated=True)
        raise LoweringError("only tables and rows are iterated")

    def beside(self, state: Rows, table: Table) -> Beside:
        """A table used inside a row's program: its rows stand beside the row's (a join, once a condition is known)."""
        state = self.settled(state)
        return Beside(table.df, table.val, state.env, left=state)

    def as_table(self, state) -> Table:
        state = self.settled(state)
        if isinstance(state, Rows):
            return Table(state.df, state.val, state.env, state.order, state.asked)
        return state

    def bind(self, node: A.Bind, state, env: dict):
        pattern = node.patterns[0]
        source = self.run(node.source, state, env) if self.touches_table(node.source, env) else None
        if source is None:
            if isinstance(state, Table):
                found = self.windowed(node, state, [], env | state.env)
                if found is not None:
                    return found
            if not isinstance(state, Rows):
                raise LoweringError("only values of rows are bound here")
            x = self.columns.one(node.source, state.val, env | state.env)
            return self.run(node.body, replace(state, env=state.env | self.columns.bound(pattern, x, env)), env)
        if isinstance(source, Table):
            found = self.windowed(replace(node, source=A.Identity()), source, [], env | source.env)
            if found is None:
                raise LoweringError("a whole table can't be bound; bind its rows")
            return found
        own = self.columns.bound(pattern, source.val, env)
        value = state.val if isinstance(state, Rows) else source.val
        return self.run(node.body, replace(source, env=source.env | own, val=value), env)

    # -- rows
    def on_row(self, node: A.Node, state: Rows, env: dict):
        scope = env | state.env
        if self.touches_table(node, env) and not (isinstance(node, A.Call) and node.name == "select" and self.is_semi(node.args[0], env)):
            node, state = self.decorrelated(node, self.settled(state), env)
            scope = env | state.env
        match node:
            case A.Call("select", (test,)):
                return self.select(test, state, env)
            case A.Call("empty", ()):
                return replace(self.settled(state), df=state.df.limit(0))
            case A.Comma():
                return self.comma(node, state, env)
            case A.Call(name, args) if (name, len(args)) in scope:
                return self.columns.called(node, scope[name, len(args)], scope, lambda body, inner: self.run(body, state, inner))
            case A.Try(body, None):
                return self.run(body, state, env)
        scalar = self.scalar(node, state, env)
        if scalar is not None:
            return scalar
        items = self.columns.many(node, state.val, scope)
        return self.iterate(replace(state, val=items), env)

    def select(self, test: A.Node, state: Rows, env: dict) -> Rows:
        semi = self.semi_join(test, state, env)
        if semi is not None:
            return semi
        where = condition(self.columns.one(test, state.val, env | state.env))
        if state.pending is not None:
            return replace(state, df=state.df.join(state.pending, where), pending=None)
        return replace(state, df=state.df.where(where))

    def is_semi(self, test: A.Node, env: dict) -> bool:
        if isinstance(test, A.Pipe) and test.right == A.Call("not"):
            test = test.left
        return isinstance(test, A.Call) and test.name == "any" and len(test.args) == 2 and self.touches_table(test.args[0], env)

    def semi_join(self, test: A.Node, state: Rows, env: dict) -> Rows | None:
        """select(any(T[]; cond)), and with not after it."""
        how = "left_semi"
        if not self.is_semi(test, env):
            return None
        if isinstance(test, A.Pipe):
            test, how = test.left, "left_anti"
        state = self.settled(state)
        right = self.run(test.args[0], None, env)
        if not isinstance(right, Rows):
            raise LoweringError("any needs the rows of a table")
        where = condition(self.columns.one(test.args[1], right.val, env | state.env))
        return replace(state, df=state.df.join(right.df, where, how))

    def comma(self, node: A.Comma, state: Rows, env: dict) -> Rows:
        parts: list[A.Node] = []

        def flat(n: A.Node) -> None:
            if isinstance(n, A.Comma):
                flat(n.left)
                flat(n.right)
            else:
                parts.append(n)

        flat(node)
        vals = [self.columns.one(p, state.val, env | state.env) for p in parts if not self.columns.is_many(p, env | state.env)]
        if len(vals) == len(parts):
            try:
                return self.iterate(replace(state, val=array_of(vals)), env)
            except LoweringError:
                pass
        raise LoweringError("outputs of several types have no common column")

    # -- tables
    def on_table(self, node: A.Node, state: Table, env: dict):
        scope = env | state.env
        rows = lambda: Rows(state.df, state.val, state.env, order=state.order, asked=state.asked)
        one = lambda n: self.columns.one(n, state.val, scope)
        match node:
            case A.Call("map", (f,)):
                out = self.settled(self.run(f, rows(), env))
                return Table(out.df, out.val, out.env, out.order, out.asked)
            case A.Call("flatten", ()) | A.Call("flatten", (A.Literal(),)):
                return self.flat(node, state)
            case A.Call("to_entries", ()):
                return self.numbered(state)
            case A.Call("group_by", (f,)):
                return Groups(state, f, one(f))
            case A.Call("sort_by", (f,)):
                return replace(state, order=[(c, True) for c in self.sort_keys(f, state, scope)] + state.order, asked=True)
            case A.Call("sort", ()):
                return replace(state, order=[(state.val.to_column(), True)], asked=True)
            case A.Call("reverse", ()):
                return replace(state, order=[(c, not up) for c, up in state.order], asked=bool(state.order))
            case A.Call("unique", ()):
                df, val = self.materialised(state.val, state.df.select("*"))
                df = df.distinct()
                return Table(df, val, {}, [(val.to_column(), True)])
            case A.Call("unique_by", (f,)):
                return self.unique_by(f, state, scope)
            case A.Call("first", ()) | A.Call("last", ()):
                return self.nth(state, node.name == "last")
            case A.Index(A.Identity(), A.Literal(0.0)):
                return self.nth(state, False)
            case A.Call(name, args) if (name, len(args)) in scope:
                return self.columns.called(node, scope[name, len(args)], scope, lambda body, inner: self.run(body, state, inner))
        if isinstance(node, A.Call) and node.name in ("any", "all") and len(node.args) == 1:
            test = truthy(one(node.args[0]))
            return self.single(state, Val((F.bool_or(test) if node.name == "any" else F.bool_and(test)), T.BooleanType()))
        return self.single(state, self.aggregate(node, state, None, scope))

    def sort_keys(self, f: A.Node, state: Table, scope: dict) -> list[Column]:
        if isinstance(f, A.Comma):
            return self.sort_keys(f.left, state, scope) + self.sort_keys(f.right, state, scope)
        if isinstance(f, A.ArrayOf) and f.body is not None:
            return self.sort_keys(f.body, state, scope)
        return [self.columns.one(f, state.val, scope).to_column()]

    def unique_by(self, f: A.Node, state: Table, scope: dict) -> Table:
        key = self.columns.one(f, state.val, scope).to_column()
        order = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in state.order] or [key]
        self.count += 1
        name = f"row__{self.count}"
        df = state.df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) == 1).drop(name)
        return replace(state, df=df, order=[(key, True)], asked=False)

    def nth(self, state: Table, last: bool) -> Rows:
        order = [(c, up != last) for c, up in state.order]
        if not order:
            raise LoweringError("the rows of a table have no order; sort_by first")
        return Rows(state.df.orderBy(*sorting(order)).limit(1), state.val, state.env)

    def cut(self, node: A.Call, found, env: dict) -> Rows:
        """limit, skip, first, last and nth over the rows of a table; without an order these are any rows of it."""
        found = self.settled(found)
        if not isinstance(found, Rows):
            raise LoweringError(f"{node.name} counts rows; iterate the table first")
        n = node.args[0].value if len(node.args) == 2 and isinstance(node.args[0], A.Literal) else 0.0 if len(node.args) == 1 else None
        if not isinstance(n, float) or n < 0 or n != int(n):
            raise LoweringError("the number of rows must be a whole constant")
        if not found.order and node.name in ("skip", "last", "nth"):
            raise LoweringError("the rows of a table have no order; sort_by first")
        order = [(c, up != (node.name == "last")) for c, up in found.order]
        df = found.df.orderBy(*sorting(order)) if order else found.df
        skipped = int(n) if node.name in ("skip", "nth") else 0
        df = df.offset(skipped) if skipped else df
        return replace(found, df=df if node.name == "skip" else df.limit(int(n) if node.name == "limit" else 1))

    def flat(self, node: A.Call, state: Table) -> Table:
        """The items of rows that are arrays, down to the depth; other rows stay."""
        depth = node.args[0].value if node.args else float("inf")
        val, df = state.val, state.df
        while depth >= 1 and val.kind == "array":
            self.count += 1
            name = f"item__{self.count}"
            df = df.select("*", F.explode(val.column).alias(name))
            val, depth = of_column(F.col(name), element(val)), depth - 1
        return Table(df, val, state.env, state.order if df is state.df else [], state.asked and df is state.df)

    def numbered(self, state: Table) -> Table:
        """The rows with their places. A place in the whole order is known to one task only, so this is for results, not for large tables."""
        if not state.order:
            raise LoweringError("the rows of a table have no order; sort_by before to_entries")
        self.count += 1
        name = f"place__{self.count}"
        df = state.df.withColumn(name, (F.row_number().over(Window.orderBy(*sorting(state.order))) - 1).cast("long"))
        return Table(df, Val(fields={"key": Val(F.col(name), LONG), "value": state.val}), state.env, [(F.col(name), True)], state.asked)

    def slice(self, state, node: A.Slice):
        if not isinstance(state, Table):
            raise LoweringError("only tables are cut here")
        bounds = [n.value if isinstance(n, A.Literal) else 0.0 if n is None else None for n in (node.low, node.high)]
        if bounds[0] is None or bounds[1] is None or node.high is None or bounds[0] < 0 or bounds[1] < 0:
            raise LoweringError("a slice of a table needs constant bounds from its start")
        if bounds[0] and not state.order:
            raise LoweringError("the rows of a table have no order; sort_by before a slice from the middle")
        df = (state.df.orderBy(*sorting(state.order)) if state.order else state.df).limit(int(bounds[1]))
        return replace(state, df=df.offset(int(bounds[0])) if bounds[0] else df)

    def set_operation(self, node: A.Binary, state, env: dict):
        if not (self.touches_table(node.left, env) and self.touches_table(node.right, env)):
            if isinstance(state, Table):
                return self.single(state, self.aggregate(node, state, None, env | state.env))
            if isinstance(state, Groups):
                return self.on_groups(node, state, env)
            raise LoweringError("both sides must be tables")
        left, right = (self.as_table(self.run(n, state, env)) for n in (node.left, node.right))
        a, x = self.materialised(left.val, left.df)
        b, y = self.materialised(right.val, right.df)
        if node.op == "+":
            return Table(a.union(b), x)
        return Table(a.join(b, x.to_column().eqNullSafe(y.to_column()), "left_anti"), x)

    def single(self, state: Table, val: Val) -> Rows:
        """One row that holds an aggregate of the table."""
        fields = val.fields if val.fields is not None else {"value": val}
        df = state.df.agg(*[v.to_column().alias(k) for k, v in fields.items()])
        made = {k: of_column(F.col(f"`{k}`"), df.schema[k].dataType) for k in fields}
        return Rows(df, Val(fields=made) if val.fields is not None else made["value"])

    # -- groups
    def on_groups(self, node: A.Node, state: Groups, env: dict):
        if state.iterated:
            return self.iterate(self.on_groups(A.Call("map", (node,)), replace(state, iterated=False), env), env)
        if isinstance(node, A.Call) and node.name == "length":
            return self.single(state.table, Val(F.count_distinct(state.key.to_column()), LONG))
        if not (isinstance(node, A.Call) and node.name == "map" and len(node.args) == 1):
            raise LoweringError("groups are mapped")
        table = state.table
        found = self.windowed(node.args[0], table, [state.key.to_column()], env | table.env)
        if found is not None:
            return Table(found.df, found.val, found.env, [], False)
        self.count += 1
        key_name = f"key__{self.count}"
        out = self.aggregate(node.args[0], table, state, env | table.env)
        fields = out.fields if out.fields is not None else {"value": out}
        names = {k: f"{k}__{self.count}" for k in fields}
        df = table.df.groupBy(state.key.to_column().alias(key_name)).agg(*[v.to_column().alias(names[k]) for k, v in fields.items()])
        made = {k: of_column(F.col(f"`{names[k]}`"), df.schema[names[k]].dataType) for k in fields}
        return Table(df, Val(fields=made) if out.fields is not None else made["value"], {}, [(F.col(key_name), True)])

    def aggregate(self, node: A.Node, table: Table, group: Groups | None, scope: dict) -> Val:
        """A part whose input is the array of a table's or group's rows, as an aggregate expression."""
        again = lambda n: self.aggregate(n, table, group, scope)
        one = lambda n: self.columns.one(n, table.val, scope)
        match node:
            case A.Call("length", ()):
                return Val(F.count(F.lit(1)), LONG)
            case A.Literal():
                return self.columns.one(node, table.val, scope)
            case A.ObjectOf(entries):
                fields = {}
                for k, v in entries:
                    if not isinstance(k, A.Literal):
                        raise LoweringError("aggregates need constant keys")
                    fields[k.value] = again(v)
                return Val(fields=fields)
            case A.Index(A.Index(A.Identity(), A.Literal(0.0)), _) | A.Pipe(A.Index(A.Identity(), A.Literal(0.0)), _) | A.Pipe(A.Call("first", ()), _):
                rest = node.right if isinstance(node, A.Pipe) else A.Index(A.Identity(), node.key)
                if group is not None and rest == group.key_node:
                    return group.key  # the grouping expression itself, so that hash aggregation applies
                v = one(rest)
                if not table.order:
                    raise LoweringError("the rows of a group have no order; sort_by first")
                return Val(F.min_by(v.to_column(), F.struct(*[c for c, _ in table.order])), v.to_type())
            case A.Call("map", (f,)):
                return self.listed(self.columns.one(f, table.val, scope), table)
            case A.Identity():
                return self.listed(table.val, table)
            case A.Pipe(A.Call("sort_by", (f,)), rest):
                return self.aggregate(rest, replace(table, order=[(c, True) for c in self.sort_keys(f, table, scope)] + table.order), group, scope)
            case A.Pipe(A.Call("min_by" | "max_by" as name, (f,)), rest):
                v = one(rest)
                pick = F.min_by if name == "min_by" else F.max_by
                return Val(pick(v.to_column(), self.by_key(f, table, scope)), v.to_type())
            case A.Call("min_by" | "max_by" as name, (f,)):
                pick = F.min_by if name == "min_by" else F.max_by
                return of_column(pick(table.val.to_column(), self.by_key(f, table, scope)), table.val.to_type())
            case A.Pipe(A.Call("map", (f,)), rest):
                return self.over_items(f, rest, table, scope)
            case A.Pipe(A.ArrayOf(A.Pipe(A.Iterate(A.Identity()), f)), rest):
                return self.over_items(f, rest, table, scope)
            case A.Pipe(left, A.Pipe(a, b)):
                return again(A.Pipe(A.Pipe(left, a), b))
            case A.Pipe(left, right):
                return self.columns.one(right, again(left), scope)
            case A.Binary(op, a, b):
                x, y = again(a), again(b)
                return self.columns.compute(op, x, y) if op in "+-*/%" else self.columns.compare(op, x, y)
            case A.Call("add" | "min" | "max" | "unique" | "any" | "all", ()):
                return self.over_items(A.Identity(), node, table, scope)
            case A.Call("add", (A.Index(A.Iterate(A.Identity()), key),)):
                return self.over_items(A.Index(A.Identity(), key), A.Call("add"), table, scope)
            case A.Reduce(A.Iterate(A.Identity()), pattern, init, update):
                return self.folded(pattern, init, update, table.val, scope, lambda c: c)
            case A.Call("any" | "all" as name, (f,)):
                test = truthy(one(f))
                return Val(F.bool_or(test) if name == "any" else F.bool_and(test), T.BooleanType())
            case A.Call(name, args) if (name, len(args)) in scope:
                return self.columns.called(node, scope[name, len(args)], scope, lambda body, inner: self.aggregate(body, table, group, inner))
        raise LoweringError(f"{type(node).__name__} over a group has no aggregate form")

    def by_key(self, f: A.Node, table: Table, scope: dict) -> Column:
        keys = self.sort_keys(f, table, scope)
        return keys[0] if len(keys) == 1 else F.struct(*keys)

    def over_items(self, f: A.Node, rest: A.Node, table: Table, scope: dict) -> Val:
        """[.[] | f] | rest: f per row, possibly behind a select; rest an aggregate."""
        keep: Column | None = None
        while isinstance(f, A.Pipe) and isinstance(f.left, A.Call) and f.left.name == "select":
            test = truthy(self.columns.one(f.left.args[0], table.val, scope))
            keep, f = test if keep is None else keep & test, f.right
        if isinstance(f, A.Call) and f.name == "select":
            test = truthy(self.columns.one(f.args[0], table.val, scope))
            keep, f = test if keep is None else keep & test, A.Identity()
        tail: A.Node | None = None
        if isinstance(rest, A.Pipe):
            rest, tail = rest.left, rest.right
        only = (lambda c: c) if keep is None else (lambda c: F.when(keep, c))
        if rest == A.Call("length"):
            made = Val(F.count(only(F.lit(1))), LONG)
        else:
            v = self.columns.one(f, table.val, scope)
            c = only(v.to_column())
            match rest:
                case A.Call("add", ()):
                    made = self.summed(v, keep, True)
                case A.Call("min", ()):
                    made = of_column(F.min(c), v.to_type())
                case A.Call("max", ()):
                    made = of_column(F.max(c), v.to_type())
                case A.Call("any", ()):
                    made = Val(F.bool_or(only(truthy(v))), T.BooleanType())
                case A.Call("all", ()):
                    made = Val(F.bool_and(only(truthy(v))), T.BooleanType())
                case A.Call("unique", ()) if tail == A.Call("length"):
                    made, tail = Val(F.count_distinct(c) + F.max(only(v.to_column().isNull().cast("int"))), LONG), None
                case A.Call("unique", ()):
                    made = Val(F.sort_array(F.collect_set(c)), T.ArrayType(v.to_type()))
                case A.Binary("/", A.Call("add", ()), A.Call("length", ())):
                    made = self.columns.compute("/", self.summed(v, keep, True), Val(F.count(only(F.lit(1))), LONG))
                case _:
                    return self.columns.one(rest if tail is None else A.Pipe(rest, tail), self.listed(v, table, keep), scope)
        return made if tail is None else self.columns.one(tail, made, scope)

    def summed(self, v: Val, keep: Column | None, nullable: bool) -> Val:
        v = as_number(v)
        integral = isinstance(v.type, T.IntegralType)
        t = LONG if integral else DOUBLE
        c = cast(v, t)
        total = F.sum(c if keep is None else F.when(keep, c))
        return Val(total if nullable else F.coalesce(total, F.lit(0).cast(t)), t)

    def listed(self, v: Val, table: Table, keep: Column | None = None) -> Val:
        """The values of a group as one array, in the table's order: as large as the group, as the program says."""
        ups = {up for _, up in table.order}
        if len(ups) > 1:
            raise LoweringError("an array per group needs keys of one direction")
        keys = [c.alias(f"k{i}") for i, (c, _) in enumerate(table.order)]
        item = F.struct(*keys, v.to_column().alias("v"))
        items = F.collect_list(item if keep is None else F.when(keep, item))
        return Val(F.transform(F.sort_array(items, True in ups) if keys else items, lambda x: x["v"]), T.ArrayType(v.to_type()))

    # -- folds and windows
    def over_rows(self, node: A.Reduce | A.Foreach, state, env: dict):
        """reduce and foreach whose source gives the rows of a table."""
        source = self.settled(self.run(node.source, state, env))
        if not isinstance(source, Rows):
            raise LoweringError("only rows are folded")
        scope = env | source.env
        if isinstance(node, A.Foreach):
            return self.running(node, Table(source.df, source.val, source.env, source.order, source.asked), [], scope)
        return self.single(Table(source.df, source.val, source.env), self.folded(node.pattern, node.init, node.update, source.val, scope, lambda c: c))

    def folded(self, pattern: A.Pattern, init: A.Node, update: A.Node, val: Val, scope: dict, over) -> Val:
        """A fold that is an aggregate: a sum, product, extreme, conjunction or disjunction. over puts a window on it."""
        inner = scope | self.columns.bound(pattern, val, scope)
        start = self.columns.one(init, literal(None), scope)
        dot = A.Identity()
        match update:
            case A.Binary("+" | "*" as op, A.Identity(), x) | A.Binary("+" | "*" as op, x, A.Identity()) if not reads_input(x):
                v = self.columns.one(x, val, inner)
                if op == "+" and v.kind != "number" or start.kind not in ("number", "null"):
                    raise LoweringError("only numbers are folded by + and *")
                if op == "*":
                    whole = over(F.product(cast(as_number(v), DOUBLE)))
                    return Val(F.coalesce(whole, F.lit(1.0)) * cast(as_number(start), DOUBLE), DOUBLE)
                total = self.summed(v, None, False)
                total = Val(F.coalesce(over(F.sum(cast(v, total.type))), F.lit(0).cast(total.type)), total.type)
                return total if start.kind == "null" or start.constant == 0 else self.columns.compute("+", start, total)
            case A.Binary("-", A.Identity(), x) if not reads_input(x):
                v = as_number(self.columns.one(x, val, inner))
                t = LONG if isinstance(v.type, T.IntegralType) else DOUBLE
                return self.columns.compute("-", as_number(start), Val(F.coalesce(over(F.sum(cast(v, t))), F.lit(0).cast(t)), t))
            case A.Logic(op, A.Identity(), x) if not reads_input(x):
                test = truthy(self.columns.one(x, val, inner))
                held = F.coalesce(over(F.bool_and(test) if op == "and" else F.bool_or(test)), F.lit(op == "and"))
                return Val(truthy(start) & held if op == "and" else truthy(start) | held, BOOLEAN)
            case A.If(A.Binary(">" | ">=" | "<" | "<=" as op, a, b), x, A.Identity()) if {a, b} == {x, dot} and not reads_input(x):
                return self.extreme((op[0] == ">") == (a == x), start, self.columns.one(x, val, inner), over)
            case A.Pipe(A.ArrayOf(A.Comma(a, b)), A.Call("max" | "min" as name, ())) if dot in (a, b):
                x = b if a == dot else a
                if not reads_input(x):
                    return self.extreme(name == "max", start, self.columns.one(x, val, inner), over)
        raise LoweringError("this fold over rows has no aggregate form")

    def extreme(self, largest: bool, start: Val, v: Val, over) -> Val:
        if v.kind not in ("number", "string") or start.kind not in (v.kind, "null"):
            raise LoweringError("extremes of other kinds are left out")
        if start.kind == "null" and not largest:
            return literal(None)  # nothing is below null
        # A null below everything: it loses every maximum and wins every minimum.
        t = common_type([start, v]) if start.kind != "null" else v.type
        found = over(F.max(v.column) if largest else F.min(v.column)).cast(t)
        if start.kind == "null":
            return Val(found, t)
        first = cast(start, t)
        if largest:
            return Val(F.greatest(first, found), t)
        lost = F.coalesce(over(F.bool_or(v.column.isNull())), F.lit(False))
        return Val(F.when(~lost, F.least(first, found)), t)

    def windowed(self, node: A.Node, table: Table, keys: list[Column], scope: dict) -> Rows | None:
        """A part over the sorted rows of a table, or of each of its groups, that needs neighbours or running state."""
        match node:
            case A.Pipe(A.Call("sort_by", (f,)), rest):
                order = [(c, True) for c in self.sort_keys(f, table, scope)] + table.order
                return self.windowed(rest, replace(table, order=order, asked=not keys), keys, scope)
            case A.Bind(A.Call("sort_by", (f,)), patterns, body):
                return self.windowed(A.Pipe(A.Call("sort_by", (f,)), A.Bind(A.Identity(), patterns, body)), table, keys, scope)
            case A.Bind(A.Identity(), (A.Pattern("var", array),), body):
                return self.neighbours(array, body, table, keys, scope)
            case A.Foreach(A.Iterate(A.Identity()), _, _, _, _):
                return self.running(node, table, keys, scope)
        return None

    def window(self, table: Table, keys: list[Column]):
        if not table.order:
            raise LoweringError("the rows of a table have no order; sort_by first")
        return Window.partitionBy(*keys).orderBy(*sorting(table.order))

    def running(self, node: A.Foreach, table: Table, keys: list[Column], scope: dict) -> Rows:
        """foreach over sorted rows: its state as a window up to the row. Without groups the window is one task's work."""
        so_far = self.window(table, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        state = self.folded(node.pattern, node.init, node.update, table.val, scope, lambda c: c.over(so_far))
        self.count += 1
        name = f"state__{self.count}"
        df = table.df.withColumn(name, state.column)
        inner = scope | self.columns.bound(node.pattern, table.val, scope)
        out = self.columns.one(node.extract, of_column(F.col(name), state.type), inner)
        return Rows(df, out, table.env, order=table.order, asked=table.asked)

    def neighbours(self, array: str, body: A.Node, table: Table, keys: list[Column], scope: dict) -> Rows | None:
        """range(low; ($array | length) - n) as $i | f with $array[$i + k]: row i with its neighbours by lead and lag."""
        match body:
            case A.Pipe(A.Call("range", args), A.Bind(A.Identity(), (A.Pattern("var", index),), rest)) | A.Bind(A.Call("range", args), (A.Pattern("var", index),), rest) if len(args) <= 2:
                pass
            case _:
                return None
        low = args[0].value if len(args) == 2 and isinstance(args[0], A.Literal) else 0.0 if len(args) == 1 else None
        cut = beyond_length(args[-1], array)
        if low is None or cut is None or low != int(low) or low < 0:
            return None
        window = self.window(table, keys)
        self.count += 1
        place, size = f"place__{self.count}", f"size__{self.count}"
        columns = {place: (F.row_number().over(window) - 1).cast("long"), size: F.count(F.lit(1)).over(Window.partitionBy(*keys))}
        env, found = dict(scope), {}

        def shifted(n: A.Node) -> A.Node:
            if isinstance(n, A.Index) and n.target == A.Variable(array):
                k = offset_of(n.key, index)
                if k is None:
                    raise LoweringError("only neighbours at a constant distance are windows")
                if low + k < 0:
                    raise LoweringError("an index below 0 counts from the end of the array")
                found[k] = f"{array}@{k}"
                return A.Variable(found[k])
            if n == A.Variable(array):
                raise LoweringError("the whole array can't be used beside its neighbours")
            return replace(n, **{f.name: mapped(getattr(n, f.name), shifted) for f in fields(n)})

        rest = shifted(rest)
        inside = table.val.fields if table.val.fields is not None else {"": table.val}
        for k, variable in found.items():
            parts = {}
            for i, (name, v) in enumerate(inside.items()):
                c = v.to_column()
                if k:
                    held = f"near__{self.count}_{k}_{i}"
                    columns[held] = F.lead(c, k).over(window) if k > 0 else F.lag(c, -k).over(window)
                    c = F.col(held)
                parts[name] = of_column(c, v.to_type())
            env[f"${variable}"] = Val(fields=parts) if table.val.fields is not None else parts[""]
        df = table.df.select("*", *[c.alias(n) for n, c in columns.items()])
        df = df.where((F.col(place) >= int(low)) & (F.col(place) < F.col(size) + cut))
        env[f"${index}"] = Val(F.col(place), LONG)
        out = Rows(df, Val(F.col(place), LONG), table.env | {k: v for k, v in env.items() if k not in scope}, order=table.order, asked=table.asked)
        return self.run(rest, out, {k: v for k, v in scope.items() if k not in table.env})

    # -- aggregates of another table inside a row's program
    def decorrelated(self, node: A.Node, state: Rows, env: dict) -> tuple[A.Node, Rows]:
        """The part with every aggregate over another table replaced by a variable that a join binds."""

        def replaced(n: A.Node, here: bool = True) -> A.Node:
            """here: the part's input is the row itself."""
            nonlocal state
            if not self.touches_table(n, env):
                return n
            match n:
                case A.Pipe(A.ArrayOf(body), rest) if body is not None and self.touches_table(body, env) and not self.touches_table(rest, env):
                    state, made = self.aggregate_beside(body, rest, state, env)
                    return made
                case A.Call("any" | "all" as name, (source, test)) if self.touches_table(source, env):
                    state, made = self.aggregate_beside(A.Pipe(source, test), A.Call(name), state, env)
                    return made
                case A.Reduce(source, pattern, init, update) if self.touches_table(source, env):
                    state, made = self.aggregate_beside(source, A.Reduce(A.Iterate(A.Identity()), pattern, init, update), state, env)
                    return made
                case A.Bind(source, (pattern,), body) if here and not self.touches_table(source, env):
                    x = self.columns.one(source, state.val, env | state.env)
                    state = replace(state, env=state.env | self.columns.bound(pattern, x, env | state.env))
                    return replaced(body)
                case A.Pipe(left, right):
                    return A.Pipe(replaced(left, here), replaced(right, here and left == A.Identity()))
            inside = here and not isinstance(n, (A.Call, A.Foreach, A.Define))
            return replace(n, **{f.name: mapped(getattr(n, f.name), lambda c: replaced(c, inside)) for f in fields(n)})

        return replaced(node), state

    def aggregate_beside(self, body: A.Node, rest: A.Node, state: Rows, env: dict) -> tuple[Rows, A.Node]:
        """[T[] | select(conditions) | f] | rest as a column of state: conditions are equations of a part of T's row with a part of the outer row."""
        outer = {name for name in state.env if name.startswith("$")}
        steps = piped(body)
        right = self.run(steps[0], None, env)
        if not isinstance(right, Rows):
            raise LoweringError("an aggregate beside rows needs the rows of a table")
        right = self.settled(right)
        equal: list[tuple[Val, Val]] = []
        nearer: list[tuple[str, A.Node, Val, Val]] = []
        for k, step in enumerate(steps[1:], 1):
            if not (isinstance(step, A.Call) and step.name == "select" and mentions(step, outer)):
                if mentions(step, outer):
                    raise LoweringError("only conditions join a table to the row beside it")
                right = self.run(step, right, env)
                continue
            if k > 1 and any(not (isinstance(s, A.Call) and s.name == "select") for s in steps[1:k]):
                raise LoweringError("conditions on the outer row come before other steps")
            for test in conjuncts(step.args[0]):
                if not mentions(test, outer):
                    right = self.run(A.Call("select", (test,)), right, env)
                    continue
                if not (isinstance(test, A.Binary) and test.op in FLIPPED):
                    raise LoweringError("rows of two tables meet by comparisons")
                op, a, b = test.op, test.left, test.right
                if mentions(a, outer):
                    op, a, b = FLIPPED[op], b, a
                if mentions(a, outer) or reads_input(b):
                    raise LoweringError("one side of a comparison is the table's, the other the outer row's")
                x, y = self.columns.one(a, right.val, env | right.env), self.columns.one(b, literal(None), env | state.env)
                if op == "==":
                    equal.append((x, y))
                else:
                    nearer.append((op, a, x, y))
        self.count += 1
        name = f"beside@{self.count}"
        if nearer:
            state, out = self.as_of(rest, right, equal, nearer, state, env)
            return replace(state, env=state.env | {f"${name}": out}), A.Variable(name)
        keys = [f"key__{self.count}_{i}" for i in range(len(equal))]
        value = f"agg__{self.count}"
        scope = env | right.env
        out = self.aggregate(rest, Table(right.df, right.val, right.env, right.order), None, scope)
        made = out.to_column()
        grouped = right.df.groupBy(*[x.to_column().alias(k) for k, (x, _) in zip(keys, equal)]).agg(made.alias(value), F.lit(True).alias(f"{value}_met"))
        joined = [y.to_column().eqNullSafe(F.col(k)) for k, (_, y) in zip(keys, equal)]
        df = state.df.join(grouped, joined, "left") if joined else state.df.crossJoin(F.broadcast(grouped))
        found, t = F.col(value), grouped.schema[value].dataType
        nothing = empty_result(rest)
        if nothing is not None:
            found = F.when(F.col(f"{value}_met").isNull(), nothing.cast(t)).otherwise(found)
        return replace(state, df=df, env=state.env | {f"${name}": of_column(found, t)}), A.Variable(name)

    def as_of(self, rest: A.Node, right: Rows, equal: list, nearer: list, state: Rows, env: dict) -> tuple[Rows, Val]:
        """The nearest row of the other table by one inequality: both sides in one sorted window per key.

        Rows of the table that are equally near are equally good.
        """
        tail: A.Node = A.Identity()
        if isinstance(rest, A.Pipe):
            rest, tail = rest.left, rest.right
        if len(nearer) != 1 or not (isinstance(rest, A.Call) and rest.name in ("max_by", "min_by") and len(rest.args) == 1):
            raise LoweringError("an inequality beside rows needs max_by or min_by of the same part")
        op, part, x, y = nearer[0]
        back = op in ("<", "<=")
        if rest.args[0] != part or rest.name != ("max_by" if back else "min_by"):
            raise LoweringError("the nearest row is max_by below, min_by above, by the compared part")
        v = self.columns.one(tail, right.val, env | right.env)
        self.count += 1
        n = self.count
        t = common_type([x, y])
        keys = [f"key__{n}_{i}" for i in range(len(equal))]
        at, side, own, found = f"at__{n}", f"side__{n}", f"own__{n}", f"found__{n}"
        mine = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(state.df.columns)])
        kinds = [common_type([a, b]) for a, b in equal]
        left = state.df.select(*[cast(b, k).alias(c) for c, k, (_, b) in zip(keys, kinds, equal)], cast(y, t).alias(at), mine.alias(own))
        there = right.df.select(*[cast(a, k).alias(c) for c, k, (a, _) in zip(keys, kinds, equal)], cast(x, t).alias(at), F.struct(v.to_column().alias("v")).alias(found))
        # Equal places: with <= and >= the table's rows come first, with < and > the row's own.
        mine_last = F.lit(1 if len(op) == 2 else -1)
        both = left.withColumn(side, mine_last).unionByName(there.withColumn(side, F.lit(0)), allowMissingColumns=True)
        place = F.col(at).asc_nulls_first() if back else F.col(at).desc_nulls_last()
        near = Window.partitionBy(*keys).orderBy(place, F.col(side)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = both.withColumn(found, F.last(found, ignorenulls=True).over(near)).where(F.col(side) != 0)
        names = [F.col(f"{own}.c{i}").alias(c) for i, c in enumerate(state.df.columns)]
        df = df.select(*names, F.col(f"{found}.v").alias(found))
        return replace(state, df=df), of_column(F.col(found), df.schema[found].dataType)


#: Builtins that count the outputs of their last argument.
CUTS = {("limit", 2), ("skip", 2), ("nth", 2), ("first", 1), ("last", 1)}
#: Comparisons and what they are with their sides exchanged.
FLIPPED = {"==": "==", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def sorting(order: list[tuple[Column, bool]]) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in order]


def mapped(value, f):
    """A field of a node with f on every node in it."""
    if isinstance(value, A.Node):
        return f(value)
    if isinstance(value, tuple):
        return tuple(mapped(v, f) for v in value)
    return value


def reads_input(node: A.Node) -> bool:
    """Whether a part may depend on its input: not if it starts from variables and constants alone."""
    match node:
        case A.Literal() | A.Variable() | A.Call("null" | "true" | "false" | "empty" | "nan" | "infinite", ()):
            return False
        case A.Identity() | A.RecurseAll() | A.Call() | A.Format():
            return True
        case A.Pipe(left, _):
            return reads_input(left)
        case A.Bind(source, _, body):
            return reads_input(source) or reads_input(body)
    return any(reads_input(c) for c in node.children())


def mentions(node: A.Node, names: set[str]) -> bool:
    """Whether a part names one of the variables."""
    return isinstance(node, A.Variable) and f"${node.name}" in names or any(mentions(c, names) for c in node.children())


def piped(node: A.Node) -> list[A.Node]:
    if isinstance(node, A.Pipe):
        return piped(node.left) + piped(node.right)
    return [node]


def conjuncts(node: A.Node) -> list[A.Node]:
    if isinstance(node, A.Logic) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def offset_of(key: A.Node, index: str) -> int | None:
    """k of $index + k."""
    me = A.Variable(index)
    match key:
        case A.Variable() if key == me:
            return 0
        case A.Binary("+" | "-" as op, a, A.Literal(float(n))) if a == me and n == int(n):
            return int(n) if op == "+" else -int(n)
        case A.Binary("+", A.Literal(float(n)), b) if b == me and n == int(n):
            return int(n)
    return None


def beyond_length(node: A.Node, array: str) -> int | None:
    """n of ($array | length) + n."""
    length = A.Pipe(A.Variable(array), A.Call("length"))
    match node:
        case A.Pipe(A.Variable(name), A.Binary("+" | "-" as op, A.Call("length", ()), A.Literal(float(n)))) if name == array and n == int(n):
            return int(n) if op == "+" else -int(n)
        case A.Binary("+" | "-" as op, a, A.Literal(float(n))) if a == length and n == int(n):
            return int(n) if op == "+" else -int(n)
    return 0 if node == length else None


def empty_result(rest: A.Node) -> Column | None:
    """What an aggregate gives for no items, as the language says, if that is a scalar."""
    from ..values import Failure
    from .interpreter import run_program

    out = run_program(rest, [])
    if len(out) != 1 or isinstance(out[0], (Failure, list, dict)) or out[0] is None:
        return None
    return F.lit(out[0])
