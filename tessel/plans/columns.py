"""Lowering of single-valued program parts to Column expressions (typed and VARIANT tiers).

Rules of the typed tier: SQL NULL stands for null; integral columns stay
integral; / and non-integral maths give DOUBLE; what is an error for one row's
value gives NULL and is noted as a failure (see failures), what is an error for
the column's type is a LoweringError (and leaves the program to a later tier).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import ast as A
from ..shapes.algebra import to_ddl
from ..shapes.direct import DirectInference
from .failures import collecting, each, fold, guarded, note


class LoweringError(Exception):
    """This part can't be expressed in the tier that is being tried."""


@dataclass
class Val:
    """A value per row: a column of a known type, or a record of such (fields).

    test is a boolean as a where clause takes it, where null counts as false.
    """

    column: Column | None = None
    type: T.DataType | None = None
    fields: dict[str, Val] | None = None
    constant: object = field(default=..., compare=False)
    test: Column | None = field(default=None, compare=False)

    @property
    def kind(self) -> str:
        if self.fields is not None:
            return "object"
        return kind_of(self.type)

    def to_column(self) -> Column:
        if self.fields is None:
            return self.column
        return F.struct(*[v.to_column().alias(k) for k, v in self.fields.items()])

    def to_type(self) -> T.DataType:
        if self.fields is None:
            return self.type
        return T.StructType([T.StructField(k, v.to_type()) for k, v in self.fields.items()])


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    for cls, name in ((T.BooleanType, "boolean"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"), (T.NullType, "null"), (T.VariantType, "variant"), (T.DatetimeType, "date")):
        if isinstance(t, cls):
            return name
    return "other"


DOUBLE, STRING, BOOLEAN, LONG, INT, VARIANT = T.DoubleType(), T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType(), T.VariantType()


def tested(c: Column) -> Val:
    """A comparison that is null where it doesn't hold for a null."""
    return Val(F.coalesce(c, F.lit(False)), BOOLEAN, test=c)


def number(c: Column) -> Val:
    return Val(c, DOUBLE)


def of_column(c: Column, t: T.DataType) -> Val:
    """A column as a value; structs open up, dates read as ISO-8601 text."""
    if isinstance(t, T.StructType):
        return Val(fields={f.name: of_column(c.getField(f.name), f.dataType) for f in t.fields}, column=c, type=t)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Val(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING)
    if isinstance(t, T.DateType):
        return Val(F.date_format(c, "yyyy-MM-dd"), STRING)
    return Val(c, t)


def literal(v: object) -> Val:
    if v is None:
        return Val(F.lit(None), T.NullType(), constant=None)
    if isinstance(v, bool):
        return Val(F.lit(v), BOOLEAN, constant=v)
    if isinstance(v, float):
        if v == int(v) if math.isfinite(v) else False:
            return Val(F.lit(int(v)), INT if abs(v) < 2**31 else LONG, constant=v)
        return Val(F.lit(v), DOUBLE, constant=v)
    return Val(F.lit(v), STRING, constant=v)


def truthy(v: Val) -> Column:
    if v.kind == "boolean":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "variant":
        return v.column.isNotNull() & ~F.is_variant_null(v.column) & F.coalesce(F.try_variant_get(v.column, "$", "boolean") | (F.schema_of_variant(v.column) != "BOOLEAN"), F.lit(True))
    if v.fields is not None:
        return v.column.isNotNull() if v.column is not None else F.lit(True)
    return v.column.isNotNull()


def condition(v: Val) -> Column:
    """truthy where null counts as false anyway (a where clause): plain, so that it can be pushed down."""
    if v.test is not None:
        return v.test
    return v.column if v.kind == "boolean" else truthy(v)


def as_number(v: Val, quiet: bool = False) -> Val:
    """The value as a number; unless quiet, the row fails where it is none."""
    if v.kind == "variant":
        made = number(F.when(_variant_is(v.column, "number"), F.try_variant_get(v.column, "$", "double")))
    elif v.kind == "number":
        made = v
    else:
        raise LoweringError(f"a number is needed, not {v.kind}")
    return made if quiet else needed(made, v, "is not a number")


def as_string(v: Val, quiet: bool = False) -> Val:
    if v.kind == "variant":
        made = Val(F.when(F.schema_of_variant(v.column) == "STRING", F.try_variant_get(v.column, "$", "string")), STRING)
    elif v.kind == "string":
        made = v
    else:
        raise LoweringError(f"a string is needed, not {v.kind}")
    return made if quiet else needed(made, v, "is not a string")


def needed(v: Val, given: Val | None = None, what: str = "") -> Val:
    """Note that the row fails where the value is null; what says how, if the message is '<what was given> <what>'."""
    if v.constant is ...:
        variant = given is not None and given.kind == "variant"
        shown = F.coalesce(F.to_json(given.column), F.lit("null")) if variant else F.lit("null")
        note(v.column.isNull(), "argument", F.concat(shown, F.lit(f" {what}")) if what else None, null=not variant)
    return v


#: Names that schema_of_variant has for numbers, beside decimals.
_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def is_number_type(s: Column) -> Column:
    return s.isin(*_NUMBERS) | s.startswith("DECIMAL")


def _variant_is(c: Column, kind: str) -> Column:
    s = F.schema_of_variant(c)
    return {"number": is_number_type(s), "array": s.startswith("ARRAY"), "object": s.startswith("OBJECT"), "string": s == "STRING", "boolean": s == "BOOLEAN", "null": s == "VOID"}[kind]


def as_array(v: Val, quiet: bool = False) -> Val:
    if v.kind == "variant":
        made = Val(F.try_variant_get(v.column, "$", "array<variant>"), T.ArrayType(VARIANT))
    elif v.kind == "object" and v.fields is not None:
        return array_of(list(v.fields.values()))
    elif v.kind == "array":
        made = v
    else:
        raise LoweringError(f"an array is needed, not {v.kind}")
    return made if quiet else needed(made, v, "is not an array")


def items_of(v: Val) -> Val:
    """The array of what .[] gives."""
    made = as_array(v, quiet=True)
    if made.column is not None and v.fields is None and v.constant is ...:
        variant = v.kind == "variant"
        shown = F.coalesce(F.to_json(v.column), F.lit("null")) if variant else F.lit("null")
        note(made.column.isNull(), "iterate", F.concat(F.lit("Cannot iterate over "), shown), null=not variant)
    return made


def common_type(vals: list[Val]) -> T.DataType:
    known = [v.to_type() for v in vals if v.kind != "null"]
    if not known:
        return T.NullType()
    first = known[0]
    if all(t == first for t in known):
        return first
    if all(isinstance(t, T.NumericType) for t in known):
        if all(isinstance(t, T.IntegralType) for t in known):
            return LONG
        return DOUBLE
    if all(isinstance(t, T.ArrayType) for t in known):
        return T.ArrayType(common_type([Val(None, t.elementType) for t in known]))
    raise LoweringError(f"types {first.simpleString()} and others have no common column type")


def cast(v: Val, t: T.DataType) -> Column:
    own = v.to_type()
    return v.to_column() if own == t else v.to_column().cast(t)


def array_of(vals: list[Val]) -> Val:
    t = common_type(vals)
    return Val(F.array(*[cast(v, t) for v in vals]), T.ArrayType(t))


def element(v: Val) -> T.DataType:
    return v.type.elementType


class Columns:
    """one(node, value, env) is the Val of a part with exactly one output; many(...) the array of all outputs of a part."""

    def __init__(self, tables: frozenset[str] = frozenset()) -> None:
        self.tables = tables
        self.depth = 0

    # -- exactly one output
    def one(self, node: A.Node, v: Val, env: dict) -> Val:
        rule = getattr(self, f"_{type(node).__name__.lower()}", None)
        if rule is None:
            raise LoweringError(f"{type(node).__name__} has no column form")
        return rule(node, v, env)

    def _identity(self, node, v, env):
        return v

    def _literal(self, node, v, env):
        return literal(node.value)

    def _variable(self, node, v, env):
        found = env.get(f"${node.name}")
        if not isinstance(found, Val):
            raise LoweringError(f"${node.name} is not a value of the row")
        return found

    def _pipe(self, node, v, env):
        left, right = node.left, node.right
        if isinstance(right, A.Call) and right.name == "fromjson":
            right = A.Pipe(right, A.Identity())
        text = self.one(left, v, env)
        if isinstance(right, A.Pipe) and right.left == A.Call("fromjson"):
            return self.parsed(as_string(text), right.right, env)
        return self.one(right, text, env)

    def parsed(self, text: Val, rest: A.Node, env: dict) -> Val:
        """JSON text read with the schema that what follows needs; else as VARIANT."""
        schema = to_ddl(DirectInference().infer(rest)[0])
        if schema.startswith("STRUCT"):
            t = T.DataType.fromDDL(schema)
            c = F.from_json(text.column, schema)
            return self.one(rest, of_column(c, t), env)
        return self.one(rest, Val(F.try_parse_json(text.column), VARIANT), env)

    def _index(self, node, v, env):
        target, key = self.one(node.target, v, env), self.one(node.key, v, env)
        if key.kind == "string":
            return self.field(target, key)
        if key.kind == "number":
            return self.item(target, key)
        raise LoweringError("the index is neither a string nor a number")

    def field(self, target: Val, key: Val) -> Val:
        if target.kind == "null":
            return literal(None)
        if target.fields is not None and isinstance(key.constant, str):
            found = target.fields.get(key.constant)
            return found if found is not None else literal(None)
        if target.kind == "variant":
            path = f"$[{_quoted(key.constant)}]" if isinstance(key.constant, str) else F.concat(F.lit('$["'), key.column, F.lit('"]'))
            return Val(F.try_variant_get(target.column, path, "variant"), VARIANT)
        if isinstance(target.type, T.MapType):
            return of_column(F.try_element_at(target.column, key.column), target.type.valueType)
        raise LoweringError(f"{target.kind} has no field")

    def item(self, target: Val, key: Val) -> Val:
        if target.kind == "null":
            return literal(None)
        arr = as_array(target, quiet=target.kind != "variant") if target.fields is None else target
        if arr.kind != "array":
            raise LoweringError(f"{target.kind} has no items")
        if isinstance(key.constant, float):
            if key.constant != int(key.constant):
                raise LoweringError("a fractional index is an error")
            at = F.lit(int(key.constant) + (key.constant >= 0))
        else:
            whole = F.when(key.column == F.floor(key.column), key.column.try_cast("int"))
            note(key.column != F.floor(key.column))
            needed(key)
            at = F.when(whole >= 0, whole + 1).otherwise(whole)
        found = F.when(at.isNotNull() & (at != 0), F.try_element_at(arr.column, at)) if key.constant is ... else F.try_element_at(arr.column, at)
        return of_column(found, element(arr))

    def _slice(self, node, v, env):
        target = self.one(node.target, v, env)
        low = self.one(node.low, v, env) if node.low else literal(0.0)
        high = self.one(node.high, v, env) if node.high else None
        if target.kind == "string":
            n = F.char_length(target.column)
        else:
            target = as_array(target, quiet=target.kind != "variant")
            n = F.size(target.column)
        clamp = lambda c: F.when(c < 0, F.greatest(F.lit(0), c + n)).otherwise(F.least(c, n))
        # A null bound is an open one.
        start = F.coalesce(clamp(F.floor(as_number(low, True).column).try_cast("int")), F.lit(0)) if low.kind != "null" else F.lit(0)
        end = F.coalesce(clamp(F.ceil(as_number(high, True).column).try_cast("int")), n) if high and high.kind != "null" else n
        size = F.greatest(F.lit(0), end - start)
        if target.kind == "string":
            return Val(F.substring(target.column, start + 1, size), STRING)
        return Val(F.slice(target.column, start + 1, size), target.type)

    def _objectof(self, node, v, env):
        fields = {}
        for key, value in node.entries:
            k = self.one(key, v, env)
            if not isinstance(k.constant, str):
                if len(node.entries) == 1 and k.kind == "string":
                    x = self.one(value, v, env)
                    return Val(F.create_map(k.column, x.to_column()), T.MapType(STRING, x.to_type()))
                raise LoweringError("a computed key among others has no column type")
            fields[k.constant] = self.one(value, v, env)
        return Val(fields=fields)

    def _arrayof(self, node, v, env):
        return self.many(node.body, v, env) if node.body else Val(F.array(), T.ArrayType(T.NullType()))

    def _negate(self, node, v, env):
        x = as_number(self.one(node.body, v, env), quiet=True)
        if x.constant is ...:
            note(x.column.isNull(), "operand", F.lit("null cannot be negated"), null=True)
        return Val(-x.column, x.type)

    def _template(self, node, v, env):
        if node.fmt not in (None, "@text"):
            raise LoweringError(f"{node.fmt} has no column form here")
        return Val(F.concat(*[F.lit(p) if isinstance(p, str) else self.tostring(self.one(p, v, env)).column for p in node.parts]), STRING)

    def _format(self, node, v, env):
        if node.name == "@text":
            return self.tostring(v)
        if node.name == "@json":
            return Val(self.tojson(v), STRING)
        if node.name == "@base64":
            return Val(F.base64(self.tostring(v).column.cast("binary")), STRING)
        if node.name == "@uri":
            return Val(F.replace(F.url_encode(self.tostring(v).column), F.lit("+"), F.lit("%20")), STRING)
        raise LoweringError(f"{node.name} has no column form")

    def tojson(self, v: Val) -> Column:
        kind = v.kind
        if kind == "string":
            return F.coalesce(F.to_json(v.column.cast("variant")), F.lit("null"))
        if kind == "null":
            return F.lit("null")
        return F.coalesce(self.tostring(v).column, F.lit("null"))

    def tostring(self, v: Val) -> Val:
        kind = v.kind
        if kind == "string":
            return Val(F.coalesce(v.column, F.lit("null")), STRING)
        if kind == "number":
            if isinstance(v.type, T.IntegralType):
                text = v.column.cast("string")
            else:
                d = v.column.cast("double")
                text = F.when((d == F.floor(d)) & (F.abs(d) < 1e17), d.cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))
            return Val(F.coalesce(text, F.lit("null")), STRING)
        if kind == "boolean":
            return Val(F.coalesce(v.column.cast("string"), F.lit("null")), STRING)
        if kind == "null":
            return Val(F.lit("null"), STRING)
        if kind == "variant":
            return Val(F.when(F.schema_of_variant(v.column) == "STRING", F.try_variant_get(v.column, "$", "string")).otherwise(F.to_json(v.column)), STRING)
        if _has_fractions(v.to_type()):
            raise LoweringError("JSON text prints whole numbers without a fraction")
        return Val(F.to_json(v.to_column(), {"ignoreNullFields": "false"}), STRING)

    def _binary(self, node, v, env):
        a, b = self.one(node.left, v, env), self.one(node.right, v, env)
        if node.op in ("==", "!=", "<", "<=", ">", ">="):
            return self.compare(node.op, a, b)
        return self.compute(node.op, a, b)

    def compute(self, op: str, a: Val, b: Val) -> Val:
        if op == "+":
            for x, y in ((a, b), (b, a)):
                if x.kind == "null":
                    return y
            if a.kind == "variant" or b.kind == "variant":
                other = b if a.kind == "variant" else a
                a, b = (as_string(x) if other.kind == "string" else as_number(x) for x in (a, b))
            if a.kind != b.kind:
                raise LoweringError(f"{a.kind} and {b.kind} cannot be added")
            if a.kind == "number":
                t = LONG if isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType) else DOUBLE
                x, y = cast(a, t), cast(b, t)
                null_free = a.constant is not ..., b.constant is not ...
                if t == LONG and T.LongType() in (a.type, b.type):
                    total = F.try_add(x, y)
                    return Val(total if all(null_free) else F.when(x.isNull(), y).when(y.isNull(), x).otherwise(total), t)
                return Val(x + y if all(null_free) else F.coalesce(x + y, *[c for c, free in ((y, null_free[1]), (x, null_free[0])) if free] or [x, y]), t)
            if a.kind == "string":
                return Val(F.coalesce(F.concat(a.column, b.column), a.column, b.column), STRING)
            if a.kind == "array":
                t = common_type([Val(None, element(a)), Val(None, element(b))])
                x, y = a.column.cast(T.ArrayType(t)), b.column.cast(T.ArrayType(t))
                return Val(F.coalesce(F.concat(x, y), x, y), T.ArrayType(t))
            if a.fields is not None and b.fields is not None:
                return Val(fields=a.fields | b.fields)
            raise LoweringError(f"{a.kind} cannot be added here")
        if op == "-" and a.kind == "array" and b.kind == "array":
            needed(a)
            needed(b)
            return Val(F.filter(a.column, lambda x: ~F.exists(b.column, lambda y: x.eqNullSafe(y))), a.type)
        if op == "*":
            for x, y in ((a, b), (b, a)):
                if x.kind == "string" and y.kind == "number":
                    needed(x)
                    needed(y)
                    n = y.column.try_cast("int")
                    return Val(F.when(y.column >= 0, F.repeat(x.column, n)), STRING)
                if x.kind == "array" and y.kind == "number" and x is a:
                    needed(x)
                    needed(y)
                    n = F.when(F.size(x.column) == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), y.column.try_cast("int")))
                    cycle = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x.column, i % F.size(x.column)))
                    return Val(F.when(n > 0, cycle).otherwise(F.array().cast(x.type)), x.type)
        if op == "*" and "variant" in (a.kind, b.kind):
            raise LoweringError("a number repeats text, so the kind of both sides must be known")
        variant = "variant" in (a.kind, b.kind)
        shown = [self.shown(x) for x in (a, b)]
        a, b = as_number(a, quiet=True), as_number(b, quiet=True)
        nulls = [x.column.isNull() for x in (a, b) if x.constant is ...]
        if nulls:
            verb = {"-": "subtracted", "*": "multiplied", "/": "divided", "%": "divided (remainder)"}[op]
            message = F.concat(shown[0], F.lit(" and "), shown[1], F.lit(f" cannot be {verb}"))
            note(nulls[0] if len(nulls) == 1 else nulls[0] | nulls[1], "operands", message, null=not variant)
        integral = isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType)
        if op in ("-", "*"):
            t = LONG if integral else DOUBLE
            if integral and T.LongType() in (a.type, b.type):  # a sum beyond 64 bits is null and ends no job
                return Val((F.try_subtract if op == "-" else F.try_multiply)(cast(a, t), cast(b, t)), t)
            return Val(cast(a, t) - cast(b, t) if op == "-" else cast(a, t) * cast(b, t), t)
        x, y = cast(a, DOUBLE), cast(b, DOUBLE)
        if op == "/":
            if isinstance(b.constant, float) and b.constant:
                return number(x / y)
            by_zero = F.when(x == 0, F.lit(math.nan)).when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf))
            return number(F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y)))
        if isinstance(b.constant, float) and b.constant:
            return Val(cast(a, LONG) % cast(b, LONG), LONG) if integral else number(x % y)
        return number(F.when(y == 0, F.lit(math.nan)).otherwise(x % F.when(y != 0, y)))

    def shown(self, v: Val) -> Column:
        """The value as messages show it."""
        if v.kind == "variant":
            return F.coalesce(F.to_json(v.column), F.lit("null"))
        return self.tojson(v)

    def compare(self, op: str, a: Val, b: Val) -> Val:
        if a.kind == "variant" or b.kind == "variant":
            other = b if a.kind == "variant" else a
            if other.kind not in ("number", "string"):
                if op in ("==", "!=") and other.kind == "null":
                    v = a if a.kind == "variant" else b
                    same = v.column.isNull() | F.is_variant_null(v.column)
                    return Val(same if op == "==" else ~same, BOOLEAN)
                raise LoweringError("variants are compared with numbers and strings only")
            if op not in ("==", "!="):
                return self.ordered_variant(op, a, b)
            if other.constant is not ...:
                same = F.coalesce(self.compare("==", *((as_string(x, True) if other.kind == "string" else as_number(x, True)) for x in (a, b))).column, F.lit(False))
                return Val(same if op == "==" else ~same, BOOLEAN)
            a, b = (as_string(x, True) if other.kind == "string" else as_number(x, True) for x in (a, b))
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            is_null = F.lit(True) if other.kind == "null" else ~truthy(other) if other.fields is not None else other.column.isNull()
            flip = a.kind == "null"
            made = {"==": is_null, "!=": ~is_null, "<=": F.lit(True) if flip else is_null, ">=": is_null if flip else F.lit(True), "<": ~is_null if flip else F.lit(False), ">": F.lit(False) if flip else ~is_null}
            return Val(made[op], BOOLEAN)
        if a.kind != b.kind:
            rank = ("null", "boolean", "number", "string", "array", "object")
            if a.kind not in rank or b.kind not in rank or a.constant is ... and b.constant is ...:
                raise LoweringError(f"{a.kind} and {b.kind} are compared by the total order")
            raise LoweringError("constants of another kind are compared by the total order")
        if a.kind == "object" or a.kind == "array" and op not in ("==", "!="):
            raise LoweringError("containers are compared by the total order")
        x, y = a.to_column(), b.to_column()
        if op in ("==", "!="):
            sure = a.constant is not ... or b.constant is not ...
            same = x == y if sure else x.eqNullSafe(y)
            for v in (a, b):
                if isinstance(v.type, (T.DoubleType, T.FloatType)) and v.constant is ... and not sure:
                    same = same & ~F.isnan(F.coalesce(v.column, F.lit(0.0)))
            if op == "==":
                return tested(same)
            return Val(~same if not sure else F.coalesce(x != y, F.lit(True)), BOOLEAN)
        if op in (">", ">="):
            low, high, strict = (b, a, op == ">")
        else:
            low, high, strict = (a, b, op == "<")
        # low < high, with null below everything and NaN right above null
        l, h = low.column, high.column
        made = l < h if strict else l <= h
        for v, is_high in ((high, True), (low, False)):
            if isinstance(v.type, (T.DoubleType, T.FloatType)) and v.constant is ...:
                made = made & ~F.isnan(v.column) if is_high else made | F.isnan(v.column)
        if low.constant is ...:
            made = made | (l.isNull() & (h.isNotNull() if strict else F.lit(True)))
        return tested(made)

    def ordered_variant(self, op: str, a: Val, b: Val) -> Val:
        """A variant against a number or string constant: by value within its kind, else by the order of kinds."""
        if b.kind == "variant":
            op, a, b = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op], b, a
        if b.constant is ...:
            raise LoweringError("two columns of unknown kinds are compared by the total order")
        own = as_string(a, True) if b.kind == "string" else as_number(a, True)
        by_value = self.compare(op, own, b).column
        kind = F.coalesce(F.schema_of_variant(a.column), F.lit("VOID"))
        lower = ["VOID", "BOOLEAN"] if b.kind == "number" else None
        is_lower = kind.isin(*lower) if lower else kind.isin("VOID", "BOOLEAN") | F.coalesce(_variant_is(a.column, "number"), F.lit(False))
        return Val(F.when(own.column.isNotNull(), by_value).otherwise(is_lower if op in ("<", "<=") else ~is_lower), BOOLEAN)

    def _logic(self, node, v, env):
        a = self.one(node.left, v, env)
        with guarded():
            b = self.one(node.right, v, env)
        x, y = condition(a), condition(b)
        # Null counts as false: AND and OR of three-valued logic agree with that under a where.
        return tested(x & y if node.op == "and" else x | y)

    def _alternative(self, node, v, env):
        with guarded():
            a = self.one(node.left, v, env)
            b = self.one(node.right, v, env)
        if a.kind == "null":
            return b
        if a.kind == "variant":
            other = b.column if b.kind == "variant" else b.to_column().cast("variant")
            return Val(F.when(truthy(a), a.column).otherwise(other), VARIANT)
        t = common_type([a, b])
        if a.kind == "boolean":
            return Val(F.when(truthy(a), a.column).otherwise(cast(b, t)), t)
        return Val(F.coalesce(cast(a, t), cast(b, t)), t)

    def _if(self, node, v, env):
        test = self.one(node.condition, v, env)
        with guarded():
            a, b = self.one(node.then, v, env), self.one(node.otherwise, v, env)
        if a.fields is not None and b.fields is not None and a.fields.keys() == b.fields.keys():
            return Val(fields={k: self.choose(test, a.fields[k], b.fields[k]) for k in a.fields})
        return self.choose(test, a, b)

    def choose(self, test: Val, a: Val, b: Val) -> Val:
        t = common_type([a, b])
        return Val(F.when(truthy(test), cast(a, t)).otherwise(cast(b, t)), t)

    def _bind(self, node, v, env):
        x = self.one(node.source, v, env)
        return self.one(node.body, v, env | self.bound(node.patterns[0], x, env))

    def bound(self, pattern: A.Pattern, x: Val, env: dict) -> dict:
        if pattern.kind == "var":
            return {f"${pattern.name}": x}
        out: dict = {}
        if pattern.kind == "array":
            for i, p in enumerate(pattern.items):
                out |= self.bound(p, self.item(x, literal(float(i))), env)
        else:
            for key, variable, inner in pattern.items:
                found = self.field(x, self.one(key, x, env))
                out |= ({f"${variable}": found} if variable else {}) | (self.bound(inner, found, env) if inner else {})
        return out

    def _reduce(self, node, v, env):
        items = self.many(node.source, v, env)
        start = self.one(node.init, v, env)
        if node.pattern.kind != "var" or start.kind not in ("number", "string", "boolean"):
            raise LoweringError("this reduce has no aggregate form")
        t = DOUBLE if start.kind == "number" else start.type
        step = lambda acc, x: cast(self.one(node.update, Val(acc, t), env | {f"${node.pattern.name}": of_column(x, element(items))}), t)
        return Val(fold(items.column, cast(start, t), step), t)

    def _assign(self, node, v, env):
        """Assignment to a path of constant fields and iterations."""
        path = self.steps(node.target, env)
        new = None if node.op == "|=" else self.one(node.value, v, env)

        def change(old: Val) -> Val:
            if node.op == "=":
                return new
            if node.op == "|=":
                return self.one(node.value, old, env)
            if node.op == "//=":
                return self.choose(Val(truthy(old), BOOLEAN), old, new) if old.kind != "null" else new
            return self.compute(node.op[:-1], old, new)

        return self.updated(v, path, change)

    def steps(self, node: A.Node, env: dict) -> list:
        match node:
            case A.Identity():
                return []
            case A.Index(target, A.Literal(str(k))):
                return [*self.steps(target, env), k]
            case A.Iterate(target):
                return [*self.steps(target, env), None]
            case A.Pipe(a, b):
                return self.steps(a, env) + self.steps(b, env)
        raise LoweringError("this path is left to the interpreter")

    def updated(self, v: Val, path: list, change) -> Val:
        if not path:
            return change(v)
        key, rest = path[0], path[1:]
        if key is None:
            items, types = items_of(v), []

            def item(x: Column) -> Column:
                out = self.updated(of_column(x, element(items)), rest, change)
                types.append(T.ArrayType(out.to_type()))
                return out.to_column()

            return Val(each(F.transform, items.column, item), types[0])
        if v.fields is None:
            raise LoweringError(f"{v.kind} has no field to assign")
        if v.column is not None:
            note(v.column.isNull(), null=True)
        return Val(fields=v.fields | {key: self.updated(v.fields.get(key, literal(None)), rest, change)})

    def _try(self, node, v, env):
        if node.handler is not None:
            raise LoweringError("a handler needs the error's value")
        with guarded():
            return self.one(node.body, v, env)

    def _define(self, node, v, env):
        return self.one(node.rest, v, env | {(node.name, len(node.params)): (node.params, node.body, env)})

    def _call(self, node, v, env):
        found = env.get((node.name, len(node.args)))
        if found is not None:
            return self.called(node, found, env, lambda body, inner: self.one(body, v, inner))
        from .column_functions import FUNCTIONS

        rule = FUNCTIONS.get((node.name, len(node.args)))
        if rule is None:
            raise LoweringError(f"{node.name}/{len(node.args)} has no column form")
        return rule(self, v, env, *node.args)

    def called(self, node: A.Call, found: tuple, env: dict, then):
        """Inline a definition; arguments keep the scope they were written in."""
        params, body, its = found
        if params == "argument":
            return then(body, its)
        inner = its | {(node.name, len(node.args)): found}
        for p, a in zip(params, node.args):
            inner = inner | {(p.removeprefix("$"), 0): ("argument", a, env)}
            if p.startswith("$"):
                raise LoweringError("$parameters are left to the interpreter")
        self.depth += 1
        if self.depth > 20:
            self.depth = 0
            raise LoweringError(f"{node.name} is recursive")
        try:
            return then(body, inner)
        finally:
            self.depth -= 1

    # -- all outputs as an array
    def many(self, node: A.Node, v: Val, env: dict) -> Val:
        match node:
            case A.Comma(a, b):
                x, y = self.many(a, v, env), self.many(b, v, env)
                t = common_type([Val(None, element(x)), Val(None, element(y))])
                return Val(F.concat(x.column.cast(T.ArrayType(t)), y.column.cast(T.ArrayType(t))), T.ArrayType(t))
            case A.Iterate(target):
                return items_of(self.one(target, v, env))
            case A.Pipe(a, b):
                if self.is_many(a, env) or self.is_many(b, env):
                    left = self.many(a, v, env)
                    return self.mapped(left, b, env)
            case A.Call("select", (test,)):
                keep = truthy(self.one(test, v, env))
                t = T.ArrayType(v.to_type())
                return Val(F.when(keep, F.array(v.to_column())).otherwise(F.array().cast(t)), t)
            case A.Call("empty", ()):
                return Val(F.array(), T.ArrayType(T.NullType()))
            case A.Call("first" | "last" as name, (f,)):
                items = self.many(f, v, env)
                return Val(F.slice(items.column, 1, 1) if name == "first" else F.slice(F.reverse(items.column), 1, 1), items.type)
            case A.Call("limit" | "skip" | "nth" as name, (n, f)):
                items, k = self.many(f, v, env), self.one(n, v, env).constant
                if not isinstance(k, float) or k < 0 or k != int(k):
                    raise LoweringError("the number of outputs must be a whole constant")
                bounds = {"limit": (F.lit(1), F.lit(int(k))), "skip": (F.lit(int(k) + 1), F.size(items.column)), "nth": (F.lit(int(k) + 1), F.lit(1))}
                return Val(F.slice(items.column, *bounds[name]), items.type)
            case A.Call("scan" | "splits" as name, (A.Literal(str(pattern)),)):
                if name == "scan" and re.search(r"(?<!\\)\((?!\?[:=!<])", pattern):
                    raise LoweringError("matches with groups are left to the interpreter")
                s = as_string(v).column
                java_pattern(pattern)
                return Val(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)) if name == "scan" else F.split(s, pattern), T.ArrayType(STRING))
            case A.Foreach(source, pattern, init, update, extract) if pattern.kind == "var":
                return self.running(self.many(source, v, env), pattern.name, self.one(init, v, env), update, extract, env)
            case A.Binary(op, a, b) if self.is_many(node, env):
                left, right = self.many(a, v, env), self.many(b, v, env)
                made: list = []
                do = self.compute if op in "+-*/%" else self.compare

                def pair(x: Column, y: Column) -> Column:
                    out = do(op, of_column(x, element(left)), of_column(y, element(right)))
                    made.append(T.ArrayType(out.type))
                    return out.column

                pairs = each(F.transform, left.column, lambda x: each(F.transform, right.column, lambda y: pair(x, y)))
                return Val(F.flatten(pairs), made[0])
            case A.Call("range", args) if len(args) <= 2:
                low = cast(as_number(self.one(args[0], v, env)), LONG) if len(args) == 2 else F.lit(0).cast("long")
                high = F.ceil(as_number(self.one(args[-1], v, env)).column).cast("long")
                return Val(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))
            case A.Bind(source, patterns, body) if not self.is_many(source, env):
                x = self.one(source, v, env)
                return self.many(body, v, env | self.bound(patterns[0], x, env))
            case A.Bind(source, patterns, body):
                items = self.many(source, v, env)
                kinds: list = []
                made = each(F.transform, items.column, lambda x: self._noted(kinds, self.many(body, v, env | self.bound(patterns[0], of_column(x, element(items)), env))))
                return Val(F.flatten(made), kinds[0])
            case A.If(test, a, b) if self.is_many(a, env) or self.is_many(b, env):
                with guarded():
                    x, y = self.many(a, v, env), self.many(b, v, env)
                t = T.ArrayType(common_type([Val(None, element(x)), Val(None, element(y))]))
                return Val(F.when(truthy(self.one(test, v, env)), x.column.cast(t)).otherwise(y.column.cast(t)), t)
            case A.Define(name, params, body, rest):
                return self.many(rest, v, env | {(name, len(params)): (params, body, env)})
            case A.Call(name, args) if (name, len(args)) in env:
                return self.called(node, env[name, len(args)], env, lambda body, inner: self.many(body, v, inner))
        return array_of([self.one(node, v, env)])

    def running(self, items: Val, name: str, start: Val, update: A.Node, extract: A.Node, env: dict) -> Val:
        """foreach: an aggregate that carries the state and the array of outputs so far."""
        if start.kind not in ("number", "string", "boolean"):
            raise LoweringError("this foreach has no aggregate form")
        t = DOUBLE if start.kind == "number" else start.type
        bound = lambda x: env | {f"${name}": of_column(x, element(items))}
        with collecting():  # for the type alone
            sample = self.one(extract, Val(F.lit(None).cast(t), t), bound(F.lit(None).cast(element(items)))).to_type()

        def step(acc: Column, x: Column) -> Column:
            state = cast(self.one(update, Val(acc["s"], t), bound(x)), t)
            out = self.one(extract, Val(state, t), bound(x)).to_column().cast(sample)
            return F.struct(state.alias("s"), F.concat(acc["o"], F.array(out)).alias("o"))

        empty = F.struct(cast(start, t).alias("s"), F.array().cast(T.ArrayType(sample)).alias("o"))
        return Val(fold(items.column, empty, step, lambda acc: acc["o"]), T.ArrayType(sample))

    @staticmethod
    def _noted(types: list, v: Val) -> Column:
        types.append(v.type)
        return v.column

    def mapped(self, items: Val, f: A.Node, env: dict) -> Val:
        """All outputs of f for every item."""
        t = element(items)
        if isinstance(f, A.Call) and f.name == "select" and len(f.args) == 1:
            return Val(each(F.filter, items.column, lambda x: truthy(self.one(f.args[0], of_column(x, t), env))), items.type)
        if isinstance(f, A.Pipe) and self.is_many(f, env):
            return self.mapped(self.mapped(items, f.left, env), f.right, env)
        types: list = []
        if self.is_many(f, env):
            made = each(F.transform, items.column, lambda x: self._noted(types, self.many(f, of_column(x, t), env)))
            return Val(F.flatten(made), types[0])

        def single(x: Column) -> Column:
            out = self.one(f, of_column(x, t), env)
            types.append(T.ArrayType(out.to_type()))
            return out.to_column()

        made = each(F.transform, items.column, single)
        return Val(made, types[0])

    def is_many(self, node: A.Node, env: dict) -> bool:
        """Whether a part may have other than one output."""
        match node:
            case A.Comma() | A.Iterate() | A.RecurseAll() | A.Call("select" | "empty" | "range" | "limit" | "skip" | "scan" | "splits" | "match" | "recurse" | "while" | "until" | "repeat", _) | A.Call("nth", (_, _)):
                return True
            case A.Call("first" | "last", (_,)):
                return True
            case A.Foreach():
                return True
            case A.ArrayOf() | A.Literal() | A.Reduce() | A.Assign():
                return False
            case A.Call(name, args) if (name, len(args)) in env:
                params, body, its = env[name, len(args)]
                self.depth += 1
                if self.depth > 20:
                    self.depth = 0
                    raise LoweringError(f"{name} is recursive")
                try:
                    return self.is_many(body, its)
                finally:
                    self.depth -= 1
            case A.Call():
                return False
            case A.Define(name, params, body, rest):
                return self.is_many(rest, env | {(name, len(params)): (params, body, env)})
        return any(self.is_many(c, env) for c in node.children())


def java_pattern(pattern: str) -> str:
    """The expression, if Spark can compile it: a bad one is refused while planning instead of ending the job."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException):
            raise LoweringError(f"{pattern} is no regular expression here") from None
    return pattern


def _has_fractions(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_fractions(f.dataType) for f in t.fields)
    if isinstance(t, T.MapType):
        return _has_fractions(t.valueType)
    if isinstance(t, T.ArrayType):
        return _has_fractions(t.elementType)
    return isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))


def _quoted(key: str) -> str:
    return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'


def regex_literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
