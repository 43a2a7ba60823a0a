"""Column forms of builtins: (name, arity) -> rule(columns, input, env, argument nodes)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import CYCLE, DATES, YEARS
from ..lang import ast as A
from .columns import BOOLEAN, DOUBLE, LONG, STRING, VARIANT, Columns, LoweringError, Val, array_of, as_array, as_number, as_string, cast, common_type, element, items_of, java_pattern, literal, needed, number, of_column, regex_literal, truthy
from .failures import collecting, each, note

FUNCTIONS: dict = {}


def rule(*names: str):
    def put(f):
        for name in names:
            base, _, arity = name.partition("/")
            FUNCTIONS[base, int(arity or 0)] = f
        return f

    return put


@rule("not")
def _not(cols, v, env):
    return Val(~truthy(v), BOOLEAN)


@rule("debug")
def _debug(cols, v, env):
    return v


# -- types
_NAMES = {"other": "object", "date": "string"}


def _variant_type(c: Column) -> Column:
    s = F.schema_of_variant(c)
    out = F.when(c.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
    return out.otherwise("number")


@rule("type")
def _type(cols, v, env):
    if v.kind == "variant":
        return Val(_variant_type(v.column), STRING)
    name = F.lit(_NAMES.get(v.kind, v.kind))
    if v.column is None or v.constant is not ... and v.constant is not None:
        return Val(name, STRING)
    return Val(F.when(v.column.isNull(), "null").otherwise(name), STRING)


for _name in ("null", "boolean", "number", "string", "array", "object"):
    FUNCTIONS[f"is{_name}", 0] = lambda cols, v, env, n=_name: Val(_type(cols, v, env).column == n, BOOLEAN)


# -- numbers
def _maths(name: str, f) -> None:
    FUNCTIONS[name, 0] = lambda cols, v, env: f(as_number(v))


def _double(f):
    return lambda v: number(f(cast(v, DOUBLE)))




def _integral(f):
    """Rounding; doubles from 2^52 on are whole, and beyond what a long holds."""

    def rounded(v):
        if isinstance(v.type, T.IntegralType):
            return v
        x = cast(v, DOUBLE)
        return number(F.when(F.abs(x) < 2.0**52, f(x).cast("double")).otherwise(x))

    return rounded


_rounded = lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))
for _name, _f in {
    "floor": _integral(F.floor), "ceil": _integral(F.ceil), "trunc": _integral(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))), "round": _integral(_rounded),
    "sqrt": _double(F.sqrt), "exp": _double(F.exp), "log": _double(F.ln), "log2": _double(F.log2), "log10": _double(F.log10), "sin": _double(F.sin), "cos": _double(F.cos),
    "exp2": _double(lambda x: F.pow(F.lit(2.0), x)), "exp10": _double(lambda x: F.pow(F.lit(10.0), x)), "pow10": _double(lambda x: F.pow(F.lit(10.0), x)), "tan": _double(F.tan), "cbrt": _double(F.cbrt),
    "logb": _double(lambda x: F.floor(F.log2(F.abs(x))).cast("double")), "significand": _double(lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))))),
    "abs": lambda v: Val(F.abs(v.column), v.type), "fabs": lambda v: Val(F.abs(v.column), v.type), "negate": lambda v: Val(-v.column, v.type),
}.items():
    _maths(_name, _f)

_maths("isnan", lambda v: Val(F.isnan(cast(v, DOUBLE)), BOOLEAN))
_maths("isinfinite", lambda v: Val(F.abs(cast(v, DOUBLE)) == math.inf, BOOLEAN))
_maths("isfinite", lambda v: Val(F.abs(cast(v, DOUBLE)) != math.inf, BOOLEAN))
_maths("isnormal", lambda v: Val((F.abs(cast(v, DOUBLE)) != math.inf) & ~F.isnan(cast(v, DOUBLE)) & (F.abs(cast(v, DOUBLE)) >= 2.2250738585072014e-308), BOOLEAN))
FUNCTIONS["nan", 0] = lambda cols, v, env: number(F.lit(math.nan))
FUNCTIONS["infinite", 0] = lambda cols, v, env: number(F.lit(math.inf))


@rule("pow/2")
def _pow(cols, v, env, x, y):
    return number(F.pow(cast(as_number(cols.one(x, v, env)), DOUBLE), cast(as_number(cols.one(y, v, env)), DOUBLE)))


@rule("scalb/2", "ldexp/2", "scalbln/2")
def _scalb(cols, v, env, x, e):
    return number(cast(as_number(cols.one(x, v, env)), DOUBLE) * F.pow(F.lit(2.0), cast(as_number(cols.one(e, v, env)), DOUBLE)))


@rule("tonumber")
def _tonumber(cols, v, env):
    if v.kind == "number":
        return v
    text = as_string(v, quiet=True).column
    well = F.coalesce(text.rlike(r"^\s*-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.lit(False))
    note(~well, "argument", F.concat(cols.shown(v), F.lit(" cannot be parsed as a number")), null=False)
    return number(F.when(well, text.try_cast("double")))


# -- strings
@rule("tostring")
def _tostring(cols, v, env):
    return cols.tostring(v)


@rule("tojson")
def _tojson(cols, v, env):
    return Val(cols.tojson(v), STRING)


@rule("fromjson")
def _fromjson(cols, v, env):
    parsed = F.try_parse_json(as_string(v).column)
    note(parsed.isNull())
    return Val(parsed, VARIANT)


FUNCTIONS["ascii_upcase", 0] = lambda cols, v, env: Val(F.translate(as_string(v).column, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), STRING)
FUNCTIONS["ascii_downcase", 0] = lambda cols, v, env: Val(F.translate(as_string(v).column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), STRING)


def _with_text(f):
    def run(cols, v, env, arg):
        return f(as_string(v).column, as_string(cols.one(arg, v, env)).column)

    return run


def _stripped(f):
    """What isn't text stays as it is."""

    def run(cols, v, env, arg):
        return f(as_string(v, quiet=True).column, as_string(cols.one(arg, v, env), quiet=True).column)

    return run


FUNCTIONS["startswith", 1] = _with_text(lambda s, p: Val(s.startswith(p), BOOLEAN))
FUNCTIONS["endswith", 1] = _with_text(lambda s, p: Val(s.endswith(p), BOOLEAN))
FUNCTIONS["ltrimstr", 1] = _stripped(lambda s, p: Val(F.when(s.startswith(p), F.substring(s, F.char_length(p) + 1, F.char_length(s))).otherwise(s), STRING))
FUNCTIONS["rtrimstr", 1] = _stripped(lambda s, p: Val(F.when(s.endswith(p), F.substring(s, F.lit(1), F.char_length(s) - F.char_length(p))).otherwise(s), STRING))


@rule("split/1")
def _split(cols, v, env, sep):
    s, p = as_string(v, quiet=v.kind == "string").column, cols.one(sep, v, env)
    if not isinstance(p.constant, str):
        raise LoweringError("the separator must be a constant")
    return Val(F.when(s.isNull() | (s == ""), F.array().cast("array<string>")).otherwise(F.split(s, regex_literal(p.constant))), T.ArrayType(STRING))


def _regex(cols, v, env, args) -> tuple[str, bool]:
    """Java form of a constant expression with its flags, and whether g is among them."""
    found = [cols.one(a, v, env).constant for a in args]
    if not all(isinstance(x, str) or x is None for x in found):
        raise LoweringError("the expression must be a constant")
    flags = (found[1] if len(found) > 1 else "") or ""
    own = "".join({"i": "iu", "x": "x", "s": "s"}.get(c, "") for c in flags)
    return java_pattern((f"(?{own})" if own else "") + found[0]), "g" in flags


@rule("split/2")
def _split2(cols, v, env, re_, flags):
    return Val(F.split(as_string(v).column, _regex(cols, v, env, (re_, flags))[0]), T.ArrayType(STRING))


@rule("test/1", "test/2")
def _test(cols, v, env, *args):
    return Val(as_string(v).column.rlike(_regex(cols, v, env, args)[0]), BOOLEAN)


@rule("gsub/2", "gsub/3")
def _gsub(cols, v, env, re_, new, *flags):
    text = cols.one(new, v, env) if isinstance(new, A.Literal) else None
    if text is None or not isinstance(text.constant, str):
        raise LoweringError("a replacement that depends on the match is left to the interpreter")
    return Val(F.regexp_replace(as_string(v).column, F.lit(_regex(cols, v, env, (re_, *flags))[0]), F.lit(text.constant.replace("\\", "\\\\").replace("$", "\\$"))), STRING)


@rule("sub/2", "sub/3")
def _sub(cols, v, env, re_, new, *flags):
    text = cols.one(new, v, env) if isinstance(new, A.Literal) else None
    pattern, every = _regex(cols, v, env, (re_, *flags))
    if text is None or not isinstance(text.constant, str) or every or "(" in pattern.removeprefix("(?iu)"):
        raise LoweringError("this replacement is left to the interpreter")
    return Val(F.regexp_replace(as_string(v).column, F.lit(f"(?s)^(.*?)(?:{pattern})(.*)$"), F.lit("$1" + text.constant.replace("\\", "\\\\").replace("$", "\\$") + "$2")), STRING)


@rule("capture/1", "capture/2")
def _capture(cols, v, env, *args):
    import re

    pattern, every = _regex(cols, v, env, args)
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    if every or not names:
        raise LoweringError("this capture is left to the interpreter")
    s = as_string(v).column
    note(~F.coalesce(s.rlike(pattern), F.lit(False)))  # no match, no output
    groups = {m: i for i, m in enumerate(re.findall(r"\((?!\?[^<]|\?<[=!])(?:\?<(\w+)>)?", pattern), 1)}
    return Val(fields={n: Val(F.when(s.rlike(pattern), F.regexp_extract(s, pattern, groups[n])), STRING) for n in names})


@rule("join/1")
def _join(cols, v, env, sep):
    items = as_array(v)
    texts = items.column if isinstance(element(items), T.StringType) else F.transform(items.column, lambda x: F.when(x.isNotNull(), cols.tostring(of_column(x, element(items))).column))
    return Val(F.array_join(texts, as_string(cols.one(sep, v, env)).constant, ""), STRING)


@rule("explode")
def _explode(cols, v, env):
    letters = F.filter(F.split(as_string(v).column, ""), lambda c: c != "")
    return Val(F.transform(letters, lambda c: F.ascii(c).cast("long")), T.ArrayType(LONG))


# -- containers
@rule("length")
def _length(cols, v, env):
    if v.kind == "string":
        return Val(F.coalesce(F.char_length(v.column).cast("long"), F.lit(0).cast("long")), LONG)
    if v.kind == "array":
        return Val(F.when(v.column.isNull(), F.lit(0)).otherwise(F.size(v.column)).cast("long"), LONG)
    if v.fields is not None:
        return literal(float(len(v.fields)))
    if v.kind == "object":
        return Val(F.when(v.column.isNull(), F.lit(0)).otherwise(F.size(v.column)).cast("long"), LONG)
    if v.kind == "number":
        return Val(F.coalesce(F.abs(v.column), F.lit(0)), v.type)
    if v.kind == "null":
        return literal(0.0)
    if v.kind == "variant":
        own = F.when(_variant_type(v.column) == "string", F.char_length(F.try_variant_get(v.column, "$", "string")))
        own = own.when(_variant_type(v.column) == "array", F.size(F.try_variant_get(v.column, "$", "array<variant>")))
        own = own.when(_variant_type(v.column) == "object", F.size(F.try_variant_get(v.column, "$", "map<string,variant>")))
        return number(own.when(_variant_type(v.column) == "number", F.abs(F.try_variant_get(v.column, "$", "double"))).when(_variant_type(v.column) == "null", F.lit(0.0)).cast("double"))
    raise LoweringError(f"{v.kind} has no length")


@rule("keys", "keys_unsorted")
def _keys(cols, v, env):
    if v.fields is not None:
        if v.column is not None:
            note(v.column.isNull(), "argument", F.lit("null has no keys"), null=True)
        return Val(F.array(*[F.lit(k) for k in sorted(v.fields)]), T.ArrayType(STRING))
    needed(v, v, "has no keys")
    if isinstance(v.type, T.MapType):
        return Val(F.array_sort(F.map_keys(v.column)), T.ArrayType(STRING))
    if v.kind == "array":
        n = F.size(v.column).cast("long")
        return Val(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))
    raise LoweringError(f"the keys of a {v.kind} are left to the interpreter")


@rule("has/1")
def _has(cols, v, env, key):
    k = cols.one(key, v, env)
    if v.fields is None:
        needed(v)
    if v.kind == "variant" and isinstance(k.constant, str):
        return Val(F.try_variant_get(v.column, f'$["{k.constant}"]', "variant").isNotNull(), BOOLEAN)
    if isinstance(v.type, T.MapType):
        return Val(F.map_contains_key(v.column, k.column), BOOLEAN)
    if v.kind == "array" and k.kind == "number":
        return Val((k.column >= 0) & (k.column < F.size(v.column)), BOOLEAN)
    raise LoweringError("absent and null fields can't be told apart in a typed record")


@rule("contains/1")
def _contains(cols, v, env, x):
    if v.kind == "string":
        return Val(needed(v).column.contains(as_string(cols.one(x, v, env)).column), BOOLEAN)
    raise LoweringError("containment of containers is left to the interpreter")


@rule("reverse")
def _reverse(cols, v, env):
    if v.kind == "string":
        return Val(F.reverse(needed(v).column), STRING)
    items = as_array(v, quiet=v.kind == "array")
    return Val(F.coalesce(F.reverse(items.column), F.array().cast(items.type)), items.type)


def _sortable(v: Val) -> Val:
    items = as_array(v)
    if not isinstance(element(items), (T.NumericType, T.StringType, T.BooleanType)):
        raise LoweringError("items of several kinds are sorted by the total order")
    return items


@rule("sort")
def _sort(cols, v, env):
    items = _sortable(v)
    return Val(F.sort_array(items.column), items.type)  # nulls come first


@rule("unique")
def _unique(cols, v, env):
    items = _sortable(v)
    return Val(F.sort_array(F.array_distinct(items.column)), items.type)


def _keyed(cols: Columns, items: Val, env: dict, f: A.Node) -> Val:
    """Array of struct(key, place, item), for stable sorts."""
    t = element(items)
    kinds: list = []

    def keyed(x: Column, i: Column) -> Column:
        key = cols.one(f, of_column(x, t), env)
        if key.kind not in ("number", "string", "boolean"):
            raise LoweringError("this key is compared by the total order")
        kinds.append(key.type)
        return F.struct(key.column.alias("k"), i.alias("i"), x.alias("x"))

    made = each(F.transform, items.column, keyed)
    return Val(made, T.ArrayType(T.StructType([T.StructField("k", kinds[0]), T.StructField("i", T.IntegerType()), T.StructField("x", t)])))


@rule("sort_by/1")
def _sort_by(cols, v, env, f):
    items = as_array(v)
    return Val(F.transform(F.sort_array(_keyed(cols, items, env, f).column), lambda s: s["x"]), items.type)


@rule("min_by/1")
def _min_by(cols, v, env, f):
    items = as_array(v)
    return of_column(F.array_min(_keyed(cols, items, env, f).column)["x"], element(items))


@rule("max_by/1")
def _max_by(cols, v, env, f):
    items = as_array(v)
    return of_column(F.array_max(_keyed(cols, items, env, f).column)["x"], element(items))


@rule("min")
def _min(cols, v, env):
    items = _sortable(v)
    return of_column(F.get(F.sort_array(items.column), F.lit(0)), element(items))


@rule("max")
def _max(cols, v, env):
    items = _sortable(v)
    return of_column(F.array_max(items.column), element(items))


@rule("first")
def _first(cols, v, env):
    return cols.item(as_array(v, quiet=v.kind == "array"), literal(0.0))


@rule("last")
def _last(cols, v, env):
    return cols.item(as_array(v, quiet=v.kind == "array"), literal(-1.0))


@rule("nth/1")
def _nth(cols, v, env, n):
    return cols.item(as_array(v, quiet=v.kind == "array"), cols.one(n, v, env))


@rule("first/1")
def _first_of(cols, v, env, f):
    items = cols.many(f, v, env)
    return of_column(F.get(items.column, F.lit(0)), element(items))


@rule("last/1")
def _last_of(cols, v, env, f):
    items = cols.many(f, v, env)
    return of_column(F.try_element_at(items.column, F.lit(-1)), element(items))


@rule("isempty/1")
def _isempty(cols, v, env, f):
    return Val(F.size(cols.many(f, v, env).column) == 0, BOOLEAN)


@rule("map/1")
def _map(cols, v, env, f):
    return cols.mapped(items_of(v), f, env)


@rule("map_values/1")
def _map_values(cols, v, env, f):
    if v.fields is not None:
        return Val(fields={k: cols.one(f, x, env) for k, x in v.fields.items()})
    if isinstance(v.type, T.MapType):
        kinds: list = []

        needed(v)

        def changed(_, x):
            out = cols.one(f, of_column(x, v.type.valueType), env)
            kinds.append(out.to_type())
            return out.to_column()

        with collecting() as inner:
            made = F.transform_values(v.column, changed)
        if inner.items:
            raise LoweringError("values of a map that may fail are left to the interpreter")
        return Val(made, T.MapType(STRING, kinds[0]))
    return cols.mapped(as_array(v), f, env)


def _sum(items: Val) -> Val:
    t = element(items)
    if isinstance(t, T.NumericType):
        out = LONG if isinstance(t, T.IntegralType) else DOUBLE
        total = F.aggregate(items.column, F.lit(0).cast(out), lambda a, x: a + F.coalesce(x.cast(out), F.lit(0).cast(out)))
        return Val(F.when(F.exists(items.column, lambda x: x.isNotNull()), total), out)
    if isinstance(t, T.StringType):
        return Val(F.when(F.exists(items.column, lambda x: x.isNotNull()), F.array_join(items.column, "")), STRING)
    if isinstance(t, T.ArrayType):
        return Val(F.when(F.exists(items.column, lambda x: x.isNotNull()), F.flatten(F.filter(items.column, lambda x: x.isNotNull()))), t)
    raise LoweringError("records are added by the interpreter")


@rule("add")
def _add(cols, v, env):
    return _sum(items_of(v))


@rule("add/1")
def _add_of(cols, v, env, f):
    return _sum(cols.many(f, v, env))


def _quantifier(name: str, whole) -> None:
    def over(items: Val, test) -> Val:
        return Val(each(whole, items.column, lambda x: truthy(test(of_column(x, element(items))))), BOOLEAN)

    FUNCTIONS[name, 0] = lambda cols, v, env: over(items_of(v), lambda x: x)
    FUNCTIONS[name, 1] = lambda cols, v, env, f: over(items_of(v), lambda x: cols.one(f, x, env))
    FUNCTIONS[name, 2] = lambda cols, v, env, g, f: over(cols.many(g, v, env), lambda x: cols.one(f, x, env))


_quantifier("any", F.exists)
_quantifier("all", F.forall)


@rule("flatten/1", "flatten")
def _flatten(cols, v, env, depth=None):
    items = as_array(v)
    n = cols.one(depth, v, env).constant if depth is not None else math.inf
    if not isinstance(n, float):
        raise LoweringError("the depth must be a constant")
    while n > 0 and isinstance(element(items), T.ArrayType):
        note(F.exists(items.column, lambda x: x.isNull()), null=True)
        items = Val(F.flatten(items.column), element(items))
        n -= 1
    return items


@rule("to_entries")
def _to_entries(cols, v, env):
    if v.fields is not None:
        return array_of([Val(fields={"key": literal(k), "value": Val(cast(x, common_type(list(v.fields.values()))), common_type(list(v.fields.values())))}) for k, x in v.fields.items()])
    if isinstance(v.type, T.MapType):
        needed(v, v, "has no keys")
        t = T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", v.type.valueType)]))
        return Val(F.map_entries(v.column), t)
    items = needed(as_array(v, quiet=True), v, "has no keys")
    t = T.ArrayType(T.StructType([T.StructField("key", T.IntegerType()), T.StructField("value", element(items))]))
    return Val(F.transform(items.column, lambda x, i: F.struct(i.alias("key"), x.alias("value"))), t)


@rule("from_entries")
def _from_entries(cols, v, env):
    items = as_array(v)
    t = element(items)
    if not isinstance(t, T.StructType) or t.fieldNames() != ["key", "value"]:
        raise LoweringError("entries need a key and a value")
    keys = F.transform(items.column, lambda x: x["key"])
    sound = (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.exists(keys, lambda k: k.isNull())
    note(~sound)
    return Val(F.when(sound, F.map_from_entries(items.column)), T.MapType(STRING, t["value"].dataType))


@rule("transpose")
def _transpose(cols, v, env):
    rows = as_array(v)
    t = element(rows)
    if not isinstance(t, T.ArrayType):
        raise LoweringError("only arrays of arrays are transposed")
    note(F.exists(rows.column, lambda r: r.isNull()), null=True)
    width = F.coalesce(F.array_max(F.transform(rows.column, lambda r: F.size(r))), F.lit(0))
    made = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows.column, lambda r: F.get(r, i)))
    return Val(F.when(width > 0, made).otherwise(F.array().cast(rows.type)), rows.type)


@rule("del/1")
def _del(cols, v, env, path):
    if isinstance(path, A.Index) and path.target == A.Identity():
        key = cols.one(path.key, v, env)
        if v.fields is not None and isinstance(key.constant, str):
            return Val(fields={k: x for k, x in v.fields.items() if k != key.constant})
        if v.kind == "array" and key.kind == "number":
            n = F.size(needed(v).column)
            at = F.when(key.column < 0, key.column + n).otherwise(key.column).try_cast("int")
            return Val(F.filter(v.column, lambda x, i: i != at), v.type)
    raise LoweringError("this deletion is left to the interpreter")


def _once(c: Column, f: Callable) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


@rule("todate", "todateiso8601")
def _todate(cols, v, env):
    given = cast(as_number(v), DOUBLE)
    held = F.abs(given) < DATES
    note(~held)

    def other(s: Column) -> Column:
        """Spark's dates end at some year, and others than 1 to 9999 get signs or eras: they are written by the cycle that serves all."""
        rest = F.pmod(s, F.lit(CYCLE))
        at = F.timestamp_seconds(rest)
        year = F.year(at) + F.round((s - rest) / CYCLE).cast("long") * 400
        return F.concat(F.regexp_replace(year.cast("string"), "^0$", "0000"), F.date_format(at, "-MM-dd'T'HH:mm:ss'Z'"))

    def date(s: Column) -> Column:
        return F.when(s.between(-62_135_596_800, 253_402_300_799), F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(other(s))

    return Val(_once(F.when(held, F.floor(given)), date), STRING)


@rule("fromdate", "fromdateiso8601")
def _fromdate(cols, v, env):
    parsed = lambda t: F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))

    def other(t: Column) -> Column:
        """Of years that the parser doesn't read: the same day in the cycle from 2000, moved by whole cycles."""

        def moved(year: Column) -> Column:
            near = F.pmod(year, F.lit(400)) + 2000
            return parsed(F.concat(near.cast("string"), F.substring(t, -16, 16))) + F.round((year - near) / 400).cast("long") * CYCLE

        return _once(F.substr(t, F.lit(1), F.length(t) - 16).try_cast("long"), moved)

    # The form is checked first: the parser's own idea of a date is wider.
    form = r"-\d\d-\d\dT\d\d:\d\d:\d\dZ$"
    at = _once(as_string(v, quiet=True).column, lambda t: F.when(t.rlike(rf"^(?!0000)\d{{4}}{form}"), parsed(t)).when(t.rlike(f"^({YEARS}){form}"), other(t)))
    message = F.concat(F.lit("date "), cols.shown(v), F.lit(" does not match format %Y-%m-%dT%H:%M:%SZ"))
    as_string(v)
    note(at.isNull(), "argument", message)
    return Val(at, LONG)
