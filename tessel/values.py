"""JSON values as Python objects: None, bool, float, str, list, dict (a dict is unordered for comparison)."""

from __future__ import annotations

import json
import math
from typing import Any

TYPES = ("null", "boolean", "number", "string", "array", "object")


class Failure(Exception):
    """An error value of the language. code names the kind, value is what the program raised."""

    def __init__(self, code: str, message: str, value: Any = None) -> None:
        super().__init__(message)
        self.code, self.message = code, message
        self.value = message if value is None and code != "error" else value


def type_of(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def truthy(v: Any) -> bool:
    return v is not None and v is not False


def order_key(v: Any) -> tuple:
    """Total order null < false < true < numbers (NaN first) < strings < arrays < objects."""
    kind = type_of(v)
    if kind == "null":
        return (0,)
    if kind == "boolean":
        return (2 if v else 1,)
    if kind == "number":
        return (3, (0, 0.0) if math.isnan(v) else (1, v))
    if kind == "string":
        return (4, v)
    if kind == "array":
        return (5, [order_key(x) for x in v])
    return (6, [(k, order_key(x)) for k, x in sorted(v.items())])


def same(a: Any, b: Any) -> bool:
    """Equality: NaN equals nothing, booleans aren't numbers, key order doesn't count."""
    ka, kb = type_of(a), type_of(b)
    if ka != kb:
        return False
    if ka == "array":
        return len(a) == len(b) and all(map(same, a, b))
    if ka == "object":
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def less(a: Any, b: Any) -> bool:
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, (int, float)) and not isinstance(b, bool) or order_key(a) < order_key(b)
    return order_key(a) < order_key(b)


def number_text(v: float) -> str:
    if math.isnan(v):
        return "null"
    if math.isinf(v):
        return "1.7976931348623157e+308" if v > 0 else "-1.7976931348623157e+308"
    if v == int(v) and abs(v) < 1e17:
        return str(int(v))
    return repr(float(v))


def to_json(v: Any) -> str:
    """Compact JSON text with keys in the object's order."""
    kind = type_of(v)
    if kind == "number":
        return number_text(v)
    if kind == "array":
        return "[" + ",".join(map(to_json, v)) + "]"
    if kind == "object":
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + to_json(x) for k, x in v.items()) + "}"
    return json.dumps(v, ensure_ascii=False)


def _sorted_pairs(pairs: list) -> dict:
    return dict(sorted(dict(pairs).items()))


def from_json(text: str) -> Any:
    """Parse JSON: numbers become floats, object keys are sorted, the last of repeated keys counts."""
    return json.loads(text, parse_int=float, parse_float=float, object_pairs_hook=_sorted_pairs)


def show(v: Any) -> str:
    """How values appear in reports: like JSON, with plain keys."""
    kind = type_of(v)
    if kind == "number":
        return number_text(v)
    if kind == "array":
        return "[" + ", ".join(map(show, v)) + "]"
    if kind == "object":
        return "{" + ", ".join(f"{k}: {show(x)}" for k, x in v.items()) + "}"
    return json.dumps(v, ensure_ascii=False)


def tostring(v: Any) -> str:
    return v if isinstance(v, str) else to_json(v)
