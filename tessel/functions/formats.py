"""@format strings, and the years of dates."""

from __future__ import annotations

import base64
import binascii
import html
import urllib.parse
from typing import Any

from ..values import Failure, number_text, show, to_json, tostring, type_of

#: Seconds of 400 years, after which the calendar repeats; dates lie within DATES seconds of 1970. Years have four digits, or as many as they need.
CYCLE, DATES, YEARS = 146_097 * 86_400, 1e18, r"\d{4}|[1-9]\d{4,10}|-[1-9]\d{0,10}"


def _cells(v: Any, what: str) -> list:
    if not isinstance(v, list):
        raise Failure("format", f"{show(v)} cannot be {what}-formatted, only an array can be")
    return v


def _cell(v: Any, what: str, quote) -> str:
    kind = type_of(v)
    if kind == "number":
        return number_text(v)
    if kind == "boolean":
        return "true" if v else "false"
    if kind == "null":
        return ""
    if kind == "string":
        return quote(v)
    raise Failure("format", f"{show(v)} is not valid in a {what} row")


def csv(v: Any) -> str:
    return ",".join(_cell(x, "csv", lambda s: '"' + s.replace('"', '""') + '"') for x in _cells(v, "csv"))


def tsv(v: Any) -> str:
    escape = lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
    return "\t".join(_cell(x, "tsv", escape) for x in _cells(v, "tsv"))


def sh(v: Any) -> str:
    one = lambda x: "'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else _cell(x, "sh", str) or "null"
    return " ".join(map(one, v)) if isinstance(v, list) else one(v)


def base64d(v: Any) -> str:
    try:
        raw = tostring(v)
        return base64.b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        raise Failure("format", f"{show(v)} is not valid base64 data") from None


def base32d(v: Any) -> str:
    try:
        return base64.b32decode(tostring(v)).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        raise Failure("format", f"{show(v)} is not valid base32 data") from None


FORMATS = {
    "@text": tostring,
    "@json": to_json,
    "@csv": csv,
    "@tsv": tsv,
    "@html": lambda v: html.escape(tostring(v), quote=True).replace("&#x27;", "&#39;"),
    "@uri": lambda v: urllib.parse.quote(tostring(v), safe="-_.~"),
    "@sh": sh,
    "@base64": lambda v: base64.b64encode(tostring(v).encode()).decode(),
    "@base64d": base64d,
    "@base32": lambda v: base64.b32encode(tostring(v).encode()).decode(),
    "@base32d": base32d,
}
