"""python -m tessel: evaluate a program on one JSON document and check the document's shape."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .lang import ParseError
from .shapes import check, ill_typed
from .shapes.algebra import render
from .values import Failure, from_json, to_json


def main(argv: list[str] | None = None) -> int:
    from .api import compile

    p = argparse.ArgumentParser(prog="tessel", description=__doc__)
    program = p.add_mutually_exclusive_group(required=True)
    program.add_argument("--expression", help="the program")
    program.add_argument("--path", help="a file with the program")
    document = p.add_mutually_exclusive_group(required=True)
    document.add_argument("--input", help="the JSON document")
    document.add_argument("--input-path", help="a file with the JSON document")
    p.add_argument("--inference", choices=("direct", "constraint"), default="direct")
    p.add_argument("--verbose", action="store_true", help="also print the inferred shapes")
    a = p.parse_args(argv)
    try:
        compiled = compile(a.expression if a.expression is not None else Path(a.path).read_text())
        value = from_json(a.input if a.input is not None else Path(a.input_path).read_text())
    except (ParseError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for out in compiled.values(value):
        print(f"failed: {out.message}" if isinstance(out, Failure) else to_json(out))
    given, outputs = compiled.infer(a.inference)
    if a.verbose:
        print(f"{given} -> {', '.join(map(str, outputs)) or 'nothing'}")
    clash = next((c for s in (given, *outputs) if (c := ill_typed(s))), None)
    if clash:
        print(f"ill typed: {render(clash.found, False)} where {render(clash.needed, False)} is needed")
        return 1
    mismatch = check(given, value)
    print(f"the document doesn't fit: {mismatch}" if mismatch else "well typed, and the document fits")
    return int(mismatch is not None)


if __name__ == "__main__":
    sys.exit(main())
