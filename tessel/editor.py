"""What an editor asks about a program text: completions, hover texts, rewrites and a formatted text.

Plain functions of a text and a place in it; a language server only has to pass them on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from .lang import ast as A
from .lang import parse
from .lang.parser import KEYWORDS, ParseError, tokenize
from .lang.printer import text_of
from .plans.rewrite import SELECTS, simplified


@dataclass(frozen=True)
class Item:
    """A completion: what to put in, its kind (field, variable, builtin, keyword, format) and a word on it."""

    text: str
    kind: str
    detail: str = ""


def _builtins() -> dict[str, list[int]]:
    from .functions.natives import NATIVES

    out: dict[str, list[int]] = {}
    for name, arity in sorted(NATIVES):
        out.setdefault(name, []).append(arity)
    return out


def completions(source: str, at: int) -> list[Item]:
    """What may stand at the place: fields behind a dot (those that the text names), variables behind $, formats behind @, else names."""
    before = source[:at]
    if found := re.search(r"\.([A-Za-z_]\w*)?$", before):
        names = sorted(set(re.findall(r"\.([A-Za-z_]\w*)", source[: found.start()] + " " + source[at:])))
        return [Item(n, "field") for n in names if n.startswith(found[1] or "")]
    if found := re.search(r"\$(\w*)$", before):
        names = sorted({n for n in re.findall(r"\$([A-Za-z_]\w*)", before[: found.start()])} | {"__loc__"})
        return [Item(f"${n}", "variable") for n in names if n.startswith(found[1])]
    if found := re.search(r"@(\w*)$", before):
        from .functions.formats import FORMATS

        return [Item(f, "format") for f in sorted(FORMATS) if f[1:].startswith(found[1])]
    start = re.search(r"[A-Za-z_]\w*$", before)
    word = start[0] if start else ""
    own = [Item(n, "definition", f"{n}({p})" if p else n) for n, p in re.findall(r"\bdef\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*:", before)]
    built = [Item(n, "builtin", ", ".join(f"{n}/{a}" for a in arities)) for n, arities in _builtins().items()]
    return [i for i in (*own, *built, *(Item(k, "keyword") for k in sorted(KEYWORDS))) if i.text.startswith(word)]


#: What keywords and operators do, in a sentence.
SENTENCES = {
    "|": "feeds each output of the left side to the right side", ",": "gives the outputs of both sides, one after the other", "//": "gives the right side where the left has no output but null, false or errors",
    "..": "gives the input and everything inside it", "?": "leaves out the errors of the part before it", "+": "adds numbers, joins strings and arrays, merges objects", "-": "subtracts numbers, or takes items out of an array",
    "*": "multiplies numbers, or repeats", "/": "divides numbers", "%": "gives the remainder", "??": "stands for a part that isn't written yet", "if": "chooses a branch for each output of the condition", "try": "runs a part and hands its errors to catch",
    "reduce": "folds outputs into one value", "foreach": "folds outputs and gives every state", "def": "names a filter", "as": "binds outputs to variables", "label": "marks where break leaves to", "and": "is true if both sides are", "or": "is true if one side is",
}


def hover(source: str, at: int) -> str | None:
    """A sentence on the token at the place: a builtin with its arities and result, a keyword, an operator, or a variable."""
    try:
        tokens = tokenize(source)[0]
    except ParseError:
        return None
    token = next((t for t in reversed(tokens) if t.at <= at and t.kind != "end"), None)
    if token is None or at >= token.at + max(1, len(token.text)):
        return None
    if token.text in SENTENCES:
        return f"{token.text} {SENTENCES[token.text]}"
    if token.kind == "field":
        return f"the field {token.text[1:]} of the input"
    if token.kind == "var":
        return f"the variable {token.text}"
    arities = _builtins().get(token.text)
    if arities is None:
        return None
    from .shapes.direct import SIGNATURES

    results = {str(SIGNATURES[token.text, a][1]) for a in arities if (token.text, a) in SIGNATURES}
    return "builtin " + ", ".join(f"{token.text}/{a}" for a in arities) + (f", gives {' or '.join(sorted(results))}" if results else "")


@dataclass(frozen=True)
class Action:
    """A rewrite on offer: what it does and the whole new text."""

    title: str
    text: str


def _everywhere(node: A.Node, f) -> A.Node:
    def inside(value):
        if isinstance(value, A.Node):
            return _everywhere(value, f)
        return tuple(map(inside, value)) if isinstance(value, tuple) else value

    return f(replace(node, **{x.name: inside(getattr(node, x.name)) for x in fields(node)}))


def _shorter(node: A.Node) -> A.Node:
    """Filters by kind get their names back, a condition that only repeats its truth loses its branches."""
    if isinstance(node, A.Call) and node.name == "select":
        return next((A.Call(name) for name, test in SELECTS.items() if node.args == (test,)), node)
    if isinstance(node, A.If) and (node.then, node.otherwise) == (A.Literal(True), A.Literal(False)):
        return A.Alternative(node.condition, A.Literal(False)) if node.condition == A.Identity() else node
    return node


def _safe(node: A.Node) -> A.Node:
    return A.Try(node, None) if isinstance(node, (A.Index, A.Iterate)) and not (isinstance(node, A.Index) and isinstance(node.target, A.Try)) else node


def actions(source: str, start: int = 0, end: int | None = None) -> list[Action]:
    """Rewrites of the program, or of the part between two places: simplify, safe access, try, pipeline, variable, type check."""
    end = len(source) if end is None else end
    part = source[start:end]
    try:
        node = parse(part)
        parse(source)
    except ParseError:
        return []
    whole = lambda new: source[:start] + new + source[end:]
    inner = lambda new: f"({new})" if (start, end) != (0, len(source)) else new
    out = []
    short = _everywhere(simplified(node), _shorter)
    if short != node:
        out.append(Action("simplify", whole(inner(text_of(short)))))
    safe = _everywhere(node, _safe)
    if safe != node:
        out.append(Action("leave out errors of missing fields", whole(inner(text_of(safe)))))
    out.append(Action("catch errors", whole(f"(try ({text_of(node)}) catch null)")))
    match node:
        case A.Call(name, (first, *rest)) if name not in ("select", "map") and not rest:
            out.append(Action("write as a pipeline", whole(inner(text_of(A.Pipe(first, A.Call(name)))))))
    out.append(Action("bind to a variable", f"{text_of(node)} as $x | " + whole("$x")))
    out.append(Action("check the type first", whole(f'({text_of(node)} | if type == "object" then . else error("not an object") end)')))
    return out


def formatted(source: str) -> str:
    """The program with even spacing. Lines that are only a comment stay in front; raises ParseError if it isn't a program."""
    head = []
    lines = source.split("\n")
    while lines and (lines[0].strip().startswith("#") or not lines[0].strip()):
        head.append(lines.pop(0).rstrip())
    return "\n".join([*(h for h in head if h), text_of(parse("\n".join(lines)))])
