"""Printer, modules, inputs and editor functions."""

import pytest

from tessel import compile
from tessel.editor import actions, completions, formatted, hover
from tessel.lang import ParseError, parse
from tessel.lang.printer import text_of

TEXTS = [
    ".", "..", ".a.b[0]", '.["a b"]', ".[1:-1]", ".[]", "[.[] | . + 1, 2]", "{a: 1, \"b c\": .x, (.k): [.v, 2]}", "-.a * (1 + 2) - 3 - (4 - 5)", "1 - (2 - 3)", ".a // .b // 3", "(.a, .b) | .c", ".a as [$x, {k: $y}] | $x + $y", ". as {$a, b: [$c]} ?// [$a] | $a",
    "reduce .[] as $x (0; . + $x)", "foreach (.a | .[]) as $x (0; . + $x; [$x, .])", "if .a then 1 elif .b then 2 else 3 end", "if . then 1 end", "try error(\"x\") catch .", "(.a)?", ".a[]?", "def f(g; $h): g | . + $h; f(. * 2; 3)", "label $out | 1, break $out, 2", "@base64 \"x\\(.a | @json)y\"",
    "\"a\\(1 + 2)\\n\\\"q\"", ".a |= . + 1", ".a += 1 | .b", ".a and .b or (.c or .d) and .e", "(1 | . + 2) * 3", "[]", "{}", "?? | .a", "$__loc__", "1e3, 0.5, -2", "not", "limit(3; .[])", "(.a | .b).c", "[range(0; 10)] | map(select(. % 2 == 0)) | add",
]


@pytest.mark.parametrize("text", TEXTS)
def test_printed_programs_parse_to_the_same_tree(text):
    node = parse(text)
    assert parse(text_of(node)) == node, text_of(node)


def test_formatted():
    assert formatted("# adds\n\n.a+1|[.[]|select(.>2)]") == "# adds\n.a + 1 | [.[] | select(. > 2)]"
    assert formatted("((.a))") == ".a"
    with pytest.raises(ParseError):
        formatted(".a |")


MODULES = {
    "geo/shapes": 'module {name: "shapes"}; import "util" as u; def area(w; h): u::times(w; h); def square: area(.; .);',
    "util": "def times(a; b): a * b; def twice: times(.; 2); def hidden: def twice: 5; twice;",
    "a": 'include "b"; def x: y;',
    "b": 'include "a"; def y: x;',
}


def test_modules(tmp_path):
    run = lambda text, v=None: compile(text, modules=MODULES).values(v)
    assert run('import "geo/shapes" as g; g::area(.w; .h), (.w | g::square)', {"w": 3.0, "h": 4.0}) == [12.0, 9.0]
    assert run('include "util"; . | twice, hidden', 4.0) == [8.0, 5.0]
    assert run('import "util" as u {search: "./"}; def times(a; b): 0; u::twice, times(1; 1)', 4.0) == [8.0, 0.0]
    (tmp_path / "m.jq").write_text("def inc: . + 1;")
    assert compile('import "m" as m; m::inc', modules=tmp_path).values(1.0) == [2.0]
    for bad in ('import "none" as n; .', 'include "a"; x', 'import "util"; .', "import util as u; ."):
        with pytest.raises(ParseError):
            compile(bad, modules=MODULES)


def test_inputs():
    assert compile("[., input, (inputs | . * 2)]").values(1.0, inputs=[2.0, 3.0, 4.0]) == [[1.0, 2.0, 6.0, 8.0]]
    assert compile("[inputs]").values(1.0) == [[]]


def test_base32():
    assert compile("@base32, (@base32 | @base32d)").values("tessel") == ["ORSXG43FNQ======", "tessel"]


def test_completions():
    texts = lambda s: [i.text for i in completions(s, len(s))]
    assert texts(".price | .qty + .pr") == ["price"] and texts(".price | .qty + .") == ["price", "qty"]
    assert texts(". as $row | .a as $rest | $r") == ["$rest", "$row"]
    assert texts("@bas") == ["@base32", "@base32d", "@base64", "@base64d"]
    assert "startswith" in texts("starts") and texts("def starter: 1; starte") == ["starter"] and "reduce" in texts("redu")


def test_hover():
    assert hover(".a | length", 6).startswith("builtin length/0") and "left side to the right" in hover(".a | length", 3)
    assert hover(".price", 2) == "the field price of the input" and hover("$x", 0) == "the variable $x"
    assert hover("nothing_known", 2) is None and hover("", 0) is None and hover('"open', 1) is None


def test_actions():
    by = lambda *a: {x.title: x.text for x in actions(*a)}
    assert by(".[] | . | select(. != null)")["simplify"] == ".[] | values"
    assert by("if . then true else false end")["simplify"] == ". // false"
    assert by(".a.b")["leave out errors of missing fields"] == ".a?.b" or "?" in by(".a.b")["leave out errors of missing fields"]
    assert by("1 + .a", 4, 6)["bind to a variable"] == ".a as $x | 1 + $x"
    assert compile(by('error("x")')["catch errors"]).values(None) == [None]
    assert all(parse(x.text) for x in actions(".a | .b + 1"))
    assert actions(".a |") == []
