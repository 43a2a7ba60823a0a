import pytest

from tessel.lang import ParseError, parse
from tessel.lang import ast as A

I = A.Identity()


def test_precedence():
    assert parse("1 + 2 * 3") == A.Binary("+", A.Literal(1.0), A.Binary("*", A.Literal(2.0), A.Literal(3.0)))
    assert parse(".a, .b | .c") == A.Pipe(A.Comma(A.Index(I, A.Literal("a")), A.Index(I, A.Literal("b"))), A.Index(I, A.Literal("c")))
    assert parse("1 // 2 // 3") == A.Alternative(A.Literal(1.0), A.Alternative(A.Literal(2.0), A.Literal(3.0)))
    assert parse(". == 1 and . < 2 or false").op == "or"
    assert isinstance(parse(".a = 1 // 2"), A.Assign)
    assert parse("-.a + 1").op == "+"


def test_postfix():
    assert parse(".a.b[0]?") == A.Try(A.Index(A.Index(A.Index(I, A.Literal("a")), A.Literal("b")), A.Literal(0.0)))
    assert parse('."a b"') == parse('.["a b"]')
    assert parse(".[1:]") == A.Slice(I, A.Literal(1.0), None)
    assert parse(".a?//1") == A.Alternative(A.Try(A.Index(I, A.Literal("a"))), A.Literal(1.0))
    assert parse("$x.a[]") == A.Iterate(A.Index(A.Variable("x"), A.Literal("a")))


def test_strings():
    assert parse(r'"a\nA\"😀"') == A.Literal('a\nA"😀')
    assert parse(r'"x\(.a + "y\(1)")z"').parts[0] == "x"
    assert parse(r'@base64 "v\(.)"').fmt == "@base64"


def test_objects():
    assert parse('{a, "b": 1, (.k): 2, $x, "c\\(.d)": 3}').entries[0] == (A.Literal("a"), A.Index(I, A.Literal("a")))
    assert parse("{a: .b | length, c: 1}").entries[0][1] == A.Pipe(A.Index(I, A.Literal("b")), A.Call("length"))


def test_comments_and_definitions():
    assert parse(". # the end") == I
    assert parse("") == I
    node = parse("def f(g; $n): g + $n; f(.a; 1)")
    assert node.params == ("g", "$n")
    assert parse("if . then 1 elif .a then 2 end").otherwise.otherwise == I


def test_bind_takes_the_expression_before_it():
    node = parse("40 - .a as $x | $x")
    assert isinstance(node, A.Bind) and node.source.op == "-"


@pytest.mark.parametrize("text", ["(", "1 +", "[1", '"abc', "{a:}", "if 1 then", ".a b", "reduce . as x (0;1)", "}", "{(.a)}"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)
