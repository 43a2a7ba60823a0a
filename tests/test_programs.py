"""Whole programs of the kind the language is written for, each with a document and the outputs worked out by hand."""

import pytest

from tessel import compile
from tessel.values import Failure

ORDER = {
    "title": "garden shed", "lines": [{"part": "plank", "size": {"n": 24.0, "unit": "m"}}, {"part": "nail", "size": {"n": 0.5, "unit": "kg"}, "instead": "screw"}, {"part": "paint", "size": {"n": 2.0, "unit": "l"}}],
    "extra lines": [{"part": "hinge", "size": {"n": 3.0, "unit": "pc"}, "instead": "strap"}, {"part": "nail", "size": {"n": 1.0, "unit": "kg"}, "instead": "peg"}],
}
GRID = [[1.0, 2.0, 4.0], [9.0, 7.0, 6.0, 5.0], [1.0, 9.0], [3.0, 3.0, 2.0], [8.0, 7.0, 9.0, 6.0], [2.0, 6.0, 0.0]]
PAIRS = [[3.0, 4.0], [4.0, 3.0], [2.0, 5.0], [1.0, 3.0], [3.0, 9.0], [3.0, 3.0]]
STEADY = "def steady: (sort == .) or ((sort | reverse) == .);"
CLOSE = "def close: . as $row | [range($row | length - 1) as $i | $row[$i + 1] - $row[$i] | abs | (. <= 3 and . != 0)] | all;"

PROGRAMS = [
    # fields, lengths and lookups
    ('[.title, (.lines | length), (.lines[] | select(.part == "nail") | .size.n)]', ORDER, [["garden shed", 3.0, 0.5]]),
    ('[.lines + ."extra lines" | .[] | select(has("instead")) | {(.part): .instead}] | add', ORDER, [{"hinge": "strap", "nail": "peg"}]),
    ('reduce ((.lines + ."extra lines")[] | select(.instead? != null)) as $l ({}; .[$l.part] += [$l.instead]) | map_values(join("/"))', ORDER, [{"hinge": "strap", "nail": "screw/peg"}]),
    # conditions on numbers
    ("pow(.x; 2) + pow(.y; 2) | if . <= 1 then \"in\" elif . <= 25 then \"near\" else \"out\" end", {"x": 3.0, "y": 4.0}, ["near"]),
    ("def rate: if . > 4 and . < 9 then 0.9 * . elif . == 9 then 0.8 * . else . end | . * 200; .speed | rate, (rate / 60 | trunc)", {"speed": 9.0}, [1440.0, 24.0]),
    ("40 - (if .passed? == null then 0 else .passed end) as $left | (if .layers? == null then 2 else .layers * 2 end) as $ready | {$left, $ready, all: ($ready + (40 - $left))}", {"passed": 25.0, "layers": 3.0}, [{"left": 15.0, "ready": 6.0, "all": 31.0}]),
    # folds over the last row of a grid
    (".[-1] | reduce .[] as $x (0; if $x == 0 then . + 1 else . end) | . != 0", GRID, [True]),
    (".[-1] | reduce .[] as $x (0; if $x > 1 then . + 1 else . end)", GRID, [2.0]),
    # strings
    ('split(" ") | map(split("") | reverse | join("")) | join(" ")', "stressed loop", ["desserts pool"]),
    ('gsub("tag[0-9]+"; "") | test("HELLO"; "i") and (match("hello"; "i")? | .offset == 0)', "tag12Hello there tag3", [True]),
    ('split(";\\\\s*"; "") | map(ltrimstr("<") | rtrimstr(">"))  # fields', "<a>;  b;<c", [["a", "b", "c"]]),
    # recursion and closures
    ("def sum: if length == 0 then 0 else .[0] + (.[1:] | sum) end; sum", [4.0, 5.0, 6.0], [15.0]),
    ("def back: if length == 0 then [] else [.[-1]] + (.[0:length - 1] | back) end; back", [1.0, 2.0, 3.0], [[3.0, 2.0, 1.0]]),
    ("def half: . / 2; def plus(n): . + n; half | plus(10)", 8.0, [14.0]),
    ("def each(f): if length == 0 then [] else [.[0] | f] + (.[1:] | each(f)) end; def last(f; acc): if length == 1 then acc else .[1:] | last(f; acc + (.[0] | f)) end; [1, 2, 3] | each(. * 3), last(. * 3; 0)", None, [[3.0, 6.0, 9.0], 18.0]),
    ("[., 0] | until(.[0] == 1; if .[0] % 2 == 0 then [.[0] / 2, .[1] + 1] else [.[0] * 3 + 1, .[1] + 1] end) | .[1]", 6.0, [8.0]),
    (
        "def at(list; x): list | to_entries | map(select(.value == x)) | .[0].key; def tree(pre; ino): if (pre | length) == 0 then null else pre[0] as $top | at(ino; $top) as $i | {v: $top, l: tree(pre[1:$i + 1]; ino[0:$i]), r: tree(pre[$i + 1:]; ino[$i + 1:])} end; tree(.p; .i)",
        {"p": [2.0, 1.0, 3.0], "i": [1.0, 2.0, 3.0]},
        [{"v": 2.0, "l": {"v": 1.0, "l": None, "r": None}, "r": {"v": 3.0, "l": None, "r": None}}],
    ),
    # columns of pairs, frequencies, neighbours
    ("[map(.[0]), map(.[1])] | map(sort) | transpose | map(.[0] - .[1] | abs) | add", PAIRS, [11.0]),
    ('. as $rows | ($rows | map(.[1]) | group_by(.) | map({"\\\\(.[0])": length}) | add) as $often | $rows | map(.[0] * ($often["\\\\(.[0])"] // 0)) | add', PAIRS, [31.0]),
    (STEADY + CLOSE + "map(select(steady and close)) | length", GRID, [2.0]),
    (STEADY + CLOSE + "def fine: steady and close; def nearly: fine or (. as $row | [range(length) as $i | $row | del(.[$i]) | fine] | any); map(select(nearly)) | length", GRID, [6.0]),
]


@pytest.mark.parametrize("program,document,outputs", PROGRAMS)
def test_program(program, document, outputs):
    program = program.replace("\\\\", "\\")
    found = compile(program).values(document)
    assert not any(isinstance(v, Failure) for v in found), found
    assert [v if not isinstance(v, float) else round(v, 9) for v in found] == outputs
