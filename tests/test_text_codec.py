"""The text notation: cases by rule, and round trips of any value."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compactcodec.kernel import scalars, stream
from compactcodec.kernel.scalars import CodecError
from compactcodec.kernel.text import dumps, loads

WORDS = ["tide", "basalt", "moss", "kelp", "ember", "quill"]
TIDES = [{"port": WORDS[i], "metres": i + 0.25, "spring": i % 2 == 0} for i in range(3)]


def rows_of(n, start=0):
    """n rows of an integer, a word and a group of two numbers."""
    return [{"no": start + i, "word": WORDS[i % 6], "at": {"x": i, "y": i * i}} for i in range(n)]


def row_text(rows, d=","):
    return "\n".join("  " + d.join(str(x) for x in (r["no"], r["word"], r["at"]["x"], r["at"]["y"])) for r in rows)


BOTH_WAYS = {
    "roots": [({}, ""), ([], "[]"), ("tide", "tide"), (-7, "-7"), (False, "false"), (None, "null"), ([3, "x"], "[2]: 3,x")],
    "fields": [({"depth": 11, "rock": "basalt", "wet": False, "age": None}, "depth: 11\nrock: basalt\nwet: false\nage: null")],
    "levels": [({"bay": {"pool": {"weed": "kelp", "seen": [2, 5], "lost": [], "void": {}}}, "x": 1}, "bay:\n  pool:\n    weed: kelp\n    seen[2]: 2,5\n    lost: []\n    void:\nx: 1")],
    "tables": [
        ({"tides": TIDES}, "tides[3]{port,metres,spring}:\n  tide,0.25,true\n  basalt,1.25,false\n  moss,2.25,true"),
        *[({"t": rows_of(n)}, f"t[{n}]{{no,word,at{{x,y}}}}:\n{row_text(rows_of(n))}") for n in (1, 4)],
        (rows_of(2, 8), f"[2]{{no,word,at{{x,y}}}}:\n{row_text(rows_of(2, 8))}"),
    ],
    "rows that are no table": [
        ([{"k": 1, "g": {"z": "a"}}, {"k": 2, "g": None}], "[2]:\n  - k: 1\n    g:\n      z: a\n  - k: 2\n    g: null"),
        ([{"k": 1}, {"l": 1}], "[2]:\n  - k: 1\n  - l: 1"), ([{"k": []}], "[1]:\n  - k: []"),
    ],
    "tables by key": [
        ({"reefs": {w: {"length": i, "kind": w[0]} for i, w in enumerate(WORDS[:3])}}, "reefs[3:]{length,kind}:\n  tide: 0,t\n  basalt: 1,b\n  moss: 2,m"),
        ({"north": {"v": 4}, "south": {"v": 5}}, "[2:]{v}:\n  north: 4\n  south: 5"), ({"only": {"v": 4}}, "only:\n  v: 4"),
    ],
    "lists": [
        ({"grid": [[7, 8], ["x,y", "null", "k:v"], []]}, 'grid[3]:\n  - [2]: 7,8\n  - [3]: "x,y","null","k:v"\n  - [0]:'),
        ([5, {"rock": "chalk"}, [{"a": 1}, {"b": 2}], {}], "[4]:\n  - 5\n  - rock: chalk\n  - [2]:\n    - a: 1\n    - b: 2\n  -"),
        ({"logs": [{"tides": [{"h": 3}, {"h": 4}], "by": "me"}]}, "logs[1]:\n  - tides[2]{h}:\n      3\n      4\n    by: me"),
        ({"logs": [{"pairs": [[9], [8, 7]], "by": "me"}]}, "logs[1]:\n  - pairs[2]:\n      - [1]: 9\n      - [2]: 8,7\n    by: me"),
    ],
    "quotes": [
        ({"two words": "x", "7": '"', "dotted.name": "\\"}, '"two words": x\n"7": "\\""\ndotted.name: "\\\\"'),
        *[([s, "z"], f'[2]: "{s}",z') for s in ("012", "+4", "-", "#", " a", "a ", "true", "false", "3e2", "-0.5", "", "[", "}", "a:b")],
        (["a\tb\r\n", "\x1b"], '[2]: "a\\tb\\r\\n","\\u001b"'), ("ß\u2003…", "ß\u2003…"),
    ],
}


@pytest.mark.parametrize(("value", "document"), [case for cases in BOTH_WAYS.values() for case in cases])
def test_both_ways(value, document):
    assert dumps(value) == document
    assert loads(document) == value


@pytest.mark.parametrize("mark", ["|", "\t"])
def test_delimiters(mark):
    assert dumps({"t": rows_of(2)}, delimiter=mark) == f"t[2{mark}]{{no{mark}word{mark}at{{x{mark}y}}}}:\n{row_text(rows_of(2), mark)}"
    other = {"|": "\t", "\t": "|"}[mark]
    cells = ["a,b", f"a{mark}b", f"a{other}b"]
    made = dumps(cells, delimiter=mark)
    assert loads(made) == cells and made.count('"') == (4 if mark == "|" else 2)


def test_options():
    assert dumps({"bay": {"seen": [4]}}, indent=3, length_marker="#") == "bay:\n   seen[#1]: 4"
    assert loads("bay:\n   seen[#1]: 4", indent=3) == {"bay": {"seen": [4]}}
    for wrong in ({"indent": 0}, {"delimiter": ";"}, {"length_marker": "!"}):
        with pytest.raises(CodecError):
            dumps({}, **wrong)


@pytest.mark.parametrize(("token", "value"), [("7", 7), ("-07", "-07"), ("1E2", 100.0), ("2.50", 2.5), ("-0", 0), ("-0.0", 0), ("1.", "1."), (".25", ".25"), ("0b1", "0b1"), ("1e-2", 0.01), ("9223372036854775808", 2.0**63), ("nan", "nan"), ('"7"', "7"), ("null", None)])
def test_tokens(token, value):
    for document, found in ((f"k: {token}", {"k": value}), (f"k[1]: {token}", {"k": [value]}), (f"k[1]{{c}}:\n  {token}", {"k": [{"c": value}]})):
        assert loads(document) == found and type(loads(f"k: {token}")["k"]) is type(value)


#: a sound document, and its value
SOUND = f"name: reef\nt[3]{{no,word,at{{x,y}}}}:\n{row_text(rows_of(3))}\nlist[2]:\n  - moss\n  - kelp\nkeyed[2:]{{v}}:\n  a: 1\n  b: 2\nlast[2]: 5,6"
VALUE = {"name": "reef", "t": rows_of(3), "list": ["moss", "kelp"], "keyed": {"a": {"v": 1}, "b": {"v": 2}}, "last": [5, 6]}


@pytest.mark.parametrize("change", [lambda s: s, lambda s: s.replace("\n", "\r\n"), lambda s: s + "\n\n", lambda s: "\ufeff" + s, lambda s: s.replace("\nlist", "\n# note\n\nlist"), lambda s: s.replace("  - kelp", "  # note\n  - kelp"), lambda s: s.replace("5,6", " 5 , 6 ")])
def test_changes_that_leave_the_value(change):
    assert loads(change(SOUND)) == VALUE


def test_other_readings():
    assert loads("# nothing else") == {} and loads("[here]") == "[here]"
    assert loads("box[2:]{v}:\n  a: []\n  b[3]: 4") == {"box": {"a": {"v": "[]"}, "b[3]": {"v": 4}}}


@pytest.mark.parametrize(("old", "new"), [
    ("t[3]", "t[4]"), ("t[3]", "t[2]"), ("0,tide,0,0", "0,tide,0"), ("0,tide,0,0", "0,tide,0,0,0"), ("list[2]", "list[1]"), ("keyed[2:]", "keyed[3:]"), ("a: 1", "a: 1,2"), ("  b: 2", "  a: 2"), ("last[2]: 5,6", "last[3]: 5,6"),
    ("name: reef", "name: reef\nname: reef"), ("{no,word", "{no,no"), ("  - kelp", "\n  - kelp"), ("  1,basalt", "\n  1,basalt"), ("  b: 2", "\n  b: 2"), ("last[2]:", "last[two]:"), ("last[2]:", "last[02]:"), ("last[2]:", "last[]:"),
    ("t[3]{no", "t[3] {no"), ("  - moss", "   - moss"), ("  - moss", "\t- moss"), ("keyed[2:]{v}:", "keyed[2:]{v}: 9"), ("last[2]: 5,6", "last[2]: 5,6\n    7"),
])
def test_strict_errors(old, new):
    """One change to a sound document each."""
    assert SOUND.count(old) == 1
    with pytest.raises(CodecError):
        loads(SOUND.replace(old, new))


@pytest.mark.parametrize("document", ["[1]: 4\nmore: 5", "[1]:\n  - [1:]{v}:\n      k: 4"])
def test_strict_errors_at_roots(document):
    with pytest.raises(CodecError):
        loads(document)


@pytest.mark.parametrize(("old", "new"), [("reef", '"re\\ef"'), ("reef", '"\\u12"'), ("reef", '"\\ud912"'), ("reef", '"reef'), ("reef", '"re"ef'), ("name: reef", "name reef"), ("name: reef", "name:\n    deep: 1"), ("name: reef", "name: reef\n  deep: 1"), ("name: reef", "name:\n  bare"), ("{v}", "{}"), ("name: reef", "name:\n  [1]: 4"), ("  - kelp", "  - x: 1\n    bare")])
def test_errors_in_both_modes(old, new):
    for strict in (True, False):
        with pytest.raises(CodecError):
            loads(SOUND.replace(old, new, 1), strict=strict)


def test_depth_is_bounded():
    deep = "\n".join("  " * k + "k:" for k in range(600))
    for strict in (True, False):
        with pytest.raises(CodecError, match="deeper"):
            loads(deep, strict=strict)


@pytest.mark.parametrize(("old", "new", "key", "value"), [
    ("t[3]", "t[1]", "t", rows_of(3)), ("name: reef", "name: reef\nname: moss", "name", "moss"), ("  - kelp", "\n  - kelp", "list", ["moss", "kelp"]), ("list[2]", "list[9]", "list", ["moss", "kelp"]),
    ("  b: 2", "  bare", "keyed", {"a": {"v": 1}}), ("  - kelp", "   - kelp", "list", ["moss", "kelp"]), ("last[2]", "last[1]", "last", [5, 6]),
])
def test_lenient(old, new, key, value):
    assert loads(SOUND.replace(old, new), strict=False)[key] == value


@pytest.mark.parametrize(("x", "text"), [(0.0, "0"), (-0.0, "0"), (5.0, "5"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (2e23, "2e+23"), (0.1, "0.1"), (math.nan, "null"), (123456789.125, "123456789.125"), (2**53, "9007199254740992")])
def test_numbers(x, text):
    assert scalars.number(x) == text


def test_plain_numbers():
    assert [scalars.number(x, "plain") for x in (1e-7, -1e-21, 1.5e-9, 1e21, 2.5)] == ["0.0000001", "0", "0.0000000015", "1000000000000000000000", "2.5"]


def values():
    leaf = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: x != 0 or math.copysign(1, x) > 0) | st.text(max_size=12)
    return st.recursive(leaf, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=20)


def same(a, b):
    """Integral floats come back as integers."""
    if isinstance(a, dict):
        return isinstance(b, dict) and list(a) == list(b) and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b or isinstance(a, float) and not isinstance(b, (bool, str)) and a == b


@settings(max_examples=400, deadline=None)
@given(values(), st.sampled_from(",\t|"), st.sampled_from([1, 2, 4]))
def test_any_value_survives(value, delimiter, indent):
    assert same(value, loads(dumps(value, indent, delimiter), indent))


def test_streams():
    doc = "head: 1\nids[1]{a}:\n  7\nlist[3]:\n  - x\n  - k: 1\n    m: 2\n  - [2]: 1,2\nnest:\n  t[3]{a,g{b,c}}:\n    1,2,3\n    4,5,6,extra\n    7\nafter: 1"
    assert list(stream.rows(doc)) == [{"a": 7}]
    assert list(stream.rows(doc, "t")) == [{"a": 1, "g": {"b": 2, "c": 3}}, {"a": 4, "g": {"b": 5, "c": 6}}, {"a": 7, "g": {}}]
    assert list(stream.rows(doc, "t", ["p", "q"]))[0] == {"p": 1, "q": 2}
    assert list(stream.items(doc, "list")) == ["x", {"k": 1, "m": 2}, [1, 2]]
    assert list(stream.raw_rows(doc, "t")) == ["1,2,3", "4,5,6,extra", "7"]
    assert list(stream.raw_cells("a[2]{x,y}:\n  \"p,q\", r \n  1,", "a")) == [['"p,q"', "r"], ["1", ""]]
    assert list(stream.rows("a[1]{x}:\n  1\n  2")) == [{"x": 1}] and list(stream.rows("none: 1")) == []
    assert list(stream.chunked(iter(range(5)), 2)) == [[0, 1], [2, 3], [4]]
    assert [stream.line_type(x) for x in ("", "- a", "a[1]: 2", "k: v", "1,2", "w")] == ["blank", "listItem", "arrayHeader", "keyValue", "dataRow", "primitive"]
