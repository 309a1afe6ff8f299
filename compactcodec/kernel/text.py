"""The text notation: ``dumps`` and ``loads`` of whole documents, and the pieces that other paths share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from compactcodec.kernel.scalars import CodecError, closing_quote, find_unquoted, normalise, parse_token, primitive, quote_key, split_cells, string_literal, trim

MARKS = {",": "", "\t": "\t", "|": "|"}
#: levels that a document may nest; deeper ones are refused, whatever the interpreter's stack
MAX_DEPTH = 200


@dataclass(frozen=True)
class Field:
    """A column of a table: a leaf, or a group of columns."""

    name: str
    fields: tuple[Field, ...] = ()

    def leaves(self) -> int:
        return sum(f.leaves() for f in self.fields) if self.fields else 1


# ---------------------------------------------------------------- shapes


def _is_primitive(x) -> bool:
    return not isinstance(x, (list, dict))


def _columns(values: list) -> Field | None:
    """The column that all values fit, without its name, or None."""
    first = values[0]
    if isinstance(first, dict):
        inner = table_fields(values)
        return None if inner is None else Field("", inner)
    return Field("") if all(map(_is_primitive, values)) else None


def table_fields(rows: list) -> tuple[Field, ...] | None:
    """Columns of rows that are non-empty, share their keys and are uniform in each; else None."""
    if not rows or not all(isinstance(r, dict) and r for r in rows):
        return None
    keys = rows[0].keys()
    if any(r.keys() != keys for r in rows):
        return None
    out = []
    for k in keys:
        column = _columns([r[k] for r in rows])
        if column is None:
            return None
        out.append(Field(k, column.fields))
    return tuple(out)


def keyed_fields(x: dict) -> tuple[Field, ...] | None:
    """Columns of a map with two or more uniform objects; else None."""
    return table_fields(list(x.values())) if len(x) >= 2 else None


def cells(row: dict, fields: tuple[Field, ...]) -> list:
    out = []
    for f in fields:
        out += cells(row[f.name], f.fields) if f.fields else [row[f.name]]
    return out


# ---------------------------------------------------------------- writing


@dataclass
class Writer:
    indent: int = 2
    delimiter: str = ","
    length_marker: str = ""
    lines: list[str] = field(default_factory=list)

    def line(self, depth: int, text: str) -> None:
        self.lines.append(" " * (self.indent * depth) + text)

    def fields(self, fields: tuple[Field, ...]) -> str:
        return self.delimiter.join(quote_key(f.name) + (f"{{{self.fields(f.fields)}}}" if f.fields else "") for f in fields)

    def header(self, key: str | None, n: int, fields: tuple[Field, ...] = (), keyed: bool = False) -> str:
        marker = "" if keyed else self.length_marker
        return f"{quote_key(key) if key is not None else ''}[{marker}{n}{':' if keyed else ''}{MARKS[self.delimiter]}]{f'{{{self.fields(fields)}}}' if fields else ''}:"

    def row(self, values: list) -> str:
        return self.delimiter.join(primitive(v, self.delimiter) for v in values)

    def root(self, x) -> None:
        if isinstance(x, dict):
            if fields := keyed_fields(x):
                self.keyed(None, x, fields, 0)
            else:
                self.members(x, 0)
        elif isinstance(x, list):
            self.array(None, x, 0)
        else:
            self.line(0, primitive(x, self.delimiter))

    def members(self, x: dict, depth: int) -> None:
        for k, v in x.items():
            self.member(k, v, depth)

    def member(self, key: str, x, depth: int) -> None:
        if isinstance(x, list):
            self.array(key, x, depth)
        elif not isinstance(x, dict):
            self.line(depth, f"{quote_key(key)}: {primitive(x, self.delimiter)}")
        elif fields := keyed_fields(x):
            self.keyed(key, x, fields, depth)
        else:
            self.line(depth, f"{quote_key(key)}:")
            self.members(x, depth + 1)

    def keyed(self, key: str | None, x: dict, fields: tuple[Field, ...], depth: int) -> None:
        self.line(depth, self.header(key, len(x), fields, True))
        for k, v in x.items():
            self.line(depth + 1, f"{quote_key(k)}: {self.row(cells(v, fields))}")

    def array(self, key: str | None, x: list, depth: int) -> None:
        if not x:
            self.line(depth, f"{quote_key(key)}: []" if key is not None else "[]")
        elif all(map(_is_primitive, x)):
            self.line(depth, f"{self.header(key, len(x))} {self.row(x)}")
        elif fields := table_fields(x):
            self.line(depth, self.header(key, len(x), fields))
            for r in x:
                self.line(depth + 1, self.row(cells(r, fields)))
        else:
            self.line(depth, self.header(key, len(x)))
            for v in x:
                self.item(v, depth + 1)

    def item(self, x, depth: int) -> None:
        if isinstance(x, dict):
            if not x:
                self.line(depth, "-")
                return
            at = len(self.lines)
            self.members(x, depth + 1)
            self.lines[at] = " " * (self.indent * depth) + "- " + self.lines[at].lstrip(" ")
        elif not isinstance(x, list):
            self.line(depth, f"- {primitive(x, self.delimiter)}")
        elif all(map(_is_primitive, x)):
            self.line(depth, f"- {self.header(None, len(x))}{' ' if x else ''}{self.row(x)}")
        else:
            self.line(depth, f"- {self.header(None, len(x))}")
            for v in x:
                self.item(v, depth + 1)


def dumps(x, indent: int = 2, delimiter: str = ",", length_marker: str = "") -> str:
    """The document of any value; an empty object is the empty text, there is no final line feed."""
    if indent < 1 or delimiter not in MARKS or length_marker not in ("", "#", None):
        raise CodecError("indent, delimiter or length marker")
    w = Writer(indent, delimiter, length_marker or "")
    w.root(normalise(x))
    return "\n".join(w.lines)


# ---------------------------------------------------------------- headers


@dataclass(frozen=True)
class Header:
    key: str | None
    length: int
    delimiter: str
    keyed: bool
    fields: tuple[Field, ...] | None
    rest: str


_BRACKET = re.compile(r"\[#?(0|[1-9][0-9]*)(:)?([\t|]?)\]")


def _closing_brace(s: str, start: int) -> int:
    level, at = 0, start
    while (at := find_unquoted(s, "{}", at)) >= 0:
        level += 1 if s[at] == "{" else -1
        if level == 0:
            return at
        at += 1
    return -1


def _field_list(s: str, delimiter: str) -> tuple[Field, ...] | None:
    """Names with groups; None if braces or quotes don't fit."""
    out, start = [], 0
    while start <= len(s):
        at = find_unquoted(s, delimiter + "{", start)
        inner: tuple[Field, ...] = ()
        if at >= 0 and s[at] == "{":
            end = _closing_brace(s, at)
            if end < 0:
                return None
            found = _field_list(s[at + 1 : end], delimiter)
            if found is None:
                return None
            if not found:
                raise CodecError("a group without fields")
            inner, name, start = found, s[start:at], end + 1
            if start < len(s) and s[start] != delimiter:
                return None
            start += 1
        else:
            name, start = (s[start:at], at + 1) if at >= 0 else (s[start:], len(s) + 1)
        name = trim(name)
        if name.startswith('"'):
            name = string_literal(name)
        elif not name:
            if inner:
                return None
            continue
        out.append(Field(name, inner))
    return tuple(out)


def parse_header(content: str) -> Header | None:
    """The array header that a line is or starts with, or None."""
    if "[" not in content:
        return None
    key = None
    if content.startswith('"'):
        end = closing_quote(content, 0)
        if end < 0 or content[end + 1 : end + 2] != "[":
            return None
        start, key = end + 1, string_literal(content[: end + 1])
    else:
        start = content.find("[")
        if start < 0 or ":" in content[:start] or content[start - 1 : start] == " ":
            return None
        if start:
            key = content[:start]
    m = _BRACKET.match(content, start)
    if not m:
        return None
    delimiter, at, fields = m[3] or ",", m.end(), None
    if content[at : at + 1] == "{":
        end = _closing_brace(content, at)
        if end < 0:
            return None
        text = content[at + 1 : end]
        if delimiter != "," and find_unquoted(text, ",") >= 0:
            return None
        fields = _field_list(text, delimiter)
        if fields is None:
            return None
        at = end + 1
        while content[at : at + 1] == " ":
            at += 1
    if content[at : at + 1] != ":":
        return None
    if fields is not None and not fields:
        raise CodecError("a header without fields")
    return Header(key, int(m[1]), delimiter, bool(m[2]), fields, trim(content[at + 1 :]))


# ---------------------------------------------------------------- lines


class Line(NamedTuple):
    depth: int
    content: str
    number: int


def scan(text: str, indent: int = 2, strict: bool = True) -> tuple[list[Line], list[int]]:
    """Lines that count, and the numbers of blank ones; comments go."""
    lines, blanks = [], []
    for number, raw in enumerate(text.removeprefix("﻿").split("\n"), 1):
        if raw.endswith("\r"):
            raw = raw.rstrip("\r")
        content = raw.lstrip(" ")
        if not content or content[0] in "\t\r#":
            if not content.strip(" \t\r"):
                blanks.append(number)
                continue
            if content[0] == "#":
                continue
            if strict and content[0] == "\t":
                raise CodecError(f"line {number}: a tab in the indentation")
        spaces = len(raw) - len(content)
        if strict and spaces % indent:
            raise CodecError(f"line {number}: indentation is no multiple of {indent}")
        if spaces // indent > MAX_DEPTH:
            raise CodecError(f"line {number}: nested deeper than {MAX_DEPTH}")
        lines.append(Line(spaces // indent, content, number))
    return lines, blanks


def is_key_value(content: str) -> bool:
    if content.startswith('"'):
        end = closing_quote(content, 0)
        return end >= 0 and content[end + 1 :].lstrip(" ").startswith(":")
    return find_unquoted(content, ":") >= 0


def is_row(content: str, delimiter: str) -> bool:
    """Is a line at row depth a row, not the next field?"""
    at = find_unquoted(content, delimiter + ":")
    return at < 0 or content[at] == delimiter


def split_key(content: str) -> tuple[str, str]:
    if content.startswith('"'):
        end = closing_quote(content, 0)
        if end < 0:
            raise CodecError("unterminated key")
        rest = content[end + 1 :].lstrip(" ")
        if not rest.startswith(":"):
            raise CodecError("no colon after a key")
        return string_literal(content[: end + 1]), rest[1:]
    at = content.find(":")
    if at < 0:
        raise CodecError("no colon after a key")
    return content[:at].strip(), content[at + 1 :]


def assign(values: list, fields: tuple[Field, ...], at: int = 0) -> tuple[dict, int]:
    """Cells, depth first, as the nested object that the fields describe; missing cells are missing keys."""
    out = {}
    for f in fields:
        if f.fields:
            out[f.name], at = assign(values, f.fields, at)
        elif at < len(values):
            out[f.name] = values[at]
            at += 1
    return out, at


# ---------------------------------------------------------------- reading


class Reader:
    def __init__(self, text: str, indent: int = 2, strict: bool = True):
        self.lines, self.blanks = scan(text, indent, strict)
        self.strict, self.at = strict, 0

    def peek(self) -> Line | None:
        return self.lines[self.at] if self.at < len(self.lines) else None

    def fail(self, what: str):
        line = self.lines[min(self.at, len(self.lines) - 1)] if self.lines else None
        raise CodecError(f"line {line.number}: {what}" if line else what)

    def root(self):
        first = self.peek()
        if first is None:
            return {}
        if first.depth == 0:
            if trim(first.content) == "[]":
                self.at += 1
                return self.whole([])
            header = parse_header(first.content)
            if header and header.key is None:
                self.at += 1
                return self.whole(self.array(header, 0))
            if len(self.lines) == 1 and not header and not is_key_value(first.content):
                return parse_token(first.content)
        return self.members(0)

    def whole(self, x):
        if self.strict and self.at < len(self.lines):
            self.fail("text after a root array")
        return x

    def members(self, depth: int, out: dict | None = None) -> dict:
        out = {} if out is None else out
        lines = self.lines
        while self.at < len(lines):
            line = lines[self.at]
            if line.depth != depth:
                if line.depth < depth:
                    break
                self.fail("deeper than its surroundings")
            self.at += 1
            key, value = self.member(line.content, depth)
            if self.strict and key in out:
                self.fail(f"key {key!r} repeats")
            out[key] = value
        return out

    def member(self, content: str, depth: int):
        if "[" in content:
            header = parse_header(content)
            if header:
                if header.key is None:
                    self.fail("an array without a key")
                return header.key, self.array(header, depth)
            if self.strict and content[0] != '"' and "[" in content.partition(":")[0] and ":" in content:
                self.fail("a malformed array header")
        key, rest = split_key(content)
        rest = trim(rest)
        if rest == "[]":
            return key, []
        if rest:
            return key, parse_token(rest)
        line = self.peek()
        if line is None or line.depth <= depth:
            return key, {}
        if line.depth > depth + 1:
            self.fail("a jump in depth")
        return key, self.members(depth + 1)

    def array(self, h: Header, depth: int):
        """What follows a header whose line is at ``depth``, or counts as if it were."""
        if self.strict:
            if h.keyed and h.fields is None:
                self.fail("a keyed header without fields")
            if h.rest and (h.keyed or h.fields is not None):
                self.fail("text after a header with fields")
            self.distinct(h.fields or ())
        if h.keyed:
            return self.keyed(h, depth)
        if h.fields is not None:
            return self.table(h, depth)
        if h.rest:
            values = [parse_token(c) for c in split_cells(h.rest, h.delimiter)]
            self.count(h, len(values))
            return values
        return self.items(h, depth)

    def distinct(self, fields: tuple[Field, ...]) -> None:
        if len({f.name for f in fields}) < len(fields):
            self.fail("a field name repeats")
        for f in fields:
            self.distinct(f.fields)

    def count(self, h: Header, n: int) -> None:
        if self.strict and n != h.length:
            self.fail(f"{h.length} declared, {n} found")

    def gaps(self, first: int | None) -> None:
        """In strict mode no line is blank between the first line of a block and its last."""
        if self.strict and first is not None and self.blanks:
            last = self.lines[self.at - 1].number
            if any(first < b < last for b in self.blanks):
                self.fail("a blank line inside an array")

    def table(self, h: Header, depth: int) -> list:
        rows, first, width = [], None, sum(f.leaves() for f in h.fields)
        while (line := self.peek()) is not None and line.depth == depth + 1 and is_row(line.content, h.delimiter):
            first = first or line.number
            values = [parse_token(c) for c in split_cells(trim(line.content), h.delimiter)]
            if self.strict and len(values) != width:
                self.fail(f"{width} cells expected, {len(values)} found")
            self.at += 1
            rows.append(assign(values, h.fields)[0])
        self.gaps(first)
        self.count(h, len(rows))
        return rows

    def keyed(self, h: Header, depth: int) -> dict:
        out, first, width, n = {}, None, sum(f.leaves() for f in h.fields or ()), 0
        while (line := self.peek()) is not None and line.depth == depth + 1:
            if not is_key_value(line.content):
                if self.strict:
                    self.fail("an entry without a key")
                self.at += 1
                continue
            first = first or line.number
            key, rest = split_key(line.content)
            values = [parse_token(c) for c in split_cells(trim(rest), h.delimiter)]
            if self.strict and len(values) != width:
                self.fail(f"{width} cells expected, {len(values)} found")
            if self.strict and key in out:
                self.fail(f"entry {key!r} repeats")
            self.at += 1
            n += 1
            out[key] = assign(values, h.fields or ())[0]
        self.gaps(first)
        self.count(h, n)
        return out

    def items(self, h: Header, depth: int) -> list:
        out, first = [], None
        while (line := self.peek()) is not None and line.depth == depth + 1 and (line.content.startswith("- ") or trim(line.content) == "-"):
            first = first or line.number
            self.at += 1
            out.append(self.item(trim(line.content[1:]), depth + 1))
        self.gaps(first)
        self.count(h, len(out))
        return out

    def item(self, content: str, depth: int):
        """An item whose hyphen is at ``depth``."""
        if not content:
            return {}
        if content == "[]":
            return []
        header = parse_header(content)
        if header and header.key is None:
            if self.strict and (header.fields is not None or header.keyed):
                self.fail("a table without a key as an item")
            return self.array(header, depth)
        if header or is_key_value(content):
            key, value = self.member(content, depth + 1)
            return self.members(depth + 1, {key: value})
        return parse_token(content)


def loads(text: str, indent: int = 2, strict: bool = True):
    """The value of a document; an empty one, or one of comments only, is an empty object."""
    return Reader(text, indent, strict).root()
