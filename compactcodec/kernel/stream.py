"""Rows and items of one array in a document, one at a time, without building the document's value.

The array is the first of its kind, or the first with a given key at any depth.  Widths and counts are
not validated: surplus cells are dropped, missing ones are missing keys, and rows end at the declared
length, at a shallower line, or at the next field.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from compactcodec.kernel.scalars import CodecError, parse_token, split_cells, trim
from compactcodec.kernel.text import Field, Header, Line, Reader, assign, is_key_value, is_row, parse_header, scan


def _headers(lines: list[Line]) -> Iterator[tuple[int, int, Header]]:
    """Position, depth of the array's field, header; a header behind a hyphen is one level deeper."""
    for i, line in enumerate(lines):
        content, depth = line.content, line.depth
        if content.startswith("- "):
            content, depth = content[2:], depth + 1
        try:
            header = parse_header(content)
        except CodecError:
            continue
        if header:
            yield i, depth, header


def _find(lines: list[Line], key: str | None, table: bool) -> tuple[int, int, Header] | None:
    return next((f for f in _headers(lines) if (key is None or f[2].key == key) and not f[2].keyed and (not table or f[2].fields is not None)), None)


def _row_lines(lines: list[Line], found: tuple[int, int, Header]) -> Iterator[Line]:
    at, depth, header = found
    body = (x for x in lines[at + 1 :])
    for line in islice(body, header.length):
        if line.depth <= depth or not is_row(line.content, header.delimiter):
            return
        yield line


def raw_rows(text: str, key: str | None = None, indent: int = 2, strict: bool = True) -> Iterator[str]:
    """Row lines as they stand."""
    lines, _ = scan(text, indent, strict)
    if found := _find(lines, key, True):
        yield from (trim(x.content) for x in _row_lines(lines, found))


def raw_cells(text: str, key: str | None = None, indent: int = 2, strict: bool = True) -> Iterator[list[str]]:
    """Cells of each row, not typed, quotes kept."""
    lines, _ = scan(text, indent, strict)
    if found := _find(lines, key, True):
        for x in _row_lines(lines, found):
            yield split_cells(trim(x.content), found[2].delimiter)


def rows(text: str, key: str | None = None, names: list[str] | None = None, indent: int = 2, strict: bool = True) -> Iterator[dict]:
    """Rows of the first table, or of the table ``key``; ``names`` replace those of the header."""
    lines, _ = scan(text, indent, strict)
    if not (found := _find(lines, key, True)):
        return
    fields = tuple(map(Field, names)) if names is not None else found[2].fields
    for x in _row_lines(lines, found):
        yield assign([parse_token(c) for c in split_cells(trim(x.content), found[2].delimiter)], fields)[0]


def items(text: str, key: str | None = None, indent: int = 2, strict: bool = True) -> Iterator:
    """Items of the first array, or of the array ``key``, of whatever form."""
    lines, _ = scan(text, indent, strict)
    if not (found := _find(lines, key, False)):
        return
    at, depth, header = found
    if header.fields is not None:
        yield from rows(text, key, None, indent, strict)
    elif header.rest:
        for c in islice(split_cells(header.rest, header.delimiter), header.length):
            yield parse_token(c)
    else:
        reader = Reader("", indent, False)
        reader.lines, reader.at = lines, at + 1
        for _ in range(header.length):
            line = reader.peek()
            if line is None or line.depth != depth + 1 or not (line.content.startswith("- ") or trim(line.content) == "-"):
                return
            reader.at += 1
            yield reader.item(trim(line.content[1:]), depth + 1)


def chunked(values: Iterator, size: int = 100) -> Iterator[list]:
    """Lists of ``size`` values, the last one shorter."""
    values = iter(values)
    while chunk := list(islice(values, size)):
        yield chunk


LINE_TYPES = ("blank", "listItem", "arrayHeader", "keyValue", "dataRow", "primitive")


def line_type(content: str, delimiter: str = ",") -> str:
    content = content.strip(" \t\r")
    if not content:
        return "blank"
    if content.startswith("- ") or content == "-":
        return "listItem"
    try:
        if parse_header(content):
            return "arrayHeader"
    except CodecError:
        pass
    if is_key_value(content):
        return "keyValue"
    return "dataRow" if delimiter in content else "primitive"
