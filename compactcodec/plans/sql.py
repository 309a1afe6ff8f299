"""Pieces of SQL that rebuild the text notation, for checking results elsewhere."""

from __future__ import annotations

_UNSAFE = r"^$|^[\x00-\x20#-]|[\x00-\x20]$|^(true|false|null)$|^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$|[\x00-\x1f:\x22\\\[\]{}"


def bare(x: str, delimiter: str = ",") -> str:
    sign = {",": ",", "\t": r"\t", "|": r"\|"}[delimiter]
    return f"not regexp_matches({x}, '{_UNSAFE}{sign}]')"


def quoted(x: str, delimiter: str = ",") -> str:
    escaped = f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return f"case when {bare(x, delimiter)} then {x} else '\"' || {escaped} || '\"' end"


def number(x: str) -> str:
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end"


def time(x: str) -> str:
    return f"'\"' || case when epoch_us({x}) % 1000 = 0 then strftime({x}, '%Y-%m-%dT%H:%M:%S.%g') else strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') end || '\"'"


def cell(x: str, kind: str, delimiter: str = ",") -> str:
    made = {"text": lambda: quoted(x, delimiter), "int": lambda: f"cast({x} as varchar)", "double": lambda: number(x), "time": lambda: time(x)}[kind]()
    return f"coalesce({made}, 'null')"


def row(columns: dict[str, str], delimiter: str = ",") -> str:
    sep = {",": "','", "\t": "chr(9)", "|": "'|'"}[delimiter]
    return "(" + f" || {sep} || ".join(cell(c, k, delimiter) for c, k in columns.items()) + ")"
