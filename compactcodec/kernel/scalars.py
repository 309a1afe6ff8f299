"""Tokens: quoting, escaping, numbers.  One set of rules for every path."""

from __future__ import annotations

import datetime
import decimal
import math
import re

#: fixed values of the notation
UNQUOTED_KEY = r"^[A-Za-z_][A-Za-z0-9_.]*$"
NUMERIC_LIKE = r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
NUMERIC_LITERAL = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
LITERALS = ("true", "false", "null")
DELIMITERS = (",", "\t", "|")
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1

_KEY, _LIKE, _LITERAL = re.compile(UNQUOTED_KEY), re.compile(NUMERIC_LIKE), re.compile(NUMERIC_LITERAL)
_UNSAFE = {d: re.compile(r'[\x00-\x1f:"\\\[\]{}' + re.escape(d) + "]") for d in DELIMITERS}
_TO_ESCAPE = re.compile(r'[\x00-\x1f"\\]')
_NAMED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_UNNAMED = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)?", re.DOTALL)


class CodecError(ValueError):
    """A document or value that the notation does not allow."""


def is_numeric_like(s: str) -> bool:
    """Would a reader be tempted to take it for a number; leading zeros and a plus sign included."""
    return bool(_LIKE.match(s)) and not s.endswith("\n")


def is_numeric_literal(s: str) -> bool:
    return bool(_LITERAL.match(s)) and not s.endswith("\n")


def has_forbidden_leading_zeros(s: str) -> bool:
    return bool(re.match(r"^-?0[0-9]", s))


def is_simple_integer(s: str) -> bool:
    return bool(re.fullmatch(r"-?[0-9]+", s))


def is_bare_key(s: str) -> bool:
    return bool(_KEY.match(s)) and not s.endswith("\n")


def is_bare(s: str, delimiter: str = ",") -> bool:
    """May a string value stand without quotes?"""
    if not s or s[0] <= " " or s[-1] <= " " or s[0] in "-#" or s in LITERALS:
        return False
    return not _UNSAFE[delimiter].search(s) and not is_numeric_like(s)


def escape(s: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _NAMED.get(m[0]) or f"\\u{ord(m[0]):04x}", s)


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if code and code[0] == "u" and len(code) == 5:
            value = int(code[1:], 16)
            if 0xD800 <= value <= 0xDFFF:
                raise CodecError("a lone surrogate is escaped")
            return chr(value)
        if code not in _UNNAMED:
            raise CodecError(f"unknown escape \\{code or ''}")
        return _UNNAMED[code]

    return _ESCAPE.sub(one, s) if "\\" in s else s


def quote(s: str, delimiter: str = ",") -> str:
    return s if is_bare(s, delimiter) else f'"{escape(s)}"'


def quote_key(s: str) -> str:
    return s if is_bare_key(s) else f'"{escape(s)}"'


def number(x: int | float, form: str = "canonical") -> str:
    """Digits of a number.  ``plain`` has no exponent and at most twenty decimals."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    size = abs(x)
    if x == int(x) and size < 1e21:
        return format(x, ".0f")
    short = repr(x)
    if 1e-6 <= size < 1e21:
        return format(decimal.Decimal(short), "f")
    if form == "plain":
        text = f"{x:.20f}" if size < 1e-4 else format(decimal.Decimal(short), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text == "-0" else text
    mantissa, _, exponent = short.partition("e")
    power = int(exponent)
    return f"{mantissa.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"


def primitive(x, delimiter: str = ",") -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return number(x)
    return quote(x, delimiter)


def normalise(x):
    """Any value as null, bool, int, float, str, list or dict.

    Not finite is null, -0.0 is 0, integers beyond 64 bits are text, times are ISO 8601 text with three
    or six digits of a second, bytes and sets are lists, keys are text; what is unknown is null.
    """
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, int):
        return int(x) if INT64_MIN <= x <= INT64_MAX else str(int(x))
    if isinstance(x, float):
        return None if not math.isfinite(x) else 0 if x == 0 else float(x)
    if isinstance(x, decimal.Decimal):
        if not x.is_finite():
            return None
        if x == x.to_integral_value():
            return int(x) if abs(x) <= 2**53 - 1 else str(int(x))
        return float(x)
    if isinstance(x, datetime.datetime):
        text = x.astimezone(datetime.UTC).replace(tzinfo=None) if x.tzinfo else x
        digits = "milliseconds" if text.microsecond % 1000 == 0 else "microseconds"
        return text.isoformat(timespec=digits) + ("Z" if x.tzinfo else "")
    if isinstance(x, datetime.date):
        return f"{x.isoformat()}T00:00:00.000"
    if isinstance(x, dict):
        return {str(k): normalise(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return {str(k): normalise(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple, set, frozenset, bytes, bytearray)):
        return [normalise(v) for v in x]
    if hasattr(x, "tolist"):
        return normalise(x.tolist())
    return None


def trim(s: str) -> str:
    """Spaces at both ends, carriage returns at the right one."""
    return s.lstrip(" ").rstrip(" \r")


def string_literal(token: str) -> str:
    """A token that starts with a quote; it must end where its string ends."""
    at = closing_quote(token, 0)
    if at < 0:
        raise CodecError("unterminated string")
    if at != len(token) - 1:
        raise CodecError("text after a closing quote")
    return unescape(token[1:at])


def closing_quote(s: str, start: int) -> int:
    """Where the string that opens at ``start`` closes, or -1."""
    at = start + 1
    while (at := s.find('"', at)) >= 0:
        back = at - 1
        while s[back] == "\\":
            back -= 1
        if (at - 1 - back) % 2 == 0:
            return at
        at += 1
    return -1


def find_unquoted(s: str, chars: str, start: int = 0) -> int:
    """The first of ``chars`` outside quoted strings, or -1."""
    at = start
    while at < len(s):
        if s[at] == '"':
            at = closing_quote(s, at)
            if at < 0:
                return -1
        elif s[at] in chars:
            return at
        at += 1
    return -1


def split_cells(s: str, delimiter: str = ",") -> list[str]:
    """Cells of a row, quotes kept, trimmed; an empty row has none, an empty cell is one."""
    if not s:
        return []
    if '"' not in s:
        return [trim(x) for x in s.split(delimiter)]
    out, start = [], 0
    while (at := find_unquoted(s, delimiter, start)) >= 0:
        out.append(trim(s[start:at]))
        start = at + 1
    out.append(trim(s[start:]))
    return out


def parse_number(token: str) -> int | float:
    """Without point and exponent an integer, if 64 bits hold it; any zero is the integer 0."""
    if is_simple_integer(token) and INT64_MIN <= (i := int(token)) <= INT64_MAX:
        return i
    x = float(token)
    return 0 if x == 0 else x


_VALUES = {"true": True, "false": False, "null": None}


def parse_token(token: str):
    token = trim(token)
    if not token:
        return ""
    first = token[0]
    if first == '"':
        return string_literal(token)
    if first in "tfn" and token in _VALUES:
        return _VALUES[token]
    if first in "-0123456789" and is_numeric_literal(token):
        return parse_number(token)
    return token


def utf8_length(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))
