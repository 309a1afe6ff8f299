"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is a DataFrame expression on the row itself: no shuffle and no Python.  The expressions
are possessive and start only where a run starts, so that a text of any length is scanned in linear
time and Java's matcher never recurses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: code points before and after a match that may hold context words
CONTEXT_CHARS = 48
BLOCK = 512

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SECRET_WORDS = "(?i)(?:token|secret|passw|api[ _-]?key|bearer)"


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must have for it to be tried, its score alone, and its context words."""

    name: str
    pattern: str
    score: float
    words: str
    least: float


#: The first four are always kept once their checks hold; the others must reach their least score.
KINDS = [
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", 0.9, r"(?i)mail|contact|correo|courriel", 0.0),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.7, r"(?i)\bip\b|host|server|address|adresse", 0.0),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.8, r"(?i)card|visa|karte|tarjeta|carte", 0.0),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"(?i)phone|call|tel|mobil", 0.0),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.9, r"(?i)iban|account|konto|cuenta|compte", 0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, r"(?i)ssn|social|security", 0.5),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", 0.4, _SECRET_WORDS, 0.5),
]
BASE = ("email", "ip", "card", "phone")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often ``body`` looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, first: int, op) -> Column:
    """``first`` and all values before each one, put together by ``op``; blocks keep the cost near linear in their number."""
    return _let(values, lambda v: _running_of(v, first, op))


def _running_of(values: Column, first: int, op) -> Column:
    zero, none = F.lit(first).cast("bigint"), F.array().cast("array<bigint>")
    start = lambda at: F.struct(at.alias("s"), none.alias("a"))
    step = lambda acc, x: F.struct(op(acc["s"], x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    parts = F.when(F.size(values) == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    sums = F.transform(parts, lambda x: F.aggregate(x, zero, op))
    before = F.aggregate(sums, start(zero), step)["a"]
    return F.flatten(F.zip_with(parts, before, lambda x, o: F.aggregate(x, start(o), step)["a"]))


def _luhn(digits: Column) -> Column:
    value = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _mod97(compact: Column) -> Column:
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(turned, i, F.lit(1)))
    step = lambda a, i: F.when(code(i) >= 65, (a * 100 + code(i) - 55) % 97).otherwise((a * 10 + code(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(found, " -", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(found, "+ ().-", "")).between(9, 15)
    if kind == "iban":
        compact = F.translate(found, " ", "")
        return F.when(F.length(compact).between(15, 34), _mod97(compact)).otherwise(False)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _needed(kind: str, text: Column) -> Column:
    """A cheap test that a text without any match fails."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "secret":
        return text.rlike(_SECRET_WORDS)
    return text.rlike("[0-9]" if kind == "card" else r"[0-9]\.[0-9]" if kind == "ip" else "[A-Z][A-Z][0-9][0-9]" if kind == "iban" else "[0-9]-[0-9][0-9]-[0-9]")


def _spans(kind: Kind, text: Column) -> Column:
    """All confirmed spans of one kind: array of (start, rank, kind, end, score), by start."""
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")
    matches = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(text, kind.pattern, -1).alias("around"))
    return F.when(_needed(kind.name, text), _let(matches, lambda m: _confirmed(kind, m["found"], m["around"]))).otherwise(none)


def _confirmed(kind: Kind, found: Column, around: Column) -> Column:
    """Spans of the matches ``found``, with the text ``around`` them, that pass their checks."""
    rank = [k.name for k in KINDS].index(kind.name)
    steps = F.zip_with(found, F.slice(around, F.lit(1), F.size(found)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))

    def span(at: Column, i: Column) -> Column:
        m, before, after = F.get(found, i), F.right(F.get(around, i), F.lit(CONTEXT_CHARS)), F.left(F.get(around, i + 1), F.lit(CONTEXT_CHARS))
        first = at + F.length(F.get(around, i))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(before.rlike(kind.words), 0.3).when(after.rlike(kind.words), 0.1).otherwise(0.0))
        return F.struct(first.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (first + F.length(m)).alias("end"), score.alias("score"), _valid(kind.name, m).alias("ok"))

    every = F.filter(F.transform(_running(steps, 0, lambda a, y: a + y), span), lambda s: s["ok"] & (s["score"] >= kind.least))
    return F.transform(every, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "end", "score")]))


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: array of (start, rank, kind, end, score), by start and then kind.

    Offsets are code points, the end is exclusive.  A null or empty text has no spans.  Kinds may
    overlap each other; within a kind spans do not.  A match that fails its check (octets over 255,
    Luhn, mod-97, number of digits) is dropped and not tried anew.  ``iban``, ``ssn`` and ``secret``
    need a score of 0.5, which the latter two reach only near a context word.  Rows are independent:
    repeated rows, null ids and extra columns pass as they are, but a column called ``out_col`` is
    replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out_col, F.sort_array(F.concat(*[_spans(k, text) for k in KINDS])))


def redact(docs: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """``docs`` with ``out_col``: the text with every span of ``find_pii``, of whatever kind, replaced by its kind in brackets.

    Only confirmed spans go, so numbers, dates and versions stay.  Spans that overlap are one, under
    the kind of the first.  A null text is empty.  Other columns pass; one called ``out_col`` is replaced.
    """
    spans, text = F.col("__spans"), F.coalesce(F.col("__text"), F.lit(""))
    reach = _running(F.transform(spans, lambda s: s["end"]), 0, lambda a, y: F.greatest(a, y))  # where all spans before each one end
    firsts = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("before"))), lambda x: x["start"] >= x["before"])
    between = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform(firsts, lambda x: F.concat(between(x["before"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    made = F.concat(F.array_join(pieces, ""), F.substr(text, (last + 1).cast("int")))
    passed = [c for c in docs.columns if c != out_col]
    found = find_pii(docs.select(*[docs[c].alias(f"p{i}") for i, c in enumerate(passed)], docs[text_col].alias("__text")), "__text", "__spans")
    return found.select(*[f"p{i}" for i in range(len(passed))], F.when(F.size(spans) == 0, text).otherwise(made).alias("__made")).toDF(*passed, out_col)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
