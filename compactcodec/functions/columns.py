"""Native expressions of the text notation; they stay in generated code and never start Python."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from compactcodec.kernel import scalars
from compactcodec.kernel.text import MARKS

_NAMED = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
_OTHER_RX = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def _replace(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _java(delimiter: str) -> str:
    return {",": ",", "\t": "\\t", "|": "\\|"}[delimiter]


def is_bare(c: Column, delimiter: str = ",") -> Column:
    """May the string stand without quotes?"""
    unsafe = f"^$|^[\\x00-\\x20#-]|[\\x00-\\x20]$|^(?:true|false|null)$|{scalars.NUMERIC_LIKE}|[\\x00-\\x1f:\"\\\\\\[\\]{{}}{_java(delimiter)}]"
    return ~c.rlike(unsafe)


def escape_text(c: Column) -> Column:
    """Quotes, backslashes and control characters escaped.  Signs other than the five with a name are rare; they go through an array, which keeps the generated method small enough to be compiled."""
    named = _replace(c, _NAMED)
    code = lambda x: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))
    odd = F.array_join(F.transform(F.split(named, ""), lambda x: F.when(x.rlike(_OTHER_RX), code(x)).otherwise(x)), "")
    return F.when(c.rlike(_OTHER_RX), odd).otherwise(named)


#: plain words, which most cells are; one simple expression finds them
_PLAIN = "^[A-Za-z](?:[A-Za-z0-9 _.]*[A-Za-z0-9])?$"


def quote_text(c: Column, delimiter: str = ",") -> Column:
    plain = c.rlike(_PLAIN) & ~c.isin(*scalars.LITERALS) & ~c.endswith("\n")
    return F.when(plain | is_bare(c, delimiter), c).otherwise(F.concat(F.lit('"'), escape_text(c), F.lit('"')))


def quote_key_text(c: Column) -> Column:
    return F.when(c.rlike(scalars.UNQUOTED_KEY) & ~c.endswith("\n"), c).otherwise(F.concat(F.lit('"'), escape_text(c), F.lit('"')))


def _fixed_point(x: Column) -> tuple[Column, Column]:
    """Digits of a double, and whether they are its shortest form: it has at most six decimals and nine digits before them, or is whole below 2^53."""
    scaled = F.rint(x * 1e6)
    a = F.abs(scaled.cast("bigint"))
    div = F.call_function("div", a, F.lit(1_000_000).cast("bigint"))
    tail = F.rtrim(F.lpad((a % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    whole = (x == F.floor(x)) & (F.abs(x) < 2.0**53)
    text = F.when(whole, x.cast("bigint").cast("string")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), div.cast("string"), F.lit("."), tail))
    # a decimal of at most 15 digits is the only one of such length that its nearest double has
    return text, whole | (F.abs(x) < 1e9) & (scaled / 1e6 == x)


def number_text(c: Column, kind: T.DataType, fixed_point: bool = False) -> Column:
    """Digits of a number.

    Most doubles are fixed-point numbers, which are printed natively; only the others go to the
    kernel's rule, in Arrow batches.  With ``fixed_point`` the plan has no Python, and any other
    double than such, an infinity or a NaN is an error.
    """
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    if isinstance(kind, T.DecimalType):
        plain = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.when(plain.contains("."), plain).when(F.abs(c) <= 2**53 - 1, plain).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))
    x = c.cast("double")
    text, fits = _fixed_point(x)
    text = F.when(fits, text)
    if fixed_point:
        return text.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").when(x.isNotNull(), F.raise_error(F.concat(F.lit("no fixed-point number: "), x.cast("string"))))
    return F.coalesce(text, canonical_number(F.when(~fits, x)))


def _digits(x: pa.Array, form: str) -> pa.Array:
    """Digits of doubles: Arrow's shortest text, put right where it has an exponent, a needless point or no number."""
    if form == "canonical":
        text = pc.replace_substring_regex(pc.cast(x, pa.string()), r"\.0$", "")
        odd = pc.fill_null(pc.or_(pc.match_substring_regex(text, "[a-z]"), pc.equal(text, "-0")), False)
    else:
        text, odd = pa.nulls(len(x), pa.string()), pc.is_valid(x)
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(at):
        made = [scalars.number(v, form) for v in x.take(pa.array(at)).to_pylist()]
        text = pc.replace_with_mask(text, odd, pa.array(made, pa.string()))
    return text


def canonical_number(c: Column, form: str = "canonical") -> Column:
    """Digits of any double, in Arrow batches."""

    @arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return _digits(x, form)

    return text(c.cast("double"))


def canonical_numbers(c: Column) -> Column:
    """Digits of each double of an array, in Arrow batches."""

    @arrow_udf("array<string>")
    def texts(x: pa.Array) -> pa.Array:
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        return pa.ListArray.from_arrays(x.offsets, _digits(x.values, "canonical"), mask=x.is_null()) if len(x) else pa.array([], pa.list_(pa.string()))

    return texts(c.cast("array<double>"))


def time_text(c: Column, utc: bool) -> Column:
    """ISO 8601 with three digits of a second, or six where three don't do."""
    c = F.to_utc_timestamp(c, F.current_timezone()) if utc else c
    text = F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
    n = F.length(text)
    return F.concat(F.when(n == 19, F.concat(text, F.lit(".000"))).when(n <= 23, F.rpad(text, 23, "0")).otherwise(F.rpad(text, 26, "0")), F.lit("Z" if utc else ""))


def cell(c: Column, kind: T.DataType, delimiter: str = ",", fixed_point: bool = False) -> Column:
    """One cell; null is ``null``."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        text = quote_text(c, delimiter)
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, T.NumericType):
        text = number_text(c, kind, fixed_point)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), time_text(c, isinstance(kind, T.TimestampType)), F.lit('"'))
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit('"'), c.cast("string"), F.lit('T00:00:00.000"'))
    elif isinstance(kind, T.NullType):
        text = F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} is no cell")
    return F.coalesce(text, F.lit("null"))


def leaves(schema: T.StructType, of: Column | None = None) -> list[tuple[Column, T.DataType]]:
    """Leaf columns of nested structs, depth first."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if of is None else of.getField(f.name)
        out += leaves(f.dataType, c) if isinstance(f.dataType, T.StructType) else [(c, f.dataType)]
    return out


def row_line(schema: T.StructType, delimiter: str = ",", fixed_point: bool = False) -> Column:
    """The table row of a record of this schema; structs are groups of columns and must not be null."""
    return F.concat_ws(delimiter, *[cell(c, kind, delimiter, fixed_point) for c, kind in leaves(schema)])


def field_list(schema: T.StructType, delimiter: str = ",") -> str:
    return delimiter.join(scalars.quote_key(f.name) + (f"{{{field_list(f.dataType, delimiter)}}}" if isinstance(f.dataType, T.StructType) else "") for f in schema.fields)


def header_text(key: str | None, n: Column, schema: T.StructType, delimiter: str = ",", length_marker: str = "", keyed: bool = False) -> Column:
    before = f"{scalars.quote_key(key) if key is not None else ''}[{'' if keyed else length_marker}"
    after = f"{':' if keyed else ''}{MARKS[delimiter]}]{{{field_list(schema, delimiter)}}}:"
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def inline_array(key: str | None, c: Column, element: T.DataType, delimiter: str = ",", length_marker: str = "", fixed_point: bool = False) -> Column:
    name = scalars.quote_key(key) if key is not None else ""
    if isinstance(element, (T.FloatType, T.DoubleType)) and not fixed_point:
        values = F.array_join(canonical_numbers(c), delimiter, "null")
    else:
        values = F.array_join(F.transform(c, lambda x: cell(x, element, delimiter, fixed_point)), delimiter)
    some = F.concat(F.lit(f"{name}[{length_marker}"), F.size(c).cast("string"), F.lit(f"{MARKS[delimiter]}]: "), values)
    return F.when(F.size(c) == 0, f"{name}: []" if key is not None else "[]").otherwise(some)


# ---------------------------------------------------------------- reading


def trim_space(c: Column) -> Column:
    return F.rtrim(F.ltrim(c), F.lit(" \r"))


def split_cells(line: Column, delimiter: str = ",") -> Column:
    """Cells of a row, quotes kept; quoted strings may hold the delimiter.  The loops are possessive, so no line is too long."""
    d = _java(delimiter)
    rx = f'{d}((?:"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"|[^{d}"]++)*+)'
    found = F.transform(F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rx), F.lit(1)), trim_space)
    plain = F.transform(F.split(line, d, -1), trim_space)
    return F.when(line == "", F.array().cast("array<string>")).when(line.contains('"'), found).otherwise(plain)


#: numbers with a sign, a bare point, or an exponent without digits or with a point
_LENIENT_RX = r"^[+-]?(?:\.[0-9]+(?:[eE][+-]?[0-9]*)?|(?:0|[1-9][0-9]*)(?:\.[0-9]*(?:[eE][+-]?[0-9]*)?|[eE][+-]?[0-9]*\.?[0-9]*)?)\z"


def looks_numeric(c: Column) -> Column:
    """A looser test than the notation's own, for writers that also count ``+1``, ``.5``, ``1.`` and ``1e`` as numbers."""
    return c.rlike(_LENIENT_RX)


def cells_by_name(line: Column, names: list[str], delimiter: str = ",") -> Column:
    """The cells of a row as a map by name, quotes kept; null where their number is not that of the names."""
    cells = split_cells(line, delimiter)
    return F.when(F.size(cells) == len(names), F.map_from_arrays(F.array(*map(F.lit, names)), cells))


#: text whose escapes are all allowed; a surrogate is none
_ESCAPED_RX = r'(?s)^(?:[^\\]|\\["\\nrt]|\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4})*+$'


def unescape_text(c: Column) -> Column:
    """Reverse of ``escape_text``, with any code of four digits; a text with another escape is null."""
    back = [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')]
    sign = lambda x: F.concat(F.decode(F.unhex(F.left(x, F.lit(4))), "UTF-16BE"), _replace(F.substr(x, F.lit(5)), back))
    coded = lambda p: F.array_join(F.transform(F.split(p, r"\\u", -1), lambda x, i: F.when(i == 0, _replace(x, back)).otherwise(sign(x))), "")
    one = lambda p: F.when(p.contains("\\u"), coded(p)).otherwise(_replace(p, back))
    return F.when(~c.contains("\\"), c).when(c.rlike(_ESCAPED_RX), F.array_join(F.transform(F.split(c, re.escape("\\\\"), -1), one), "\\"))


def parse_cell(c: Column, kind: T.DataType) -> Column:
    """A typed cell: what does not fit the type is null, as is ``null`` itself."""
    quoted = c.startswith('"')
    if isinstance(kind, T.StringType):
        return F.when(quoted, unescape_text(F.substr(c, F.lit(2), F.length(c) - 2))).when(c != "null", c)
    if isinstance(kind, T.BooleanType):
        return F.when(c == "true", True).when(c == "false", False)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.when(quoted, F.substr(c, F.lit(2), F.length(c) - 2).try_cast(kind))
    if isinstance(kind, T.IntegralType):
        x = c.try_cast(kind)
        return F.when((x.cast("string") == c) | c.rlike(scalars.NUMERIC_LITERAL), x)
    if isinstance(kind, T.NumericType):
        return F.when(c.rlike(scalars.NUMERIC_LITERAL), c.try_cast(kind))
    raise TypeError(f"{kind.simpleString()} is no cell")


def split_by_mark(line: Column, mark: Column) -> Column:
    """Cells of a row under a header with this delimiter mark: none, a tab or a pipe."""
    return F.when(mark == "", split_cells(line)).when(mark == "|", split_cells(line, "|")).otherwise(split_cells(line, "\t"))


def typed_cells(parts: Column, schema: T.StructType, at: Column | None = None) -> list[Column]:
    """Typed columns of a row's cells; the leaves take the cells in order, or those at the places ``at``.  Nested structs are rebuilt."""
    k = iter(range(10**6))

    def leaf() -> Column:
        i = F.lit(next(k))
        return F.get(parts, i if at is None else F.get(at, i))

    def build(s: T.StructType) -> list[Column]:
        return [(F.struct(*build(f.dataType)) if isinstance(f.dataType, T.StructType) else parse_cell(leaf(), f.dataType)).alias(f.name) for f in s.fields]

    return build(schema)


def parse_row(line: Column, schema: T.StructType, delimiter: str = ",") -> list[Column]:
    """Typed columns of a row line whose cells are in the schema's order."""
    return typed_cells(split_cells(line, delimiter), schema)


#: parts a path's names; no name that needs no quotes holds it
PATH = "\x1f"
_HEADER_RX = r'^(?:"(?:[^"\\]|\\.)*+"|[^:\["{} ][^:\["{}]*+)?\[#?((?:0|[1-9][0-9]*):?[\t|]?)\]\{(.*)\} *:[ \r]*$'


def leaf_paths(schema: T.StructType, above: tuple[str, ...] = ()) -> list[str]:
    """Paths of the leaves of nested structs, depth first."""
    out: list[str] = []
    for f in schema.fields:
        path = (*above, f.name)
        out += leaf_paths(f.dataType, path) if isinstance(f.dataType, T.StructType) else [PATH.join(path)]
    return out


def header_parts(line: Column) -> Column:
    """(n, keyed, mark, fields) of a table's header line; ``n`` is null for any other line."""
    count, fields = F.regexp_extract(line, _HEADER_RX, 1), F.regexp_extract(line, _HEADER_RX, 2)
    mark = F.when(count.endswith("|"), "|").when(count.endswith("\t"), "\t").when(count.isNotNull(), "")
    return F.struct(F.rtrim(count, F.lit(":|\t")).try_cast("int").alias("n"), count.contains(":").alias("keyed"), mark.alias("mark"), fields.alias("fields"))


def header_paths(parts: Column, usual: T.StructType | None = None) -> Column:
    """Paths of the columns, groups included, of what ``header_parts`` gives, which should be a column, as each token looks at it.

    The field list of ``usual`` is known by its text.
    """
    mark, fields = parts["mark"], parts["fields"]
    sign = F.when(mark == "", ",").otherwise(mark)
    pattern = F.concat(F.lit(r'"(?:[^"\\]|\\.)*+"|[{}'), sign, F.lit(r']|[^"{}'), sign, F.lit("]++"))
    tokens = F.regexp_extract_all(fields, pattern, F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), F.lit(None).cast("string").alias("name"), none.alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["name"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.array_join(F.concat(acc["stack"], F.array(acc["name"])), PATH))))

    def step(acc: Column, t: Column) -> Column:
        plain = trim_space(t)
        name = F.when(plain.startswith('"'), unescape_text(F.substr(plain, F.lit(2), F.length(plain) - 2))).when(plain == "", acc["name"]).otherwise(plain)
        opens, closes, parts = t == "{", t == "}", t == sign
        stack = F.when(opens, F.concat(acc["stack"], F.array(acc["name"]))).when(closes, F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), F.when(~(opens | closes | parts), name).alias("name"), F.when(closes | parts, closed(acc)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(tokens, start, step, closed)
    if usual is None or not usual.fields:
        return found
    known = [(mark == sign_of) & (fields == field_list(usual, d)) for d, sign_of in MARKS.items()]
    return F.when(reduce(lambda a, b: a | b, known), F.array(*map(F.lit, leaf_paths(usual)))).otherwise(found)


def table_header(line: Column) -> Column:
    """(n, keyed, mark, paths) of a table's header line; ``n`` is null for any other line.  ``paths`` are those of the columns, groups included."""
    whole = F.transform(F.array(header_parts(line)), lambda x: F.struct(x["n"].alias("n"), x["keyed"].alias("keyed"), x["mark"].alias("mark"), header_paths(x).alias("paths")))
    return F.get(whole, F.lit(0))


def line_type(c: Column, delimiter: str = ",") -> Column:
    """blank, listItem, arrayHeader, keyValue, dataRow or primitive, for lines without odd headers."""
    x = F.regexp_replace(c, "^[ \\t]+|[ \\t\\r]+$", "")
    name = r'(?:"(?:[^"\\]|\\.)*+"|[^:\["]*+)'
    header = rf"^{name}\[#?(?:0|[1-9][0-9]*):?[\t|]?\](?:\{{.*\}} *)?:"
    key = r'^(?:"(?:[^"\\]|\\.)*+" *:|(?:[^:"]|"(?:[^"\\]|\\.)*+")*+:)'
    return F.when(x == "", "blank").when((x == "-") | x.startswith("- "), "listItem").when(x.rlike(header), "arrayHeader").when(x.rlike(key), "keyValue").when(x.contains(delimiter), "dataRow").otherwise("primitive")


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)


#: fixed values of the size estimate: an object, a key's surroundings, an array, an element, a cell, a string's surroundings
ESTIMATE = {"object": 64, "key": 8, "array": 64, "element": 16, "cell": 16, "string": 4, "other": 16}


def estimate_size(schema: T.StructType, of: Column | None = None) -> Column:
    """Estimated characters of a record's document, from its keys and the lengths of its strings and arrays."""
    total = F.lit(ESTIMATE["object"])
    for f in schema.fields:
        c, kind = F.col(f"`{f.name}`") if of is None else of.getField(f.name), f.dataType
        other = F.lit(ESTIMATE["other"])
        if isinstance(kind, T.StructType):
            size = F.when(c.isNull(), other).otherwise(estimate_size(kind, c))
        elif isinstance(kind, T.ArrayType):
            each = len(kind.elementType.fields) * ESTIMATE["cell"] + ESTIMATE["element"] if isinstance(kind.elementType, T.StructType) else ESTIMATE["element"]
            size = F.when(c.isNull(), other).otherwise(F.size(c) * each + ESTIMATE["array"])
        elif isinstance(kind, T.StringType):
            size = F.coalesce(F.char_length(c) + ESTIMATE["string"], other)
        else:
            size = other
        total = total + (len(f.name) + ESTIMATE["key"]) + size
    return total


# ---------------------------------------------------------------- objects


def _is_cell(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType))


def _may_be_keyed(schema: T.StructType) -> bool:
    """Could a record of this schema be a table by key, which depends on its values?"""
    inner = [f.dataType for f in schema.fields]
    return len(inner) >= 2 and all(isinstance(k, T.StructType) for k in inner) and len({frozenset(k.names) for k in inner}) == 1


def has_native_object(schema: T.DataType) -> bool:
    """Does the schema alone decide the form of its documents: cells, arrays of cells, and objects of such?"""
    if not isinstance(schema, T.StructType) or not schema.fields or _may_be_keyed(schema):
        return False
    return all(_is_cell(f.dataType) or isinstance(f.dataType, T.ArrayType) and _is_cell(f.dataType.elementType) or has_native_object(f.dataType) for f in schema.fields)


def object_text(schema: T.StructType, of: Column | None = None, indent: int = 2, delimiter: str = ",", length_marker: str = "", depth: int = 0, fixed_point: bool = False) -> Column:
    """The document of a record, by native expressions, for schemas that ``has_native_object`` accepts; doubles as in ``number_text``."""
    if not has_native_object(schema):
        raise TypeError(f"the values of {schema.simpleString()} decide the form of its documents")
    pad, parts = " " * (indent * depth), []
    for f in schema.fields:
        c, kind, name = F.col(f"`{f.name}`") if of is None else of.getField(f.name), f.dataType, scalars.quote_key(f.name)
        null = F.lit(f"{pad}{name}: null")
        if isinstance(kind, T.StructType):
            inner = object_text(kind, c, indent, delimiter, length_marker, depth + 1, fixed_point)
            parts.append(F.when(c.isNull(), null).otherwise(F.concat(F.lit(f"{pad}{name}:\n"), inner)))
        elif isinstance(kind, T.ArrayType):
            parts.append(F.coalesce(F.concat(F.lit(pad), inline_array(f.name, c, kind.elementType, delimiter, length_marker, fixed_point)), null))
        else:
            parts.append(F.concat(F.lit(f"{pad}{name}: "), cell(c, kind, delimiter, fixed_point)))
    return F.concat_ws("\n", *parts)


def _typed(kind: T.DataType):
    return lambda x: parse_cell(x, kind)


def parse_object(doc: Column, schema: T.StructType, delimiter: str = ",") -> list[Column]:
    """Typed columns of a document of cells and inline arrays at the margin, without Python.

    It reads what ``object_text`` writes for such a schema; a field that is missing, or that another
    writer lays out in another way, is null.  Other documents are for the kernel.
    """
    out = []
    lines = F.concat(F.lit("\n"), doc)
    for f in schema.fields:
        name = re.escape(scalars.quote_key(f.name))
        if isinstance(f.dataType, T.ArrayType):
            head = rf"\n{name}(?:: \[\]|\[#?[0-9]+{_java(delimiter) if delimiter != ',' else ''}\]: ([^\n\r]*+))"
            element = f.dataType.elementType
            values = F.transform(split_cells(F.regexp_extract(lines, head, 1), delimiter), _typed(element))
            out.append(F.when(lines.rlike(head), values).alias(f.name))
        else:
            rx = rf"\n{name}: ([^\n\r]*+)"
            out.append(F.when(lines.rlike(rx), parse_cell(trim_space(F.regexp_extract(lines, rx, 1)), f.dataType)).alias(f.name))
    return out
