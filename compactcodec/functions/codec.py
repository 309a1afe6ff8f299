"""Whole documents and messages as column functions, run by the kernels in Arrow batches."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from compactcodec.functions.batches import dump_tables, has_table, is_table, load_tables, plain
from compactcodec.kernel import binary, text
from compactcodec.kernel.scalars import CodecError


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


#: bytes of values, documents or messages that are Python objects at a time; as objects they take some ten times that
SLICE = 2 << 20


def _slices(x: pa.Array) -> Iterator[pa.Array]:
    """An array in slices of about ``SLICE`` bytes, one value at least: a batch has up to 10,000 values of any size."""
    if isinstance(x, pa.ChunkedArray):
        for chunk in x.chunks:
            yield from _slices(chunk)
    elif len(x):
        todo = [(0, len(x))]
        while todo:
            start, n = todo.pop()
            part = x.slice(start, n)
            if n == 1 or part.nbytes <= SLICE:
                yield part
            else:
                todo += [(start + n // 2, n - n // 2), (start, n // 2)]


def _sliced(x: pa.Array, kind: pa.DataType, of) -> pa.Array:
    """``of`` each slice, which is a list or an array of the type, put together."""
    made = [v if isinstance(v := of(part), pa.Array) else pa.array(v, kind) for part in _slices(x)]
    return made[0] if len(made) == 1 else pa.concat_arrays(made) if made else pa.array([], kind)


def to_ctext(c: Column, indent: int = 2, delimiter: str = ",", length_marker: str = "", json_input: bool = False) -> Column:
    """The document of each value, of any type; with ``json_input`` the column holds JSON text, whose key order counts."""

    @arrow_udf("string")
    def encode(x: pa.Array) -> pa.Array:
        return _sliced(x, pa.string(), lambda part: [None if v is None else text.dumps(json.loads(v) if json_input else v, indent, delimiter, length_marker) for v in plain(part)])

    return encode(c)


#: what a document or message of foreign origin can raise
BROKEN = (CodecError, ValueError, TypeError, ArithmeticError, RecursionError)
_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _fitter(kind: T.DataType):
    """A function that gives a decoded value as the type asks; a value of another kind is an error."""
    if isinstance(kind, T.StructType):
        fields = [(f.name, _fitter(f.dataType)) for f in kind.fields]

        def fit(x):
            if not isinstance(x, dict):
                raise CodecError("no object")
            return {name: None if (v := x.get(name)) is None else of(v) for name, of in fields}

    elif isinstance(kind, T.MapType):
        each = _fitter(kind.valueType)

        def fit(x):
            if not isinstance(x, dict):
                raise CodecError("no object")
            return [(k, None if v is None else each(v)) for k, v in x.items()]

    elif isinstance(kind, T.ArrayType):
        each = _fitter(kind.elementType)

        def fit(x):
            if not isinstance(x, list):
                raise CodecError("no array")
            return [None if v is None else each(v) for v in x]

    elif isinstance(kind, T.StringType):

        def fit(x):
            return x if isinstance(x, str) else _json(x)

    elif isinstance(kind, T.BooleanType):

        def fit(x):
            if not isinstance(x, bool):
                raise CodecError("no boolean")
            return x

    elif isinstance(kind, T.IntegralType):
        least, beyond = -(1 << _RANGES[type(kind)]), 1 << _RANGES[type(kind)]

        def fit(x):
            if type(x) is not int and (isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x)):
                raise CodecError("no integer")
            if not least <= x < beyond:
                raise CodecError("an integer out of range")
            return int(x)

    elif isinstance(kind, (T.FloatType, T.DoubleType)):

        def fit(x):
            if isinstance(x, bool) or not isinstance(x, (int, float)):
                raise CodecError("no number")
            return float(x)

    elif isinstance(kind, T.BinaryType):

        def fit(x):
            if not isinstance(x, bytes):
                raise CodecError("no bytes")
            return x

    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):

        def fit(x):
            if not isinstance(x, str):
                raise CodecError("no time")
            found = datetime.datetime.fromisoformat(x)
            return found.date() if isinstance(kind, T.DateType) else found

    elif isinstance(kind, T.DecimalType):
        unit, context = decimal.Decimal(1).scaleb(-kind.scale), decimal.Context(prec=40)

        def fit(x):
            found = decimal.Decimal(str(x)).quantize(unit, context=context)
            if not found.is_finite() or found and found.adjusted() >= kind.precision - kind.scale:
                raise CodecError("a decimal out of range")
            return found

    else:

        def fit(x):
            raise CodecError(f"no {kind.simpleString()}")

    return fit


def _schema(schema: T.DataType | str) -> T.DataType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def _decoded(values: list, kind: T.DataType, decode, mode: str) -> pa.Array:
    out, fit = [], _fitter(kind)
    for v in values:
        try:
            found = None if v is None else decode(v)
            out.append(None if found is None else fit(found))
        except BROKEN:
            if mode == "FAILFAST":
                raise
            out.append(None)
    return pa.array(out, to_arrow_type(kind))


def from_ctext(c: Column, schema: T.DataType | str, indent: int = 2, strict: bool = True, mode: str = "PERMISSIVE") -> Column:
    """Documents as values of a type; a broken one is null, or with ``FAILFAST`` an error."""
    kind = _schema(schema)

    @arrow_udf(kind)
    def decode(x: pa.Array) -> pa.Array:
        return _sliced(x, to_arrow_type(kind), lambda part: _decoded(part.to_pylist(), kind, lambda v: text.loads(v, indent, strict), mode))

    return decode(c)


def from_ctext_json(c: Column, indent: int = 2, strict: bool = True) -> Column:
    """Documents as JSON text with their key order; broken ones are null."""

    @arrow_udf("string")
    def decode(x: pa.Array) -> pa.Array:
        def one(v):
            try:
                return None if v is None else _json(text.loads(v, indent, strict))
            except BROKEN:
                return None

        return _sliced(x, pa.string(), lambda part: [one(v) for v in part.to_pylist()])

    return decode(c)


def is_valid_ctext(c: Column, indent: int = 2, strict: bool = True) -> Column:
    """Does the document read without an error?"""

    @arrow_udf("boolean")
    def check(x: pa.Array) -> pa.Array:
        def one(v):
            try:
                text.loads(v, indent, strict)
            except BROKEN:
                return False
            return True

        return pa.array([None if v is None else one(v) for v in x.to_pylist()], pa.bool_())

    return check(c)


def to_cbin(c: Column, schema: binary.BinSchema | str | None = None, element: str | None = None, **options) -> Column:
    """The message of each value; ``schema`` may be a schema or ``auto``.

    With ``element`` the column holds arrays of numbers, and each is a typed array of that element; a
    number that does not fit is an error.  Lists of records of numbers go from Arrow's buffers to the message's columns."""

    @arrow_udf("binary")
    def encode(x: pa.Array) -> pa.Array:
        def one(v):
            v = v if element is None else binary.TypedArray(v, element)
            return binary.dumps(v, schema=binary.derive_schema(v) if schema == "auto" else schema, **options)

        by_column = schema is None and element is None and not options and is_table(x.type)
        return _sliced(x, pa.binary(), lambda part: dump_tables(part) if by_column else [None if v is None else one(v) for v in plain(part)])

    return encode(c)


def from_cbin(c: Column, schema: T.DataType | str, bin_schema: binary.BinSchema | None = None, mode: str = "PERMISSIVE") -> Column:
    """Messages as values of a type; a broken one is null, or with ``FAILFAST`` an error."""
    kind = _schema(schema)

    @arrow_udf(kind)
    def decode(x: pa.Array) -> pa.Array:
        def one(v):
            found = binary.loads(v, schema=bin_schema)
            return [found] if isinstance(kind, T.ArrayType) and isinstance(found, dict) else found

        def some(part):
            messages = part.to_pylist()
            whole = load_tables(messages, kind) if bin_schema is None and has_table(kind) else None
            return _decoded(messages, kind, one, mode) if whole is None else whole

        return _sliced(x, to_arrow_type(kind), some)

    return decode(c)


def derive_schema(df: DataFrame) -> binary.BinSchema:
    """Sorted columns, each with the type of a value that is not null; one row of them reaches the driver."""
    first = df.agg(F.count("*"), *[F.first(F.col(f"`{c}`"), ignorenulls=True) for c in df.columns]).head()
    return binary.derive_schema([dict(zip(df.columns, first[1:], strict=True))] if first[0] else [])


def string_table(df: DataFrame, columns: list[str], order: list[str], least: int = 2) -> DataFrame:
    """(entry, n, place): the string table of text columns over a whole frame, as the kernel would make it.

    Strings that occur ``least`` times or more, in the order of their first places: rows by ``order``,
    columns as listed.  Counts and first places are one aggregate; only the table's own entries are put
    in order.
    """
    place = lambda k: F.struct(*order, F.lit(k).alias("k"))
    each = F.explode(F.array(*[F.struct(F.col(f"`{c}`").alias("entry"), place(k).alias("at")) for k, c in enumerate(columns)]))
    found = df.select(each.alias("x")).select("x.*").where("entry is not null").groupBy("entry").agg(F.count("*").alias("n"), F.min("at").alias("at")).where(F.col("n") >= least)
    return found.select("entry", "n", (F.row_number().over(Window.orderBy("at")) - 1).alias("place"))


def column_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each number column its least and largest value, whether it has nulls, and whether 32 bits hold all its doubles; what a table by column needs to choose its element types."""
    out = []
    for c in columns:
        x = F.col(f"`{c}`")
        out += [F.min(x).alias(f"{c}.min"), F.max(x).alias(f"{c}.max"), (F.count(x) < F.count("*")).alias(f"{c}.nulls")]
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            out.append(F.coalesce(F.bool_and(~F.isnan(x) & (x.cast("float").cast("double") == x)), F.lit(False)).alias(f"{c}.float32"))
    return df.agg(*out)


def _kind(x) -> T.DataType:
    if isinstance(x, dict):
        return T.StructType([T.StructField(k, _kind(v)) for k, v in x.items()])
    if isinstance(x, list):
        return T.ArrayType(_merge([_kind(v) for v in x]))
    return T.NullType() if x is None else T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()


def _merge(kinds: list[T.DataType]) -> T.DataType:
    out: T.DataType = T.NullType()
    for k in kinds:
        if isinstance(out, T.NullType) or out == k:
            out = k
        elif isinstance(k, T.NullType):
            continue
        elif isinstance(out, T.StructType) and isinstance(k, T.StructType):
            names = list(dict.fromkeys(out.names + k.names))
            out = T.StructType([T.StructField(n, _merge([s[n].dataType for s in (out, k) if n in s.names])) for n in names])
        elif isinstance(out, T.ArrayType) and isinstance(k, T.ArrayType):
            out = T.ArrayType(_merge([out.elementType, k.elementType]))
        elif {type(out), type(k)} == {T.LongType, T.DoubleType}:
            out = T.DoubleType()
        else:
            out = T.StringType()
    return out


def infer_schema(docs: DataFrame, column: str, sample: int | None = None, **options) -> T.DataType:
    """The type that holds all the documents, or at most ``sample`` of them; one type a task reaches the driver.

    Fields are in the order of the partitions that hold them first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: T.DataType = T.NullType()
        for batch in batches:
            for doc in batch.column(0):
                out = _merge([out, _kind(text.loads(doc.as_py(), **options))])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([out.json()])], ["part", "kind"])

    known = docs.select(column).where(f"`{column}` is not null")
    rows = (known if sample is None else known.limit(sample)).mapInArrow(run, "part long, kind string").collect()
    return _merge([T._parse_datatype_json_string(r["kind"]) for r in sorted(rows, key=lambda r: r["part"])])
