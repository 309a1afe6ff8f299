"""Arrow batches to plain values, and tables by column straight from and to their buffers."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from compactcodec.kernel.binary import ARRAY, DTYPES, ELEMENT_CODES, ELEMENT_NAMES, MAGIC, OBJECT_TABLE, STRING, VERSION, dumps

_HEAD = MAGIC + bytes([VERSION, 0, 0, 0])
_SIZES = struct.Struct("<BII")
_UNSIGNED, _SIGNED = ("uint8", "uint16", "uint32", "uint64"), ("int8", "int16", "int32", "int64")
_TARGETS = {T.ByteType: "i1", T.ShortType: "i2", T.IntegerType: "i4", T.LongType: "i8", T.FloatType: "f4", T.DoubleType: "f8"}


def plain(x: pa.Array) -> list:
    """The same as ``to_pylist``, with lists and records made column by column."""
    kind = x.type
    if isinstance(x, pa.ChunkedArray):
        return plain(x.combine_chunks()) if x.num_chunks else []
    if pa.types.is_list(kind):
        cuts = x.offsets.to_numpy().tolist()
        values = plain(x.values.slice(cuts[0], cuts[-1] - cuts[0])) if len(x) else []
        out = [values[a - cuts[0] : b - cuts[0]] for a, b in zip(cuts, cuts[1:])]
    elif pa.types.is_struct(kind) and len({f.name for f in kind}) == len(kind) > 0:
        names = [f.name for f in kind]
        out = [dict(zip(names, row)) for row in zip(*map(plain, x.flatten()), strict=True)]
    else:
        return x.to_pylist()
    return [v if ok else None for v, ok in zip(out, x.is_valid().to_pylist())] if x.null_count else out


def is_table(kind: pa.DataType) -> bool:
    """Are the values lists of flat records of numbers?"""
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return False
    fields = list(kind.value_type)
    numbers = all(pa.types.is_signed_integer(f.type) or pa.types.is_float32(f.type) or pa.types.is_float64(f.type) for f in fields)
    return 0 < len(fields) == len({f.name for f in fields}) and numbers


def _elements(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The code of the narrowest element type of each stretch of a column."""
    if values.dtype.kind == "f":
        with np.errstate(over="ignore"):
            fits = np.logical_and.reduceat(values.astype("f4") == values, cuts)
        return np.where(fits, ELEMENT_CODES["float32"], ELEMENT_CODES["float64"])
    low, high = np.minimum.reduceat(values, cuts).astype("i8"), np.maximum.reduceat(values, cuts).astype("i8")
    unsigned = np.array([ELEMENT_CODES[e] for e in _UNSIGNED])[np.searchsorted([2**8 - 1, 2**16 - 1, 2**32 - 1], high)]
    signed = np.array([ELEMENT_CODES[e] for e in _SIGNED])[np.searchsorted([2**7 - 1, 2**15 - 1, 2**31 - 1], np.maximum(~low, high))]
    return np.where(low < 0, signed, unsigned)


def dump_tables(x: pa.ListArray) -> list[bytes | None]:
    """The messages of lists of records of numbers, byte for byte those of the kernel, which writes the lists with nulls in them."""
    ends = x.offsets.to_numpy().astype("i8")
    rows, ends = x.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
    filled = np.flatnonzero(np.diff(ends))
    if not len(filled):
        return [None if v is None else dumps(v) for v in plain(x)]
    cuts, columns, gaps = ends[:-1][filled], [], np.zeros(len(filled), bool)
    for f, child in sorted(zip(rows.type, rows.flatten(), strict=True), key=lambda p: p[0].name):
        if child.null_count:
            gaps |= np.logical_or.reduceat(child.is_null().to_numpy(zero_copy_only=False), cuts)
            child = child.fill_null(0)
        values, name = child.to_numpy(zero_copy_only=False), f.name.encode()
        codes = _elements(values, cuts)
        with np.errstate(over="ignore", invalid="ignore"):
            data = {c: memoryview(values.astype(DTYPES[ELEMENT_NAMES[c]]).tobytes()) for c in np.unique(codes).tolist()}
        columns.append((struct.pack("<BI", STRING, len(name)) + name, codes.tolist(), data))
    sizes = {c: DTYPES[n].itemsize for c, n in ELEMENT_NAMES.items() if n in DTYPES}
    out: list[bytes | None] = [None] * len(x)
    valid, places = x.is_valid().to_pylist(), ends.tolist()
    for k, i in enumerate(filled.tolist()):
        if not valid[i] or gaps[k]:
            continue
        a, b = places[i], places[i + 1]
        message = bytearray(_HEAD)
        message += _SIZES.pack(OBJECT_TABLE, b - a, len(columns))
        for name, codes, data in columns:
            code = codes[k]
            size = sizes[code]
            message += name
            message.append(code)
            # the head's eight bytes do not change the alignment
            pad = -(len(message) + 1) % size
            message.append(pad)
            message += bytes(pad)
            message += data[code][a * size : b * size]
        out[i] = bytes(message)
    rest = [i for i, m in enumerate(out) if m is None and valid[i]]
    for i, v in zip(rest, plain(x.take(pa.array(rest, pa.int64()))), strict=True):
        out[i] = dumps(v)
    return out


def has_table(kind: T.DataType) -> bool:
    """Is the type a list of flat records of numbers?"""
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return False
    fields = kind.elementType.fields
    return 0 < len(fields) == len({f.name for f in fields}) and all(type(f.dataType) in _TARGETS for f in fields)


def _columns(raw: bytes) -> tuple[int, dict[bytes, np.ndarray]] | None:
    """Rows and columns of a message that is an empty list, or one table with its names in place; None if it is neither, or is broken."""
    if raw[:13] == _HEAD + bytes([ARRAY, 0, 0, 0, 0]):
        return 0, {}
    if raw[:8] != _HEAD or len(raw) < 17 or raw[8] != OBJECT_TABLE:
        return None
    _, n, width = _SIZES.unpack_from(raw, 8)
    at, out = 17, {}
    for _ in range(width):
        if at + 5 > len(raw) or raw[at] != STRING:
            return None
        start = at + 5
        end = start + int.from_bytes(raw[at + 1 : start], "little")
        if end + 2 > len(raw) or raw[end + 1] > 7:
            return None
        kind = DTYPES.get(ELEMENT_NAMES.get(raw[end]))
        data = end + 2 + raw[end + 1]
        if kind is None or data + n * kind.itemsize > len(raw):
            return None
        out[raw[start:end]] = np.frombuffer(raw, kind, n, data)
        at = data + n * kind.itemsize
    return (n, out) if width else None


def load_tables(messages: list[bytes | None], kind: T.ArrayType) -> pa.ListArray | None:
    """Tables by column as lists of records; None if a message is anything else or a value does not fit, which the kernel then judges."""
    fields, parts, counts = kind.elementType.fields, [], []
    names = [f.name.encode() for f in fields]
    for m in messages:
        found = (0, {}) if m is None else _columns(m)
        if found is None or found[0] and found[1].keys() != set(names):
            return None
        counts.append(found[0])
        if found[0]:
            parts.append(found[1])
    children = []
    for f, name in zip(fields, names, strict=True):
        target, pieces = np.dtype(_TARGETS[type(f.dataType)]), [p[name] for p in parts]
        if target.kind == "i":
            if any(p.dtype.kind == "f" or p.dtype == "u8" and int(p.max()) >> 63 for p in pieces):
                return None
            whole = np.concatenate([np.empty(0, "i8"), *pieces], dtype="i8", casting="unsafe")
            limits = np.iinfo(target)
            if len(whole) and not limits.min <= whole.min() <= whole.max() <= limits.max:
                return None
        else:
            whole = np.concatenate([np.empty(0, "f8"), *pieces], dtype="f8", casting="unsafe")
        with np.errstate(over="ignore"):
            children.append(pa.array(whole.astype(target)))
    want = to_arrow_type(kind)
    rows = pa.StructArray.from_arrays(children, fields=list(want.value_type))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    mask = pa.array([m is None for m in messages], pa.bool_()) if None in messages else None
    return pa.ListArray.from_arrays(offsets, rows, type=want, mask=mask)
