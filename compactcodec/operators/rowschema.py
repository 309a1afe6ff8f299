"""Row schemas: records as positional lists, flattened paths, and enumerations as codes.

Each schema gives Column expressions for both directions and the same rules on Python records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec.kernel import text
from compactcodec.kernel.scalars import parse_token, split_cells

#: declared types and what they accept; null is always accepted
ACCEPTS = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "any": lambda x: True,
}
SPARK_KINDS = {"string": T.StringType, "integer": T.IntegralType, "number": T.NumericType, "boolean": T.BooleanType, "null": T.NullType, "object": (T.StructType, T.MapType), "array": T.ArrayType, "any": T.DataType}


@dataclass(frozen=True)
class SchemaField:
    name: str
    kind: str = "any"
    required: bool = False


@dataclass(frozen=True)
class RowSchema:
    """Fields by position."""

    fields: tuple[SchemaField, ...]

    @classmethod
    def named(cls, *names: str, **options):
        return cls(tuple(map(SchemaField, names)), **options)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def encode(self, record: dict) -> list:
        """Values by position; what is missing is null, what is not declared goes."""
        return [record.get(n) for n in self.names]

    def decode(self, values: list) -> dict:
        """As many fields as there are values."""
        return dict(zip(self.names, values))  # noqa: B905

    def matches(self, record: dict) -> bool:
        for f in self.fields:
            if f.name not in record:
                if f.required:
                    return False
            elif record[f.name] is not None and not ACCEPTS[f.kind](record[f.name]):
                return False
        return True

    def matches_all(self, records: list[dict]) -> bool:
        return all(map(self.matches, records))

    def to_columns(self, df: DataFrame) -> list[Column]:
        """The declared columns in order, null where the frame has none."""
        return [(F.col(f"`{n}`") if n in df.columns else F.lit(None)).alias(n) for n in self.names]

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*self.to_columns(df))

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{n}`") for n in self.names if n in df.columns])

    def matches_frame(self, df: DataFrame) -> Column:
        """Whether a row fits, decided from the frame's types and the row's nulls."""
        ok = F.lit(True)
        for f in self.fields:
            if f.name not in df.columns:
                ok = ok & F.lit(not f.required)
            elif not isinstance(df.schema[f.name].dataType, SPARK_KINDS[f.kind]):
                ok = ok & F.col(f"`{f.name}`").isNull()
        return ok


@dataclass(frozen=True)
class FlattenedSchema(RowSchema):
    """Fields are dotted paths into nested records."""

    def encode(self, record: dict) -> list:
        def get(path: str):
            x = record
            for part in path.split("."):
                x = x.get(part) if isinstance(x, dict) else None
            return x

        return [get(n) for n in self.names]

    def decode(self, values: list) -> dict:
        out: dict = {}
        for path, v in zip(self.names, values):  # noqa: B905
            *groups, last = path.split(".")
            x = out
            for g in groups:
                if not isinstance(x.get(g), dict):
                    x[g] = {}
                x = x[g]
            x[last] = v
        return out

    def to_columns(self, df: DataFrame) -> list[Column]:
        def has(kind: T.DataType, path: list[str]) -> bool:
            return not path or isinstance(kind, T.StructType) and path[0] in kind.names and has(kind[path[0]].dataType, path[1:])

        quoted = lambda n: ".".join(f"`{p}`" for p in n.split("."))
        return [(F.col(quoted(n)) if has(df.schema, n.split(".")) else F.lit(None)).alias(n) for n in self.names]

    def restore(self, df: DataFrame) -> DataFrame:
        """Nested structs from flat columns with dotted names."""
        tree: dict = {}
        for n in self.names:
            *groups, last = n.split(".")
            x = tree
            for g in groups:
                x = x.setdefault(g, {})
            x[last] = F.col(f"`{n}`")

        def build(x: dict) -> list[Column]:
            return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in x.items()]

        return df.select(*build(tree))


@dataclass(frozen=True)
class EnumSchema(RowSchema):
    """Text of some fields as integer codes; what has no code passes as it is.

    In a column codes and text share one type, so there text without a code that could be taken for
    one gets a backslash in front, which decoding takes off.
    """

    codes: dict[str, dict[str, int]] = field(default_factory=dict)

    def encode(self, record: dict) -> list:
        return [self.codes.get(n, {}).get(v, v) if isinstance(v := record.get(n), str) else v for n in self.names]

    def decode(self, values: list) -> dict:
        back = {n: {c: s for s, c in m.items()} for n, m in self.codes.items()}
        return {n: back.get(n, {}).get(v, v) if isinstance(v, int) and not isinstance(v, bool) else v for n, v in zip(self.names, values)}  # noqa: B905

    def to_columns(self, df: DataFrame) -> list[Column]:
        """Coded fields are text of the code, or the value where it has none."""
        plain = lambda c: F.when(c.rlike(_CODE_LIKE), F.concat(F.lit("\\"), c)).otherwise(c)
        return [F.coalesce(_lookup(self.codes[n], F.col(f"`{n}`")), plain(F.col(f"`{n}`"))).alias(n) if n in self.codes and n in df.columns else c for n, c in zip(self.names, super().to_columns(df), strict=True)]

    def restore(self, df: DataFrame) -> DataFrame:
        plain = lambda c: F.when(c.rlike(_CODE_LIKE) & c.startswith("\\"), F.substr(c, F.lit(2))).otherwise(c)
        back = lambda n: _lookup({str(c): s for s, c in self.codes[n].items()}, F.col(f"`{n}`"))
        return df.select(*[F.coalesce(back(n), plain(F.col(f"`{n}`"))).alias(n) if n in self.codes else F.col(f"`{n}`") for n in self.names])


#: digits, as a code has them, behind any number of backslashes
_CODE_LIKE = r"^\\*-?[0-9]+$"


def _lookup(codes: dict, c: Column) -> Column:
    pairs = [F.lit(x) for k, v in codes.items() for x in (k, str(v))]
    return F.try_element_at(F.create_map(*pairs), c)


class Registry:
    """Schemas by name, on the driver."""

    def __init__(self):
        self._schemas: dict[str, RowSchema] = {}

    def register(self, name: str, schema: RowSchema) -> None:
        self._schemas[name] = schema

    def get(self, name: str) -> RowSchema | None:
        return self._schemas.get(name)

    def has(self, name: str) -> bool:
        return name in self._schemas

    def remove(self, name: str) -> bool:
        return self._schemas.pop(name, None) is not None

    def clear(self) -> None:
        self._schemas.clear()

    def names(self) -> list[str]:
        return list(self._schemas)

    def __len__(self) -> int:
        return len(self._schemas)


def encode_with_schema(key: str | None, records: list[dict], schema: RowSchema, indent: int = 2, delimiter: str = ",") -> str:
    """A table document by a schema, without looking at the records' shape; keys and names are quoted as need be."""
    w = text.Writer(indent, delimiter)
    w.line(0, w.header(key, len(records), tuple(text.Field(n) for n in schema.names)))
    for r in records:
        w.line(1, w.row(schema.encode(r)))
    return "\n".join(w.lines)


def decode_with_schema(rows: list[str], schema: RowSchema, delimiter: str = ",", decode: str = "names") -> list[dict]:
    """Records of row lines: by the schema's names alone, or with ``schema`` by its own decoding."""
    values = [[parse_token(c) for c in split_cells(r, delimiter)] for r in rows]
    return [dict(zip(schema.names, v)) if decode == "names" else schema.decode(v) for v in values]  # noqa: B905
