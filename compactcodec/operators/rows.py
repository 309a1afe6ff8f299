"""Table functions over documents: rows, items, raw rows and lines, one document at a time."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from compactcodec.kernel import stream, text


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


@udtf(returnType="row_idx int, row string")
class CtextRows:
    """Rows of the first table of a document, or of the table with a key, as JSON; ``names`` replace those of its header."""

    def eval(self, doc: str, key: str = None, names: list = None):  # noqa: RUF013
        for i, r in enumerate(stream.rows(doc or "", key, list(names) if names else None)):
            yield i, _json(r)


@udtf(returnType="item_idx int, item string")
class CtextItems:
    """Items of the first array of a document, or of the array with a key, as JSON."""

    def eval(self, doc: str, key: str = None):  # noqa: RUF013
        for i, x in enumerate(stream.items(doc or "", key)):
            yield i, _json(x)


@udtf(returnType="row_idx int, line string, cells array<string>")
class CtextRawRows:
    """Row lines and their cells, not typed."""

    def eval(self, doc: str, key: str = None):  # noqa: RUF013
        for i, (line, cells) in enumerate(zip(stream.raw_rows(doc or "", key), stream.raw_cells(doc or "", key), strict=True)):
            yield i, line, cells


@udtf(returnType="line_no int, depth int, content string, line_type string")
class CtextLines:
    """Lines of a document that count."""

    def eval(self, doc: str):
        for x in text.scan(doc or "", strict=False)[0]:
            yield x.number, x.depth, x.content, stream.line_type(x.content)


FUNCTIONS = {"ctext_rows": CtextRows, "ctext_items": CtextItems, "ctext_raw_rows": CtextRawRows, "ctext_lines": CtextLines}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)


def lateral(docs: DataFrame, column: str, function: str, key: str | None = None, keep: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """``keep`` and the columns of a table function applied to each document."""
    register(docs.sparkSession)
    args = [F.col(column).outer()] + ([F.lit(key)] if function != "ctext_lines" else []) + ([F.array(*map(F.lit, names))] if names else [])
    return docs.lateralJoin(FUNCTIONS[function](*args)).select(*(keep or []), *_columns(function))


def _columns(function: str) -> list[Column]:
    names = {"ctext_rows": ["row_idx", "row"], "ctext_items": ["item_idx", "item"], "ctext_raw_rows": ["row_idx", "line", "cells"], "ctext_lines": ["line_no", "depth", "content", "line_type"]}
    return [F.col(n) for n in names[function]]


def chunks(rows: DataFrame, by: list[str], index: str, size: int = 100) -> DataFrame:
    """Rows of each document in lists of ``size``, the last one shorter: by, chunk, rows."""
    value = F.struct(*[c for c in rows.columns if c not in by])
    return rows.groupBy(*by, F.floor(F.col(index) / size).alias("chunk")).agg(F.sort_array(F.collect_list(value)).alias("rows"))
