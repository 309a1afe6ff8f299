"""Tables to documents and back.

A document is one value, so only what belongs together by nature becomes one: a bounded table, the
rows of a group, or the rows of a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec.functions.columns import header_parts, header_paths, header_text, leaf_paths, parse_row, quote_key_text, row_line, split_by_mark, trim_space, typed_cells


def _body(lines: Column, indent: int) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(" " * indent), x)), "\n")


def _ordered(order: list[str], line: Column) -> Column:
    """Lines of a group by ``order``; only the group's own rows meet."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("__line"))))
    return F.transform(rows, lambda r: r["__line"])


def encode_rows(df: DataFrame, columns: list[str] | None = None, delimiter: str = ",", keep: list[str] | None = None, fixed_point: bool = False) -> DataFrame:
    """``keep`` and ``line``: the table row of each record.  ``fixed_point`` as in ``number_text``, here and below."""
    part = df.select(*(columns or df.columns))
    return df.select(*(keep or []), row_line(part.schema, delimiter, fixed_point).alias("line"))


def encode_groups(df: DataFrame, by: list[str], order: list[str], key: str | None = None, columns: list[str] | None = None, delimiter: str = ",", length_marker: str = "", indent: int = 2, fixed_point: bool = False) -> DataFrame:
    """``by`` and ``document``: a table document of each group's rows, in order.

    A document is one value of one task; for groups beyond that, ``sources.write_tables`` writes files.
    """
    names = columns or [c for c in df.columns if c not in by]
    schema = df.select(*names).schema
    lined = df.select(*by, *[c for c in order if c not in by], row_line(schema, delimiter, fixed_point).alias("__line"))
    grouped = lined.groupBy(*by).agg(_ordered(order, F.col("__line")).alias("__lines"))
    document = F.concat(header_text(key, F.size("__lines"), schema, delimiter, length_marker), F.lit("\n"), _body(F.col("__lines"), indent))
    return grouped.select(*by, document.alias("document"))


def encode_table(df: DataFrame, order: list[str], key: str | None = None, **options) -> DataFrame:
    """One document of a table that fits a value; an empty table gives no row."""
    return encode_groups(df.withColumn("__all", F.lit(1)), ["__all"], order, key, df.columns, **options).select("document")


def encode_keyed(df: DataFrame, entry: str, key: str | None = None, columns: list[str] | None = None, delimiter: str = ",", indent: int = 2, fixed_point: bool = False) -> DataFrame:
    """One document that maps each ``entry`` to its record, by entry."""
    names = columns or [c for c in df.columns if c != entry]
    schema = df.select(*names).schema
    line = F.concat(quote_key_text(F.col(entry).cast("string")), F.lit(": "), row_line(schema, delimiter, fixed_point))
    grouped = df.select(entry, line.alias("__line")).groupBy().agg(_ordered([entry], F.col("__line")).alias("__lines")).where(F.size("__lines") > 0)
    return grouped.select(F.concat(header_text(key, F.size("__lines"), schema, delimiter, keyed=True), F.lit("\n"), _body(F.col("__lines"), indent)).alias("document"))


def decode_lines(lines: DataFrame, column: str, schema: T.StructType, delimiter: str = ",", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the typed columns of row lines, whose cells are in the schema's order."""
    return lines.select(*(keep or []), *parse_row(F.col(column), schema, delimiter))


#: a blank line with a row before and one after it
_GAP = r"\n +[^\s#][^\n]*+\n(?:[ \t]*+#[^\n]*+\n)*+[ \t\r]*+\n(?:[ \t\r]*+\n)*+ +[^\s#]"


def _fixed(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and the columns ``made``, each worked out once a row: a filter above is not carried below, nor is an expression repeated."""
    once = df.select(*keep, F.struct(*[c.alias(n) for n, c in made.items()]).alias("__made"))
    return once.select(*keep, F.explode(F.array("__made")).alias("__made")).select(*keep, *[F.col("__made")[n].alias(n) for n in made])


def _exploded(docs: DataFrame, column: str, keep: list[str], mode: str, schema: T.StructType | None = None) -> DataFrame:
    """``keep``, ``mark``, ``row_idx`` and ``__row`` of ``explode_rows``: its ``line``, and its ``cells`` where ``mode`` has them counted.

    With them come ``paths``, or with a schema ``at``, the places of its leaves.
    """
    text = F.when(F.col(column).startswith("\ufeff"), F.substr(column, F.lit(2))).otherwise(F.col(column))
    plain = lambda x: F.ltrim(x, F.lit(" \t\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: (plain(x) != "") & ~plain(x).startswith("#"))
    found = _fixed(docs.where(F.col(column).isNotNull()), keep, __text=F.col(column), __all=lines)
    body = F.slice("__all", F.lit(2), F.greatest(F.size("__all") - 1, F.lit(0)))
    parts = header_parts(F.get("__all", F.lit(0)))
    found = _fixed(found, [*keep, "__text"], __body=body, __margin=F.array_position(F.transform(body, lambda x: ~x.startswith(" ")), True), __parts=parts)
    within = F.when(F.col("__margin") == 0, F.col("__body")).otherwise(F.slice("__body", F.lit(1), F.greatest(F.col("__margin").cast("int") - 1, F.lit(0))))
    n, mark = F.col("__parts.n"), F.col("__parts.mark")
    found = _fixed(found, [*keep, "__text"], __lines=F.transform(within, trim_space), __table=n.isNotNull() & ~F.col("__parts.keyed"), n=F.coalesce(n, F.lit(0)), mark=mark, paths=header_paths(F.col("__parts"), schema))
    place = {"paths": F.col("paths")}
    if schema is not None:
        leaves, found_at = F.array(*map(F.lit, leaf_paths(schema))), lambda p: (F.array_position(F.col("paths"), p) - 1).cast("int")
        in_order = (F.col("paths") == leaves) & (F.size(F.array_distinct(leaves)) == F.size(leaves))
        place = {"at": F.when(in_order, F.array(*[F.lit(i) for i in range(len(leaf_paths(schema)))])).otherwise(F.transform(leaves, found_at))}
    row = lambda x, cells: F.struct(x.alias("line"), cells.alias("cells"))
    if mode != "PERMISSIVE":
        counted = F.when(F.size("__lines") == F.col("n"), F.transform("__lines", lambda x: row(x, split_by_mark(x, F.col("mark")))))
        found = _fixed(found, [*keep, "__text", "__table", "n", "mark", "paths"], __rows=counted)
        width = F.forall("__rows", lambda x: F.size(x["cells"]) == F.size("paths"))
        fine = F.coalesce(F.col("__table") & F.col("__rows").isNotNull() & (F.size(F.array_distinct("paths")) == F.size("paths")) & width & ~F.col("__text").rlike(_GAP), F.lit(False))
        fine = fine if mode == "DROPMALFORMED" else F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("malformed table: "), F.left("__text", F.lit(200)))).cast("boolean"))
        # with the rows, so that no test of them comes before the error
        found = _fixed(found, [*keep, "mark"], __rows=F.col("__rows"), __fine=fine, **place).where("__fine")
    else:
        found = found.where("__table")
        found = _fixed(found, [*keep, "mark"], __rows=F.transform(F.slice("__lines", F.lit(1), F.col("n")), lambda x: F.struct(x.alias("line"))), **place)
    return found.select(*keep, "mark", *place, F.posexplode("__rows").alias("row_idx", "__row"))


def explode_rows(docs: DataFrame, column: str, keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """``keep``, ``row_idx``, ``line``, ``mark`` and ``paths`` of documents that start with a table, or are one; no Python.

    The header says how many rows there are, what parts their cells (``mark``) and which columns they
    belong to (``paths``).  Rows end at that number or at the next line at the margin.  A document is
    malformed if it starts with no header, repeats a column, or has another number of rows, a row of
    another width or a blank line between rows.  Of such a document ``PERMISSIVE`` gives the rows that
    there are, ``DROPMALFORMED`` none, and ``FAILFAST`` stops.
    """
    keep = keep or []
    return _exploded(docs, column, keep, mode).select(*keep, "row_idx", F.col("__row.line").alias("line"), "mark", "paths")


def decode_tables(docs: DataFrame, column: str, schema: T.StructType, keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Typed rows of table documents: ``keep``, ``row_idx`` and the schema's columns, found by the names in each document's header.

    Columns that a header doesn't have are null, columns that the schema doesn't have are left out.
    ``mode`` as in ``explode_rows``.
    """
    keep = keep or []
    rows = _exploded(docs, column, keep, mode, schema)
    cells = split_by_mark(F.col("__row.line"), F.col("mark")) if mode == "PERMISSIVE" else F.col("__row.cells")
    return rows.select(*keep, "row_idx", *typed_cells(cells, schema, F.col("at")))
