"""Reading and writing files with Spark's text and binary sources, which reach any store that Spark reaches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec.functions.codec import from_ctext, to_cbin
from compactcodec.functions.columns import field_list, leaf_paths, row_line, table_header, trim_space
from compactcodec.kernel import scalars
from compactcodec.kernel.text import MARKS
from compactcodec.operators.tabular import decode_lines, decode_tables

CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, schema: T.DataType | str | None = None, mode: str = "PERMISSIVE", indent: int = 2, strict: bool = True) -> DataFrame:
    """One document a file: path and document, or with ``schema`` its fields.

    Broken documents are nulls with their text in ``_corrupt_record`` (``PERMISSIVE``), missing
    (``DROPMALFORMED``) or an error (``FAILFAST``).
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    if schema is None:
        return files
    found = files.withColumn("v", from_ctext(F.col("document"), schema, indent, strict, "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE"))
    if mode == "DROPMALFORMED":
        found = found.where("v is not null")
    corrupt = [] if mode in ("FAILFAST", "DROPMALFORMED") else [F.when(F.col("v").isNull(), F.col("document")).alias(CORRUPT)]
    return found.select("path", "v.*", *corrupt)


def read_tables(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of files that are one flat table each: path, row_idx and the columns by the header's names, without Python."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return decode_tables(read_documents(spark, path), "document", kind, ["path"], mode)


def read_big_table(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",") -> DataFrame:
    """Rows of tables of any size: files are split at line feeds, which rows never hold.

    A split of a file may lack its header, so the schema gives the columns and their order; a header
    with others, or with another delimiter, stops the job, as does any other line at the margin.
    Comments and blank lines go; counts are not looked at.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    line = F.col("value")
    head = table_header(F.regexp_replace(line, "^\ufeff", ""))
    fits = F.coalesce((head["mark"] == MARKS[delimiter]) & (head["paths"] == F.array(*map(F.lit, leaf_paths(kind)))) & ~head["keyed"] & head["n"].isNotNull(), F.lit(False))
    other = F.raise_error(F.concat(F.lit("not the header of this schema: "), line)).cast("boolean")
    is_row = F.when(line.rlike(r"^[ \t]*(?:#|\r*$)"), False).when(line.startswith(" "), True).when(fits, False).otherwise(other)
    lines = spark.read.text(path, lineSep="\n").where(is_row).select(trim_space(line).alias("line"))
    return decode_lines(lines, "line", kind, delimiter)


def write_tables(df: DataFrame, path: str, key: str | None = None, delimiter: str = ",", indent: int = 2, mode: str = "errorifexists", fixed_point: bool = False) -> None:
    """One table document for each partition, with its exact count; a task holds its lines as Arrow batches until it has counted them."""
    lines = df.select(row_line(df.schema, delimiter, fixed_point).alias("line"))
    before, after = f"{scalars.quote_key(key) if key is not None else ''}[", f"{MARKS[delimiter]}]{{{field_list(df.schema, delimiter)}}}:"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0) for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{before}{sum(map(len, held))}{after}"])], ["value"])
            for part in held:
                yield pa.RecordBatch.from_arrays([pa.array([" " * indent + x for x in part.to_pylist()])], ["value"])

    lines.mapInArrow(run, "value string").write.mode(mode).text(path, lineSep="\n")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One message a file: path and message."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("message"))


def write_messages(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """The messages of a column of values, one a row, as Parquet."""
    df.select(to_cbin(F.col(column)).alias("message")).write.mode(mode).parquet(path)
