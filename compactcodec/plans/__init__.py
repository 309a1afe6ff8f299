"""Compositions: plans that decode, join, aggregate and encode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compactcodec.operators.tabular import decode_tables, encode_groups


def decode_join_encode(docs: DataFrame, column: str, schema, dim: DataFrame, left: str, right: str, by: str, measure: str, key: str) -> DataFrame:
    """Rows of table documents, joined with a dimension and summed by one of its columns; one document a first letter of it."""
    rows = decode_tables(docs, column, schema)
    totals = rows.join(dim, rows[left] == dim[right]).groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(measure).cast("decimal(18,2)")).alias("total"))
    return encode_groups(totals.withColumn("letter", F.left(by, F.lit(1))), ["letter"], [by], key)
