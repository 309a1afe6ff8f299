"""Structured Streaming over arriving documents and over messages of sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec.functions.codec import from_ctext
from compactcodec.kernel import binary


def read_document_stream(spark: SparkSession, path: str, schema: T.DataType | str, indent: int = 2, strict: bool = True) -> DataFrame:
    """Fields of each document file as it arrives; a broken document gives nulls.  Stateless."""
    files = spark.readStream.text(path, wholetext=True)
    return files.select(from_ctext(F.col("value"), schema, indent, strict).alias("v")).select("v.*")


def decode_session_stream(messages: DataFrame, session: str = "session", seq: str = "seq", column: str = "message") -> DataFrame:
    """session, seq, value of binary messages; the state of a session is its dictionary.

    Messages of one session must arrive in order of ``seq`` between batches; within a batch they are
    sorted.  A null message has a null value.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = binary.Session(list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(frames)).sort_values("seq")
        values = [None if x is None else json.dumps(binary.loads(x, session=known), ensure_ascii=False, separators=(",", ":")) for x in rows["message"]]
        state.update((known.entries,))
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"].to_numpy(), "value": pd.Series(values, dtype=object)})

    rows = messages.selectExpr(f"cast(`{session}` as string) as session", f"cast(`{seq}` as long) as seq", f"`{column}` as message")
    return rows.groupBy("session").applyInPandasWithState(step, "session string, seq long, value string", "entries array<string>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, late: str, window: str, *by: str) -> DataFrame:
    """Rows a window and key of a stream or table, with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
