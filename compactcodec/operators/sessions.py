"""Messages of a session in order, with the dictionary that both sides build as they go.

A session is sequential by nature.  Sessions are dealt by a hash and sorted within their partition, and
a task holds one session's dictionary at a time, never its messages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from compactcodec.kernel import binary


def _in_order(df: DataFrame, session: str, seq: str, column: str) -> DataFrame:
    return df.selectExpr(f"cast(`{session}` as string) as session", f"cast(`{seq}` as long) as seq", f"`{column}` as x").repartition("session").sortWithinPartitions("session", "seq")


def encode_sessions(df: DataFrame, session: str, seq: str, column: str, **options) -> DataFrame:
    """session, seq, message: JSON values of ``column`` encoded with one growing dictionary a session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in batches:
            out = []
            for s, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if known is None or s != at:
                    at, known = s, binary.Session()
                out.append(None if x is None else binary.dumps(json.loads(x), session=known, **options))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["session", "seq", "message"])

    return _in_order(df, session, seq, column).mapInArrow(run, "session string, seq long, message binary")


def decode_sessions(df: DataFrame, session: str = "session", seq: str = "seq", column: str = "message") -> DataFrame:
    """session, seq, value: the messages decoded to JSON, each session from its first message on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in batches:
            out = []
            for s, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if known is None or s != at:
                    at, known = s, binary.Session()
                out.append(None if x is None else json.dumps(binary.loads(x, session=known), ensure_ascii=False, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["session", "seq", "value"])

    return _in_order(df, session, seq, column).mapInArrow(run, "session string, seq long, value string")
