"""What the operators share: table access, the shared folder, and materialised intermediate tables."""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compactcodec.scratch import scratch, spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: the contract's white space [\x20\x09-\x0D]
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a reread and not a recomputation, and keeps
    nondeterministic recomputation out of later joins.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the quick built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_blob(path: str, value) -> None:
    """A bounded value as a file of the shared folder, for tasks to read when they need it."""
    system, name = _open(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as sink:
        sink.write(pickle.dumps(value))


def read_blob(path: str):
    system, name = _open(path)
    with system.open_input_stream(name) as source:
        return pickle.loads(source.read())
