"""What reads and writes share: the folder that driver and executors share, and the spread of small inputs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: bytes of an input below which dealing it out anew costs next to nothing
SMALL = 256 << 20


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they see that folder.

    On a cluster that doesn't share it, send the package along (``--py-files``).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in (*known, root) if p])


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine a temporary folder is chosen and set; on
    a cluster that is an error.  It goes when the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get() if jvm_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return re.sub("^file:/(?!/)", "file:///", fs.makeQualified(hadoop).toString())


_MADE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def scratch_paths() -> list[str]:
    """The paths given out and not released, in order."""
    return list(_MADE)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete what lies at scratch paths that no frame reads any more."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _MADE.remove(path)


def spread(df: DataFrame) -> DataFrame:
    """A small input in fewer files than there are cores, dealt to all cores by its first column; any other input as it is.

    One file of one row group is one task however many cores wait.  The size bound keeps this from
    moving anything that counts.
    """
    reach(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL and len(df.inputFiles()) < cores:
        return df.repartition(cores, df.columns[0])  # by a key, which needs no sort
    return df
