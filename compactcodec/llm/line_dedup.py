"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop, reassemble.

Only DataFrame functions are used.  The shuffles carry 128-bit line keys and positions; whole texts
move once, when each document meets the list of its dropped positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compactcodec.llm.common import WHITE, ascii_lower, materialise

MIN_CHARS = 20
MIN_DOCS = 3


def _text(text: str):
    return F.coalesce(F.col(text), F.lit(""))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: id, hash of the whole text, position, 128-bit key hash."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(_text(text_col)).alias("of"), F.posexplode(F.split(_text(text_col), "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "of", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    return keys.select("id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  Keys of at
    least ``min_chars`` code points that occur in at least ``min_docs`` distinct ids lose all their
    lines, but for those of the largest id.  Null and empty texts are one empty line.  Rows that
    repeat an id are one document when lines are counted, and each row keeps its own lines.  A row
    whose id is null neither counts nor loses a line.  Extra columns pass through; columns of these
    three names are replaced.  An empty table gives an empty table.
    """
    keys = line_keys(docs, id_col, text_col, min_chars)
    common = keys.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("holder")).where(F.col("n") >= min_docs).drop("n")
    common = materialise(common, "common")  # read anew, so that the join below can split a frequent line
    dropped = keys.join(common, ["h1", "h2"]).where(F.col("id") != F.col("holder"))
    dropped = dropped.groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(F.collect_list("pos").alias("__pos"))
    passed = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # the caller's columns under names of our own, so that none can clash
    plain = docs.select(*[docs[c].alias(f"p{i}") for i, c in enumerate(passed)], F.col(id_col).alias("__key"), _text(text_col).alias("__text"))
    joined = plain.join(dropped, (F.col("__key") == F.col("__id")) & (F.xxhash64("__text") == F.col("__of")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__pos")), lambda i: F.get(F.col("__lines"), i))
    whole = F.col("__pos").isNull()
    out = joined.withColumn("__lines", F.split("__text", "\n", -1))
    text = F.when(whole, F.col("__text")).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.when(whole, F.lit(0)).otherwise(F.size(F.array_distinct("__pos"))).cast("long")
    made = out.select(*[f"p{i}" for i in range(len(passed))], text.alias("kept_text"), F.size("__lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
    return made.toDF(*passed, "kept_text", "n_lines", "n_dropped")
