"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; between stages the rows
are written as Parquet and read again, and what the stage before wrote is deleted.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compactcodec.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from compactcodec.llm.common import materialise, table
from compactcodec.llm.queries import tokenizer_path
from compactcodec.scratch import release, scratch_paths

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: ids that may be broadcast, 8 MB
BROADCAST_IDS = 1_000_000
#: words that the encoders keep; they stay in workers that later runs of other stages share
KEPT_WORDS = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that several of them share; ``n_chars`` counts what is left."""
    made = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return made.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; a repeated row stays once.

    An id is one document: where it goes, all its rows go.  Rows that repeat id and text keep the least
    of their other columns.  The ids to drop are sent to the texts if they are few; more of them meet
    the texts in a shuffle.
    """
    found = materialise(near_dup.near_duplicates(docs), "components")
    dropped = materialise(found.where("not kept").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    kept = docs.select(*COLUMNS).join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rest = F.min(F.struct("lang", "source", "n_chars")).alias("rest")
        once = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "rest.*")
        kept = kept.where("doc_id is null").union(once)
    return kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    made = packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), 2048, 0, kept_words=KEPT_WORDS)
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("decontamination", decontaminated), ("packing", packed)]
#: shingles, latent space and tokenizer have no SQL; tests hold the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), scratch_paths()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
            release(spark, [p for p in scratch_paths()[:-1] if p not in before])
    return docs
