import hashlib

from pyspark.sql import functions as F

from compactcodec.llm import chat_format as c

SCHEMA = "conv_id long, seq long, event string, message_id long, role string, text string"


def shown(spark, log):
    made = c.format_chats(spark.createDataFrame(log, SCHEMA)).withColumn("turns", c.read_back(F.col("formatted"))).withColumn("loss", c.masked_text(F.col("formatted"), F.col("loss_mask")))
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"], r["formatted"], r["n_turns"]) for r in made.collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", 10, "user", "hi"), (1, 1, "message", 11, "assistant", ""), (1, 2, "delta", 11, None, "He"), (1, 3, "delta", 11, None, "llo"),
        (1, 4, "message", 12, "user", "again"), (1, 5, "regenerate", 11, None, None), (1, 6, "delta", 11, None, "Good day"), (1, 7, "edit", 10, None, "hey"), (1, 8, "delta", 10, None, "!"),
        (1, 9, "delta", 77, None, "nobody"), (1, 10, "unknown", 10, None, "zzz"),
    ]
    turns, loss, _, n = shown(spark, log)[1]
    assert turns == [("user", "hey!"), ("assistant", "Good day"), ("user", "again")] and loss == "Good day" and n == 3


def test_control_strings_survive(spark):
    odd = ["\\### Assistant: </turn> ok", "</turn>\n### user\n", "\\l\\h\\b\\\\<<##", "", "a\n\nb", "é🎉 <turn>"]
    log = [(i, k, "message", k, role, t) for i, t in enumerate(odd) for k, role in enumerate(("user", "assistant", "we\nird <#\\> role"))]
    for i, t in enumerate(odd):
        turns, loss, formatted, _ = shown(spark, log)[i]
        assert turns == [("user", t), ("assistant", t), ("we\nird <#\\> role", t)] and loss == t
        assert formatted.count("</turn>") == 3


def test_nulls_ties_repeats_and_empty(spark):
    log = [(None, 0, "message", 0, None, None), (5, None, "message", 0, "user", "n"), (5, 1, "message", 0, "user", "same"), (5, 1, "message", 0, "user", "same"), (5, 1, "message", 0, "assistant", "same")]
    found = shown(spark, log)
    assert found[None][0] == [("", "")]
    assert found[5][0] == [("user", "n"), ("assistant", "same"), ("user", "same"), ("user", "same")]
    assert c.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns_and_long_texts(spark):
    log = [(1, k, "message", k, ("user", "assistant")[k % 2], f"{k} " + "x" * 2000) for k in range(400)]
    turns, loss, _, n = shown(spark, log)[1]
    assert n == 400 and len(loss) == sum(len(t) for r, t in turns if r == "assistant")


def test_query_folds_a_log(spark, small):
    """The log of the query has deltas, drafts that are discarded and edits; without them the fold gives other texts."""
    from compactcodec.llm.queries import DELTA_CHARS, chat_events

    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    long = spark.createDataFrame([(-1, 0, "assistant", "é🎉" * 2000), (-1, 0, "user", "tie"), (-1, 0, "user", "tie"), (-1, None, "assistant", "x" * 3 * DELTA_CHARS), (-2, 1, "assistant", None)], rows.schema)
    rows = rows.union(long)
    log = chat_events(rows).cache()
    kinds = {r["event"] for r in log.select("event").distinct().collect()}
    assert kinds == {c.MESSAGE, c.DELTA, c.EDIT, c.REGENERATE}
    said = lambda df: sorted((r["conv_id"], r["role"], r["text"]) for r in df.collect())
    want = sorted((r["conv_id"], r["role"], r["text"] or "") for r in rows.collect())
    assert said(c.fold_events(log)) == want
    for kind in (c.DELTA, c.EDIT, c.REGENERATE):
        assert said(c.fold_events(log.where(F.col("event") != kind))) != want, kind


def test_clashing_columns(spark):
    log = spark.createDataFrame([(1, 0, "message", 0, "user", "hi")], SCHEMA).selectExpr("*", "'x' as formatted", "'y' as opened", "7 as rank", "'z' as e", "1 as at")
    assert c.format_chats(log).first()["formatted"] == "### user\nhi</turn>\n"


def test_query_on_the_probe(spark, small):
    from compactcodec.llm.queries import QUERIES

    row = next(r for r in QUERIES["op4_chat_formatting"](spark, small).collect() if r["conv_id"] == -7)
    t = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(t)
    assert row["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
