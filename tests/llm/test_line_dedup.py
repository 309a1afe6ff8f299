import hashlib
import random

from pyspark.sql import functions as F

from compactcodec.llm.line_dedup import dedup_lines

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows):
    holders = {}
    for i, t in rows:
        if i is not None:
            for x in {key(x) for x in (t or "").split("\n")}:
                if len(x) >= 20:
                    holders.setdefault(x, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(df, **more).collect()], key=str)


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"Line number {i} with É some words" for i in range(12)] + ["short", "", "  ", "tie " * 6]
    form = [str, str.upper, lambda s: f" \t{s}\r", lambda s: f"{s} "]
    rows = [(i, "\n".join(rng.choice(form)(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, "another text\n" + pool[0]), (None, pool[0]), (None, None), (99, None), (98, ""), (97, "\n\n")]
    assert run(spark, rows) == brute(rows)


def test_very_long_and_hot_line(spark):
    hot = "this very line is everywhere in the corpus"
    rows = [(i, f"{hot}\nown line of document number {i}") for i in range(300)] + [(1000, "\n".join(["x" * 30, hot] * 3000))]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", "old", 5)], "doc_id long, text string, kept_text string, n_lines int")
    assert dedup_lines(df.limit(0)).count() == 0
    row = dedup_lines(df).first()
    assert row["kept_text"] == "a" and row["n_lines"] == 1
    names = ["__id", "__of", "__pos", "__lines", "id", "pos", "h1", "key"]
    odd = df.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    assert [dedup_lines(odd).first()[c] for c in names] == list(range(len(names)))


def test_digest_of_a_document(spark, small):
    from compactcodec.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(docs))
    assert sorted(map(tuple, QUERIES["op1_line_dedup"](spark, small).collect())) == want
