import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from compactcodec.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams, covered = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def got(text):
    m = q.measure(text)
    return tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n\t é\x1f", max_size=200))
def test_any_text_equals_brute_force(text):
    assert got(text) == brute(text)


def test_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 90)))
        assert got(text) == brute(text)
    phrase = " ".join(f"w{i}" for i in range(12))
    assert got(f"{phrase} x {phrase}") == brute(f"{phrase} x {phrase}")
    assert got(None) == brute(None) and got("") == brute("")


def test_verdicts():
    clean = " ".join(f"word{i}" for i in range(200))
    assert q.measure(clean)["kept"]
    assert not q.measure("\n".join(["the same line of words again"] * 40))["kept"]
    symbols = q.measure(" | ".join(f"w{i}" for i in range(100)))
    assert symbols["kept"] and symbols["n_symbols"] == 99  # counted, no part of the verdict
    runs = " ".join(" ".join([f"w{i}"] * 5) for i in range(10))
    assert not q.measure(runs)["base_failed"] and not q.measure(runs)["kept"]  # four words alike, never eight in a row
    assert q.measure(runs, {12: 0.2})["kept"]
    line = "one line of six words here"
    text = "\n".join(f"{line}\n{' '.join(f'v{i}.{k}' for k in range(4))}" for i in range(10))
    assert not q.measure(text, {})["kept"] and q.measure(text, {}, 1.0)["kept"] == (not q.measure(text)["base_failed"])


def test_shares_are_of_characters():
    """Two-byte letters count once, as others do."""
    m = q.measure("aa " * 4 + "éé " * 4 + " ".join(f"w{i:02}" for i in range(40)), {4: 1.0})
    assert m["dup_ngram_share"][4] == 0.0
    m = q.measure("é é é é é " + "b c d f g h i j k l m n o p q", {4: 1.0})
    assert m["dup_ngram_share"][4] == 5 / 20
    assert q.measure("éé\n" * 2 + "bb", {})["dup_line_share"] == 2 / 8
    assert not q.measure(None)["kept"]
    long = " ".join(f"w{i}" for i in range(60_000))
    assert q.measure(long)["n_words"] == 60_000 and q.measure(long)["kept"]


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, n_words string")
    rows = q.quality_rules(df).collect()
    assert sorted(r["n_words"] for r in rows) == [0, 2, 2]
    assert q.quality_rules(df.limit(0)).count() == 0


def test_query_covers_the_table(spark, small):
    from compactcodec.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op7_quality_rules"](spark, small).collect():
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(docs.pop(r["doc_id"]))
    assert not docs
