"""Spans against a plain scan of the base patterns, and checksums."""

import random
import re

import pytest
from pyspark.sql import functions as F

from compactcodec.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    out = [(m.start(), i, k, m.end()) for i, (k, rx) in enumerate(BASE.items()) for m in re.finditer(rx, text or "") if good(k, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in pii.find_pii(df).collect()}


EDGE = [
    None, "", "no data", "a@b.c%d@e.f x", "a@b-c.d.@x.y", "..a@b..c@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "999.1.1.1 001.002.003.255 1.2.3.256", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (017) 555-7713 +1((((", "+123456789012345 +1234567890123456", "é🎉 a@b.co 🎉 8.8.8.8", "x" * 20000 + "@y.zz", "1" * 5000, "+1" + "." * 5000, "a@" + "b." * 3000 + "c", "a.b.c-d@e_f.g", "1-2-3 4 5 6 7 8 9 0 1 2 3 4",
]


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab1 2.@+-(3)0\n%4é") for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    texts = EDGE + noise
    found = spans(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[0] in BASE] == brute(t), t[:80]


def test_documents_equal_a_plain_scan(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in BASE] for r in pii.find_pii(df).collect()}
    for r in df.collect():
        assert found[r["doc_id"]] == brute(r["text"])


def test_many_matches_stay_in_order(spark):
    text = "a@b.co, 8.8.8.8; " * 1500
    assert spans(spark, [text])[0] == brute(text)


@pytest.mark.parametrize(("text", "kinds"), [
    ("IBAN DE89 3704 0044 0532 0130 00.", {"iban"}), ("DE89370400440532013001", set()), ("GB82WEST12345698765432", {"iban"}),
    ("my social security number 123-45-6789", {"ssn"}), ("part 123-45-6789 of 9", set()), ("ssn 000-45-6789", set()),
    ('token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"', {"secret"}), ("commit 9233a8ecf7c5b09fe5949719b6b82bc439e9329b", set()),
])
def test_added_kinds(spark, text, kinds):
    assert {k for k, _, _ in spans(spark, [text])[0]} - set(BASE) == kinds


def test_empty_table_extra_columns_and_redaction(spark):
    df = spark.createDataFrame([(1, "x a@b.co", "keep", "old")], "doc_id long, text string, extra string, pii string")
    row = pii.find_pii(df).first()
    assert row["extra"] == "keep" and len(row["pii"]) == 1
    assert pii.find_pii(df.limit(0)).count() == 0
    assert pii.redact(df).first()["redacted"] == "x [email]"
    assert pii.redact(df).columns == [*df.columns, "redacted"]
    assert pii.find_pii(df.union(df)).count() == 2


def test_redaction_takes_confirmed_spans_only(spark):
    cases = {
        "In 1984, 25 people paid 300 dollars, version 10.20.30.400": "In 1984, 25 people paid 300 dollars, version 10.20.30.400",
        "IBAN DE89 3704 0044 0532 0130 00.": "IBAN [iban].", "my social security number 123-45-6789": "my social security number [ssn]",
        "é🎉 a@b.co 🎉 8.8.8.8": "é🎉 [email] 🎉 [ip]", "4111 1111 1111 1111": "[card]", "a@8.8.8.8 x": "[email] x", "": "",
    }
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(cases)] + [(99, None, "k")], "i int, text string, redacted string")
    found = {r["i"]: r["redacted"] for r in pii.redact(df).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values()) and found[99] == ""


def test_redaction_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a@b.co", " ", "8.8.8.8", "4111111111111111", "+123456789012", "word", "é", ","]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["a@b.co, 8.8.8.8; " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["pii"]] for r in pii.find_pii(df).collect()}
    for r in pii.redact(df).collect():
        out, at = "", 0
        for start, end, kind in spans[r["doc_id"]]:
            if start >= at:
                out += r["text"][at:start] + f"[{kind}]"
            at = max(at, end)
        assert r["redacted"] == out + r["text"][at:]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.find_pii(df).select(F.size("pii"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
