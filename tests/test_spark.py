"""Column functions, operators, sources and streams against the kernels, and every query against SQL."""

import json
import math
import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec import catalogue, sources
from compactcodec import functions as C
from compactcodec.functions import columns
from compactcodec.kernel import binary, scalars, stream, text
from compactcodec.operators import rows, rowschema, sessions, tabular

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def strings(n=600):
    rng = random.Random(11)
    odd = ["", " ", "a", "-", "#x", "null", "true", "05", "1e5", "+1", "1.", "a,b", "a|b", "a\tb", 'q"q', "b\\s", "b\\\\n", "\\u0041", "x\ny", "\r", "\x01\x1f", "é", " x", "日本", "{", "a:b", "[1]", "  pad", "pad  "]
    return odd + ["".join(rng.choice('ab\\"\n\t\r,|:01-# \x02é') for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_native_unescape_reads_every_escape(spark):
    """Any code of four digits, next to other escapes; what the kernel refuses is null."""
    cells = [r'"\u4e2d x"', r'"\u00e9\n\u0041\\u0041\\\u2028\"\t"', r'"\uFFFD\uabcd"', r'"\u0000"', r'"\q"', r'"\u12"', r'"\ud800"', r'"a\\"', '"plain"', r'"\u4E2D\u4e2d"']
    def kernel(c):
        try:
            return scalars.string_literal(c)
        except scalars.CodecError:
            return None

    df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", C.parse_cell(F.col("c"), T.StringType()).alias("x"))
    assert {r["c"]: r["x"] for r in df.collect()} == {c: kernel(c) for c in cells}


HEADERS = [
    ("t[1]{b,a}:\n  x,1", [(1, "x")]), ("t[1|]{b|a}:\n  x,y|1", [(1, "x,y")]), ("[2\t]{a\tb}:\n  1\tx\n  2\ty", [(1, "x"), (2, "y")]), ("\ufeff# note\n\nt[1]{a}:\r\n  1\r\n", [(1, None)]),
    ("t[2]{a,b}:\n  1,x\n  # note\n  2,y\nafter: 1\nmore[1]: 5", [(1, "x"), (2, "y")]), ('"odd: [key"[1]{"a",g{a,b{a}},b}:\n  1,9,9,x', [(1, "x")]), ("t[#1]{ a , b }:\n  1, x ", [(1, "x")]), ("t[0]{a,b}:", []),
]


@pytest.mark.parametrize("mode", ["PERMISSIVE", "FAILFAST", "DROPMALFORMED"])
def test_headers_decide_the_columns(spark, mode):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(HEADERS)], "i int, d string")
    found = tabular.decode_tables(df, "d", T._parse_datatype_string("a int, b string"), ["i"], mode).orderBy("i", "row_idx").collect()
    assert [(r["i"], r["a"], r["b"]) for r in found] == [(i, *row) for i, (_, rows_) in enumerate(HEADERS) for row in rows_]
    nested = spark.createDataFrame([("t[1]{z,g{y,h{x}},a}:\n  0,1,2,3",)], "d string")
    r = tabular.decode_tables(nested, "d", T._parse_datatype_string("a int, g struct<h:struct<x:int>,y:int,no:int>"), mode=mode).first()
    assert (r["a"], r["g"]["h"]["x"], r["g"]["y"], r["g"]["no"]) == (3, 2, 1, None)


MALFORMED = [
    ("t[5]{a,b}:\n  1,x\nafter: 2", 1), ("t[1]{a,b}:\n  1,x\n  2,y", 1), ("t[2]{a,b}:\n  1,x\n  2", 2), ("t[1]{a,b}:\n  1,x,9", 1), ("t[2]{a,b}:\n  1,x\n\n  2,y", 2), ("a: 1", 0), ("", 0), ("t[2:]{a}:\n  k: 1\n  l: 2", 0), ("t[1]{a,a}:\n  1,2", 1), ("t[2]:\n  - 1\n  - 2", 0),
]


def test_malformed_tables_by_mode(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(MALFORMED)] + [(99, "t[1]{a,b}:\n  7,z"), (100, None)], "i int, d string")
    kind = T._parse_datatype_string("a int, b string")
    found = tabular.decode_tables(df, "d", kind, ["i"]).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in found} == {i: n for i, (_, n) in enumerate(MALFORMED) if n} | {99: 1}
    assert [r["i"] for r in tabular.decode_tables(df, "d", kind, ["i"], "DROPMALFORMED").collect()] == [99]
    for i in range(len(MALFORMED)):
        with pytest.raises(Exception, match="malformed table"):
            tabular.decode_tables(df.where(f"i = {i}"), "d", kind, mode="FAILFAST").collect()
    assert not tabular.decode_tables(df.limit(0), "d", kind).count()


def test_big_tables_refuse_other_headers(spark, tmp_path):
    for i, (head, fine) in enumerate([("k[1]{a,b}:", True), ("[1]{a,b}:", True), ("k[1]{b,a}:", False), ("k[1|]{a|b}:", False), ("k[1]{a}:", False), ("k: 1", False)]):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "x.ctext").write_text(f"# note\n{head}\n  1,x\n\n")
        read = sources.read_big_table(spark, f"{tmp_path}/{i}", "a int, b string")
        if fine:
            assert [tuple(r) for r in read.collect()] == [(1, "x")]
        else:
            with pytest.raises(Exception, match="not the header"):
                read.collect()


def test_permissive_reading_never_stops(spark):
    bad = [("a: 3000000000", "a int"), ("a: 200", "a tinyint"), ("a: 9", "a timestamp"), ("a: word", "a decimal(9,2)"), ("a: 123456789", "a decimal(4,2)"), ("a: 1e400", "a decimal(38,2)"), ("a: 1", "a array<int>"), ("a: x", "a date"), ("a: true", "a double"), ("\n".join("  " * k + "k:" for k in range(600)), "a int"), ("a[1]: 1", "a struct<b:int>")]
    for doc, kind in bad:
        df = spark.createDataFrame([(doc,), (None,)], "d string")
        assert df.select(C.from_ctext(F.col("d"), kind).alias("v")).where("v is not null").count() == 0, doc[:20]
        with pytest.raises(Exception):  # noqa: B017
            df.select(C.from_ctext(F.col("d"), kind, mode="FAILFAST")).collect()
    deep = spark.createDataFrame([(bad[9][0],)], "d string")
    assert deep.select(C.is_valid_ctext(F.col("d")).alias("v")).first()["v"] is False and deep.select(C.from_ctext_json(F.col("d")).alias("v")).first()["v"] is None
    good = spark.createDataFrame([("a: 12.345",)], "d string").select(C.from_ctext(F.col("d"), "a decimal(4,2)").alias("v")).first()
    assert str(good["v"]["a"]) == "12.34"


def test_data_sources_overwrite_commit_and_split(spark, tmp_path):
    sources.register(spark)
    for name in ("ctext", "cbin"):
        path, df = f"{tmp_path}/{name}", spark.range(10).selectExpr("id", "concat('v', id) as s")
        write = lambda mode, frame: frame.write.format(name).option("maxRecordsPerFile", 3).mode(mode).save(path)  # noqa: B023, E731
        rows_ = lambda: sorted(x["id"] for r in spark.read.format(name).load(path).collect() for x in json.loads(r["value"]))  # noqa: B023, E731
        write("append", df.coalesce(1))
        assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 4 and os.listdir(path).count("_staging") == 0
        write("append", df.limit(1))
        assert rows_() == sorted([*range(10), 0])
        write("overwrite", df.limit(2))
        assert rows_() == [0, 1]
        with pytest.raises(Exception):  # noqa: B017
            write("overwrite", df.selectExpr("if(id = 9, raise_error('stop'), id) as id", "s"))
        assert rows_() == [0, 1]  # what tasks of the failed job still wrote is staged, which no reader sees


def test_the_stream_takes_late_files_of_any_name(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "in").mkdir()

    def drain():
        q = spark.readStream.format("ctext").load(f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return sorted(os.path.basename(r["path"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in/m.ctext").write_text("a: 1")
    assert drain() == ["m.ctext"]
    time.sleep(0.05)
    (tmp_path / "in/b.ctext").write_text("a: 2")
    assert drain() == ["b.ctext", "m.ctext"]
    assert drain() == ["b.ctext", "m.ctext"]


def test_session_stream_with_a_null_message(spark, tmp_path):
    from compactcodec.streaming import decode_session_stream

    data = [("s", k, json.dumps({"k": "same"}) if k != 1 else None) for k in range(4)]
    sent = sessions.encode_sessions(spark.createDataFrame(data, "s string, k int, v string"), "s", "k", "v")
    sent.write.parquet(f"{tmp_path}/m")
    stream = decode_session_stream(spark.readStream.schema(sent.schema).parquet(f"{tmp_path}/m"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    assert {r["seq"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {k: '{"k":"same"}' if k != 1 else None for k in range(4)}


def test_codes_and_text_like_codes_survive(spark):
    enum = rowschema.EnumSchema.named("s", codes={"s": {"open": 1, "shut": -2}})
    values = ["open", "shut", "1", "-2", "7", "\\1", "\\\\1", "\\x", "", "else", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    sent = enum.project(df)
    assert [r["s"] for r in sent.collect()][:4] == ["1", "-2", "\\1", "\\-2"]
    assert [r["s"] for r in enum.restore(sent).collect()] == values


def test_string_table_and_ranges_equal_the_kernel(spark):
    rng = random.Random(6)
    data = [(i, rng.choice("abcdef") * 2, rng.choice("abxyz") * 2, rng.randint(-300, 300), rng.choice([0.5, 0.25, 3.0])) for i in range(60)]
    df = spark.createDataFrame(data, "i int, p string, q string, n int, x double").repartition(5)
    seen = {}
    for r in data:
        for v in r[1:3]:
            seen[v] = seen.get(v, 0) + 1
    assert [(r["entry"], r["n"]) for r in C.string_table(df, ["p", "q"], ["i"]).orderBy("place").collect()] == [(s, n) for s, n in seen.items() if n >= 2]
    r = C.column_ranges(df.withColumn("y", F.col("x") / 3), ["n", "x", "y"]).first()
    assert (r["n.min"], r["n.max"], r["n.nulls"]) == (min(d[3] for d in data), max(d[3] for d in data), False)
    assert r["x.float32"] is True and r["y.float32"] is False


@pytest.mark.parametrize("delimiter", [",", "|", "\t"])
def test_native_quoting_equals_the_kernel(spark, delimiter):
    df = spark.createDataFrame([(s,) for s in strings()], "s string")
    token = C.quote_text(F.col("s"), delimiter)
    for r in df.select("s", C.is_bare(F.col("s"), delimiter).alias("bare"), token.alias("t"), C.quote_key_text(F.col("s")).alias("k"), C.parse_cell(token, T.StringType()).alias("back"), C.split_cells(F.concat_ws(delimiter, token, F.lit("x"), token), delimiter).alias("cells")).collect():
        assert r["bare"] == scalars.is_bare(r["s"], delimiter)
        assert r["t"] == scalars.quote(r["s"], delimiter)
        assert r["k"] == scalars.quote_key(r["s"])
        assert r["back"] == r["s"]
        assert r["cells"] == [scalars.trim(r["t"]), "x", scalars.trim(r["t"])]


def test_very_long_quoted_cell(spark):
    s = 'a"b,\\' * 200_000
    df = spark.createDataFrame([(s,)], "s string").select(C.split_cells(F.concat(C.quote_text(F.col("s")), F.lit(",1"))).alias("c"))
    assert df.select(C.parse_cell(F.col("c")[0], T.StringType()).alias("x"), F.col("c")[1].alias("y")).first() == (s, "1")


def test_numbers(spark):
    rng = random.Random(2)
    exact = [0.0, -0.0, 5.0, 0.1, 2e23, 1e-7, 1e21, 123.456, 1 / 3, float("inf")] + [rng.random() * 10 ** rng.randint(-8, 22) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in exact], "x double")
    assert [r["t"] for r in df.select(C.canonical_number(F.col("x")).alias("t")).collect()] == [scalars.number(x) for x in exact]
    money = [round(rng.uniform(-99999, 99999), rng.randint(0, 6)) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in money], "x double")
    assert [r["t"] for r in df.select(C.number_text(F.col("x"), T.DoubleType()).alias("t")).collect()] == [scalars.number(x) for x in money]
    assert [r["t"] for r in df.select(C.number_text(F.col("x"), T.DoubleType(), True).alias("t")).collect()] == [scalars.number(x) for x in money]
    with pytest.raises(Exception, match="fixed-point"):
        spark.createDataFrame([(1 / 3,)], "x double").select(C.number_text(F.col("x"), T.DoubleType(), True)).collect()
    special = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in special.select(C.number_text(F.col("x"), T.DoubleType(), True)).collect()] == ["null", "null", None]


def test_any_double_prints_like_the_kernel(spark):
    """Random bit patterns, values near the edges of the native form, and the probes that once stopped a job."""
    rng = random.Random(4)
    bits = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    edges = [x for n in (1, 12345, 999_999, 10**9 - 1, 10**9, 2**53 - 1, 2**53) for d in range(8) for x in (n / 10**d, math.nextafter(n / 10**d, 1e30), -n / 10**d)]
    probes = [0.1234567, 1234567890.5, 5e-324, 2.0**-1074, 1.7976931348623157e308, 8.41e21, 2e23, 1e15, 1e16, 123456789012345680.0, -0.0, None]
    values = bits + edges + probes
    kernel = lambda x: None if x is None else scalars.number(x)
    df = spark.createDataFrame([(x, [x, 0.5]) for x in values], "x double, a array<double>")
    rows = df.select(C.number_text(F.col("x"), T.DoubleType()).alias("n"), C.canonical_number(F.col("x")).alias("c"), C.canonical_number(F.col("x"), "plain").alias("p"), C.canonical_numbers(F.col("a")).alias("a")).collect()
    for x, r in zip(values, rows, strict=True):
        assert (r["n"], r["c"], r["a"]) == (kernel(x), kernel(x), [kernel(x), "0.5"]) and r["p"] == (None if x is None else scalars.number(x, "plain")), x
    floats = spark.createDataFrame([(0.1, [0.1, None], None), (1e-9, [], [3.5])], "f float, l array<float>, m array<double>")
    docs = floats.select(C.object_text(floats.schema).alias("d")).collect()
    want = floats.collect()
    assert [r["d"] for r in docs] == [text.dumps(w.asDict()) for w in want]
    line = floats.select("f").select(columns.row_line(floats.select("f").schema).alias("l")).first()["l"]
    assert line == scalars.number(want[0]["f"]) and tabular.encode_table(floats.select("f"), ["f"], "t").count() == 1


def test_native_tables_equal_the_kernel(spark):
    data = [(1, s, (float(i), None if i % 3 else s), bool(i % 2)) for i, s in enumerate(strings(40))]
    df = spark.createDataFrame(data, "g int, s string, n struct<x:double,y:string>, b boolean").withColumn("i", F.monotonically_increasing_id())
    for delimiter in ",|":
        doc = tabular.encode_groups(df, ["g"], ["i"], "t", columns=["s", "n", "b"], delimiter=delimiter).first()["document"]
        assert doc == text.dumps({"t": [{"s": s, "n": {"x": x, "y": y}, "b": b} for _, s, (x, y), b in data]}, delimiter=delimiter)
    rows_ = tabular.decode_tables(tabular.encode_groups(df, ["g"], ["i"], "t", columns=["s", "n", "b"]), "document", df.select("s", "n", "b").schema).orderBy("row_idx").collect()
    assert [(r["s"], tuple(r["n"]), r["b"]) for r in rows_] == [(s, n, b) for _, s, n, b in data]
    keyed = tabular.encode_keyed(df.where("i < 3"), "s", "m", ["b"]).first()["document"]
    assert text.loads(keyed) == {"m": {s: {"b": b} for _, s, _, b in data[:3]}} or df.where("i < 3").count() < 3
    assert tabular.encode_table(df.limit(0), ["i"]).count() == 0


def test_documents_of_any_shape(spark):
    values = [{"a": [1, {"b": None}], "c": "x"}, [1, 2.5, "t"], {}, "s", {"k": {"x": {"v": 1}, "y": {"v": 2}}}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [(None,)], "j string")
    made = df.select("j", C.to_ctext(F.col("j"), json_input=True).alias("d"))
    assert [r["d"] for r in made.collect()] == [text.dumps(v) for v in values] + [None]
    back = made.select(C.from_ctext_json(F.col("d")).alias("b")).collect()
    assert [json.loads(r["b"]) for r in back if r["b"]] == values
    bad = spark.createDataFrame([("a: 1",), ("a: x",), ("a[1]: 1,2",), (None,)], "d string")
    assert [r[0] and r[0]["a"] for r in bad.select(C.from_ctext(F.col("d"), "a int")).collect()] == [1, None, None, None]
    with pytest.raises(Exception):  # noqa: B017
        bad.select(C.from_ctext(F.col("d"), "a int", mode="FAILFAST")).collect()
    assert C.infer_schema(bad.limit(1), "d").simpleString() == "struct<a:bigint>"


def test_native_objects_equal_the_kernel(spark):
    odd = strings(150)
    data = [(i, s, odd[i : i + i % 4], (s, [i] * (i % 3)) if i % 5 else None, None if i % 7 else True) for i, s in enumerate(odd)]
    df = spark.createDataFrame(data, "`a b` int, s string, l array<string>, n struct<x:string,y:array<int>>, b boolean")
    for delimiter, indent, marker in ((",", 2, ""), ("|", 4, "#")):
        made = [r["d"] for r in df.select(C.object_text(df.schema, None, indent, delimiter, marker).alias("d")).collect()]
        want = [{"a b": i, "s": s, "l": x, "n": n and {"x": n[0], "y": n[1]}, "b": b} for i, s, x, n, b in data]
        assert made == [text.dumps(v, indent, delimiter, marker) for v in want]
    flat = df.select("a b", "s", "l", "b")
    back = flat.select(C.object_text(flat.schema).alias("d")).select(*C.parse_object(F.col("d"), flat.schema))
    assert [tuple(r) for r in back.collect()] == [(i, s, x, b) for i, s, x, _, b in data]
    assert not C.has_native_object(T._parse_datatype_string("a struct<x:int>, b struct<x:int>"))
    assert not C.has_native_object(T._parse_datatype_string("a array<struct<x:int>>"))


def test_messages(spark):
    df = spark.createDataFrame([(1, [1.5, 2.5], {"k": "v"}), (2, None, {})], "i long, v array<float>, m map<string,string>")
    made = df.select(C.to_cbin(F.struct("i", "v")).alias("m"))
    assert [binary.loads(bytes(r["m"])) for r in made.collect()] == [{"i": 1, "v": [1.5, 2.5]}, {"i": 2, "v": None}]
    assert [r[0]["i"] for r in made.select(C.from_cbin(F.col("m"), "i long, v array<float>")).collect()] == [1, 2]


def test_table_functions(spark):
    doc = "ids[1]{a}:\n  7\nt[2]{a,g{b}}:\n  1,2\n  4,5\nl[2]:\n  - x\n  - k: 1"
    df = spark.createDataFrame([(1, doc), (2, ""), (3, None)], "i int, d string")
    assert [json.loads(r["row"]) for r in rows.lateral(df, "d", "ctext_rows", "t", ["i"]).collect()] == list(stream.rows(doc, "t"))
    assert [json.loads(r["item"]) for r in rows.lateral(df, "d", "ctext_items", "l").collect()] == ["x", {"k": 1}]
    assert rows.lateral(df, "d", "ctext_raw_rows").count() == 1
    rows.register(spark)
    df.createOrReplaceTempView("docs")
    assert spark.sql("select i, row from docs, lateral ctext_rows(d, 't')").count() == 2
    assert rows.lateral(df, "d", "ctext_lines", keep=["i"]).where("i = 1").count() == len(doc.split("\n"))


def test_row_schemas(spark):
    flat = rowschema.FlattenedSchema.named("u.id", "u.n.x", "s")
    record = {"u": {"id": 1, "n": {"x": 2}}, "s": "t", "more": 0}
    assert flat.encode(record) == [1, 2, "t"] and flat.decode([1, 2, "t"]) == {"u": {"id": 1, "n": {"x": 2}}, "s": "t"} and flat.encode({}) == [None] * 3
    enum = rowschema.EnumSchema.named("s", "p", codes={"s": {"open": 1, "shut": 2}})
    assert enum.encode({"s": "open", "p": "q"}) == [1, "q"] and enum.decode([2, "q"]) == {"s": "shut", "p": "q"} and enum.encode({"s": "odd"}) == ["odd", None]
    field = rowschema.SchemaField
    typed = rowschema.RowSchema((field("a", "integer", True), field("b", "string")))
    assert typed.matches({"a": 1, "x": 0}) and typed.matches({"a": None}) and not typed.matches({"b": "x"}) and not typed.matches({"a": "1"}) and typed.matches_all([{"a": 1}, {"a": 2}])
    assert typed.decode([1]) == {"a": 1} and typed.decode([1, "x", 3]) == {"a": 1, "b": "x"}
    doc = rowschema.encode_with_schema("k", [{"a": 1, "b": "#x"}, {"a": 2}], typed)
    assert doc == 'k[2]{a,b}:\n  1,"#x"\n  2,null'
    assert rowschema.decode_with_schema(['1,"#x"', "2"], typed) == [{"a": 1, "b": "#x"}, {"a": 2}]
    assert rowschema.decode_with_schema(["1,2,t"], flat, decode="schema") == [{"u": {"id": 1, "n": {"x": 2}}, "s": "t"}]
    registry = rowschema.Registry()
    registry.register("t", typed)
    assert registry.has("t") and registry.get("t") is typed and len(registry) == 1 and registry.names() == ["t"] and registry.remove("t") and not registry.remove("t")
    df = spark.createDataFrame([((1, (2,)), "t")], "u struct<id:int,n:struct<x:int>>, s string")
    assert tuple(flat.project(df).first()) == (1, 2, "t") and flat.restore(flat.project(df)).first() == df.first()


def test_sessions_in_order(spark):
    data = [(s, k, json.dumps({"name": f"n{k % 3}", "s": s})) for s in range(5) for k in range(40)]
    df = spark.createDataFrame(data, "s int, k int, v string").repartition(7)
    sent = sessions.encode_sessions(df, "s", "k", "v")
    assert {(int(r["session"]), r["seq"], r["value"].replace(":", ": ").replace(",", ", ")) for r in sessions.decode_sessions(sent).collect()} == set(data)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v,{i}", i / 4) for i in range(50)], "a int, b string, c double").repartition(3)
    sources.write_tables(df, f"{tmp_path}/t", "k")
    files = [f for f in os.listdir(f"{tmp_path}/t") if f.startswith("part")]
    for f in files:
        value = text.loads(open(f"{tmp_path}/t/{f}").read())
        assert set(value) <= {"k"}
    assert sorted(map(tuple, sources.read_tables(spark, f"{tmp_path}/t", df.schema).select("a", "b", "c").collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, sources.read_big_table(spark, f"{tmp_path}/t", "a int, b string, c double").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.ctext").write_text("a: 1")
    (tmp_path / "d/y.ctext").write_text("a[1]: 1,2")
    found = {r["path"][-7:]: r for r in sources.read_documents(spark, f"{tmp_path}/d", "a int").collect()}
    assert found["x.ctext"]["a"] == 1 and found["y.ctext"]["_corrupt_record"] == "a[1]: 1,2"
    assert sources.read_documents(spark, f"{tmp_path}/d", "a int", mode="DROPMALFORMED").count() == 1
    sources.register(spark)
    assert spark.read.format("ctext").option("mode", "DROPMALFORMED").load(f"{tmp_path}/d").count() == 1
    out = spark.readStream.format("ctext").load(f"{tmp_path}/d").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.sql("select * from arrived").count() == 2


def test_plans_stay_in_the_jvm(spark, small):
    for name in ("tabular_encode_rows_lineitem", "tabular_roundtrip_lineitem", "quote_predicate"):
        plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    narrow = catalogue.QUERIES["canonical_number_lineitem"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in narrow


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    found = catalogue.QUERIES[name](spark, small)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_small_inputs_use_all_cores(spark, small, tmp_path):
    from compactcodec.scratch import scratch, spread

    one = spark.read.parquet(f"{small}/lineitem.parquet")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == one.count()
    one.repartition(9).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert spread(many) is many
    assert scratch(spark, "x") != scratch(spark, "x") and "://" in scratch(spark, "x")


def test_time_cells(spark):
    df = spark.sql("select timestamp_ntz'2024-01-15 10:30:00' a, timestamp_ntz'2024-01-15 10:30:00.000001' b, timestamp'2024-01-15 10:30:00.5Z' c, date'2024-01-15' d")
    assert df.select(columns.row_line(df.schema).alias("l")).first()["l"] == '"2024-01-15T10:30:00.000","2024-01-15T10:30:00.000001","2024-01-15T10:30:00.500Z","2024-01-15T00:00:00.000"'
    assert text.loads(df.select(C.to_ctext(F.struct("a", "b", "c", "d")).alias("t")).first()["t"]) == {"a": "2024-01-15T10:30:00.000", "b": "2024-01-15T10:30:00.000001", "c": "2024-01-15T10:30:00.500Z", "d": "2024-01-15T00:00:00.000"}


def test_all_orders_are_streamed(spark, small):
    """Orders beyond the first keys too, in several files."""
    orders = spark.read.parquet(f"{small}/orders.parquet")
    found = catalogue.QUERIES["stream_documents"](spark, small)
    assert orders.where("o_orderkey > 50").count() and found.count() == orders.count() and not orders.join(found, orders["o_orderkey"] == found["id"], "left_anti").count()


def test_inference_reads_all_documents(spark):
    """A field, a double and a value that is not null after the first hundred documents; order by partition."""
    docs = [json.dumps({"a": 1, "n": None}) for _ in range(150)] + [json.dumps({"a": 2.5, "n": [1], "late": {"x": True}})]
    df = spark.createDataFrame([(text.dumps(json.loads(d)),) for d in docs] + [(None,)], "d string")
    assert C.infer_schema(df, "d").simpleString() == "struct<a:double,n:array<bigint>,late:struct<x:boolean>>"
    assert C.infer_schema(df.limit(100), "d").simpleString() == C.infer_schema(df.coalesce(1), "d", sample=100).simpleString() == "struct<a:bigint,n:void>"
    assert C.infer_schema(df.limit(0), "d") == T.NullType()


def test_schema_of_a_table_with_nulls_first(spark):
    """The type of a value that is not null, wherever it stands; as the kernel derives it from all rows."""
    rows_ = [(None, None, i, None) for i in range(50)] + [(1.5, "x", None, None)]
    df = spark.createDataFrame(rows_, "`a.b` double, s string, n int, z string").coalesce(1)
    assert C.derive_schema(df) == binary.derive_schema([dict(zip(df.columns, r, strict=True)) for r in rows_])
    assert dict(C.derive_schema(df).fields) == {"a.b": "float64", "s": "string", "n": "int64", "z": "null"}
    assert C.derive_schema(df.limit(0)).fields == ()


def test_all_nations_are_encoded(spark, small):
    document = catalogue.QUERIES["encode_with_schema_nation"](spark, small).first()["document"]
    assert len(text.loads(document)["nation"]) == spark.read.parquet(f"{small}/nation.parquet").count() > 2
