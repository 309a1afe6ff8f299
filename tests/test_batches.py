"""Tables by column made from Arrow's buffers: byte for byte what the kernel makes of the rows."""

import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec import functions as C
from compactcodec.functions import batches, codec
from compactcodec.kernel import binary

KIND = T.ArrayType(T.StructType().add("n", "long").add("x", "double").add("a", "integer"))
WIDE = st.sampled_from([0, 1, -1, 127, 128, -129, 255, 256, 32768, 65536, 2**31, -(2**31), 2**32, 2**40, 2**63 - 1, -(2**63)])
ROWS = st.fixed_dictionaries({
    "n": st.none() | WIDE | st.integers(-(2**63), 2**63 - 1), "x": st.floats(allow_nan=False) | st.sampled_from([0.5, -0.0, 3.5e38, 0.1]), "a": st.integers(-300, 300),
})
LISTS = st.lists(st.none() | st.lists(st.none() | ROWS, max_size=4), max_size=6)


def arrow(lists):
    return pa.array(lists, codec.to_arrow_type(KIND))


@settings(max_examples=300, deadline=None)
@given(LISTS, st.integers(0, 2))
def test_messages_equal_those_of_the_kernel(lists, skip):
    x = arrow([None, [{"n": 1, "x": 2.0, "a": 3}], *lists]).slice(skip)
    values = x.to_pylist()
    assert batches.plain(x) == values
    assert batches.dump_tables(x) == [None if v is None else binary.dumps(v) for v in values]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(ROWS.filter(lambda r: r["n"] is not None), max_size=4), max_size=6))
def test_messages_read_back_as_by_rows(lists):
    messages = [None if v is None else binary.dumps(v) for v in lists]
    found = batches.load_tables(messages, KIND)
    assert found is not None and found.equals(codec._decoded(messages, KIND, binary.loads, "FAILFAST"))


def test_what_is_no_table_is_left_to_the_kernel():
    table = binary.dumps([{"n": 1, "x": 1.5, "a": 2}])
    others = ([{"n": 1.5, "x": 1.5, "a": 2}], [{"n": 1, "x": 1.5, "a": 2**40}], [{"n": 1, "x": 1.5}], [1, 2], {"n": 1}, [{"n": None, "x": 1.5, "a": 2}])
    for message in (*map(binary.dumps, others), b"", table[:20], table[:-1], table[:9] + b"\xff\xff\xff\xff" + table[13:]):
        assert batches.load_tables([table, message], KIND) is None
    assert batches.load_tables([table, None, binary.dumps([])], KIND).to_pylist() == [[{"n": 1, "x": 1.5, "a": 2}], None, []]
    assert not batches.has_table(T.ArrayType(T.StructType().add("n", "long").add("s", "string"))) and not batches.is_table(pa.list_(pa.int64()))


def test_not_a_number_stays_one():
    back = batches.load_tables(batches.dump_tables(arrow([[{"n": 1, "x": math.nan, "a": 0}]])), KIND).to_pylist()
    assert math.isnan(back[0][0]["x"])


@pytest.mark.parametrize("rows", [[], [(1, [(1, 0.5, 2), (2**40, 0.1, -2)]), (2, None), (3, []), (4, [(None, 1.0, 1)])]])
def test_tables_as_columns(spark, rows):
    df = spark.createDataFrame(rows, f"id int, rows {KIND.simpleString()}")
    back = df.select("id", C.from_cbin(C.to_cbin(F.col("rows")), KIND).alias("rows"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_cells_by_name_looser_numbers_and_element_types(spark):
    df = spark.createDataFrame([('a,"b,c"', [1.0, 2.0]), ("a", None), ("", []), (None, [3.0])], "line string, v array<double>")
    found = df.select(C.cells_by_name(F.col("line"), ["x", "y"]).alias("m"), C.to_cbin(F.col("v"), element="int8").alias("b")).collect()
    assert [r["m"] for r in found] == [{"x": "a", "y": '"b,c"'}, None, None, None]
    assert [r["b"] and binary.loads(bytes(r["b"]), keep_arrays=True).element for r in found] == ["int8", None, "int8", "int8"]
    words = {"+1": True, ".5": True, "1.": True, "1e": True, "0": True, "-0.5E-3": True, "1e5.": True, "05": False, ".": False, "": False, "e5": False, "1\n": False, "--1": False, "1e+-2": False}
    made = spark.createDataFrame([(w,) for w in words], "w string").select("w", C.looks_numeric(F.col("w")).alias("ok")).collect()
    assert {r["w"]: r["ok"] for r in made} == words
