"""Reading tables works each thing out once a document, so its time grows with the text alone."""

import pytest
from pyspark.sql import types as T

from compactcodec.operators import tabular

DOC = '# other\norders[2|]{more|"o_\\u006frderkey"|t{x}}:\n  x|1|2.5\n  "a|b"|2|-3\nafter: 1'


@pytest.mark.parametrize("mode", ["PERMISSIVE", "DROPMALFORMED", "FAILFAST"])
def test_lines_are_split_once(spark, mode):
    docs = spark.createDataFrame([(1, DOC)], "k long, d string")
    found = tabular.decode_tables(docs, "d", T._parse_datatype_string("o_orderkey long, t struct<x:double>"), ["k"], mode)
    assert [(r[0], r[1], r[2], r[3].x) for r in found.collect()] == [(1, 0, 1, 2.5), (1, 1, 2, -3.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("filter(split(") == 1


def test_a_wrong_number_of_rows_is_an_error(spark):
    docs = spark.createDataFrame([("t[3]{a}:\n  1",), ("t[0]{a}:\n  1",), ("t[1]{a}:",)], "d string")
    for k in range(3):
        with pytest.raises(Exception, match="malformed table"):
            tabular.decode_tables(docs.offset(k).limit(1), "d", T._parse_datatype_string("a long"), mode="FAILFAST").collect()
    assert tabular.decode_tables(docs, "d", T._parse_datatype_string("a long"), mode="DROPMALFORMED").count() == 0
