"""All queries over the driver tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compactcodec import functions as C
from compactcodec import sources
from compactcodec.functions.columns import inline_array
from compactcodec.kernel import binary
from compactcodec.operators import rows as R
from compactcodec.operators import rowschema, sessions, tabular
from compactcodec.plans import decode_join_encode
from compactcodec.plans import sql as S
from compactcodec.scratch import scratch, spread
from compactcodec.streaming import decode_session_stream, read_document_stream, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: columns of the driver tables by kind of cell
TABLES = {
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "double", "props": "text"},
    "documents": {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}
#: what the rows of one document share, and their order in it
GROUPS = {"region": ("r_regionkey", "r_name"), "nation": ("n_regionkey", "n_nationkey"), "customer": ("c_nationkey", "c_custkey"), "supplier": ("s_nationkey", "s_suppkey"), "part": ("p_brand", "p_partkey"), "orders": ("o_custkey", "o_orderkey"), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("user_id", "event_id"), "documents": ("doc_id", "lang"), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- tables as text


def _encode_rows(name: str, delimiter: str = ",") -> Callable:
    keys = list(GROUPS[name])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tabular.encode_rows(table(spark, sf_dir, name), delimiter=delimiter, keep=keys, fixed_point=True)

    return run


def _roundtrip(name: str) -> Callable:
    by, order = GROUPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        body = df.select(*[c for c in df.columns if c != by]).schema
        docs = tabular.encode_groups(df, [by], [order], key=name, fixed_point=True)
        return tabular.decode_tables(docs, "document", body, keep=[by]).select(*df.columns)

    return run


for _name, _columns in TABLES.items():
    if _name not in ("documents", "conversations"):
        query(f"tabular_encode_rows_{_name}", f"select {', '.join(GROUPS[_name])}, {S.row(_columns)} as line from {_name}")(_encode_rows(_name))
    query(f"tabular_roundtrip_{_name}", f"select {', '.join(_columns)} from {_name}")(_roundtrip(_name))
for _label, _sign in (("pipe", "|"), ("tab", "\t")):
    query(f"tabular_encode_{_label}_part", f"select {', '.join(GROUPS['part'])}, {S.row(TABLES['part'], _sign)} as line from part")(_encode_rows("part", _sign))


def _lines(columns: dict[str, str], order: str) -> str:
    return f"string_agg('  ' || {S.row(columns)}, chr(10) order by {order})"


@query("tabular_document_nation", f"select 'nation[' || count(*) || ']{{n_nationkey,n_name,n_regionkey}}:' || chr(10) || {_lines(TABLES['nation'], 'n_nationkey')} as document from nation")
def tabular_document_nation(spark, sf_dir):
    return tabular.encode_table(table(spark, sf_dir, "nation"), ["n_nationkey"], "nation")


@query("tabular_document_length_marker", f"select '[#' || count(*) || '|]{{r_regionkey|r_name}}:' || chr(10) || string_agg('    ' || {S.row(TABLES['region'], '|')}, chr(10) order by r_regionkey) as document from region")
def tabular_document_length_marker(spark, sf_dir):
    return tabular.encode_table(table(spark, sf_dir, "region"), ["r_regionkey"], None, delimiter="|", length_marker="#", indent=4)


@query("tabular_embeddings", "select vec_id, 'embedding[' || len(embedding) || ']: ' || 'same' as line, embedding[1] as first from embeddings")
def tabular_embeddings(spark, sf_dir):
    """Any double: a vector as an inline array, and its first number as a cell, read back."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("embedding")[0].alias("first"))
    rows = tabular.encode_rows(df.select("vec_id", "first"), keep=["vec_id"]).withColumnRenamed("line", "row")
    lines = df.select("vec_id", inline_array("embedding", F.col("embedding"), T.FloatType()).alias("line"))
    values = F.transform(C.split_cells(F.substring_index("line", "]: ", -1)), lambda x: C.parse_cell(x, T.FloatType()))
    same = F.when(values == F.col("embedding"), F.concat(F.substring_index("line", "]: ", 1), F.lit("]: same"))).otherwise(F.col("line"))
    found = lines.join(df, "vec_id").join(rows, "vec_id")
    return found.select("vec_id", same.alias("line"), C.parse_cell(C.split_cells(F.col("row"))[1], T.FloatType()).alias("first"))


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a customer as another writer lays them out: other columns first, pipes, a comment, quoted names, a field behind the table."""
    line = F.concat(F.lit("  "), F.concat_ws("|", F.lit("x"), C.quote_text(F.col("o_orderpriority"), "|"), F.col("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    head = F.concat(F.lit("# by another writer\norders["), F.col("n").cast("string"), F.lit('|]{more|"o_\\u006frderpriority"|t{o_totalprice}|o_orderkey}:\n'))
    return docs.select("o_custkey", F.concat(head, "body", F.lit("\nafter: 1")).alias("document"))


@query("tabular_foreign_header", "select o_custkey, o_orderkey, o_totalprice as total, o_orderpriority, cast(null as varchar) as missing from orders")
def tabular_foreign_header(spark, sf_dir):
    """The header's names, groups and delimiter decide where a column stands."""
    kind = T._parse_datatype_string("o_orderkey long, missing string, o_orderpriority string, t struct<o_totalprice:double>")
    return tabular.decode_tables(_foreign(spark, sf_dir), "document", kind, ["o_custkey"], "FAILFAST").select("o_custkey", "o_orderkey", F.col("t.o_totalprice").alias("total"), "o_orderpriority", "missing")


@query("tabular_wrong_counts", "with c as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, case when o_custkey % 3 = 0 then 0 else n end as strict, case when o_custkey % 3 = 0 then n - 1 else n end as permissive from c")
def tabular_wrong_counts(spark, sf_dir):
    """Every third document declares a row too few: left out, or read up to that number."""
    docs = _foreign(spark, sf_dir)
    n = F.regexp_extract("document", r"orders\[([0-9]+)", 1)
    wrong = F.regexp_replace("document", F.lit(r"orders\[[0-9]+"), F.concat(F.lit("orders["), (n.cast("int") - 1).cast("string")))
    docs = docs.select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, wrong).otherwise(F.col("document")).alias("document"))
    count = lambda mode: tabular.decode_tables(docs, "document", T._parse_datatype_string("o_orderkey long"), ["o_custkey"], mode).groupBy("o_custkey").agg(F.count("*").alias(mode))
    found = docs.join(count("DROPMALFORMED"), "o_custkey", "left").join(count("PERMISSIVE"), "o_custkey", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return found.select("o_custkey", zero("DROPMALFORMED").alias("strict"), zero("PERMISSIVE").alias("permissive"))


@query("tabular_nested_group", f"""select c_nationkey, 'customers[' || count(*) || ']{{c_custkey,nation{{name,region}},c_acctbal}}:' || chr(10) ||
  string_agg('  ' || {S.row({'c_custkey': 'int', 'n_name': 'text', 'n_regionkey': 'int', 'c_acctbal': 'double'})}, chr(10) order by c_custkey) as document
  from customer join nation on c_nationkey = n_nationkey group by c_nationkey""")
def tabular_nested_group(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nested = joined.select("c_nationkey", "c_custkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"), "c_acctbal")
    return tabular.encode_groups(nested, ["c_nationkey"], ["c_custkey"], "customers")


@query("tabular_nested_decode", "select c_custkey, n_name, n_regionkey, c_acctbal from customer join nation on c_nationkey = n_nationkey")
def tabular_nested_decode(spark, sf_dir):
    kind = T._parse_datatype_string("c_custkey long, nation struct<name:string,region:int>, c_acctbal double")
    made = tabular.decode_tables(tabular_nested_group(spark, sf_dir), "document", kind)
    return made.select("c_custkey", F.col("nation.name").alias("n_name"), F.col("nation.region").alias("n_regionkey"), "c_acctbal")


@query("keyed_document_nation", f"select 'nations[' || count(*) || ':]{{n_nationkey,n_regionkey}}:' || chr(10) || string_agg('  ' || case when regexp_matches(n_name, '^[A-Za-z_][A-Za-z0-9_.]*$') then n_name else '\"' || n_name || '\"' end || ': ' || n_nationkey || ',' || n_regionkey, chr(10) order by n_name) as document from nation")
def keyed_document_nation(spark, sf_dir):
    return tabular.encode_keyed(table(spark, sf_dir, "nation"), "n_name", "nations")


@query("keyed_decode_nation", "select n_name, n_nationkey, n_regionkey from nation")
def keyed_decode_nation(spark, sf_dir):
    found = keyed_document_nation(spark, sf_dir).select(C.from_ctext(F.col("document"), "nations map<string,struct<n_nationkey:int,n_regionkey:int>>").alias("v"))
    return found.select(F.explode("v.nations").alias("n_name", "r")).select("n_name", "r.*")


@query("inline_array_per_region", "select n_regionkey, 'names[' || count(*) || ']: ' || string_agg(" + S.quoted("n_name") + ", ',' order by n_name) as line from nation group by n_regionkey")
def inline_array_per_region(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", inline_array("names", F.col("names"), T.StringType()).alias("line"))


# ---------------------------------------------------------------- whole documents


def _order_record() -> Column:
    return F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority")).alias("customer"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_totalprice").alias("total"))


@query("encode_objects_orders", f"""select o_orderkey, 'id: ' || o_orderkey || chr(10) || 'customer:' || chr(10) || '  key: ' || o_custkey || chr(10) || '  priority: ' || {S.quoted('o_orderpriority')} || chr(10) ||
  'tags[2]: ' || {S.quoted('o_orderstatus')} || ',' || {S.quoted('o_orderpriority')} || chr(10) || 'total: ' || {S.number('o_totalprice')} as document from orders""")
def encode_objects_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.to_ctext(_order_record()).alias("document"))


@query("decode_objects_orders", "select o_orderkey as id, o_custkey as key, o_orderpriority as priority, o_orderstatus as status, o_totalprice as total from orders")
def decode_objects_orders(spark, sf_dir):
    kind = "id long, customer struct<key:long,priority:string>, tags array<string>, total double"
    found = encode_objects_orders(spark, sf_dir).select(C.from_ctext(F.col("document"), kind).alias("v"))
    return found.select("v.id", "v.customer.key", "v.customer.priority", F.col("v.tags")[0].alias("status"), "v.total")


@query("encode_objects_native", ORACLE_SQL["encode_objects_orders"])
def encode_objects_native(spark, sf_dir):
    """The same documents from generated code alone."""
    record = table(spark, sf_dir, "orders").select("o_orderkey", _order_record().alias("v"))
    return record.select("o_orderkey", C.object_text(record.schema["v"].dataType, F.col("v"), fixed_point=True).alias("document"))


@query("flat_objects_native", "select o_orderkey as id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def flat_objects_native(spark, sf_dir):
    """Flat records as documents and back, from generated code alone."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return df.select(C.object_text(df.schema, fixed_point=True).alias("d")).select(*C.parse_object(F.col("d"), df.schema))


@query("list_form_mixed", f"select n_nationkey, '[3]:' || chr(10) || '  - ' || {S.quoted('n_name')} || chr(10) || '  - id: ' || n_nationkey || chr(10) || '    region: ' || n_regionkey || chr(10) || '  - [2]: 1,' || n_regionkey as document from nation")
def list_form_mixed(spark, sf_dir):
    value = F.concat(F.lit("["), F.to_json(F.array("n_name")).substr(F.lit(2), F.length(F.to_json(F.array("n_name"))) - 2), F.lit(',{"id":'), F.col("n_nationkey"), F.lit(',"region":'), F.col("n_regionkey"), F.lit("},[1,"), F.col("n_regionkey"), F.lit("]]"))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.to_ctext(value, json_input=True).alias("document"))


@query("json_roundtrip_events", "select event_id, props from events")
def json_roundtrip_events(spark, sf_dir):
    """JSON text to a document and back, in its own key order."""
    made = table(spark, sf_dir, "events").select("event_id", C.to_ctext(F.col("props"), json_input=True).alias("document"))
    return made.select("event_id", F.replace(F.replace(C.from_ctext_json(F.col("document")), F.lit(":"), F.lit(": ")), F.lit(","), F.lit(", ")).alias("props"))


@query("infer_schema_orders", "select 'struct<id:bigint,customer:struct<key:bigint,priority:string>,tags:array<string>,total:double>' as kind")
def infer_schema_orders(spark, sf_dir):
    kind = C.infer_schema(encode_objects_orders(spark, sf_dir), "document")
    return spark.createDataFrame([(kind.simpleString(),)], "kind string")


#: rules of the notation, a document that breaks each (made of a customer's row), and whether a strict and a lenient reader take it
RULES = [
    ("row of another width", "who[2]{{k,n}}:\n  {k},{n}\n  {k}", False, True),
    ("more values than declared", "ids[1]: {k},{k}", False, True),
    ("blank line between items", "who[2]:\n  - {k}\n\n  - {n}", False, True),
    ("a key twice", "k: {k}\nk: {n}", False, True),
    ("a level left out", "who:\n    k: {k}", False, False),
    ("unknown escape", 'n: "{n}\\z"', False, False),
    ("string without end", 'n: "{n}', False, False),
    ("tab as indentation", "who:\n\tk: {k}", False, True),
    ("length that is none", "ids[k]: {k}", False, True),
    ("sound", "k: {k}\nboth[2]: {k},{n}", True, True),
    ("a comment alone", "# {n}", True, True),
]


@query("strict_validation_report", "select c_custkey, name, strict, lenient from customer, (values " + ", ".join(f"('{n}', {str(s).lower()}, {str(x).lower()})" for n, _, s, x in RULES) + ") as t(name, strict, lenient)")
def strict_validation_report(spark, sf_dir):
    """Each rule, tried on a document of every customer."""
    def document(form: str) -> Column:
        key, name = F.col("c_custkey").cast("string"), F.col("c_name")
        parts = [x for p in form.replace("{{", "\x01").replace("}}", "\x02").split("{k}") for x in (F.lit("\x03"), p)][1:]
        made = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
        return F.replace(F.replace(F.replace(F.replace(made, F.lit("\x03"), key), F.lit("{n}"), name), F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))

    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), document(d).alias("document")) for n, d, _, _ in RULES]))
    docs = table(spark, sf_dir, "customer").select("c_custkey", rows.alias("r")).select("c_custkey", "r.*")
    return docs.select("c_custkey", "name", C.is_valid_ctext(F.col("document")).alias("strict"), C.is_valid_ctext(F.col("document"), strict=False).alias("lenient"))


# ---------------------------------------------------------------- scalars


@query("quote_predicate", f"select doc_id, {S.bare('text')} as bare, {S.quoted('text')} as token from documents")
def quote_predicate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.is_bare(F.col("text")).alias("bare"), C.quote_text(F.col("text")).alias("token"))


@query("unquote_documents", "select doc_id, text from documents")
def unquote_documents(spark, sf_dir):
    token = table(spark, sf_dir, "documents").select("doc_id", C.quote_text(F.col("text")).alias("token"))
    return token.select("doc_id", C.parse_cell(F.col("token"), T.StringType()).alias("text"))


@query("key_predicate", "select p_partkey, case when regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_.]*$') then p_name else '\"' || p_name || '\"' end as key from part")
def key_predicate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.quote_key_text(F.col("p_name")).alias("key"))


_NUMERIC_FORMS = ["{}", "0{}", "+{}", "{}.", ".{}", "{}.50", "-{}e1", "1e-{}", "{}_0", "0x{}"]
_LITERAL_RX = "^-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?$"


@query("numeric_tokens", "with w as (select p_partkey, unnest([" + ", ".join("'" + f.replace("{}", "' || (p_size % 30) || '") + "'" for f in _NUMERIC_FORMS) + f"]) as word from part) select p_partkey, word, regexp_matches(word, '^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') as number_like, try_cast(case when regexp_matches(word, '{_LITERAL_RX}') then word end as double) as number from w")
def numeric_tokens(spark, sf_dir):
    """What looks like a number, and what is one, over all parts' sizes in ten notations."""
    from compactcodec.kernel.scalars import NUMERIC_LIKE

    size = (F.col("p_size") % 30).cast("string")
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.concat(F.lit(f.split("{}")[0]), size, F.lit(f.split("{}")[1])) for f in _NUMERIC_FORMS])).alias("word"))
    return words.select("p_partkey", "word", F.col("word").rlike(NUMERIC_LIKE).alias("number_like"), C.parse_cell(F.col("word"), T.DoubleType()).alias("number"))


#: writings of a positive number, and whether the looser test takes them
_LENIENT_FORMS = {"+{}": True, ".{}": True, "{}.": True, "{}e": True, "{}.e": True, "-{}E+": True, "{}e5.5": True, "0{}": False, "{}-": False, "{}..": False, "e{}": False, "{}.5.": False, "+-{}": False, " {}": False}


@query("lenient_numbers", "select p_partkey, " + ", ".join(f"{str(ok).lower()} as form{k}" for k, ok in enumerate(_LENIENT_FORMS.values())) + " from part")
def lenient_numbers(spark, sf_dir):
    """Fourteen writings of each part's size."""
    word = lambda f: F.concat(F.lit(f.split("{}")[0]), F.col("p_size").cast("string"), F.lit(f.split("{}")[1]))
    return table(spark, sf_dir, "part").select("p_partkey", *[C.looks_numeric(word(f)).alias(f"form{k}") for k, f in enumerate(_LENIENT_FORMS)])


@query("canonical_number_lineitem", f"select l_orderkey, l_linenumber, {S.number('l_extendedprice')} as price, {S.number('l_discount')} as discount from lineitem")
def canonical_number_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.canonical_number(F.col("l_extendedprice")).alias("price"), C.number_text(F.col("l_discount"), T.DoubleType(), True).alias("discount"))


@query("line_types", "select doc_id, k, case k when 0 then 'listItem' when 1 then 'arrayHeader' when 2 then 'arrayHeader' when 3 then 'keyValue' when 4 then 'keyValue' when 5 then 'dataRow' when 6 then 'primitive' else 'blank' end as line_type from documents, unnest(generate_series(0, 7)) as t(k)")
def line_types(spark, sf_dir):
    """Lines made of every document's columns, by their form."""
    quoted = F.concat(F.lit('"'), C.escape_text(F.left("text", F.lit(50))), F.lit('"'))
    forms = [F.concat(F.lit("- "), "lang"), F.concat("lang", F.lit("[2]: 1,2")), F.concat("source", F.lit("[1]{a,b}:")), F.concat("lang", F.lit(": "), quoted), F.concat(quoted, F.lit(": 1")), F.concat("lang", F.lit(","), F.col("n_chars").cast("string")), F.col("lang"), F.lit("  ")]
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*forms)).alias("k", "line"))
    return lines.select("doc_id", F.col("k").cast("bigint").alias("k"), C.line_type(F.col("line")).alias("line_type"))


@query("split_cells_part", "select p_partkey, 0 as pos, cast(p_partkey as varchar) as cell from part union all select p_partkey, 1, p_name from part union all select p_partkey, 2, 'a,\"b' from part")
def split_cells_part(spark, sf_dir):
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), C.quote_text(F.col("p_name")), F.lit('"a,\\"b"'))
    cells = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.split_cells(line)).alias("pos", "cell"))
    return cells.select("p_partkey", "pos", C.parse_cell(F.col("cell"), T.StringType()).alias("cell"))


@query("cells_by_name_part", "select p_partkey, p_name as name, cast(p_size as integer) as size, true as short from part")
def cells_by_name_part(spark, sf_dir):
    line = F.concat_ws("|", C.quote_text(F.col("p_name"), "|"), F.col("p_size").cast("string"))
    made = table(spark, sf_dir, "part").select("p_partkey", C.cells_by_name(line, ["name", "size"], "|").alias("m"), C.cells_by_name(line, ["name"], "|").isNull().alias("short"))
    return made.select("p_partkey", C.parse_cell(F.col("m")["name"], T.StringType()).alias("name"), C.parse_cell(F.col("m")["size"], T.IntegerType()).alias("size"), "short")


@query("utf8_length_documents", "select doc_id, cast(strlen(text) as integer) as bytes from documents")
def utf8_length_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.utf8_length(F.col("text")).alias("bytes"))


@query("estimate_size_nation", "select n_nationkey, cast(64 + length('n_nationkey') + 24 + length('n_name') + 12 + length(n_name) + length('n_regionkey') + 24 as integer) as size from nation")
def estimate_size_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", C.estimate_size(df.schema).alias("size"))


# ---------------------------------------------------------------- rows and items


def _two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a region: its name, then its nations, then a list of their names."""
    nations = tabular.encode_groups(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], "nations")
    listed = inline_array_per_region(spark, sf_dir)
    document = F.concat(F.lit("ids[1]{a}:\n  1\n"), F.col("document"), F.lit("\n"), F.col("line"))
    return nations.join(listed, "n_regionkey").select("n_regionkey", document.alias("document"))


@query("rows_at_key", "select n_regionkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as row_idx, n_nationkey, n_name from nation")
def rows_at_key(spark, sf_dir):
    found = R.lateral(_two_tables(spark, sf_dir), "document", "ctext_rows", "nations", ["n_regionkey"])
    v = F.from_json("row", "n_nationkey int, n_name string")
    return found.select("n_regionkey", "row_idx", v.alias("v")).select("n_regionkey", "row_idx", "v.n_nationkey", "v.n_name")


@query("rows_with_schema", "select n_regionkey, n_nationkey as id, n_name as label from nation")
def rows_with_schema(spark, sf_dir):
    """Names of a schema in place of the header's."""
    found = R.lateral(_two_tables(spark, sf_dir), "document", "ctext_rows", "nations", ["n_regionkey"], ["id", "label"])
    return found.select("n_regionkey", F.from_json("row", "id int, label string").alias("v")).select("n_regionkey", "v.id", "v.label")


@query("first_table_rows", "select n_regionkey, 0 as row_idx, '{\"a\":1}' as row from nation group by n_regionkey")
def first_table_rows(spark, sf_dir):
    return R.lateral(_two_tables(spark, sf_dir), "document", "ctext_rows", None, ["n_regionkey"])


@query("list_items", "select n_regionkey, cast(row_number() over (partition by n_regionkey order by n_name) - 1 as integer) as item_idx, '\"' || n_name || '\"' as item from nation")
def list_items(spark, sf_dir):
    return R.lateral(_two_tables(spark, sf_dir), "document", "ctext_items", "names", ["n_regionkey"])


@query("raw_rows", f"select n_regionkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as row_idx, {S.row({'n_nationkey': 'int', 'n_name': 'text'})} as line, 2 as width from nation")
def raw_rows(spark, sf_dir):
    return R.lateral(_two_tables(spark, sf_dir), "document", "ctext_raw_rows", "nations", ["n_regionkey"]).select("n_regionkey", "row_idx", "line", F.size("cells").alias("width"))


@query("document_lines", "select n_regionkey, line_type, cast(count(*) as bigint) as n from (select n_regionkey, unnest(['arrayHeader', 'arrayHeader', 'arrayHeader', 'primitive']) as line_type from (select distinct n_regionkey from nation) union all select n_regionkey, 'dataRow' from nation) group by all")
def document_lines(spark, sf_dir):
    return R.lateral(_two_tables(spark, sf_dir), "document", "ctext_lines", None, ["n_regionkey"]).groupBy("n_regionkey", "line_type").agg(F.count("*").alias("n"))


@query("chunked_rows", "select c_nationkey, cast(floor((rn - 1) / 10) as bigint) as chunk, cast(count(*) as integer) as n, min(c_custkey) as first_key from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) group by 1, 2")
def chunked_rows(spark, sf_dir):
    docs = tabular.encode_groups(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_custkey"], "customers")
    rows = tabular.decode_tables(docs, "document", T._parse_datatype_string("c_custkey long, c_name string"), keep=["c_nationkey"])
    found = R.chunks(rows, ["c_nationkey"], "row_idx", 10)
    return found.select("c_nationkey", "chunk", F.size("rows").alias("n"), F.col("rows")[0]["c_custkey"].alias("first_key"))


@query("conversations_by_row", "select conv_id, turn, role, text from conversations")
def conversations_by_row(spark, sf_dir):
    """One document a conversation, its rows by the table function."""
    docs = tabular.encode_groups(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turns")
    found = R.lateral(docs, "document", "ctext_rows", "turns", ["conv_id"])
    return found.select("conv_id", F.from_json("row", "turn long, role string, text string").alias("v")).select("conv_id", "v.turn", "v.role", "v.text")


# ---------------------------------------------------------------- row schemas


FLAT = rowschema.FlattenedSchema.named("o.key", "o.status", "c.name")


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("o"), F.struct(F.col("c_name").alias("name")).alias("c"))


@query("flatten_schema", 'select o_orderkey as "o.key", o_orderstatus as "o.status", c_name as "c.name" from orders join customer on o_custkey = c_custkey')
def flatten_schema(spark, sf_dir):
    return FLAT.project(_nested_orders(spark, sf_dir))


@query("unflatten_schema", "select o_orderkey as key, o_orderstatus as status, c_name as name from orders join customer on o_custkey = c_custkey")
def unflatten_schema(spark, sf_dir):
    return FLAT.restore(flatten_schema(spark, sf_dir)).select("o.key", "o.status", "c.name")


CODES = rowschema.EnumSchema.named("o_orderkey", "o_orderstatus", codes={"o_orderstatus": {"O": 1, "F": 2}})


@query("enum_encode", "select o_orderkey, case o_orderstatus when 'O' then '1' when 'F' then '2' else o_orderstatus end as o_orderstatus from orders")
def enum_encode(spark, sf_dir):
    return CODES.project(table(spark, sf_dir, "orders"))


@query("enum_decode", "select o_orderkey, o_orderstatus from orders")
def enum_decode(spark, sf_dir):
    return CODES.restore(enum_encode(spark, sf_dir))


@query("schema_project", "select n_name, cast(null as varchar) as capital, n_regionkey from nation")
def schema_project(spark, sf_dir):
    made = rowschema.RowSchema.named("n_name", "capital", "n_regionkey").project(table(spark, sf_dir, "nation"))
    return made.withColumn("capital", F.col("capital").cast("string"))


@query("schema_matches", "select event_id, value is null as value_fits, props is null as props_fits from (select event_id, case when value < 50 then null else value end as value, case when event_id % 2 = 0 then props end as props from events)")
def schema_matches(spark, sf_dir):
    """Decided by the rows: a field of another kind than the declared one fits only where it is null."""
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 50, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"))
    field = rowschema.SchemaField
    one = rowschema.RowSchema((field("event_id", "integer", True), field("value", "string"), field("props", "string"), field("more", "array")))
    other = rowschema.RowSchema((field("props", "number"), field("value", "number"), field("event_id", "integer", True)))
    return df.select("event_id", one.matches_frame(df).alias("value_fits"), other.matches_frame(df).alias("props_fits"))


@query("encode_with_schema_nation", f"select 'nation[' || count(*) || ']{{n_nationkey,n_name}}:' || chr(10) || {_lines({'n_nationkey': 'int', 'n_name': 'text'}, 'n_nationkey')} as document from nation")
def encode_with_schema_nation(spark, sf_dir):
    return tabular.encode_table(rowschema.RowSchema.named("n_nationkey", "n_name").project(table(spark, sf_dir, "nation")), ["n_nationkey"], "nation")


# ---------------------------------------------------------------- binary


def _bin_roundtrip(name: str, schema: bool = False) -> Callable:
    by, order = GROUPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        plain = df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in times})
        kind = T.ArrayType(plain.select(*[c for c in plain.columns if c != by]).schema)
        grouped = plain.groupBy(by).agg(F.collect_list(F.struct(*[c for c in plain.columns if c != by])).alias("rows"))
        made = grouped.select(by, C.to_cbin(F.col("rows"), "auto" if schema else None).alias("message"))
        back = made.select(by, F.explode(C.from_cbin(F.col("message"), kind, mode="FAILFAST")).alias("v")).select(by, "v.*")
        return back.withColumns({c: F.timestamp_micros(c).cast(df.schema[c].dataType) for c in times}).select(*df.columns)

    return run


for _name in ("orders", "lineitem", "events"):
    query(f"bin_roundtrip_{_name}", f"select {', '.join(TABLES[_name])} from {_name}")(_bin_roundtrip(_name))
query("bin_schema_mode_orders", f"select {', '.join(TABLES['orders'])} from orders")(_bin_roundtrip("orders", True))


@query("bin_small_integers", "select i, '42544f4e01000000' || case when i between -32 and 95 then lower(printf('%02x', i + 64)) else '03' || lower(printf('%02x%02x%02x%02x', i & 255, (i >> 8) & 255, (i >> 16) & 255, (i >> 24) & 255)) end as message from (select cast(unnest(generate_series(-40, 300)) as bigint) as i)")
def bin_small_integers(spark, sf_dir):
    return spark.range(-40, 301).select(F.col("id").alias("i"), F.lower(F.hex(C.to_cbin(F.col("id")))).alias("message"))


@query("bin_typed_array_embeddings", "select vec_id, cast(len(embedding) as integer) as n, cast(18 + 4 * len(embedding) - (18 % 4) + 0 as integer) as size, true as same from embeddings")
def bin_typed_array_embeddings(spark, sf_dir):
    made = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", C.to_cbin(F.col("embedding")).alias("message"))
    back = made.withColumn("back", C.from_cbin(F.col("message"), "array<float>"))
    return back.select("vec_id", F.size("embedding").alias("n"), F.octet_length("message").alias("size"), (F.col("back") == F.col("embedding")).alias("same"))


@query("bin_typed_array_element", "select vec_id, cast(16 + 8 * len(embedding) as integer) as size, true as same from embeddings")
def bin_typed_array_element(spark, sf_dir):
    """Arrays written with the caller's element type in place of the narrowest."""
    made = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", C.to_cbin(F.col("embedding"), element="float64").alias("message"))
    same = C.from_cbin(F.col("message"), "array<float>") == F.col("embedding")
    return made.select("vec_id", F.octet_length("message").alias("size"), same.alias("same"))


@query("bin_object_table_lineitem", "select l_orderkey, cast(count(*) as integer) as n, true as columnar, cast(sum(l_partkey) as bigint) as parts, cast(sum(cast(l_tax as decimal(18,2))) as decimal(18,2)) as tax from lineitem group by l_orderkey")
def bin_object_table_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_tax")).alias("rows"))
    made = rows.select("l_orderkey", C.to_cbin(F.col("rows")).alias("message"))
    back = made.withColumn("back", C.from_cbin(F.col("message"), "array<struct<l_partkey:long,l_suppkey:long,l_quantity:double,l_tax:double>>"))
    # no string table here, so the body follows the envelope
    columnar = F.substr("message", F.lit(9), F.lit(1)) == F.lit(bytes([binary.OBJECT_TABLE]))
    total = lambda f, kind: F.aggregate("back", F.lit(0).cast(kind), lambda a, x: (a + x[f].cast(kind)).cast(kind))
    return back.select("l_orderkey", F.size("back").alias("n"), columnar.alias("columnar"), total("l_partkey", "long").alias("parts"), total("l_tax", "decimal(18,2)").alias("tax"))


@query("bin_derive_schema", "select * from (values ('event_id', 'int64'), ('event_type', 'string'), ('late', 'float64'), ('never', 'null'), ('value', 'float64')) as t(field, element)")
def bin_derive_schema(spark, sf_dir):
    """Over all events, with a field that most of them lack and one that none has."""
    late = F.when(F.col("event_id") == F.lit(table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]), F.col("value"))
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value", late.alias("late"), F.lit(None).cast("string").alias("never"))
    return spark.createDataFrame(list(C.derive_schema(df).fields), "field string, element string")


@query("bin_out_of_band_schema", f"select {', '.join(c for c in TABLES['orders'] if c != 'o_orderdate')} from orders")
def bin_out_of_band_schema(spark, sf_dir):
    """Records whose messages leave their schema out, read under the schema that both sides know."""
    df = table(spark, sf_dir, "orders").drop("o_orderdate")
    schema = C.derive_schema(df)
    made = df.select(C.to_cbin(F.struct(*df.columns), schema, embed_schema=False).alias("message"))
    return made.select(C.from_cbin(F.col("message"), df.schema, schema, "FAILFAST").alias("v")).select("v.*")


@query("bin_string_table_frequency", "with w as (select doc_id, unnest([lang, source]) as entry, generate_subscripts([lang, source], 1) as k from documents) select entry, cast(count(*) as bigint) as n, cast(row_number() over (order by min(doc_id * 2 + k)) - 1 as integer) as place from w group by entry having count(*) >= 2")
def bin_string_table_frequency(spark, sf_dir):
    """The string table of two columns: strings that occur twice or more, in the order of their first places."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return C.string_table(df, ["lang", "source"], ["doc_id"])


@query("session_dictionary_conversations", "select cast(conv_id as varchar) as session, turn as seq, role, text from conversations")
def session_dictionary_conversations(spark, sf_dir):
    value = F.to_json(F.struct("role", "text"))
    sent = sessions.encode_sessions(table(spark, sf_dir, "conversations").withColumn("value", value), "conv_id", "turn", "value")
    got = sessions.decode_sessions(sent)
    return got.select("session", "seq", F.from_json("value", "role string, text string").alias("v")).select("session", "seq", "v.role", "v.text")


# ---------------------------------------------------------------- files, streams, compositions


@query("source_table_files", "select c_custkey, c_name, c_acctbal from customer")
def source_table_files(spark, sf_dir):
    path, df = scratch(spark, "tables"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    sources.write_tables(df, path, "customers", fixed_point=True)
    return sources.read_tables(spark, path, df.schema).select(*df.columns)


@query("source_big_table", "select l_orderkey, l_linenumber, l_extendedprice, l_returnflag from lineitem")
def source_big_table(spark, sf_dir):
    path, df = scratch(spark, "tables"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    sources.write_tables(df, path, fixed_point=True)
    return sources.read_big_table(spark, path, df.schema)


def _source(name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources.register(spark)
        path = scratch(spark, name)
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format(name).mode("append").save(path)
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format(name).mode("overwrite").save(path)
        found = spark.read.format(name).load(path)
        rows = F.explode(F.from_json("value", "array<struct<s_suppkey:bigint,s_name:string,s_acctbal:double>>"))
        return found.select(rows.alias("v")).select("v.*")

    return run


for _name in ("ctext", "cbin"):
    query(f"datasource_{_name}", "select s_suppkey, s_name, s_acctbal from supplier")(_source(_name))


def _drain(spark: SparkSession, stream: DataFrame, what: str) -> DataFrame:
    path, state = scratch(spark, what), scratch(spark, f"{what}-state")
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_documents", "select o_orderkey as id, o_totalprice as total from orders")
def stream_documents(spark, sf_dir):
    """All orders as documents that arrive as files, about 2,000 orders a file, decoded as a stream."""
    path, orders = scratch(spark, "arriving"), table(spark, sf_dir, "orders")
    files = F.pmod(F.xxhash64("o_orderkey"), F.lit(orders.count() // 2000 + 1))
    rows = orders.groupBy(files.alias("file")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))).alias("orders"))
    rows.select("file", C.to_ctext(F.struct("orders")).alias("value")).write.partitionBy("file").text(path)
    stream = read_document_stream(spark, f"{path}/*", "orders array<struct<id:long,total:double>>")
    return _drain(spark, stream.select(F.explode("orders").alias("v")).select("v.*"), "stream")


@query("stream_sessions", "select cast(conv_id as varchar) as session, turn as seq, role from conversations")
def stream_sessions(spark, sf_dir):
    """Messages of sessions as a stream, with the dictionary as state."""
    path = scratch(spark, "messages")
    value = F.to_json(F.struct("role", "text"))
    sent = sessions.encode_sessions(table(spark, sf_dir, "conversations").withColumn("value", value), "conv_id", "turn", "value")
    sent.write.parquet(path)
    got = _drain(spark, decode_session_stream(spark.readStream.schema(sent.schema).parquet(path)), "sessions")
    return got.select("session", "seq", F.from_json("value", "role string").alias("v")).select("session", "seq", "v.role")


@query("stream_windowed_counts", "select date_trunc('hour', ts) as start, event_type, cast(count(*) as bigint) as n from events group by 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """Counts an hour and type of events that arrive as documents."""
    path, name = scratch(spark, "events"), f"counts_{uuid.uuid4().hex}"
    value = F.struct("event_id", F.col("ts").cast("string").alias("ts"), "event_type")
    table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(value).alias("events")).select(C.to_ctext(F.struct("events")).alias("document")).write.parquet(path)
    rows = C.from_ctext(F.col("document"), "events array<struct<event_id:long,ts:string,event_type:string>>")
    stream = spark.readStream.schema("document string").parquet(path).select(F.explode(rows["events"]).alias("v")).select(F.col("v.ts").cast("timestamp").alias("ts"), "v.event_type")
    counts = windowed_counts(stream, "ts", "10 minutes", "1 hour", "event_type")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("decode_join_aggregate_encode", """with totals as (select n_name, count(*) as n, sum(cast(c_acctbal as decimal(18,2))) as total from customer join nation on c_nationkey = n_nationkey group by n_name),
  lines as (select left(n_name, 1) as letter, n_name, '  ' || n_name || ',' || n || ',' || regexp_replace(regexp_replace(cast(total as varchar), '0+$', ''), '\\.$', '') as line from totals)
select letter, 'nations[' || count(*) || ']{n_name,n,total}:' || chr(10) || string_agg(line, chr(10) order by n_name) as document from lines group by letter""")
def decode_join_aggregate_encode(spark, sf_dir):
    docs = tabular.encode_groups(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"], "customers", columns=["c_custkey", "c_nationkey", "c_acctbal"], fixed_point=True)
    kind = T._parse_datatype_string("c_custkey long, c_nationkey int, c_acctbal double")
    return decode_join_encode(docs, "document", kind, table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "n_name", "c_acctbal", "nations")
