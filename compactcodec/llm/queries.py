"""The thin queries ``opN_<name>`` over the whole driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compactcodec.llm import chat_format, decontaminate, html_extract, line_dedup, near_dup, packing, pii, quality_rules, token_file, warc
from compactcodec.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: code points of a streamed delta, and numbers kept free for the events of a turn
DELTA_CHARS, EVENTS_A_TURN = 256, 1 << 20


def chat_events(rows: DataFrame) -> DataFrame:
    """The event log that ends in these turns (conv_id, turn, role, text).

    An assistant's text is streamed in deltas; before that, some turns stream a draft that a
    regeneration discards.  Some users' texts are first written wrong and then edited.  A rule on
    conv_id and turn decides which.  Each row is a message of its own, rows of one turn too.
    """
    text = F.coalesce("text", F.lit(""))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    event = lambda name, said: F.struct(F.lit(name).alias("event"), said.alias("said"))
    empty = F.lit("")
    streamed = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)), lambda x: event(chat_format.DELTA, x))
    draft = F.array(event(chat_format.DELTA, F.lit("a draft ")), event(chat_format.DELTA, F.left(text, F.lit(40))), event(chat_format.REGENERATE, empty))
    assistant = F.concat(F.array(event(chat_format.MESSAGE, empty)), F.when(kind == 0, draft).otherwise(F.slice(draft, 1, 0)), streamed)
    user = F.when(kind == 0, F.array(event(chat_format.MESSAGE, F.concat(F.lit("wrong: "), text)), event(chat_format.DELTA, F.lit("?")), event(chat_format.EDIT, text))).otherwise(F.array(event(chat_format.MESSAGE, text)))
    numbered = rows.withColumn("message_id", F.monotonically_increasing_id())
    log = numbered.select("conv_id", "turn", "message_id", "role", F.posexplode(F.when(F.col("role") == chat_format.TRAINED, assistant).otherwise(user)).alias("k", "e"))
    seq = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 41))) * EVENTS_A_TURN + F.col("k")
    return log.select("conv_id", seq.alias("seq"), "e.event", "message_id", F.when(F.col("k") == 0, F.col("role")).alias("role"), F.col("e.said").alias("text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], rows.schema)
    made = chat_format.format_chats(chat_events(rows.unionByName(probe)))
    turns = chat_format.read_back(F.col("formatted"))
    loss = made.withColumn("turns", turns).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return loss.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a full response, followed by a revisit with its entity tag and one with another; a third revisit is no later than the response."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    tag, at = F.md5("html"), F.col("page_id") * 10
    text = lambda c: c.cast("string")

    def capture(number: int, kind: str, late: int, etag, server: str):
        time = at + late
        headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text(time), F.lit("ETag"), etag, F.lit("Server"), F.lit(server))
        body = F.col("html") if kind == "response" else F.lit(None).cast("string")
        return F.struct((F.col("page_id") * 4 + number).alias("record_id"), "url", time.alias("at"), F.lit(kind).alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"), body.alias("body"))

    log = F.array(capture(0, "response", 5, tag, "a"), capture(1, "revisit", 6, F.concat(F.lit("W/"), tag), "b"), capture(2, "revisit", 7, F.md5("url"), "b"), capture(3, "revisit", 5, tag, "b"))
    made = warc.resolve_revisits(pages.select(F.explode(log).alias("c")).select("c.*"), span=10_000)
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n")
    return made.select("record_id", "status", "resolved_id", lines.alias("headers"), F.char_length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_file.token_files(spark, docs, tokenizer_path("word_bpe_49k.json"), 2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(of(*pii.BASE)), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_near_dup, op4_chat_formatting, op5_warc, op6_html_extraction, op7_quality_rules, op8_decontaminate, op9_token_file, op10_pii)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_line_dedup": f"""
with rows_ as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from rows_),
keyed as (select *, {_LOWER.format(f"trim(line, {_WS})")} as k from lines),
common as (select k, max(doc_id) as holder from keyed where length(k) >= 20 and doc_id is not null group by k having count(distinct doc_id) >= 3),
marked as (select keyed.*, common.k is not null and keyed.doc_id <> common.holder as gone from keyed left join common on keyed.k = common.k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where coalesce(gone, false)) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not coalesce(gone, false)), '')) as kept_sha256
from marked group by r, doc_id""",
    "op4_chat_formatting": r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(4 + length(role) + 1 + 8 + length(text)
         + 2 * (length(text) + length(role)) - length(replace(text, '\', '')) - length(replace(role, '\', ''))
         - length(replace(replace(text, '<', ''), '#', '')) - length(replace(replace(replace(role, '<', ''), '#', ''), chr(10), ''))) as bigint) as formatted_chars
from rows_ group by conv_id""",
    "op5_warc": r"""
with parts as (select page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') as rest from pages),
split_ as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':[0-9]*$', ''), '^(www|m)\.', '') as host,
    regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&') as fields
  from parts),
keyed as (select page_id, url, html, host || case when path = '' then '/' else path end || case when fields = '' then '' else '?' || fields end as k, md5(html) as tag from split_),
revisits as (
  select page_id * 4 + n as record_id, k, page_id * 10 + late as "at", case n when 2 then md5(url) else tag end as etag, case n when 1 then 'W/' || tag when 2 then md5(url) else tag end as raw_tag
  from keyed, (values (1, 6), (2, 7), (3, 5)) as v(n, late)),
found as (
  select r.*, (select max(struct_pack("at" := s.page_id * 10 + 5, id := s.page_id * 4)) from keyed s where s.k = r.k and s.page_id * 10 + 5 < r."at") as hit from revisits r),
joined as (select f.*, s.html, s.tag, f.hit.id as resolved_id, f.etag = s.tag as same from found f left join keyed s on s.page_id * 4 = f.hit.id)
select record_id, case when resolved_id is null then 'no earlier response' when coalesce(same, false) then 'resolved' else 'validator mismatch' end as status, resolved_id,
  'content-type: text/html' || chr(10) || 'date: ' || cast("at" as varchar) || chr(10) || 'etag: ' || raw_tag || chr(10) || 'server: ' || case when coalesce(same, false) then 'a' else 'b' end as headers,
  case when coalesce(same, false) then cast(length(html) as bigint) end as n_chars, case when coalesce(same, false) then sha256(html) end as body_sha256
from joined""".replace("\\\\", "\\"),
    "op3_near_dup": rf"""
with recursive rows_ as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct r, doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from (select r, doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from rows_ where len(w) > 0)),
sizes as (select r, doc_id, count(*) as n from shingles group by r, doc_id),
both_ as (select a.r as x, b.r as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.r < b.r group by a.r, b.r),
linked as (select distinct p.doc_id as x, q.doc_id as y from both_ join sizes p on p.r = x join sizes q on q.r = y where 100 * both_.n >= 75 * (p.n + q.n - both_.n)),
edges as (select x, y from linked union select y, x from linked),
reach as (select doc_id as x, doc_id as c from documents union select e.y, reach.c from reach join edges e on e.x = reach.x),
named as (select x, min(c) as component_id from reach group by x)
select rows_.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, rows_.doc_id = component_id as kept
from rows_ left join sizes using (r) join named on named.x = rows_.doc_id""",
    "op7_quality_rules": rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
words as (select r, unnest(w) as w, generate_subscripts(w, 1) as pos from (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs)),
grams as (select r, w, pos, {", ".join(f"case when lead(w, {n - 1}) over of is not null then " + " || ' ' || ".join(f"lead(w, {k}) over of" for k in range(n)) + f" end as g{n}" for n in (4, 8, 12))} from words window of as (partition by r order by pos)),
twice as (select r, w, pos, {", ".join(f"g{n} is not null and count(*) over (partition by r, g{n}) > 1 as d{n}" for n in (4, 8, 12))} from grams),
covered as (select r, length(w) as chars, {", ".join(f"bool_or(d{n}) over (partition by r order by pos rows between {n - 1} preceding and current row) as c{n}" for n in (4, 8, 12))} from twice),
by_word as (select r, count(*) as n, sum(chars) as chars, sum(cast(c8 as int)) as repeats, {", ".join(f"sum(case when c{n} then chars else 0 end) / sum(chars) as s{n}" for n in (4, 8, 12))} from covered group by r),
lines as (select r, l, count(*) as n from (select r, unnest(string_split(t, chr(10))) as l from docs) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r, l),
by_line as (select r, sum(n - 1) as dups, sum((n - 1) * length(l)) as chars from lines group by r),
joined as (
  select doc_id, coalesce(n, 0) as n, coalesce(by_word.chars, 0) as chars, coalesce(repeats, 0) as repeats, coalesce(s4, 0) as s4, coalesce(s8, 0) as s8, coalesce(s12, 0) as s12, coalesce(dups, 0) as dups,
    coalesce(by_line.chars, 0) / greatest(1, length(t)) as line_share, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as symbols
  from docs left join by_word using (r) left join by_line using (r)),
judged as (select *, n < 20 or 100 * repeats > 30 * n as base_failed from joined)
select doc_id, cast(n as bigint) as n_words, cast(chars as bigint) as word_chars, cast(symbols as bigint) as n_symbols, cast(dups as bigint) as n_dup_lines, cast(repeats as bigint) as n_repeat_words, base_failed,
  not base_failed and not (n >= {quality_rules.MIN_WORDS} and (line_share > {quality_rules.LINE_LIMIT} or {" or ".join(f"s{n} > {limit}" for n, limit in quality_rules.NGRAM_LIMITS.items())})) as kept
from judged""",
}
