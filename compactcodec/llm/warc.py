"""Web archives: records of WARC files, and captures that say "not modified" resolved to what they repeat.

A revisit is joined, as of its time, to the latest earlier full response of its canonical URL.  Keys
and times alone take part in that join.  A URL's timeline is cut into spans of time: within a span a
window finds the latest response, and one row a URL and span carries it over the spans before.  So no
task gets more of a URL than the distinct times of one span, however many captures it has.  Headers
and bodies then join by URL, time and record.
"""

from __future__ import annotations

import datetime
import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compactcodec.llm.common import materialise

SPAN = 86_400
#: fields of a 304 response that replace those of the stored one
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
RESOLVED, MISMATCH, MISSING = "resolved", "validator mismatch", "no earlier response"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, ``m.`` and port, path, and sorted query without tracking fields; scheme, user and fragment go."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":[0-9]*$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    fields = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(fields == "", "").otherwise(F.concat(F.lit("?"), fields)))


def _clean_headers(headers: Column) -> Column:
    """Entries with names in lower case; of a repeated name the last one."""
    e = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    return F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"]))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with the permitted ones of the fresh response in their place; a map with sorted names."""
    new = F.filter(_clean_headers(fresh), lambda x: x["key"].isin(*PERMITTED))
    names = F.transform(new, lambda x: x["key"])
    old = F.filter(_clean_headers(stored), lambda x: ~F.array_contains(names, x["key"]))
    return F.map_from_entries(F.array_sort(F.concat(old, new)))


def latest_before(captures: DataFrame, span: int = SPAN) -> DataFrame:
    """key, at, hit (at and record_id of the latest strictly earlier response) of each distinct URL and time of ``captures``.

    Rows of one URL and time have one answer, so they are one row before any window sees them: a
    window holds a URL's distinct times within ``span``, and a second one a row for each span.
    """
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id"))
    times = captures.groupBy("key", F.floor(F.col("at") / span).alias("span"), "at").agg(F.max(full).alias("last"))
    within = Window.partitionBy("key", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spans = times.groupBy("key", "span").agg(F.max("last").alias("last"))
    carried = spans.select("key", "span", F.max("last").over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    near = times.select("key", "span", "at", F.max("last").over(within).alias("near"))
    return near.join(carried, ["key", "span"]).select("key", "at", F.coalesce("near", "before").alias("hit"))


def resolve_revisits(captures: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each revisit: record_id, url, at, status, resolved_id, headers, body.

    ``captures`` has record_id, url, at (a whole number), kind (``response`` or ``revisit``), etag,
    last_modified, headers (map) and body; other kinds and columns are not looked at.  Only a strictly
    earlier response counts; of several at one time that with the largest record_id, and of several
    rows of one URL, time and record_id that with the largest validators and then body.  Entity tags
    agree without their weakness mark; where the revisit has none, the dates of modification must
    agree.  A revisit without an earlier response, or whose validators disagree, keeps its own headers
    and has no body.  Null URLs and times match nothing.  Repeated rows give repeated results, and
    revisits that share a record_id are resolved each by its own URL and time.

    Answers are written before they are joined, and so are stored responses where several bear one
    name and have to be made one, so that the join can split a page that is revisited very often.
    """
    names = ["record_id", "url", "at", "etag", "last_modified", "headers"]
    rows = captures.select(*names, "kind", "body", canonical_url(F.col("url")).alias("key")).where(F.col("kind").isin("response", "revisit"))
    timed = rows.where("key is not null and at is not null")
    answers = materialise(latest_before(timed.select("key", "at", "kind", "record_id"), span).where("hit is not null"), "answers")
    name = [F.col("key").alias("hit_key"), F.col("at").alias("hit_at"), F.col("record_id").alias("hit_id")]
    value = F.struct("etag", "last_modified", "headers", "body")
    full = timed.where("kind = 'response'")
    stored = full.select(*name, value.alias("stored"))
    if full.groupBy("key", "at", "record_id").count().where("count > 1").limit(1).count():
        first = F.struct(F.coalesce("etag", F.lit("")), F.coalesce("last_modified", F.lit("")), F.coalesce("body", F.lit("")))
        stored = materialise(full.groupBy(*name).agg(F.max_by(value, first).alias("stored")), "stored")
    fresh = rows.where("kind = 'revisit'").select("key", *names)
    # what has no URL or time is dealt by its own id, not all to one task
    dealt = fresh.withColumn("key", F.coalesce("key", F.concat(F.lit("none "), F.col("record_id").cast("string"))))
    found = dealt.join(answers, ["key", "at"], "left").select("key", *names, "hit.at", "hit.record_id").toDF("key", *names, "to_at", "to_id")
    to_key = F.when(F.col("to_at").isNotNull(), F.col("key")).otherwise(F.concat(F.lit("none "), F.col("record_id").cast("string")))
    both = found.withColumn("to_key", to_key).join(stored, (F.col("to_key") == F.col("hit_key")) & (F.col("to_at") == F.col("hit_at")) & F.col("to_id").eqNullSafe(F.col("hit_id")), "left")
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    agree = F.when(F.col("etag").isNotNull(), tag(F.col("etag")) == tag(F.col("stored.etag"))).otherwise(F.col("last_modified") == F.col("stored.last_modified"))
    status = F.when(F.col("hit_key").isNull(), MISSING).when(F.coalesce(agree, F.lit(False)), RESOLVED).otherwise(MISMATCH)
    good = status == RESOLVED
    own = F.map_from_entries(F.array_sort(_clean_headers(F.col("headers"))))
    return both.select("record_id", "url", "at", status.alias("status"), F.col("to_id").alias("resolved_id"), F.when(good, merge_headers(F.col("stored.headers"), F.col("headers"))).otherwise(own).alias("headers"), F.when(good, F.col("stored.body")).alias("body"))


def write_record(kind: str, headers: dict[str, str], content: bytes, compress: bool = True) -> bytes:
    """One WARC record, as a gzip member of its own unless told otherwise."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers.items() if k.lower() not in ("warc-type", "content-length")]
    lines.append(b"Content-Length: " + str(len(content)).encode())
    raw = b"\r\n".join(lines) + b"\r\n\r\n" + content + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0) if compress else raw


def read_records(source) -> Iterator[tuple[str, dict[str, str], bytes, bool]]:
    """Type, headers (names in lower case), content of each record, and whether it is whole; ``source`` is a file or bytes, plain or gzip-compressed.

    A file that ends within a record, or whose compressed data is damaged, gives what there is of that
    record, marked as not whole; so does a record without a readable length.  Nothing follows it.
    """
    stream = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while True:
        kind, headers, content, whole = "", {}, b"", False
        try:
            first = stream.readline()
            if not first:
                return
            if not first.strip():
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            kind, length = headers.get("warc-type", ""), headers.get("content-length", "")
            if length.isdecimal():
                left, parts = int(length), []
                try:
                    while left and (part := stream.read(min(1 << 20, left))):
                        parts.append(part)
                        left -= len(part)
                finally:
                    content = b"".join(parts)
                whole = not left
        except (EOFError, OSError, zlib.error):
            whole = False
        yield kind, headers, content, whole
        if not whole:
            return


RECORDS = "number long, type string, url string, date string, headers map<string,string>, content binary, complete boolean"


_FIELDS = ["number", "type", "url", "date", "headers", "content", "complete"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
#: records and bytes that leave a task together
MOST_RECORDS, MOST_BYTES = 1024, 8 << 20


def _batches(source, files: str | None = None) -> Iterator[pa.RecordBatch]:
    """The records of a file's bytes or stream, as bounded batches."""
    rows, held = [], 0

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
        names = [pa.array([files] * len(rows), pa.string())] if files is not None else []
        return pa.RecordBatch.from_arrays(names + columns, ["file"] * len(names) + _FIELDS)

    for number, (kind, headers, content, whole) in enumerate(read_records(source)):
        rows.append((number, kind, headers.get("warc-target-uri"), headers.get("warc-date"), list(headers.items()), content, whole))
        held += len(content)
        if len(rows) >= MOST_RECORDS or held >= MOST_BYTES:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: file, number, type, url, date, headers, content, complete.

    Spark lists the files; a task streams each of its files and holds few records at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                with system.open_input_stream(name, compression=None) as source:
                    yield from _batches(source, file)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(run, f"file string, {RECORDS}")


def read_archives(archives: DataFrame, column: str) -> DataFrame:
    """Records of the archives in a binary column, each a file's bytes: number, type, url, date, headers, content, complete; null ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                if raw.is_valid:
                    yield from _batches(raw.as_py())

    return archives.select(column).mapInArrow(run, RECORDS)


def write_archives(captures: DataFrame, compress: bool = True) -> DataFrame:
    """``archive``: the bytes of WARC archives that hold all ``captures`` (record_id, url, at, kind, headers, body), some hundred in each.

    A capture's content is its HTTP message.  What is null has no field; times are seconds since 1970.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                made = []
                for record_id, url, at, kind, headers, body in zip(*[c.to_pylist() for c in rows.columns[:-1]], rows.columns[-1], strict=True):
                    fields = {"WARC-Record-ID": record_id, "WARC-Target-URI": url, "WARC-Date": at and datetime.datetime.fromtimestamp(at, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
                    head = [b"HTTP/1.1 304 Not Modified" if kind == "revisit" else b"HTTP/1.1 200 OK", *[f"{k}: {v}".encode() for k, v in headers or () if v is not None], b"", b""]
                    raw = b"" if not body.is_valid else body.as_py().encode()
                    made.append(write_record(kind, {k: v for k, v in fields.items() if v is not None}, b"\r\n".join(head) + raw, compress))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], ["archive"])

    plain = captures.select(F.col("record_id").cast("string"), "url", F.col("at").cast("long"), "kind", "headers", "body")
    return plain.mapInArrow(run, "archive binary")


def captures_of(records: DataFrame) -> DataFrame:
    """Captures (as ``resolve_revisits`` takes them, record_id as text) of WARC records whose content is an HTTP message; records that are not whole are left out.

    A revisit has no body.  Fields of one name in different case are one, the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, bodies = [], []
            for kind, content in zip(batch.column("type").to_pylist(), batch.column("content"), strict=True):
                head, _, body = content.as_py().partition(b"\r\n\r\n")
                lines = head.decode("utf-8", "replace").split("\r\n")[1:]
                found = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
                fields.append(found)
                bodies.append(None if kind == "revisit" else body.decode("utf-8", "replace"))
            lower = [{k.lower(): v for k, v in x.items()} for x in fields]
            made = [pa.array([x.get(k) for x in lower], pa.string()) for k in ("etag", "last-modified")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made, pa.array([list(x.items()) for x in fields], pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.string())], [*batch.schema.names[:4], "etag", "last_modified", "headers", "body"])

    at = F.unix_timestamp(F.to_timestamp("date", "yyyy-MM-dd'T'HH:mm:ssX"))
    plain = records.where("complete").select(F.col("headers")["warc-record-id"].alias("record_id"), "url", at.alias("at"), "type", "content")
    out = plain.mapInArrow(run, "record_id string, url string, at long, type string, etag string, last_modified string, headers map<string,string>, body string")
    return out.withColumnRenamed("type", "kind")
