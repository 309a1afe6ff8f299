"""Token ids in files of independent zstandard frames with a seek table.

A shard holds documents in ascending id order.  Its frames hold whole documents, carry a checksum of
their content and can be decompressed alone.  After them come two skippable frames: the document
index, and the seek table of the public zstandard seekable format (compressed size, decompressed
size and checksum of each frame, then the number of frames, a descriptor byte and a magic number),
which readers find from the end of the file.  Ids take 2 bytes if the vocabulary allows, else 4.

Spark range-partitions and sorts the texts; each task encodes its range and writes one shard to the
shared folder.  A shard counts only if the manifest names it, so a task that is run again leaves at
worst an unused file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compactcodec.llm import tokens
from compactcodec.llm.common import materialise, scratch

#: fixed values of the public format
SKIPPABLE_TABLE, SKIPPABLE_INDEX, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 18
_INDEX_KEY = b"docs"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard; ``add`` takes documents in their order."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.plain = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.waiting = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.at: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        if self.waiting and self.waiting + len(raw) > self.frame_bytes:
            self._flush()
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.at.append(len(self.frames))
        self.parts.append(raw)
        self.waiting += len(raw)

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.parts)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.waiting = [], 0

    def close(self) -> None:
        if self.parts:
            self._flush()
        known = np.array([x is not None for x in self.ids], "u1")
        ids = np.array([x or 0 for x in self.ids], "<i8")
        index = self.plain.compress(b"".join([ids.tobytes(), known.tobytes(), np.array(self.sizes, "<u8").tobytes(), np.array(self.at, "<u4").tobytes()]))
        body = _INDEX_KEY + struct.pack("<IB", len(self.ids), self.width) + index
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        # the index's place follows from the frames' sizes
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class ShardReader:
    """Random access to a shard: only the frames of the documents asked for are decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        start = end - 9 - 12 * n - 8
        kind, length = struct.unpack("<II", self._at(start, 8))
        if kind != SKIPPABLE_TABLE or length != 12 * n + 9:
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])]).astype(np.int64)
        kind, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        body = self._at(int(self.starts[-1]) + 8, length)
        if kind != SKIPPABLE_INDEX or body[:4] != _INDEX_KEY:
            raise ValueError("no document index")
        m, self.width = struct.unpack("<IB", body[4:9])
        raw = self.unpack.decompress(body[9:], max_output_size=max(1, 21 * m))
        self.ids, known = np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "u1", m, 8 * m).astype(bool)
        self.known, self.sizes, self.at = known, np.frombuffer(raw, "<u8", m, 9 * m).astype(np.int64), np.frombuffer(raw, "<u4", m, 17 * m)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        size, length, check = self.frames[k]
        raw = self.unpack.decompress(self._at(int(self.starts[k]), int(size)), max_output_size=max(1, int(length)))
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, wanted=None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, ids before it in the shard, and token ids; of all documents, or of the ids wanted."""
        before = np.concatenate([[0], np.cumsum(self.sizes)])
        rows = range(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)) & self.known)
        held, data, base = -1, None, 0
        for r in rows:
            if self.at[r] != held:
                held, data = int(self.at[r]), self.frame(int(self.at[r]))
                base = int(before[np.searchsorted(self.at, held)])
            s = int(before[r]) - base
            yield (int(self.ids[r]) if self.known[r] else None), int(before[r]), data[s : s + int(self.sizes[r])]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all documents below ``path``; returns the manifest: file, first_id, n_docs, n_tokens, base.

    ``base`` counts the ids of all shards before.  Null and empty texts are the end id alone.  Ids are
    integers.  Rows that repeat an id follow each other by a hash of their text, then by the text; null
    ids come first.  Shards are ranges of id and hash, so an id, or its absence, that many rows share
    is spread; only rows that are wholly alike stay together.  Other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = plain.withColumn("part", F.xxhash64("text")).repartitionByRange("id", "part").sortWithinPartitions("id", "part", "text").select("id", "text", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        width = 2 if max(coder.vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        fs, folder = _open(path)
        writer = sink = name = None
        first, part, n_tokens = None, None, 0
        for batch in batches:
            for doc_id, text, hashed in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                doc_id = doc_id.as_py()
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    name, first, part = f"{uuid.uuid4().hex}.ids", doc_id, hashed.as_py()
                    sink = fs.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(sink, width, frame_bytes)
                ids = np.frombuffer(coder.encode(text.as_py()) + end, "<u4")
                n_tokens += len(ids)
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([first], pa.int64()), pa.array([part], pa.int64()), pa.array([len(writer.ids)], pa.int64()), pa.array([n_tokens], pa.int64())], ["file", "first_id", "first_part", "n_docs", "n_tokens"])

    shards = materialise(ordered.mapInArrow(run, "file string, first_id long, first_part long, n_docs long, n_tokens long"), "manifest")
    # one row a shard
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).drop("first_part")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), and ids (32-bit bytes) if asked for, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(file)
                rows = []
                with fs.open_input_file(name) as source:
                    for doc_id, start, ids in ShardReader(source).documents(wanted):
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        if len(rows) >= 4096:
                            yield _rows(rows, with_ids)
                            rows = []
                if rows:
                    yield _rows(rows, with_ids)

    spread = manifest.select("file", "base").repartition(max(1, min(manifest.count(), 10_000)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, raw = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(raw, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write to a new folder below the shared one and read everything back."""
    return read_token_files(write_token_files(docs, scratch(spark, "tokens"), tokenizer, end_id))
