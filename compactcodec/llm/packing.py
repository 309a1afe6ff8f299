"""Best-fit packing under several capacities at once: tokens, documents, attention cost.

Only sizes are packed, never texts.  Pieces are numbered when they are written and dealt into groups
of about ``GROUP`` by a hash of that number, so a group is bounded however many pieces there are and
whatever ids or sizes repeat; each group is packed by decreasing size, which leaves about one loosely
filled sequence a group.

Attention is paid in square tiles: a piece of n tokens costs the tiles on and below the diagonal, of
``TILE`` tokens a side, begun tiles counted whole.  A sequence may cost no more than one that a single
piece fills, and hold no more than ``MAX_DOCS`` pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compactcodec.llm import tokens
from compactcodec.llm.common import materialise

GROUP = 8192
WEIGHTS = (1.0, 0.1, 0.1)
#: pieces a sequence, and tokens a side of a tile of attention
MAX_DOCS, TILE = 48, 64
#: words kept by a task's encoder in each of two generations, about 250 MB; the task holds little else
KEPT_WORDS = 700_000


def best_fit(items: np.ndarray, capacity: np.ndarray, weights=WEIGHTS, method: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and what its first dimension finds filled there.

    ``items`` is n x d, all values at most ``capacity``.  Items go by decreasing first dimension.  An
    item goes to the open bin, among those where it fits in every dimension, with the smallest
    weighted norm of what would remain (``norm``) or the largest weighted dot product of item and
    remainder (``dot``); if it fits in none, a bin opens.
    """
    n, d = items.shape
    scaled, root = items / capacity, np.sqrt(np.asarray(weights, float)[:d])
    bins, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    left, where = np.empty((n, d)), np.empty(n, np.int64)
    filled = np.zeros(n, np.int64)
    least = scaled.min(axis=0) if n else None
    n_open, n_bins, eps = 0, 0, 1e-9
    for i in np.argsort(-items[:, 0], kind="stable"):
        x, k = scaled[i], -1
        if x[0] < 1 - eps and n_open:
            rest = left[:n_open] - x
            fits = np.flatnonzero((rest >= -eps).all(axis=1))
            if len(fits):
                score = ((rest[fits] * root) ** 2).sum(axis=1) if method == "norm" else -((left[fits] * x) @ (root**2))
                k = int(fits[np.argmin(score)])
        if k < 0:
            k, n_open = n_open, n_open + 1
            left[k], where[k], n_bins = 1.0, n_bins, n_bins + 1
        b = where[k]
        bins[i], offset[i] = b, filled[b]
        filled[b] += items[i, 0]
        left[k] -= x
        if (left[k] < least - eps).any():  # nothing fits any more
            n_open -= 1
            left[k], where[k] = left[n_open], where[n_open]
    return bins, offset


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than ``most``."""
    first = n % most or most
    return [(0, min(n, first))] + [(s, most) for s in range(first, n, most)]


def tokenise_pieces(docs: DataFrame, path: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and ids (32-bit bytes) if asked for.

    A null or empty text is the end id alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(path, kept_words).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, rows, ids = [], [], []
            for r, text in enumerate(batch.column(1)):
                raw = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(raw) // 4, most)):
                    piece = raw[4 * start : 4 * (start + length)]
                    at.append(r)
                    rows.append((k, start, length, tokens.crc(piece)))
                    if with_ids:
                        ids.append(piece)
            k, start, length, crc = zip(*rows, strict=True) if rows else ([], [], [], [])
            out = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def attention_tiles(length, tile: int = TILE):
    """Tiles of causal attention over ``length`` tokens."""
    side = -(-length // tile)
    return side * (side + 1) // 2


def pack(pieces: DataFrame, max_tokens: int = 2048, max_docs: int = MAX_DOCS, max_attention: int | None = None, weights=WEIGHTS, method: str = "norm", group: int = GROUP, tile: int = TILE) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset`` added.

    A sequence holds at most ``max_tokens`` tokens, ``max_docs`` pieces and ``max_attention`` tiles of
    attention, by default those of one piece of ``max_tokens``.  Offsets in a sequence leave no gap.
    Pieces that exceed a sequence by themselves are an error.  Rows are packed as they are, repeated
    ones and null ids included; an empty table gives an empty table.  Extra columns pass; columns of
    the two names are replaced.
    """
    max_attention = max_attention or attention_tiles(max_tokens, tile)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    source = pieces.select(*names)
    plain = materialise(source.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("number")), "pieces")
    size, key = f"p{names.index('length')}", [f"p{names.index(c)}" for c in ("length", "doc_id", "piece")]
    n_groups = max(1, -(-plain.count() // group))
    side = F.ceil(F.col(size) / tile)
    if plain.where((F.col(size) > max_tokens) | (side * (side + 1) / 2 > max_attention) | (F.col(size) < 1)).limit(1).count():
        raise ValueError("a piece exceeds a sequence")
    dealt = plain.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(n_groups)))
    schema = ", ".join([f"p{i} {source.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + ["sequence_id long", "offset long"])
    capacity = np.array([max_tokens, max_docs, max_attention], float)

    def one(key_: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ascending=[False, True, True], kind="stable")
        n = rows[size].to_numpy(np.int64)
        bins, offset = best_fit(np.stack([n, np.ones_like(n), attention_tiles(n, tile)], axis=1), capacity, weights, method)
        return rows.drop(columns=["group", "number"]).assign(sequence_id=int(key_[0]) * 2**32 + bins, offset=offset)

    out = dealt.groupBy("group").applyInPandas(one, schema)
    return out.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, most: int = 2048, end_id: int = 0, with_ids: bool = False, kept_words: int = KEPT_WORDS, **options) -> DataFrame:
    """Tokenise, cut and pack; ``pack`` writes the pieces once, so that no text is tokenised twice.

    ``kept_words`` bounds the memory of the encoders, which stay with their Python workers.
    """
    return pack(tokenise_pieces(docs, path, most, end_id, with_ids=with_ids, kept_words=kept_words), most, **options)


def assemble(packed: DataFrame) -> DataFrame:
    """Token ids (32-bit bytes) of each sequence, from packed pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("ids"))
