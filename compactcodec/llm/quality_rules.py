"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

A text is rejected if too large a share of its characters lies in repeated n-grams of one of several
lengths, or in lines that repeat an earlier one.  Symbols are counted, but have no part in the
verdict.  The limits stand above the largest shares among 3,302 documents labelled good (0.276 for
four words, 0.276 for eight, 0.154 for twelve, 0.136 for lines) and far below those of texts that
repeat words (0.8 to 1).

Each text is read whole, once, as bytes.  Words become numbers, n-grams become 64-bit rolling hashes
of those numbers in numpy, and a sort finds the n-grams that occur twice.  There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
BASE_WINDOW = 8
#: n-gram length -> largest share of a text's word characters that may lie in repeated n-grams
NGRAM_LIMITS = {4: 0.35, 8: 0.3, 12: 0.2}
#: largest share of a text's characters that may lie in lines that repeat an earlier one
LINE_LIMIT = 0.17
#: shares below these sizes say nothing
MIN_WORDS = 20

FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("dup_line_share", T.DoubleType()), T.StructField("dup_ngram_share", T.MapType(T.IntegerType(), T.DoubleType())), T.StructField("kept", T.BooleanType())])

_RNG = np.random.Generator(np.random.PCG64(20240607))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n, a mask of the words that lie in an n-gram occurring twice or more.

    The hash of n words grows from that of n - 1 words by one multiply and add.
    """
    out, n_words = {}, len(codes)
    h = codes.copy()
    for n in range(2, max(lengths) + 1):
        if n_words < n:
            break
        h = h[:-1] * _MULT + codes[n - 1 :]
        if n not in lengths:
            continue
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            continue
        twice = np.unique(twice)
        at = np.searchsorted(twice, h)
        at[at == len(twice)] = 0
        hit = np.flatnonzero(twice[at] == h)
        edge = np.zeros(n_words + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        out[n] = np.cumsum(edge[:-1]) > 0
    return {n: out.get(n, np.zeros(n_words, bool)) for n in lengths}


def _chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))


def measure(text: str | None, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> dict:
    """The measures and the verdict for one text; null counts as an empty text."""
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_dup_lines, dup_line_chars = 0, 0
    if len(lines) > 1 and (distinct := len(set(lines))) < len(lines):
        n_dup_lines = len(lines) - distinct
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                dup_line_chars += _chars(x)
            seen.add(x)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    shares, n_repeat = dict.fromkeys(limits, 0.0), 0
    if len(numbers) < n:
        ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            codes = _mix((ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            masks = repeated_words(codes, sorted({BASE_WINDOW, *limits}))
        n_repeat = int(masks[BASE_WINDOW].sum())
        if any(masks[k].any() for k in limits):
            sizes = np.fromiter(map(_chars, numbers), np.int64, len(numbers))[ids.astype(np.int64)]
            shares = {k: float(sizes[masks[k]].sum()) / word_chars for k in limits}
    base_failed = n < 20 or 100 * n_repeat > 30 * n
    line_share = dup_line_chars / max(1, len(text))
    bad = n >= MIN_WORDS and (line_share > line_limit or any(shares[k] > v for k, v in limits.items()))
    return {"n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": base_failed, "dup_line_share": line_share, "dup_ngram_share": shares, "kept": not base_failed and not bad}


def quality_rules(docs: DataFrame, text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) and the measures and verdict of each row.

    A null or empty text has no words and is not kept.  Repeated rows are measured each for itself,
    ids are not looked at, an empty table gives an empty table.  Columns of ``docs`` that bear the
    name of a measure are replaced.
    """
    names = {f.name for f in FIELDS}
    passed = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*[docs[c].alias(f"p{i}") for i, c in enumerate(passed)], docs[text_col].alias("__text"))
    schema = T.StructType([source.schema[f"p{i}"] for i in range(len(passed))] + FIELDS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.map_(pa.int32(), pa.float64()), pa.bool_()]
        for batch in batches:
            rows = [measure(x.as_py(), ngram_limits, line_limit) for x in batch.column("__text")]
            made = [pa.array([list(r[f.name].items()) if f.name == "dup_ngram_share" else r[f.name] for r in rows], kind) for f, kind in zip(FIELDS, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [f.name for f in schema])

    out = source.mapInArrow(run, schema)
    return out.select(*[out[f"p{i}"].alias(c) for i, c in enumerate(passed)], *[out[f.name] for f in FIELDS])
