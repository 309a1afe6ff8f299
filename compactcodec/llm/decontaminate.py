"""Benchmark decontamination by latent semantic retrieval, then a longest common subsequence.

Words are weighted by their document frequency in the whole corpus.  A distributed randomised SVD of
the benchmark's TF-IDF passages gives the latent space; every window of every document is folded into
it, and windows whose cosine with a passage is high enough are compared with it word by word.  As a
space of few dimensions barely holds some passages, so are places that share enough adjacent pairs of
words with one, whatever their number.  A document is contaminated if the common subsequence covers
enough of a passage, or a smaller part and the item's answer.

An item of more than ``PASSAGE`` words is several passages, each beginning in the middle of the one
before, so a document that holds a paragraph of it holds three quarters of some passage.

The benchmark is taken in blocks of bounded size, which lie in the shared folder.  Two passes read the
corpus, however many blocks there are: one for frequencies and one for the search; each task goes
through the blocks, one at a time, and neither pass moves a text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compactcodec.llm.common import materialise, read_blob, scratch, write_blob

#: passages and words of a block
BLOCK, BLOCK_WORDS = 4000, 160_000
#: words of a passage, and the step to the next one
PASSAGE, PASSAGE_STEP = 64, 32
RANK, OVERSAMPLE, POWER = 128, 16, 2
WINDOW, STRIDE = 40, 10
LEAST_COSINE = 0.22
#: windows that are held at once
SLICE = 2048
#: share of a passage's words in the common subsequence: alone, or with the item's answer
LCS_SHARE, LCS_WITH_ANSWER, ANSWER_SHARE = 0.6, 0.45, 0.9
ANSWER_WORDS = 8
#: words of a text whose shared pairs are counted at once
SPAN = 2000
#: items with fewer words are leaks only word by word
LEAST_WORDS = 8

_FOLD = bytes(ord(" ") if c < 128 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, ASCII signs as spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def passages_of(item: list[bytes], answer: list[bytes] | None) -> list[tuple[list[bytes], list[bytes] | None]]:
    """The passages of an item, each with the answer that may confirm it.

    Where the benchmark has no answers, the last words of an item stand for its answer; they confirm
    only the passage that holds them.
    """
    last = max(0, len(item) - PASSAGE)
    starts = [*range(0, last, PASSAGE_STEP), last]
    return [(item[s : s + PASSAGE], answer or (item[-ANSWER_WORDS:] if s == last else None)) for s in starts]


def judge(item: list[bytes], region: list[bytes], answer: list[bytes] | None) -> float:
    """Share of the passage's words in common with the region, in order; 0 if that is no leak."""
    share = lcs(item, region) / len(item)
    if share >= LCS_SHARE or share >= LCS_WITH_ANSWER and answer and lcs(answer, region) >= ANSWER_SHARE * len(answer):
        return share
    return 0.0


def least_pairs(n: int, ends: bool) -> int:
    """How many adjacent pairs of a passage of ``n`` words a leak keeps if words were only replaced or left out.

    Each missing word costs two of the ``n - 1`` pairs; where the passage ends with its answer, a leak
    by that keeps those of the answer.
    """
    missing = n - math.ceil(LCS_SHARE * n - 1e-9)
    return max(1, min(n - 1 - 2 * missing, ANSWER_WORDS - 1 if ends else n))


class Pairs:
    """The adjacent pairs of words of all passages, and the places where a text shares enough of them."""

    def __init__(self, items: list[np.ndarray], n_words: int, ends: list[bool]):
        self.n_words, self.sizes = n_words, np.array([len(x) for x in items])
        self.least = np.array([least_pairs(len(x), e) for x, e in zip(items, ends, strict=True)])
        pairs = [np.unique(x[:-1] * n_words + x[1:]) for x in items]
        key, owner = np.concatenate(pairs), np.repeat(np.arange(len(items)), [len(x) for x in pairs])
        order = np.argsort(key, kind="stable")
        self.owners = owner[order]
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.starts = np.append(self.starts, [len(key), len(key)])
        self.keys = np.append(self.keys, -1)  # the place of keys beyond the last

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place of its first shared pair) by the numbers of a text's words, -1 for words of no item."""
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        key = ids[at] * self.n_words + ids[at + 1]
        k = np.searchsorted(self.keys[:-1], key)
        hit = self.keys[k] == key
        at, k = at[hit], k[hit]
        if not len(at):
            return
        over, start = 2 * int(self.sizes.max()), int(at[0])
        while start <= at[-1]:
            lo, hi = np.searchsorted(at, [start, start + SPAN + over])
            yield from self._dense(at[lo:hi], k[lo:hi])
            start += SPAN

    def _dense(self, at: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int]]:
        many = self.starts[k + 1] - self.starts[k]
        ends = np.cumsum(many)
        if not len(ends):
            return
        which = self.owners[np.arange(ends[-1]) + np.repeat(self.starts[k] - ends + many, many)]
        enough = np.bincount(which, minlength=len(self.least)) >= self.least
        if not enough.any():
            return
        some = np.flatnonzero(enough[which])
        which, at = which[some], np.repeat(at, many)[some]
        order = np.argsort(which, kind="stable")
        which, at = which[order], at[order]
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        for item, seen in zip(which[first].tolist(), np.split(at, first[1:]), strict=True):
            least, before = self.least[item], -STRIDE
            for place in seen[: len(seen) - least + 1][seen[least - 1 :] - seen[: len(seen) - least + 1] <= 2 * self.sizes[item]].tolist():
                if place >= before + STRIDE:  # the region of the one before holds it otherwise
                    before = place
                    yield item, place


def document_frequencies(docs: DataFrame, vocabularies: list[str], text_col: str) -> DataFrame:
    """(block, word, n): in how many documents each word of each block's vocabulary occurs; word -1 counts all documents.

    ``vocabularies`` are files of the shared folder, one a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, file in enumerate(vocabularies):
                known = _held(file)
                df = np.zeros(len(known) + 1, np.int64)
                for text in batch.column(0):
                    df[-1] += 1
                    if hit := known.keys() & words_of(text.as_py()):
                        df[[known[w] for w in hit]] += 1
                at = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b)), pa.array(np.where(at == len(known), -1, at)), pa.array(df[at])], ["block", "word", "n"])

    return docs.select(text_col).mapInArrow(run, "block long, word long, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))


_HELD: dict = {}


def _held(file: str):
    """A block's file; a worker keeps the last one."""
    if file not in _HELD:
        _HELD.clear()
        _HELD[file] = read_blob(file)
    return _HELD[file]


def _passage(words: list[bytes], vocabulary: dict[bytes, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique([vocabulary[w] for w in words], return_counts=True)
    x = tf * idf[at]
    return at, x / np.linalg.norm(x)


def randomised_svd(passages: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int, oversample: int = OVERSAMPLE, power: int = POWER) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of ``passages`` (text).

    Each round multiplies the matrix and its transpose to a thin basis: tasks make their share from
    their rows, a shuffle adds the shares up by block of words.
    """
    n, wide, rows_a_block = len(vocabulary), rank + oversample, 512

    def product(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, seen = np.zeros((n, basis.shape[1])), False
            for batch in batches:
                for text in batch.column(0):
                    at, x = _passage(words_of(text.as_py()), vocabulary, idf)
                    out[at] += np.outer(x, x @ basis[at])
                    seen = True
            if seen:
                blocks = range(0, n, rows_a_block)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([out[b : b + rows_a_block].tobytes() for b in blocks], pa.binary())], ["block", "part"])

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": parts["block"][:1], "part": [sum(np.frombuffer(p) for p in parts["part"]).tobytes()]})

        made = passages.select("text").mapInArrow(run, "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary").collect()
        out = np.zeros_like(basis)
        for r in made:
            part = np.frombuffer(r["part"]).reshape(-1, basis.shape[1])
            out[r["block"] : r["block"] + len(part)] = part
        return out

    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((n, min(wide, n))))[0]
    for _ in range(power):
        basis = np.linalg.qr(product(basis))[0]
    last = product(basis)
    value, turn = np.linalg.eigh(basis.T @ last)
    return basis @ turn[:, np.argsort(-value)[:rank]]


class Block:
    """What the search needs of a block: passages with their places in the latent space, their pairs, and short items."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes] | None]], short: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], idf: np.ndarray, most_idf: float, space: np.ndarray):
        self.items, self.vocabulary = items, vocabulary
        self.weight = (idf[:, None] * space).astype(np.float32)
        self.square = np.append(idf, most_idf).astype(np.float32) ** 2
        self.rows = np.zeros((len(items), space.shape[1]), np.float32)
        for r, (_, words, _) in enumerate(items):
            at, x = _passage(words, vocabulary, idf)
            self.rows[r] = x @ space[at]
        self.rows /= np.maximum(np.linalg.norm(self.rows, axis=1, keepdims=True), 1e-9)
        self.counts = [Counter(words) for _, words, _ in items]
        ends = [answer is not None and words[-len(answer) :] == answer for _, words, answer in items]
        self.pairs = Pairs([np.array([vocabulary[w] for w in words]) for _, words, _ in items], len(vocabulary), ends) if items else None
        self.by_first: dict[bytes, list[tuple[int, list[bytes]]]] = {}
        for item_id, words in short:
            self.by_first.setdefault(words[0], []).append((item_id, words))

    def verbatim(self, words: list[bytes]) -> dict[int, float]:
        if not (firsts := self.by_first.keys() & words):
            return {}
        return {item_id: 1.0 for i, w in enumerate(words) if w in firsts for item_id, item in self.by_first[w] if words[i : i + len(item)] == item}

    def compare(self, item: int, region: list[bytes], found: dict[int, float]) -> None:
        item_id, words, answer = self.items[item]
        shared = self.counts[item].keys() & region
        if sum(map(self.counts[item].__getitem__, shared)) < LCS_WITH_ANSWER * len(words):
            return  # no subsequence is longer than what they share
        wanted = shared | set(answer or ())
        if score := judge(words, [w for w in region if w in wanted], answer):
            found[item_id] = max(found.get(item_id, 0.0), score)

    def near(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, passage) where the cosine is high enough, some windows at a time."""
        wide = max(1, WINDOW // STRIDE)
        windows = max(1, -(-len(ids) // STRIDE) - wide + 1)
        for s in range(0, windows, SLICE):
            part = ids[s * STRIDE : (min(windows, s + SLICE) + wide - 1) * STRIDE]
            cuts = np.arange(0, len(part), STRIDE)
            size = np.add.reduceat(self.square[part], cuts)
            at = np.flatnonzero(part >= 0)  # other words are beyond the space
            first = np.searchsorted(at, cuts)
            some = np.flatnonzero(first < np.append(first[1:], len(at)))
            total = np.zeros((len(cuts), self.weight.shape[1]), np.float32)
            if not len(some):
                continue
            total[some] = np.add.reduceat(self.weight[part[at]], first[some], axis=0)
            if len(cuts) > wide:
                total, size = np.cumsum(total, axis=0), np.cumsum(size)
                total[wide:] -= total[:-wide].copy()
                size[wide:] -= size[:-wide].copy()
                total, size = total[wide - 1 :], size[wide - 1 :]
            else:
                total, size = total.sum(axis=0, keepdims=True), size.sum(keepdims=True)
            cosine = (total @ self.rows.T) / np.sqrt(np.maximum(size, 1e-9))[:, None]
            for window, item in np.argwhere(cosine >= LEAST_COSINE):
                yield s + int(window), int(item)

    def leaks(self, text: str | None) -> dict[int, float]:
        words = words_of(text)
        found = self.verbatim(words) if self.by_first else {}
        if len(words) < LEAST_WORDS or not self.items:
            return found
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        for window, item in self.near(ids):
            if found.get(self.items[item][0], 0.0) < LCS_SHARE:
                reach = max(WINDOW, len(self.items[item][1]))
                start, end = window * STRIDE - reach, window * STRIDE + WINDOW + reach
                self.compare(item, words[max(0, start) : end], found)
        for item, place in self.pairs.places(ids):
            if found.get(self.items[item][0], 0.0) < LCS_SHARE:
                reach = len(self.items[item][1])
                self.compare(item, words[max(0, place - reach) : place + 2 * reach], found)
        return found


def _search(docs: DataFrame, blocks: list[str], id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for file in blocks:
                block = _held(file)
                for found, text in zip(scores, batch.column(1), strict=True):
                    for item_id, score in block.leaks(text.as_py()).items():
                        found[item_id] = max(found.get(item_id, 0.0), score)
            rows = [(i, item_id, score) for i, found in zip(batch.column(0).to_pylist(), scores, strict=True) for item_id, score in found.items()]
            doc_ids, item_ids, values = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(item_ids, pa.int64()), pa.array(values, pa.float64())], ["doc_id", "item_id", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, item_id long, score double")


def _passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, answer, n, short) of every distinct passage, its words in lower case with spaces between."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                for passage, end in passages_of(words, words_of(said.as_py()) or None) if words else ():
                    rows.append((item_id, b" ".join(passage), None if end is None else b" ".join(end), len(passage), len(words) < LEAST_WORDS))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["item_id", "text", "answer", "n", "short"])

    known = benchmark.select(F.col("item_id").cast("long"), "text", answer.alias("answer")).where("item_id is not null and text is not null")
    made = known.mapInArrow(run, "item_id long, text binary, answer binary, n long, short boolean").distinct()
    return made.select("item_id", F.decode("text", "UTF-8").alias("text"), F.decode("answer", "UTF-8").alias("answer"), "n", "short")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score) of each document and benchmark item of which it holds a passage, in part or in other words.

    ``benchmark`` has item_id, text and, if it knows them, answer; without that column an item's last
    ``ANSWER_WORDS`` words stand for its answer.  Null and empty texts, and items without words, match
    nothing.  An item with fewer than ``LEAST_WORDS`` words matches a text with these words in a row.
    Items that repeat an id count as that item.  Ids are integers.  A row without an id appears with a
    null id.  Rows that repeat an id give a row each.  Empty tables give an empty table; other columns
    are not read.
    """
    spark = docs.sparkSession
    passages = materialise(_passages(benchmark), "passages")
    n, n_words = passages.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    if not n:
        return spark.createDataFrame([], "doc_id long, item_id long, score double")
    blocks = max(1, -(-n // block), -(-n_words // block_words))
    passages = passages.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    folder = scratch(spark, "blocks")

    def of(b: int) -> tuple[list, list, dict[bytes, int]]:
        rows = [(r["item_id"], r["text"].encode("utf-8", "surrogatepass").split(), r["answer"] and r["answer"].encode("utf-8", "surrogatepass").split(), r["short"]) for r in passages.where(F.col("block") == b).collect()]
        items, short = sorted((r[:3] for r in rows if not r[3]), key=lambda r: r[:2]), [r[:2] for r in rows if r[3]]
        return items, short, {w: i for i, w in enumerate(dict.fromkeys(w for _, words, _ in items for w in words))}

    files = [f"{folder}/words-{b}" for b in range(blocks)]
    for b, file in enumerate(files):
        write_blob(file, of(b)[2])
    counts = materialise(document_frequencies(docs, files, text_col), "frequencies")
    made = []
    for b in range(blocks):
        items, short, vocabulary = of(b)
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for r in counts.where(F.col("block") == b).collect():
            df[r["word"]] = r["n"]
        n_docs = int(df[-1])
        idf = np.log((1 + n_docs) / (1 + df[:-1])) + 0.01
        own = passages.where((F.col("block") == b) & ~F.col("short")).repartition(max(1, len(items) // 1000))
        space = randomised_svd(own, vocabulary, idf, min(rank, len(vocabulary))) if items else np.zeros((0, 0))
        made.append(f"{folder}/block-{b}")
        write_blob(made[-1], Block(items, short, vocabulary, idf, float(np.log(1 + n_docs) + 0.01), space))
    return _search(docs, made, id_col, text_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay."""
    leaks = materialise(find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "leaks")
    return docs.join(leaks, id_col, "left_anti")
