"""MinHash near-dedup as a chosen-path set similarity join.

Documents are sets of word shingles.  Exact copies collapse first.  Each of several independent trees
deals the remaining sets to nodes by the token that a minwise hash selects; nodes too large to be
compared branch again, by further tokens chosen from the node's path, until what is left is small.
Small nodes are compared exhaustively, first by minwise sketches of 256 bits, and then, where a sketch
leaves a chance, on full sets.  The result is components, so a node yields a spanning forest of its
links and never all pairs.

Two passes keep the work linear.  The first takes few trees; a large node is cut into blocks that
share some random members, which joins dense families across blocks.  The second takes the other
trees and looks only at pairs from different components: a large node in which all but few members
are one component is cut into blocks that all hold those few, which is exact; other large nodes
branch.  A path never selects a position twice.  With ``TREES`` trees a link of similarity s is missed
at the roots with probability (1 - s) ** TREES, which is 6e-8 at 0.75.  Down to ``DEPTH`` a large node
branches twice, and a link at 0.75 is kept with probability 0.89 in each tree that it reached; below,
it branches 4/3 times on average, which keeps one path of such a link on average, so that the work
stays far below the square of a node: the link is kept with 0.77 after eight more levels, 0.64 after
sixteen, 0.41 after forty.  Ten trees then find it with 0.9998, 0.998 and 0.975, closer links more often.  A
node whose members agree in all ``POSITIONS`` tokens is one family and is cut like those of the first
pass.  A sketch loses a link at 0.75 with probability 1e-6.

Nodes and blocks are bounded in members and in the shingles that these hold together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compactcodec.llm.common import materialise
from compactcodec.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
TREES, FIRST_TREES = 12, 2
POSITIONS = 64
BRANCHES = 2
DEPTH = 4
NODE = 1024
#: shingles that the members of a node or block may hold together, unless they are few: 32 MB
MOST_SHINGLES = 4_000_000
LEADERS = 16
#: rows of three numbers that may be broadcast, about 10 MB
BROADCAST_ROWS = 300_000
#: of 64 sketch digits, two sets of similarity 0.75 agree in 49 on average, with a deviation of 3.4
LEAST_EQUAL = 32

_M = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = {w: xxhash.xxh3_64_intdigest(w) for w in dict.fromkeys(words)}
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = out * _M + h[k : len(h) - size + 1 + k]
        return np.unique(_mix(out + np.uint64(size)))


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest of the set's hashes under each of ``POSITIONS`` orders, 32 bits each."""
    low = np.full(POSITIONS, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            low = np.minimum(low, ((s[at : at + 2048, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return low


def sketch(tokens: np.ndarray) -> np.ndarray:
    digits = (_mix(tokens) & np.uint64(15)).reshape(4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(digits, axis=1)


def equal_digits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of 64 digits agree, for all rows of a against all rows of b (n x 4 each)."""
    out = np.full((len(a), len(b)), POSITIONS, np.int16)
    for k in range(4):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        out -= np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int16)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, fingerprint of the set (f1, f2), minwise tokens and sketch (s0..s3); whole texts, read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, tokens, words = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                with np.errstate(over="ignore"):
                    f1.append(_mix(s).sum(dtype=np.uint64))
                    f2.append(_mix(s ^ _M).sum(dtype=np.uint64))
                low = minwise(s)
                tokens.append(low.astype("<u4").tobytes())
                words.append(sketch(low))
            w = np.array(words, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(tokens, pa.binary()), *[pa.array(w[:, k].copy()) for k in range(4)]], ["id", "n_shingles", "f1", "f2", "tokens", "s0", "s1", "s2", "s3"])

    schema = "id long, n_shingles long, f1 long, f2 long, tokens binary, s0 long, s1 long, s2 long, s3 long"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def _token(position) -> F.Column:
    return F.substr("tokens", position * 4 + 1, F.lit(4))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``block``, which stand together, as tables of whole blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        last = int(np.searchsorted(block, block[-1])) if block[0] <= block[-1] else 0
        if last == 0 and held and held[-1].column("block")[-1].as_py() == block[0]:
            held.append(batch)
            continue
        cut = 0
        if held and held[-1].column("block")[-1].as_py() == block[0]:
            cut = int(np.searchsorted(block, block[0], "right"))
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
            held = []
        if last > cut:
            yield pa.Table.from_batches([batch.slice(cut, last - cut)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _close(blocks: DataFrame, least_equal: int) -> DataFrame:
    """Members of each block whose sketch leaves a chance with a member of another component: block, id, comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            block, comp = t.column("block").to_numpy(), t.column("comp").to_numpy()
            sk = np.stack([t.column(f"s{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
            edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            keep = np.zeros(len(block), bool)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                c = comp[s:e]
                for at in range(s, e, 2048):
                    to = min(e, at + 2048)
                    near = (equal_digits(sk[at:to], sk[s:e]) >= least_equal) & (comp[at:to, None] != c)
                    keep[at:to] |= near.any(axis=1)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(block[keep]), t.column("id").combine_chunks().filter(pa.array(keep)), pa.array(comp[keep])], ["block", "id", "comp"])

    dealt = blocks.select("block", "id", "comp", "s0", "s1", "s2", "s3").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "block long, id long, comp long")


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what pairwise links join: breadth first, each set against those not yet reached."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    begin = np.concatenate([[0], np.cumsum(size)])
    own = lambda i: ids[begin[i] : begin[i + 1]]
    free = np.arange(n)
    links: list[tuple[int, int]] = []
    flat, starts = ids, begin[:-1]
    held = free
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            x = queue.pop()
            if len(free) <= len(held) // 2:
                held = free
                flat = np.concatenate([own(i) for i in held])
                starts = np.concatenate([[0], np.cumsum(size[held])])[:-1]
            mark[own(x)] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own(x)] = False
            linked = held[100 * both >= percent * (size[x] + size[held] - both)]
            new = linked[np.isin(linked, free, assume_unique=True)]
            if len(new):
                links += [(x, int(y)) for y in new]
                queue += new.tolist()
                free = free[~np.isin(free, new, assume_unique=True)]
    return links


def _compare(close: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links (a, b) between components, found on the full sets of whole texts within each block.

    Few enough members are sent to where the texts are; more of them meet the texts in a shuffle.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    close = materialise(close, "close")
    few = close.count() <= BROADCAST_ROWS
    dealt = texts.join(F.broadcast(close) if few else close, "id").select("block", "id", "comp", "text").repartition("block").sortWithinPartitions("block", "id")

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        found = spanning_links([r[2] for r in rows], percent)
        return list({(min(a, b), max(a, b)) for x, y in found if (a := rows[x][1]) != (b := rows[y][1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, out = None, [], []
        for batch in batches:
            for b, i, c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b != block:
                    out += links(rows)
                    block, rows = b, []
                found = shingles(t.as_py())
                if not (rows and rows[-1][0] == i and np.array_equal(rows[-1][2], found)):  # not a repeated row
                    rows.append((i, c, found))
            if len(out) > 5000:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
                out = []
        out += links(rows)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


def _root(tree: int) -> F.Column:
    """The root node of a set in a tree."""
    return F.xxhash64(F.lit(tree), _token(F.lit(tree)))


def _parts(n: F.Column, weight: F.Column, node: int, most: int) -> F.Column:
    """Into how many parts a node of ``n`` members goes; a part holds ``LEADERS`` members at least."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / LEADERS), F.greatest(F.ceil(n / node), F.ceil(weight / most)))).cast("int")


def _first_blocks(at: DataFrame, node: int, most: int) -> DataFrame:
    """Blocks of the nodes of ``at`` (node, id, n_shingles, ...): a large node is cut by a hash, and some random members are in each part."""
    many = materialise(at.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1"), "nodes")
    k = _parts(F.col("n"), F.col("weight"), node, most)
    mine = F.pmod(F.xxhash64("id"), k).cast("int")
    leader = F.pmod(F.xxhash64(F.lit(3), "node", "id"), F.ceil(F.col("n") / LEADERS)) == 0
    part = F.when(k == 1, F.array(F.lit(0))).when(leader, F.sequence(F.lit(0), k - 1)).otherwise(F.array(mine))
    return at.join(many, "node").withColumn("part", F.explode(part)).withColumn("block", F.xxhash64("node", "part"))


def _mixed(at: DataFrame) -> DataFrame:
    """The rows of nodes with more than one component, with the node's size, largest component and its size, and their shingles."""
    own = at.groupBy("node", "comp").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    largest = F.max(F.struct("m", "comp", "w"))
    by = own.groupBy("node").agg(F.sum("m").alias("n"), F.sum("w").alias("weight"), largest.alias("x")).select("node", "n", "weight", F.col("x.comp").alias("most"), F.col("x.m").alias("top"), F.col("x.w").alias("top_weight")).where("n > top")
    return at.join(materialise(by, "nodes"), "node")  # read anew, so that the join can split a large node


def _children(level: int, branches: int, depth: int) -> F.Column:
    """Nodes below a node, each by a token at a position that its path has not used: ``branches`` of them down to ``depth``, then one or two."""
    free = F.array_except(F.array(*map(F.lit, range(POSITIONS))), F.col("used"))
    many = F.size(free)
    first = F.pmod(F.xxhash64("node"), many)

    def child(b: int) -> F.Column:
        # distinct as long as there are enough
        at = F.get(free, F.pmod(first + b, many).cast("int"))
        return F.struct(F.xxhash64("node", F.lit(b), at, _token(at)).alias("node"), F.concat("used", F.array(at)).alias("used"))

    two = F.array(*[child(b) for b in range(branches)])
    if level < depth:
        return two
    return F.when(F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(3)) == 0, two).otherwise(F.array(child(0)))


def _later_blocks(known: DataFrame, trees: range, node: int, branches: int, depth: int, most: int) -> Iterator[DataFrame]:
    """Blocks of mixed nodes, level by level.  Tokens and sketches join only the rows of mixed nodes."""
    tree = lambda t: F.struct(_root(t).alias("node"), F.array(F.lit(t)).alias("used"))
    roots = known.select("id", "comp", "n_shingles", F.explode(F.array(*[tree(t) for t in trees])).alias("at")).select("id", "comp", "n_shingles", "at.node", "at.used")
    slim = materialise(_mixed(roots), "mixed")
    mixed = materialise(slim.join(known.select("id", "tokens", "s0", "s1", "s2", "s3"), "id"), "mixed")
    for level in range(POSITIONS):
        n, weight = F.col("n"), F.col("weight")
        small = (n <= node) & ((weight <= most) | (n <= LEADERS))
        dense = (n - F.col("top") <= node // 2) & (weight - F.col("top_weight") <= most // 2)
        k = F.greatest(F.ceil(n / (node // 2)), F.ceil(weight / (most // 2))).cast("int")
        mine = F.pmod(F.xxhash64("id"), k).cast("int")
        everywhere = F.sequence(F.lit(0), k - 1)
        whole = mixed.where(small | dense)
        part = F.when(small, F.array(F.lit(0))).when(F.col("comp") != F.col("most"), everywhere).otherwise(F.array(mine))
        yield whole.withColumn("part", F.explode(part)).withColumn("block", F.xxhash64("node", "part"))
        large = mixed.where(~small & ~dense)
        if not large.limit(1).count():
            return
        columns = ["id", "comp", "n_shingles", "tokens", "s0", "s1", "s2", "s3"]
        if level == POSITIONS - 1:  # all tokens agree
            yield _first_blocks(large.select("node", *columns), node, most)
            return
        at = large.select(*columns, F.explode(_children(level, branches, depth)).alias("at")).select(*columns, "at.node", "at.used")
        mixed = materialise(_mixed(at), "mixed")


def _links_of_ids(several: DataFrame, with_set: DataFrame, copies: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between the components of the sets that one id has, of ids with ``several``."""
    key = ["f1", "f2", "n_shingles"]
    own = with_set.select("id", *key).join(several, "id", "left_semi").distinct().join(copies, key).join(known.select(F.col("id").alias("rep"), "comp"), "rep")
    own = materialise(own.select("id", "comp").distinct(), "own")
    least = materialise(own.groupBy("id").agg(F.min("comp").alias("a")), "least")
    return own.join(least, "id").where("a <> comp").select("a", F.col("comp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, trees: int = TREES, first_trees: int = FIRST_TREES, node: int = NODE, branches: int = BRANCHES, depth: int = DEPTH, least_equal: int = LEAST_EQUAL, most: int = MOST_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their shingle sets; a
    component's name is its smallest id and only that row is kept.  Texts without words (null, empty,
    white space) are linked with nothing.  A row without an id is linked with nothing: its component
    is null and it is kept.  Ids are integers, and an id is one document: rows that share one are
    linked, whatever their texts, and have one component.  An empty table gives an empty table; other
    columns are not read.
    """
    sig = materialise(signatures(docs, id_col, text_col), "signatures")
    sketches = ["s0", "s1", "s2", "s3"]
    with_set = sig.where("id is not null and n_shingles > 0")
    copies = materialise(with_set.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep")), "copies")
    one = copies.select("f1", "f2", "n_shingles", F.col("rep").alias("id"))
    key = ["id", "f1", "f2", "n_shingles"]

    # of several texts under one id, each is a member
    roots = with_set.select(*key, *sketches, F.array(*[_root(t) for t in range(first_trees)]).alias("nodes")).join(one, key, "left_semi")
    at = roots.select("id", "n_shingles", F.col("id").alias("comp"), *sketches, F.explode("nodes").alias("node"))
    close = _close(_first_blocks(materialise(at, "roots"), node, most), least_equal)
    first = connected_components(_compare(close, docs, id_col, text_col, percent))
    known = with_set.select(*key, "tokens", *sketches).join(one, key, "left_semi").join(first.withColumnRenamed("v", "id"), "id", "left")
    known = materialise(known.select("id", "n_shingles", "tokens", *sketches, F.coalesce("component", "id").alias("comp")), "known")
    blocks = [b.select("block", "id", "comp", *sketches) for b in _later_blocks(known, range(first_trees, trees), node, branches, depth, most)]
    rest = blocks[0]
    for b in blocks[1:]:
        rest = rest.union(b)
    links = _compare(_close(rest, least_equal), docs, id_col, text_col, percent)
    several = with_set.groupBy("id").agg(F.min(F.struct("f1", "f2", "n_shingles")).alias("a"), F.max(F.struct("f1", "f2", "n_shingles")).alias("b")).where("a <> b").select("id")
    several = materialise(several, "several")
    if several.limit(1).count():
        links = links.union(_links_of_ids(several, with_set, copies, known))
    second = connected_components(links)

    final = known.select(F.col("id").alias("rep"), "comp").join(second.select(F.col("v").alias("comp"), "component"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("component_id")).distinct()
    named = copies.join(final, "rep", "left").select("f1", "f2", "n_shingles", "component_id")
    out = sig.select("id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
