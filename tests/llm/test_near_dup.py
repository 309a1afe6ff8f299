import random

import numpy as np

from compactcodec.llm import near_dup as nd
from compactcodec.llm.components import connected_components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))  # noqa: B905


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, **more).collect()}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(8)
    texts = []
    for f, n in enumerate((60, 12, 3, 2)):
        base = [f"w{f}.{rng.randrange(500)}" for _ in range(120)]
        texts += [" ".join(base)] * 3 + family(rng, base, n, 4)
    passage = " ".join(f"shared{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"p{i}.{k}" for k in range(60)) for i in range(40)]
    texts += ["", None, "  \n", "one two", "ONE  two", "one two three", "a b c d e", "A b c d e"]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_components_equal_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_tiny_nodes_force_blocks_and_branches(spark):
    rows = corpus()
    found, want = run(spark, rows, node=16, depth=3), brute(rows)
    assert found == want


def test_deep_branches_and_small_blocks(spark):
    """Nodes of a few members, so that paths use many positions, and blocks bounded by their shingles."""
    rows = corpus()
    assert run(spark, rows, node=4, depth=1, most=400) == brute(rows)
    passage = " ".join(f"s{k}" for k in range(70))
    alike = [(i, passage + " " + " ".join(f"p{i}.{k}" for k in range(30))) for i in range(120)] + [(500, passage + " " + " ".join(f"p7.{k}" for k in range(29)))]
    found = run(spark, alike, node=32, depth=2)
    assert found[500][1] == 7 and sum(not r[2] for r in found.values()) == 1


def test_an_id_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a + " tail"), (5, a), (5, b), (9, b + " tail"), (2, " ".join(f"c{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in nd.near_duplicates(df).collect()) == [(2, 2), (3, 3), (5, 3), (5, 3), (9, 3)]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kept")
    found = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 0, 2, True), (3, 0, 3, True)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_long_text_has_all_shingles():
    text = " ".join(f"w{i}" for i in range(50_000))
    assert len(nd.shingles(text)) == 49_996


def test_spanning_links_connect_what_all_pairs_connect():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64) for _ in range(60)]
    seen = nd.spanning_links(sets, 60)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in seen:
        parent[root(a)] = root(b)
    for a in range(60):
        for b in range(a):
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both):
                assert root(a) == root(b)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 160)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
