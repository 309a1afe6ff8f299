import html
import random
import re
import time

import pytest

from compactcodec.llm import decontaminate, html_extract, warc
from compactcodec.llm.queries import ORACLE_SQL, QUERIES

# ---------------------------------------------------------------- pages


def test_pages_give_their_articles(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op6_html_extraction"](spark, small).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages.pop(r["page_id"]), re.DOTALL)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split()) and r["n_chars"] == len(r["text"])
    assert not pages


def labelled(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


WEIGHTS = html_extract.fit_weights([labelled(
    "<header class=masthead><h1>Site name</h1></header><nav class='main-menu'><ul><li><a>x y</a></li><li><a>z</a></li></ul></nav><div class=ad>a b c</div>"
    "<article><h1>Title of it</h1><p>c d e f g h i j</p><ul><li>an item of a list</li></ul><blockquote>said and quoted words</blockquote><p>k l m n o p</p></article>"
    "<div class='promo-box'>buy this now</div><footer>z z</footer>")] * 20)  # fmt: skip


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), (None, ""), ("just words", "just words"), ("<article></article>", ""),
    ("<article><p>a &amp; b&nbsp;<b>c</b>d\n  e<br>f<p>g</article>", "a & b cd e f g"),
    ("<article><p>one two three<div class='ad'>buy</div><p>four five six<aside>x</aside><form>f<input></form><section id=comments><p>nice post</section><p>seven eight nine</article>", "one two three four five six seven eight nine"),
    ("<article><p>x<script>if (a < b) '</p>'</script>y<style>p{}</style><!-- c --><p>z", "xy z"),
    ("<ARTICLE><P CLASS=x>Up<P>per</ARTICLE>", "Up per"), ("<article><p>&lt;b&gt; &#233; &zzz; 1 < 2</p></article>", "<b> é &zzz; 1 < 2"),
    # inside an article only whole names are left out, and a header of its own stays
    ("<article><p>kept one<div class='article-header'><h2>Heading words</h2></div><p class='share-price'>The share price rose.</p><div id='search-results-study'><p>A study of search.</div></article>", "kept one Heading words The share price rose. A study of search."),
    ("<article><header><h1>Head of it</h1></header><p>text of it</article>", "Head of it text of it"),
    ("<article><p>one two three four</article><p>between</p><article><p>five six seven</article>", "one two three four between five six seven"),
])
def test_page_shapes(page, text):
    assert html_extract.main_text(page, WEIGHTS) == text


#: pages that no element marks, and their text as a reader would mark it
UNMARKED = [
    (labelled("<header><h1>Site</h1></header><div class='cookie-notice'>We use cookies here</div><div><h2>The title</h2><p>First words here <a href=x>link</a> end.<p>Second part.</div><footer>contact us</footer>"), "The title First words here link end. Second part."),
    (labelled("<nav class='main-menu'><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class='page'><div class='text'><h1>Rain</h1><p>It rained all day in the north.</p><ul><li>one wet road</li></ul><p>It stopped at night.</p></div><div class='promo-box'>buy this now and save</div></div><footer>z</footer>"), "Rain It rained all day in the north. one wet road It stopped at night."),
    (labelled("<div class=ad>buy now cheap</div><section><p>A text that stands in a section alone.</p><blockquote>Somebody said this.</blockquote></section><section id=comments><p>I liked this a lot</p></section>"), "A text that stands in a section alone. Somebody said this."),
    (labelled("<div class='promo-box'>a short offer</div><p>Loose words of a page without any box at all.</p><nav><a>next</a></nav>"), "Loose words of a page without any box at all."),
]


@pytest.mark.parametrize(("page", "text"), UNMARKED)
def test_weights_decide_on_hand_marked_pages(page, text):
    assert html_extract.main_text(page, WEIGHTS) == text
    assert html_extract.main_text(page, {"words": {}, "within": {}, "tags": {}}) != text


def test_without_weights_the_query_has_other_rows(spark, small):
    """Every page of the table, marked or not, owes its text to the fitted weights."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    bare = {r["page_id"]: r["text"] for r in html_extract.extract(pages, weights={"words": {}, "within": {}, "tags": {}}).collect()}
    assert all(texts[i] != bare[i] for i in texts)


def test_fitted_weights_find_the_text_of_unmarked_pages(spark, small):
    """Pages whose article tags are taken off give the same text."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect() if r["html"]]
    weights = html_extract.fit_weights(pages)
    for page in pages:
        bare = re.sub(r"(?i)<(/?)(?:article|main)(?=[ >])", r"<\1div", page)
        assert bare != page and html_extract.main_text(bare, weights) == html_extract.main_text(page, weights)


def test_a_marked_teaser_does_not_hide_the_text():
    page = "<body><article><p>Short teaser</p></article><div><p>" + "the long main text " * 30 + "</p></div></body>"
    assert html_extract.main_text(page, WEIGHTS).endswith("the long main text " * 29 + "the long main text")


@pytest.mark.parametrize("piece", ["<div><b>x</i>", "<p><b>x</i></p></b>", "<table><tr><td><li>x", "<b></div>"])
def test_time_is_linear_in_nesting(piece):
    def seconds(n):
        start = time.perf_counter()
        html_extract.main_text(piece * n, WEIGHTS)
        return time.perf_counter() - start

    assert min(seconds(16_000) for _ in range(2)) < 8 * 2.5 * max(0.01, min(seconds(2000) for _ in range(2)))


def test_the_sample_is_the_same_at_any_layout(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert html_extract.labelled_sample(pages.repartition(7), most=20) == html_extract.labelled_sample(pages.coalesce(1), most=20)
    assert html_extract.labelled_sample(pages, most_bytes=10) == []


def test_pages_of_a_frame(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "<article><p>" + "w " * 100_000, "k"), (2, "<p>a b c", "k")], "page_id long, html string, text string")
    rows = html_extract.extract(df).collect()
    assert sorted(len(r["text"]) for r in rows) == [0, 5, 199_999]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_best_run_is_the_best():
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randint(1, 12))]
        s, e = html_extract.best_run(scores)
        best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))
        assert sum(scores[s:e]) == best


# ---------------------------------------------------------------- archives

CAPTURE = "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>, body string"


def test_revisits(spark):
    log = [
        (1, "http://www.A.org:80/p?b=2&a=1&utm_x=1#f", 100, "response", "e1", None, {"ETag": "e1", "Server": "s", "DATE": "1", "Date": "2"}, "one"),
        (2, "https://a.org/p?a=1&b=2", 90_000, "response", "e2", "m2", {"ETag": "e2", "X": "y"}, "two"),
        (3, "https://a.org/p?a=1&b=2", 50, "revisit", "e1", None, None, None),
        (4, "https://a.org/p?a=1&b=2", 100, "revisit", "e1", None, {}, None),
        (5, "https://a.org/p?a=1&b=2", 101, "revisit", "W/e1", None, {"date": "3", "Server": "t"}, None),
        (6, "https://a.org/p?a=1&b=2", 500_000, "revisit", None, "m2", {"Vary": "v"}, None),
        (7, "https://a.org/p?a=1&b=2", 500_000, "revisit", "e1", None, {"Vary": "v"}, None),
        (8, None, 500_000, "revisit", "e1", None, None, None), (9, "https://b.org/", None, "revisit", "e1", None, None, None),
        (10, "http://a.org/p?a=1&b=2", 95_000, "metadata", "e9", None, None, "no"),
    ]
    found = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(log, CAPTURE)).collect()}
    assert {k: (r["status"], r["resolved_id"], r["body"]) for k, r in found.items()} == {
        3: (warc.MISSING, None, None), 4: (warc.MISSING, None, None), 5: (warc.RESOLVED, 1, "one"), 6: (warc.RESOLVED, 2, "two"), 7: (warc.MISMATCH, 2, None), 8: (warc.MISSING, None, None), 9: (warc.MISSING, None, None),
    }
    assert found[5]["headers"] == {"etag": "e1", "server": "s", "date": "3"}
    assert found[6]["headers"] == {"etag": "e2", "x": "y", "vary": "v"}
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0
    twice = spark.createDataFrame([*log, *log], CAPTURE)
    assert warc.resolve_revisits(twice).count() == 14


def test_revisits_that_share_a_record_id_and_responses_that_do(spark):
    log = [
        (1, "http://a.org/", 10, "response", "e1", None, {}, "one"), (2, "http://b.org/", 10, "response", "e2", None, {}, "two"),
        (9, "http://a.org/", 20, "revisit", "e1", None, {}, None), (9, "http://b.org/", 20, "revisit", "e2", None, {}, None),
        (5, "http://c.org/", 10, "response", "e3", None, {}, "small"), (5, "http://c.org/", 10, "response", "e3", None, {}, "tall"),
        (6, "http://c.org/", 20, "revisit", "e3", None, {}, None), (5, "http://d.org/", 10, "response", "e3", None, {}, "elsewhere"),
        (None, "http://e.org/", 10, "response", "e4", None, {}, "no id"), (None, "http://e.org/", 20, "revisit", "e4", None, {}, None),
    ]
    found = warc.resolve_revisits(spark.createDataFrame(log, CAPTURE)).collect()
    assert sorted((str(r["record_id"]), r["url"], r["resolved_id"], r["body"]) for r in found) == [("6", "http://c.org/", 5, "tall"), ("9", "http://a.org/", 1, "one"), ("9", "http://b.org/", 2, "two"), ("None", "http://e.org/", None, "no id")]


def test_a_hot_page_and_a_very_long_body(spark):
    """Thousands of revisits in one second and over days, against a plain scan."""
    rng = random.Random(3)
    times = [rng.randrange(0, 400_000) for _ in range(3000)] + [5000] * 2000
    log = [(i, "http://hot.org/", t, "revisit", "e", None, {}, None) for i, t in enumerate(times)]
    log += [(10_000 + i, "http://hot.org/", t, "response", "e", None, {}, "x" * 3_000_000 if i == 0 else f"b{i}") for i, t in enumerate([4999, 5000, 100_000, 100_000, 300_000])]
    found = {r["record_id"]: (r["resolved_id"], r["n"]) for r in warc.resolve_revisits(spark.createDataFrame(log, CAPTURE), span=50_000).selectExpr("record_id", "resolved_id", "length(body) as n").collect()}
    full = sorted((r[2], r[0], len(r[7])) for r in log if r[3] == "response")
    want = {r[0]: max(((f[1], f[2]) for f in full if f[0] < r[2]), key=lambda x: next(f[:2] for f in full if f[1] == x[0]), default=(None, None)) for r in log if r[3] == "revisit"}
    assert found == want


def test_revisits_equal_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    found = QUERIES["op5_warc"](spark, small)
    want = con.sql(ORACLE_SQL["op5_warc"])
    order = found.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())


def test_archive_files(spark, tmp_path):
    raw = b"".join(warc.write_record("response", {"WARC-Target-URI": f"http://x/{i}", "WARC-Date": "2024-01-01T00:00:00Z"}, f"body {i}\r\n\r\nWARC/1.1".encode()) for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("number").collect()
    assert [r["url"] for r in rows] == [f"http://x/{i}" for i in range(5)] and bytes(rows[4]["content"]).startswith(b"body 4") and all(r["complete"] for r in rows)
    with pytest.raises(ValueError, match="WARC"):
        list(warc.read_records(b"nonsense\r\n"))


def test_damaged_archives_say_so(spark):
    plain = [warc.write_record("response", {"WARC-Target-URI": f"u{i}"}, b"x" * 500, compress=False) for i in range(2)]
    whole = b"".join(plain)
    assert [r[3] for r in warc.read_records(whole)] == [True, True]
    cut = list(warc.read_records(whole[:-300]))
    assert [r[3] for r in cut] == [True, False] and len(cut[1][2]) == 204
    packed = b"".join(warc.write_record("response", {}, bytes([i]) * 5000) for i in range(2))
    assert [r[3] for r in warc.read_records(packed[:-12])] == [True, False]
    assert [r[3] for r in warc.read_records(whole.replace(b"Content-Length: 500", b"Content-Length: many", 1))] == [False]
    df = spark.createDataFrame([(bytearray(whole[:-300]),), (None,), (bytearray(b""),)], "archive binary")
    assert [r["complete"] for r in warc.read_archives(df, "archive").collect()] == [True, False]
    assert warc.captures_of(warc.read_archives(df, "archive")).count() == 1


@pytest.mark.parametrize("compress", [True, False])
def test_captures_survive_archives(spark, compress):
    log = [("1", "http://x/", 5, "response", {"ETag": "e", "Last-Modified": "m"}, "b\r\n\r\né" + "long " * 300_000), ("2", None, None, "revisit", {}, None), ("3", "http://x/", 7, "revisit", {"etag": "e"}, None), ("4", "http://y/", 7, "response", None, "")]
    df = spark.createDataFrame(log, "record_id string, url string, at long, kind string, headers map<string,string>, body string").repartition(2)
    found = warc.captures_of(warc.read_archives(warc.write_archives(df, compress), "archive")).collect()
    assert sorted((r["record_id"], r["url"], r["at"], r["kind"], r["etag"], r["last_modified"], r["headers"], r["body"]) for r in found) == [(a, b, c, k, (h or {}).get("ETag") or (h or {}).get("etag"), (h or {}).get("Last-Modified"), h or {}, t) for a, b, c, k, h, t in log]


# ---------------------------------------------------------------- benchmark


def test_lcs():
    def slow(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def leaks(passages, words):
    """Does a text hold one of an item's passages?  Every region, word by word, without the latent space."""
    for passage, answer in passages:
        reach, known = 2 * max(len(passage), decontaminate.WINDOW), set(passage)
        marks = [w in known for w in words]
        if any(sum(marks[k : k + reach]) >= 0.45 * len(passage) and decontaminate.judge(passage, words[k : k + reach], answer) for k in range(0, max(1, len(words) - len(passage)), 10)):
            return True
    return False


def test_leaks_equal_brute_force(spark, small):
    """Each document and item of the tables, against the definition itself; pairs that share few words are none."""
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    passages = {i: decontaminate.passages_of(w, None) for i, w in items.items() if len(w) >= decontaminate.LEAST_WORDS}
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = decontaminate.words_of(r["text"])
        own = set(words)
        want |= {(r["doc_id"], i) for i, ps in passages.items() if any(sum(w in own for w in p) >= 0.45 * len(p) for p, _ in ps) and leaks(ps, words)}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontaminate"](spark, small).collect()}
    assert want and found == want


def test_a_paragraph_of_a_long_item(spark):
    """Some seventy words out of a thousand, at any place, are a leak; the blocks and their number don't matter."""
    rng = random.Random(4)
    say = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, say(1000)) for i in range(6)]
    docs = [(k, " ".join([*say(90), *items[k % 6][1][k * 37 : k * 37 + 70], *say(90)])) for k in range(24)] + [(99, " ".join(say(400)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(k, k % 6) for k in range(24)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, block=30, block_words=1500).collect()} == want


def test_answers_of_a_column(spark):
    """Half of an item counts only where its answer stands there too."""
    item = [f"q{i}" for i in range(40)]
    half = " ".join(item[:20])
    df = spark.createDataFrame([(1, f"{half} the answer is forty two indeed"), (2, half + " nothing of it here at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item), "Forty-two")], "item_id long, text string, answer string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == {(1, 7)}
    assert decontaminate.find_leaks(df, bench.drop("answer")).count() == 0


def test_windows_go_in_slices(spark):
    """A text of several slices has the leaks that its parts have, wherever they stand."""
    rng = random.Random(12)
    say = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    items = [(i, say(40)) for i in range(12)]
    step = decontaminate.SLICE * decontaminate.STRIDE
    words = say(3 * step + 500)
    for i, (_, w) in enumerate(items):
        at = i * step // 4 + (i % 3) * 7
        words[at : at + 40] = w
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    found = decontaminate.find_leaks(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {r["item_id"] for r in found.collect()} == set(range(12))


def test_paraphrases_nulls_and_long_texts(spark):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, say(40)) for i in range(12)]
    edited = list(items[3][1])
    for k in range(0, 40, 6):
        edited[k] = "other"
    docs = [(1, " ".join(say(300) + items[0][1] + say(300))), (2, " ".join(say(50) + edited + say(50))), (3, " ".join(say(500))), (4, None), (5, ""), (6, " ".join(say(30_000) + items[5][1])), (None, " ".join(items[1][1])), (1, " ".join(items[0][1]).upper() + "!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, "too short"), (91, None), (None, "x")], "item_id long, text string")
    want = {(1, 0), (2, 3), (6, 5), (None, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, block=5).collect()} == want
    kept = decontaminate.clean(df, bench).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "4", "5", "None"]
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def zipf_words(rng, n):
    """Words as uneven as those of texts: a few are everywhere, most are rare."""
    return [f"w{int(20_000 ** rng.random())}" for _ in range(n)]


@pytest.mark.parametrize("n", [1000, 4000])
def test_a_copy_of_every_item_is_found(spark, n):
    """A block of far more items than the space has dimensions loses no verbatim copy."""
    rng = random.Random(n)
    items = [(i, " ".join(zipf_words(rng, rng.randint(15, 59)))) for i in range(n)]
    docs = [(i, " ".join([*zipf_words(rng, 60), t, *zipf_words(rng, 60)])) for i, t in items]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(i, i) for i, _ in items} <= {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_places_of_shared_pairs():
    """Every third word replaced, at the end of a text of several spans."""
    item = decontaminate.np.arange(30)
    pairs = decontaminate.Pairs([item, decontaminate.np.arange(40, 60)], 100, [True, True])
    text = decontaminate.np.full(7000, -1)
    text[6900:6930] = decontaminate.np.where(item % 4 == 3, -1, item)
    assert {i for i, place in pairs.places(text) if 6890 <= place <= 6930} == {0}
    assert not list(pairs.places(text[:6900])) and not list(pairs.places(text[:1])) and not list(pairs.places(text[:0]))


def test_copies_of_short_items(spark):
    """Items of 8 to 14 words within longer texts, and shorter ones word by word."""
    rng = random.Random(8)
    items = [(i, " ".join(zipf_words(rng, rng.randint(8, 14)))) for i in range(1000)]
    tiny = [(2000 + n, " ".join(f"q{k}" for k in range(n))) for n in range(2, 8)] + [(3000, "Lone!"), (3001, "..."), (3002, "")]
    docs = [(i, " ".join([*zipf_words(rng, 60), t, *zipf_words(rng, 60)])) for i, t in items]
    docs += [(5000, "a q0, Q1 q2 q3 b"), (5001, "lone"), (5002, "q0 x q1 q2 q3 q4 q5 q6 " + "z " * 99), (5003, "q0 q1 q2 q3 q4 q5 q6 " + "z " * 99), (5004, None), (5005, "")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + tiny, "item_id long, text string")
    rows = decontaminate.find_leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(i, i) for i, _ in items} <= found and len(rows) == len(found)
    want = {(5000, 2002), (5000, 2003), (5000, 2004), (5001, 3000)} | {(5003, 2000 + n) for n in range(2, 8)}
    assert {x for x in found if x[1] >= 2000} == want
    only = decontaminate.find_leaks(docs, bench.where("item_id >= 2000"), block=3).collect()
    assert {(r["doc_id"], r["item_id"]) for r in only} == want
