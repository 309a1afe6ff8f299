"""The pipeline's rows against plain versions of its stages."""

import corpus_pipeline
from tests.llm.test_html_warc_leaks import leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_near
from tests.llm.test_tokens_and_packing import check_packing

from compactcodec.llm import decontaminate, quality_rules


def test_stages(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [r for r in rows if quality_rules.measure(r[1])["kept"]]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    near = brute_near(rows)
    rows = [r for r in rows if near[r[0]][2]]
    items = [decontaminate.passages_of(w, None) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if len(w := decontaminate.words_of(r["text"])) >= decontaminate.LEAST_WORDS]
    texts = {i: t for i, t in rows if not any(leaks(item, decontaminate.words_of(t)) for item in items)}
    used, least = check_packing(corpus_pipeline.run(spark, small).collect(), texts)
    assert used <= 1.03 * least + 1


def test_columns_between_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)), "en", "s", 5), (1, " ".join(f"w{i}" for i in range(50)), "en", "s", 5), (None, " ".join(f"x{i}" for i in range(50)), None, None, None), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "None"]
