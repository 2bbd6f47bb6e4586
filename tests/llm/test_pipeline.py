"""Each stage on what its predecessor kept, held against brute force."""

import corpus_pipeline as cp
from lattica.llm import lines, quality
from lattica.llm.common import table

from .test_packing import check_packed
from .test_text_operators import brute_classes, brute_hits


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality_filter", "line_dedup", "near_dedup", "decontamination", "pack"]
    good = table(stages["quality_filter"](spark, docs, sf), "t")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all((d in kept) == bool(q) for d, q in truth.items() if q is not None) or sum((d in kept) != bool(q) for d, q in truth.items()) <= 2
    model = quality.learn_from(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept == {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
    lined = table(stages["line_dedup"](spark, good, sf), "t")
    assert lined.columns == docs.columns
    assert {r.doc_id: r.text for r in lined.collect()} == {r.doc_id: r.text for r in lines.dedup_lines(good).where("n_removed = 0 OR length(trim(text)) > 0").collect()}
    assert all(len(r.text) == r.n_chars for r in lined.collect())
    single = table(stages["near_dedup"](spark, lined, sf), "t")
    classes = brute_classes([(r.doc_id, r.text) for r in lined.collect()])
    assert {r.doc_id for r in single.collect()} == set(classes.values())
    clean = table(stages["decontamination"](spark, single, sf), "t")
    want = set()
    for r in single.collect():
        n, hit, _ = brute_hits(r.text, items)
        if not hit or 20 * len(hit) < n:
            want.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == want
    packed = stages["pack"](spark, clean, sf).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in clean.collect()])


def test_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "a few words in a row here", "en", "s", 25), (5, "same text for two rows of one id", "en", "s", 1), (5, "same text for two rows of one id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert cp.near_dedup(spark, docs, sf).where("doc_id = 5").count() == 1
