"""The pipeline on a small corpus, stage by stage against what each is for."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import DOCS, near_truth, prose, removed


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    passage, item = prose(rnd, 90), prose(rnd, 14)
    texts = [prose(rnd, 80) for _ in range(12)] + [None, "", "123 456"]
    texts += [texts[0], texts[1] + " tail", f"{prose(rnd)} {passage} {prose(rnd)}", f"{prose(rnd)} {passage}", f"start {item} end"]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, t, "xx", "s", len(t or ""), 1) for k, t in enumerate(texts)], DOCS).drop("start").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", texts


def test_stages_and_run(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    alive = {k: t for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    want = []
    want.append(dict(alive))
    truth = near_truth([alive.get(k) for k in range(len(texts))])
    alive = {k: t for k, t in alive.items() if truth[k][2]}
    want.append(dict(alive))
    cut = dict(zip(alive, removed(list(alive.values()), 400), strict=True))
    want.append({k: cut[k][0] - cut[k][1] for k in alive})
    want.append(set(alive) - {len(texts) - 1})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        got = rows if k < 2 else {i: len(t.encode()) for i, t in rows.items()} if k == 2 else set(rows)
        assert got == want[k]
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == want[3]
    assert packed.columns == corpus_pipeline.STAGES[4][1](spark, docs, folder).columns


def test_repeated_rows_leave_one(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "xx", "s", 1, 1)] * 2 + [(None, "a b c d e f", "xx", "s", 1, 1)], DOCS)
    kept = corpus_pipeline.near_dedup(spark, rows, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_stages_keep_columns_of_any_name_and_versions_of_a_doc_id(spark):
    extra = "doc_id long, text string, spans string, hit_key long, key0 int, own0 int, c0 string"
    text = prose(random.Random(30), 100)
    rows = spark.createDataFrame([(1, text, "s", 1, 2, 3, "c"), (2, f"{text} tail", "t", 1, 2, 3, None), (2, "another text of one document", None, 1, 2, 3, "c"), (3, None, "u", 1, 2, 3, "c")], extra)
    kept = corpus_pipeline.near_dedup(spark, rows, "")
    assert kept.columns == rows.columns
    # The version that is like document 1 goes, or stays for both; the other one stays.
    assert sorted(r.text or "" for r in kept.collect() if r.text != text and not (r.text or "").endswith("tail")) == ["", "another text of one document"]
    assert sum((r.text or "").startswith(text) for r in kept.collect()) == 1
    cut = corpus_pipeline.suffix_dedup(spark, rows, "")
    assert cut.columns == rows.columns and sorted((r.spans or "", r.text) for r in cut.collect())[1:] == [("s", ""), ("t", " tail"), ("u", None)]
    from lociweave.llm.decontam import uncontaminated

    items = spark.createDataFrame([(1, "another text of one document")], "item_id long, text string")
    clean = uncontaminated(rows, items)
    assert clean.columns == rows.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 3]


def test_stages_take_names_with_dots_and_empty_tables(spark, tmp_path):
    extra = "doc_id long, text string, lang string, `a.b` int, c0 string, score int, lang_pred string"
    text = prose(random.Random(31), 100)
    rows = spark.createDataFrame([(k, f"{text} {k}" if k < 3 else prose(random.Random(k), 60), "xx", k, "c", 1, "yy") for k in range(8)] + [(9, None, None, 1, None, None, None)], extra)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == rows.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[4][1](spark, docs, f"file://{tmp_path}")
        assert packed.select("doc_id").distinct().count() == docs.count()
