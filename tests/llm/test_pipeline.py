"""The pipeline against plain Python on a small corpus."""

import re

import corpus_pipeline
from llm.test_operators import ROWS, brute_components

SF = "/root/testdata/sf0.001"


def test_pipeline_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in docs.items() if any(c.isalpha() for c in t)}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: docs[i] for i in first.values()}
    left = {i: docs[i] for i, (_, root) in brute_components(left, 5, 80).items() if root == i}
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    left = {i: t for i, t in left.items() if not any(plain(x) in plain(t) for x in items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "best-fit packing"


def test_stages_on_odd_and_empty_tables(spark):
    names = ["gone_id", "label", "digest", "node", "keep_id", "component_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, g, s, 0, *["x"] * len(names)) for i, t, g, s in ROWS]
    for rows_in, left in ((rows, {None, 1, 5, 7, 9}), ([], set())):
        docs = spark.createDataFrame(rows_in, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, SF)
            assert docs.columns == before.columns, name
            docs = spark.createDataFrame(docs.collect(), schema)  # as reread
        assert {r.doc_id for r in docs.collect()} - {None, 8} == left - {None}
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert pieces.where("piece = 0").count() == docs.count()
