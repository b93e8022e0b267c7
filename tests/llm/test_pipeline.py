"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from tallybeam.llm import queries, secret_links
from tests.conftest import SF_DIR
from tests.llm.samples import frame, odd_rows, sentences
from tests.llm.test_dedup import expected_components


def test_stages(spark, tmp_path):
    docs = queries.documents(spark, SF_DIR).unionByName(frame(spark, [(9000 + k, t) for k, (_, t) in enumerate(odd_rows())]), allowMissingColumns=True)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "node")
    given = [tuple(r) for r in docs.collect()]
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF_DIR)
        if k < 4:
            assert result.columns == docs.columns
        result.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        results.append(docs.collect())
    language, exact, near, clean, packed = results
    kept = {r.doc_id for r in language}
    assert {r[0] for r in given} - kept == {r[0] for r in given if not re.search(r"[^\W\d_]", r[1] or "")}
    last = {}
    for r in language:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    expected = expected_components([(r.doc_id, r.text) for r in exact])
    assert sorted(r.doc_id for r in near) == sorted(k for k, _, component in expected if k == component)
    texts = {r.doc_id: r.text for r in near}
    assert sorted(texts) == sorted(r.doc_id for r in clean)
    for r in clean:
        spans = secret_links.base_spans(texts[r.doc_id])
        if not spans and not secret_links.linked_parts(texts[r.doc_id], spans):
            assert r.text == texts[r.doc_id]
        else:
            assert "[secret]" in r.text
    assert {r.doc_id for r in packed} == set(texts)


def test_empty(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []


def near(text, place):
    words = text.split()
    words[place] = "changed"
    return " ".join(words)


def test_near_copies_go_by_row(spark):
    """A shared or missing id never takes an unrelated row along, and never saves a near copy."""
    a, b, c = (sentences(k, 90) for k in (31, 32, 33))
    rows = [(1, a), (5, near(a, 40)), (5, sentences(34, 90)), (None, b), (None, near(b, 50)), (None, sentences(35, 90)), (7, c), (7, near(c, 3)), (8, None), (9, "")]
    docs = frame(spark, rows).withColumnsRenamed({"id": "gone", "g": "number", "node": "component"})
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == 7
    assert {(1, a), (5, rows[2][1]), (None, rows[5][1]), (8, None), (9, "")} <= set(found)
    assert sum(t in (b, near(b, 50)) for _, t in found) == 1
    assert sum(t in (c, near(c, 3)) for _, t in found) == 1


def test_stages_with_columns_of_any_type(spark):
    docs = frame(spark, [(1, "some words here"), (2, "some words here"), (3, None), (2, "some words here")])
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "map('k', doc_id) AS gone", "parse_json('{\"a\":1}') AS number", "array(map('x', 1)) AS best")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        result = stage(spark, docs, SF_DIR)
        assert result.columns == docs.columns
        assert result.selectExpr("doc_id", "gone['k'] AS k", "best[0]['x'] AS x").filter("k != doc_id OR x != 1").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF_DIR).select("doc_id").collect()) == [2, 3]
