from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from eventloom.llm import decontam, langid, pieces, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        seen.append((name, docs.count(), out.count()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
            docs = out
    assert [n for n, _, _ in seen] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert all(b <= a for _, a, b in seen) and seen[-1][1] == seen[-1][2]
    assert seen[3][2] < seen[3][1] < seen[0][1]
    kept = docs.collect()
    index = decontam.Index.of([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert not any(decontam.leaks(index, r.text) for r in kept)
    assert all(r.n_chars == len(r.text) for r in kept)
    codec = pieces.Codec(pieces.Vocabulary.read())
    plain = {r.doc_id: codec.encode([r.text])[0].tolist() for r in kept}
    assert {r.doc_id: r.ids for r in out.collect()} == plain
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(plain)


def test_odd_documents(spark, tmp_path):
    rows = [(1, "the cat and the dog\n" * 3, "en", "s", 60, "x"), (1, "the cat and the dog\n" * 3, "en", "s", 60, "x"), (2, None, "en", "s", 0, "x"), (3, "", "de", None, None, "x"), (4, "123", None, "s", 3, "x"), (None, "the cat walks alone at night", None, "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.exact) for r in got), key=str) == [(1, True), (None, True)]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_every_document(spark, name):
    got = queries.QUERIES[name](spark, SF).collect()
    ids = [r.doc_id for r in got]
    if name == "op8_decontam":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
        assert {(r.doc_id, r.item_id) for r in got} >= {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    else:
        assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_line_sql_agrees(spark):
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = base.execute(queries.ORACLE_SQL["op5_lines"]).df()
    got = queries.QUERIES["op5_lines"](spark, SF).toPandas()[list(want.columns)]
    order = lambda d: d.sort_values("doc_id").reset_index(drop=True)
    assert order(got).equals(order(want).astype(got.dtypes.to_dict()))


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
