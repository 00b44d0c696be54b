from __future__ import annotations

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from eventloom import schema
from eventloom.operators import embedding
from eventloom.operators.order import numbered
from eventloom.sources import events as files
from eventloom.streaming import stream_tables, windowed_counts

T0 = datetime.datetime(2000, 1, 1)


def test_read_events(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, "B"), (1, T0, "A")], "subject_id bigint, time timestamp_ntz, code string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/data")
    got = files.read_events(spark, str(tmp_path)).orderBy("event_ord").collect()
    assert [r.code for r in got] == ["B", "A"] and got[0].numeric_value is None
    with pytest.raises(ValueError):
        files.read_events(spark, f"{tmp_path}/nowhere")
    rows.select("subject_id").write.parquet(f"{tmp_path}/bad")
    good, skipped = files.read_shards(spark, [f"{tmp_path}/data", f"{tmp_path}/bad"])
    assert len(good) == 1 and skipped == [f"{tmp_path}/bad"]
    with pytest.raises(ValueError):
        schema.complete(rows.select("code"))
    assert not files.is_reader_format(spark, str(tmp_path))
    nanos = rows.withColumn("time", F.lit(946_684_800_000_000_123))
    nanos.write.parquet(f"{tmp_path}/nanos")
    assert files.read_events(spark, f"{tmp_path}/nanos").first().time == T0
    files.write_events(files.read_events(spark, str(tmp_path)).drop("event_ord"), f"{tmp_path}/out")
    assert files.verify_copy(spark.read.parquet(f"{tmp_path}/out").select("subject_id", "time", "code"), rows)
    assert not files.verify_copy(rows, rows.limit(1))


def test_datasets_and_metadata(spark, tmp_path):
    spark.createDataFrame([(1, T0, "A")], "subject_id bigint, time timestamp_ntz, code string").write.parquet(f"{tmp_path}/d/data")
    spark.createDataFrame([(1, T0, "x"), (2, T0, "y")], "id int, index_t timestamp_ntz, split string").write.parquet(f"{tmp_path}/d/metadata/s.parquet")
    config = {"dataset_path": f"{tmp_path}/d", "samples_path": f"{tmp_path}/d/metadata/s.parquet", "split": "x"}
    _, own = files.open_dataset(spark, config)
    assert [(r.subject_id, r.split) for r in own.collect()] == [(1, "x")] and "dataset_path" in config
    with pytest.raises(ValueError):
        files.open_dataset(spark, {"dataset_path": "x"})
    assert files.copy_metadata(spark, f"{tmp_path}/d", f"{tmp_path}/e") and not files.copy_metadata(spark, f"{tmp_path}/none", f"{tmp_path}/f")


def test_documents(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert files.write_document(spark, {"x": math.inf}, path) and not files.write_document(spark, {"x": 1}, path)
    assert files.read_document(spark, path) == {"x": math.inf}
    assert files.write_document(spark, {"x": 1}, path, overwrite=True) and files.read_document(spark, path) == {"x": 1}
    with pytest.raises(TypeError):
        files.write_document(spark, {"x": object()}, f"{tmp_path}/c.json")
    assert not (tmp_path / "c.json").exists()
    with pytest.raises(ValueError):
        files.read_document(spark, "x.txt")


def test_sinks(spark, tmp_path):
    seq = spark.createDataFrame([(i, [1, 2]) for i in range(10)], "sample_id bigint, token_ids array<int>").coalesce(1)
    files.write_tokens(seq, f"{tmp_path}/t", 4)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 10 and len(list((tmp_path / "t").glob("*.parquet"))) == 3
    rep = spark.createDataFrame([(7, T0 + datetime.timedelta(milliseconds=900), [0.5])], "subject_id bigint, index_t timestamp_ntz, representation array<double>")
    files.write_representations(rep, f"{tmp_path}/r")
    r = spark.read.parquet(f"{tmp_path}/r").first()
    assert r.id == "7" and r.representations == [0.5]


def test_set_hash_and_numbering(spark, tmp_path):
    texts = spark.createDataFrame([(t,) for t in ("cherry", "apple", "", "é", "Z")], "embedding_text string").repartition(3)
    want = hashlib.sha256(b"".join(t.encode() + b"\0" for t in sorted(["cherry", "apple", "", "é", "Z"]))).hexdigest()
    assert embedding.string_set_hash(texts) == want
    ids = embedding.text_ids(texts)
    assert [r.embedding_text for r in ids.orderBy("embedding_text_id").collect()] == sorted(["cherry", "apple", "", "é", "Z"])
    table = embedding.encode_texts(ids, embedding.hash_encoder(3))
    embedding.write_lookup(table, f"{tmp_path}/lookup", model_name="hash")
    assert want in spark.read.text(f"{tmp_path}/lookup/metadata").first().value
    many = numbered(spark.range(5000).repartition(7), [F.col("id")], "n")
    assert many.where("id != n").count() == 0 and many.count() == 5000


def test_partition_counts_do_not_matter(spark):
    from eventloom import catalog

    usual = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, catalog.QUERIES["sequence_with_intervals"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert seen[0] == seen[1]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + datetime.timedelta(hours=h), "A", 1.0) for h in (1, 2, 30, 80)], "time timestamp_ntz, code string, numeric_value double")
    rows.write.parquet(f"{tmp_path}/in")
    out = windowed_counts(stream_tables(spark, f"{tmp_path}/in", rows.schema))
    run = out.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.n for r in spark.sql("select * from counted").collect()) == [1, 1, 2]
    assert sorted(r.n for r in windowed_counts(rows).collect()) == [1, 1, 2]
