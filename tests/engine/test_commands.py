"""The jobs end to end, from shards on disk to batches and representations."""

from __future__ import annotations

import argparse

import pytest
from pyspark.sql import functions as F

from eventloom import commands
from eventloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("meds"))
    tables.events(spark, SF).drop("event_ord").repartition(3, "subject_id").sortWithinPartitions("subject_id", "time").write.parquet(f"{d}/data")
    tables.samples(spark, SF).write.parquet(f"{d}/metadata/samples.parquet")
    return d


def test_from_events_to_representations(spark, dataset, tmp_path):
    own = {"dataset_path": dataset, "samples_path": f"{dataset}/metadata/samples.parquet"}
    made = commands.train_vocabulary(spark, **own, output_path=f"{tmp_path}/v", mode="factorized", vocab_size=100, quantiles=4, intervals=True, demographics=True)
    assert made["written"] and made["num_ntp_classes"] <= made["entries"]
    assert not commands.train_vocabulary(spark, **own, output_path=f"{tmp_path}/v", split="train", vocab_size=9)["written"]
    # Static tokens are within the vocabulary's own length, so they push out all others here; a joint one has room.
    joint = commands.train_vocabulary(spark, **own, output_path=f"{tmp_path}/j", vocab_size=300, quantiles=4, intervals=True)
    assert joint["entries"] > 50
    some = {"vocab_size": 300, "quantiles": 4, "reservoir_size": 5, "reservoir_mode": "uniform", "demographics": True, "save_reservoirs": True}
    commands.train_vocabulary(spark, **own, output_path=f"{tmp_path}/u", **some, seed=1)
    held = spark.read.parquet(f"{tmp_path}/u/reservoirs").groupBy("key").count().collect()
    assert held and all(r["count"] <= 5 for r in held)
    sexes = []
    for k, codes in enumerate(({}, {"male_codes": "8532", "female_codes": "8507"})):
        commands.pretokenize(spark, **own, vocab_path=f"{tmp_path}/u/vocab.json", output_path=f"{tmp_path}/s{k}", demographics=True, **codes)
        sexes.append({r.sample_id: r.token_ids[0] for r in spark.read.parquet(f"{tmp_path}/s{k}").collect()})
    assert sexes[1] == {s: {0: 1, 1: 0, 2: 2}[i] for s, i in sexes[0].items()} and len(set(sexes[0].values())) > 1
    counts = commands.pretokenize(spark, **own, vocab_path=f"{tmp_path}/j/vocab.json", output_path=f"{tmp_path}/t", intervals=True, max_interval_repeat=2)
    assert counts["kept"] == 28 <= counts["samples"]
    rows = spark.read.parquet(f"{tmp_path}/t").where("length > 0")
    assert rows.where("size(token_ids) != length or size(age) != length or size(age_normalized) != length").count() == 0
    assert rows.where("exists(sequence(1, length - 1), i -> length > 1 and i < length and i >= 1 and get(age, i) < get(age, i - 1))").count() == 0
    n = commands.make_batches(spark, f"{tmp_path}/t", f"{tmp_path}/b", max_length=32, stride=20, budget=128, min_patients=2, drop=0.1, shards=2)
    assert n == spark.read.parquet(f"{tmp_path}/b").count() > 1
    plain = f"{tmp_path}/plain.parquet"  # samples as they are usually given: id, index_t, split
    spark.read.parquet(own["samples_path"]).select("id", "index_t", "split").write.parquet(plain)
    commands.pretokenize(spark, **own | {"samples_path": plain}, vocab_path=f"{tmp_path}/j/vocab.json", output_path=f"{tmp_path}/tp", intervals=True)
    assert commands.make_batches(spark, f"{tmp_path}/tp", f"{tmp_path}/bp", max_length=32, budget=128) > 1
    commands.compute_representations(spark, f"{tmp_path}/t", f"{tmp_path}/r", lambda ids, ages: [[[float(i), a] for i, a in zip(x, y, strict=True)] for x, y in zip(ids, ages, strict=True)], 32)
    commands.make_batches(spark, f"{tmp_path}/t", f"{tmp_path}/bq", max_length=32, budget=128, shards=1, positions=True)
    lengths = spark.read.parquet(f"{tmp_path}/bq").first()
    assert lengths.ages == [float(i) for n in lengths.patient_lengths for i in range(n)] and not any(lengths.normalized_ages)
    commands.compute_representations(spark, f"{tmp_path}/t", f"{tmp_path}/rq", lambda ids, ages: [[[a] for a in y] for y in ages], 32, positions=True)
    assert {float(min(r.length, 32) - 1) for r in rows.collect()} == {r.representations[0] for r in spark.read.parquet(f"{tmp_path}/rq").collect()}
    last = {(r.id, str(r.index_t)[:19]): r.representations for r in spark.read.parquet(f"{tmp_path}/r").collect()}
    for r in rows.collect():
        assert last[str(r.subject_id), str(r.index_t)[:19]][0] == r.token_ids[-1]


def test_embedding_jobs(spark, dataset, tmp_path):
    own = {"dataset_path": dataset, "samples_path": f"{dataset}/metadata/samples.parquet"}
    commands.train_vocabulary(spark, **own, output_path=f"{tmp_path}/v", vocab_size=300, quantiles=4)
    about = commands.build_embedding_lookup(spark, dataset, f"{tmp_path}/l", dim=8, model_name="digest")
    assert about["n_embeddings"] == 45 and about["dtype"] == "float16" and len(about["string_set_hash"]) == 64
    counts = commands.pretokenize_embedding(spark, **own, vocab_path=f"{tmp_path}/v/vocab.json", lookup_path=f"{tmp_path}/l", output_path=f"{tmp_path}/e")
    assert 0 < counts["kept"] <= counts["samples"]
    r = spark.read.parquet(f"{tmp_path}/e").first()
    assert len(r.embedding_text_ids) == len(r.token_ids) == len(r.numeric_features) == len(r.age) == r.length


def test_transforms(spark, tmp_path):
    own = tables.visits(spark, SF)
    own.repartition(2, "visit_id").write.parquet(f"{tmp_path}/in/data")
    spark.range(1).write.parquet(f"{tmp_path}/in/metadata/codes.parquet")
    whole = commands.apply_transforms(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    apart = commands.apply_transforms(spark, f"{tmp_path}/in", f"{tmp_path}/out2", per_file=True)
    assert whole == apart and whole["moved"] > 0
    other = own.withColumn("code", F.regexp_replace("code", "^VISIT/", "STAY/")).withColumn("workflow_stage", F.regexp_replace(F.lower("workflow_stage"), "^(start|end)$", "$1ed"))
    other.repartition(2, "visit_id").write.parquet(f"{tmp_path}/other/data")
    assert commands.apply_transforms(spark, f"{tmp_path}/other", f"{tmp_path}/out4")["moved"] == 0
    assert commands.apply_transforms(spark, f"{tmp_path}/other", f"{tmp_path}/out5", visit_pattern="STAY", start_stage="Started", end_stage="ENDED")["moved"] == whole["moved"]
    assert spark.read.parquet(f"{tmp_path}/out/data").count() == own.count() == whole["events"]
    assert spark.read.parquet(f"{tmp_path}/out/metadata/codes.parquet").count() == 1
    own.withColumn("visit_id", F.col("visit_id")).repartition(4, "code").write.parquet(f"{tmp_path}/split/data")
    assert commands.apply_transforms(spark, f"{tmp_path}/split", f"{tmp_path}/out3", per_file=True)["moved"] <= whole["moved"]


def test_options():
    assert commands.options(["--vocab-size", "5", "--mode", "joint", "--intervals", "yes", "--split", "a"]) == {"vocab_size": 5, "mode": "joint", "intervals": True, "split": "a"}
    with pytest.raises(argparse.ArgumentTypeError):
        commands.options(["--x"])
    assert commands.to_bool("Yes") and not commands.to_bool("f")
    with pytest.raises(argparse.ArgumentTypeError):
        commands.to_bool("maybe")
