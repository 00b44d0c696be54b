"""The whole jobs, as functions and on the command line: python -m eventloom.commands JOB --option value ..."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventloom import session
from eventloom.constants import END_STAGE, FEMALE_CODES, MALE_CODES, MOVED_PREFIXES, START_STAGE, UNKNOWN_CODES, VISIT_PATTERN
from eventloom.operators import batching, embedding, statistics, visits, vocabulary, windows
from eventloom.plans import pretokenize as plans
from eventloom.plans import training
from eventloom.sources import events as files
from eventloom.sources.literal import literal


def apply_transforms(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    prefixes: tuple[str, ...] = MOVED_PREFIXES,
    check_description: bool = True,
    per_file: bool = False,
    visit_pattern: str = VISIT_PATTERN,
    start_stage: str = START_STAGE,
    end_stage: str = END_STAGE,
) -> dict[str, int]:
    """Moves events to their visits' ends and writes them with the metadata; visits are paired over all files, or within each."""
    own = files.read_events(spark, input_dir).withColumn("_file", F.col("event_ord.file"))
    moved = visits.move_to_visit_end(own, tuple(prefixes), check_description, by=("_file",) if per_file else (), flag=True, pattern=visit_pattern, start=start_stage, end=end_stage)
    files.write_events(moved.drop("_file", "moved"), f"{output_dir}/data")
    files.copy_metadata(spark, input_dir, output_dir)
    row = moved.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("moved").cast("int")).alias("m")).first()
    return {"events": row.n, "moved": row.m or 0}


def train_vocabulary(
    spark: SparkSession,
    dataset_path: str,
    samples_path: str,
    output_path: str,
    split: str | None = None,
    intervals: bool = False,
    demographics: bool = False,
    overwrite: bool = False,
    save_reservoirs: bool = False,
    **settings: Any,
) -> dict[str, Any]:
    """Trains a vocabulary and writes output_path/vocab.json; static tokens go in front, within the vocabulary's size.

    save_reservoirs also writes output_path/reservoirs, a Parquet table (key, numeric_value) of the values behind the breaks."""
    own, samples = files.open_dataset(spark, {"dataset_path": dataset_path, "samples_path": samples_path, "split": split})
    options = training.Settings(**settings)
    trained = training.fit(own, samples, options)
    classes = trained.vocabulary.first().num_ntp_classes if "num_ntp_classes" in trained.vocabulary.columns else trained.vocabulary.count()
    if demographics:
        trained.vocabulary = vocabulary.with_demographics(trained.vocabulary)
    if intervals:
        trained.vocabulary = vocabulary.with_intervals(trained.vocabulary)
    doc = training.document(trained)
    doc["config"]["num_ntp_classes"] = classes
    written = files.write_document(spark, doc, f"{output_path}/vocab.json", overwrite)
    if save_reservoirs and written and options.emit_quantiles:
        training.reservoirs(training.train(own, samples), options).write.mode("overwrite").parquet(f"{output_path}/reservoirs")
    return {"entries": len(doc["vocab"]), "num_ntp_classes": classes, "written": written}


def _with_overrides(spark: SparkSession, trained: training.Trained, quantile_breaks_path: str | None) -> training.Trained:
    if quantile_breaks_path and trained.breaks is not None:
        given = files.read_document(spark, quantile_breaks_path)
        new = literal(spark, [(k, [float(x) for x in v]) for k, v in given.items()], "key string, breaks array<double>")
        trained.breaks = statistics.override_breaks(trained.breaks, new)
    return trained


def pretokenize(spark: SparkSession, dataset_path: str, samples_path: str, vocab_path: str, output_path: str, split: str | None = None, quantile_breaks_path: str | None = None, rows_a_file: int = 32_768, male_codes: str | None = None, female_codes: str | None = None, unknown_codes: str | None = None, **options: Any) -> dict[str, int]:
    """Writes token sequences; returns how many were kept and skipped, by reason. Sex codes come as text, parted by commas."""
    own, samples = files.open_dataset(spark, {"dataset_path": dataset_path, "samples_path": samples_path, "split": split})
    trained = _with_overrides(spark, training.load(spark, files.read_document(spark, vocab_path)), quantile_breaks_path)
    codes = tuple(tuple(str(given).split(",")) if given else usual for given, usual in ((male_codes, MALE_CODES), (female_codes, FEMALE_CODES), (unknown_codes, UNKNOWN_CODES)))
    out, skipped = plans.sequences(own, samples, trained, sex_codes=codes, **options)
    files.write_tokens(out, output_path, rows_a_file)
    counts = {"kept": spark.read.parquet(output_path).count(), "samples": samples.count()}
    if skipped is not None:
        counts |= {r.skip_reason: r["count"] for r in skipped.where("skip_reason is not null").groupBy("skip_reason").count().collect()}
    return counts


def build_embedding_lookup(spark: SparkSession, dataset_path: str, output_path: str, encode: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64, half: bool = True, **metadata: Any) -> dict[str, Any]:
    """Writes the table of all distinct embedding texts; any encoder of lists of texts will do, by default vectors drawn from digests."""
    texts = embedding.text_ids(embedding.unique_texts(files.read_events(spark, dataset_path)))
    table = embedding.encode_texts(texts, encode or embedding.hash_encoder(dim), half)
    embedding.write_lookup(table, output_path, dtype="float16" if half else "float32", **metadata)
    return json.loads(spark.read.text(f"{output_path}/metadata").first().value)


def pretokenize_embedding(spark: SparkSession, dataset_path: str, samples_path: str, vocab_path: str, lookup_path: str, output_path: str, split: str | None = None, cutoff: int | None = None) -> dict[str, int]:
    """Writes the embedding branch's sequences."""
    own, samples = files.open_dataset(spark, {"dataset_path": dataset_path, "samples_path": samples_path, "split": split})
    trained = training.load(spark, files.read_document(spark, vocab_path))
    texts = spark.read.parquet(f"{lookup_path}/table").select("embedding_text", "embedding_text_id")
    files.write_tokens(embedding.assembled(plans.embedding_rows(own, samples, trained, texts, cutoff)), output_path)
    return {"kept": spark.read.parquet(output_path).count(), "samples": samples.count()}


def make_batches(spark: SparkSession, tokens_path: str, output_path: str, max_length: int, budget: int = 16_384, min_patients: int = 1, stride: int | None = None, one_window: bool = False, min_length: int = 0, drop: float = 0.0, classes: int | None = None, seed: int = 0, shards: int | None = None, positions: bool = False) -> int:
    """Windows, drops, labels, packs and collates a token table; returns the number of batches. Shards follow the number of windows
    unless given; positions=True puts places for ages."""
    own = windows.windows(spark.read.parquet(tokens_path), max_length, stride, one_window, min_length)
    own = windows.dropout(own, drop, seed) if drop else own
    own = windows.positions(own) if positions else own
    own = own.withColumn("labels", windows.labels(F.col("token_ids"), classes))
    batching.collated(batching.packed(own, budget, min_patients, seed, shards), own).write.parquet(output_path)
    return spark.read.parquet(output_path).count()


def compute_representations(spark: SparkSession, tokens_path: str, output_path: str, encode: Callable[[list[list[int]], list[list[float]]], list[list[list[float]]]], max_length: int, positions: bool = False) -> None:
    """Each sequence's last window through a model, given as a function of token and age lists that returns a vector a token;
    the vector of the last token is written. Sequences without tokens have none. positions=True gives the model places for ages."""
    own = windows.windows(spark.read.parquet(tokens_path), max_length, one=True)
    own = windows.positions(own) if positions else own

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        for f in frames:
            out = encode([list(x) for x in f["token_ids"]], [list(x) for x in f["age"]]) if len(f) else []
            yield f[["subject_id", "index_t"]].assign(representation=[list(map(float, v[-1])) for v in out])

    made = own.select("subject_id", "index_t", "token_ids", "age").mapInPandas(run, "subject_id bigint, index_t timestamp_ntz, representation array<float>")
    files.write_representations(made, output_path)


def to_bool(text: str) -> bool:
    """yes/no in the usual spellings."""
    plain = text.strip().lower()
    if plain in ("1", "true", "t", "yes", "y"):
        return True
    if plain in ("0", "false", "f", "no", "n"):
        return False
    raise argparse.ArgumentTypeError(f"{text!r} is neither yes nor no")


JOBS: dict[str, Callable[..., Any]] = {f.__name__: f for f in (apply_transforms, train_vocabulary, pretokenize, build_embedding_lookup, pretokenize_embedding, make_batches)}


def options(words: list[str]) -> dict[str, Any]:
    """--name value pairs; values are JSON where they parse as such, yes/no words for flags, text otherwise."""
    if len(words) % 2 or any(not w.startswith("--") for w in words[::2]):
        raise argparse.ArgumentTypeError("options come as --name value")
    out: dict[str, Any] = {}
    for name, value in zip(words[::2], words[1::2], strict=True):
        try:
            out[name[2:].replace("-", "_")] = json.loads(value)
        except ValueError:
            out[name[2:].replace("-", "_")] = to_bool(value) if value.lower() in ("yes", "no") else value
    return out


def main(argv: list[str] | None = None) -> Any:
    parser = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    own, rest = parser.parse_known_args(argv)
    result = JOBS[own.job](session.build(), **options(rest))
    print(json.dumps(result))
    return result




if __name__ == "__main__":
    main()
