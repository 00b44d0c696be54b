"""The two-pass vocabulary plan, and its document."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import cohort, statistics, tokens, vocabulary
from eventloom.sources.literal import literal, settled


@dataclass(frozen=True)
class Settings:
    mode: str = "joint"
    vocab_size: int = 98_304
    quantiles: int = 10
    reservoir_size: int = 1_000
    emit_quantiles: bool = True
    emit_text: bool = True
    emit_stage: bool = True
    remove_prefixes: bool = True
    separator: str = "/"
    by_unit: bool = False
    unit_aware: bool = False
    reservoir_mode: str = "first"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("joint", "factorized"):
            raise ValueError(f"mode is joint or factorized, not {self.mode!r}")
        if self.reservoir_mode not in statistics.MODES:
            raise ValueError(f"reservoir_mode is one of {', '.join(statistics.MODES)}, not {self.reservoir_mode!r}")
        if self.vocab_size < 1 or self.quantiles < 1 or self.reservoir_size < 1:
            raise ValueError("vocab_size, quantiles and reservoir_size are at least 1")


@dataclass
class Trained:
    """vocabulary: entries with token_id; age_stats: (mean, std); breaks: (key, breaks) or None; stages: (stage) or None."""

    settings: Settings
    vocabulary: DataFrame
    age_stats: DataFrame
    breaks: DataFrame | None
    stages: DataFrame | None


def reservoirs(events: DataFrame, settings: Settings) -> DataFrame:
    return statistics.reservoir(events, settings.reservoir_size, settings.by_unit, settings.reservoir_mode, settings.seed)


def scan(events: DataFrame, settings: Settings) -> tuple[DataFrame | None, DataFrame | None]:
    """The first pass: breaks and stages of a cohort. Without quantile tokens there is no such pass, and a joint vocabulary
    then knows no stages, so that all of them pass."""
    breaks = stages = None
    if settings.emit_quantiles:
        breaks = statistics.quantile_breaks(reservoirs(events, settings), settings.quantiles)
    if settings.emit_stage and (settings.emit_quantiles or settings.mode == "factorized"):
        stages = statistics.stages(events)
    return breaks, stages


def parts(events: DataFrame, breaks: DataFrame | None, stages: DataFrame | None, settings: Settings) -> DataFrame:
    return tokens.with_parts(events, breaks, stages, settings.mode == "joint", settings.separator, settings.remove_prefixes, settings.emit_text, settings.emit_stage, settings.unit_aware)


def train(events: DataFrame, samples: DataFrame) -> DataFrame:
    """The weighted cohort of all samples; dropped ones still count in each sample's weight."""
    n = samples.agg(F.count(F.lit(1)).alias("n_samples"))
    own = cohort.cohort(events, samples).join(F.broadcast(n))
    return own.withColumn("weight", 1.0 / (F.col("n_samples").cast("double") * F.col("n_events"))).drop("n_samples")


def build(events: DataFrame, samples: DataFrame, settings: Settings = Settings()) -> Trained:
    """The training plan; nothing runs before a part of it is used."""
    return _from_cohort(train(events, samples), settings)


def _from_cohort(own: DataFrame, settings: Settings) -> Trained:
    breaks, stages = scan(own, settings)
    ages = statistics.age_moments(own)
    if settings.mode == "joint":
        # Every stage of the cohort is known to it, so stages need no look-up here.
        named = parts(own, breaks, None, settings).withColumn("token", tokens.joint(settings.separator))
        entries = vocabulary.joint_vocabulary(named, settings.vocab_size)
    else:
        base = tokens.base_code(F.col("code"), settings.separator, settings.remove_prefixes)
        entries = vocabulary.factorized_vocabulary(own, base, stages, settings.vocab_size, settings.quantiles if settings.emit_quantiles else None, settings.emit_text)
    return Trained(settings, entries, ages, breaks, stages)


def fit(events: DataFrame, samples: DataFrame, settings: Settings = Settings()) -> Trained:
    """A trained vocabulary, computed now: its passes share one persisted cohort, and its tables - at most vocab_size entries, a
    break list a numeric code, the stage labels, one row of moments - become literal ones, as if read from a document."""
    own = train(events, samples).persist()
    try:
        made = _from_cohort(own, settings)
        breaks = settled(made.breaks) if made.breaks is not None else None
        stages = settled(made.stages) if made.stages is not None else None
        if settings.mode == "joint":
            named = parts(own, breaks, None, settings).withColumn("token", tokens.joint(settings.separator))
            made.vocabulary = vocabulary.joint_vocabulary(named, settings.vocab_size)
        return Trained(settings, settled(made.vocabulary), settled(made.age_stats), breaks, stages)
    finally:
        own.unpersist()


def document(trained: Trained) -> dict[str, Any]:
    """The vocabulary document; every part is bounded by the vocabulary's size or the label sets."""
    s = trained.settings
    keep = ("type", "token", "code_string", "text_string", "unit", "val_start", "val_end", "weight")
    rows = trained.vocabulary.orderBy("token_id").collect()
    entries = []
    for r in rows:
        own = {k: r[k] for k in keep if k in r.asDict() and r[k] is not None}
        own["label"] = own.pop("token", None)
        if own["type"] == "code" and own["label"] is not None:
            own.setdefault("code_string", own["label"])
        entries.append({k: v for k, v in own.items() if v is not None})
    stats = trained.age_stats.first()
    return {
        "vocab": entries,
        "age_stats": {"mean": stats["mean"], "std": stats["std"]},
        "config": {
            "tokenization_mode": s.mode,
            "emit_quantiles": s.emit_quantiles,
            "emit_text": s.emit_text,
            "emit_stage": s.emit_stage,
            "num_quantiles": s.quantiles,
            "remove_prefixes": s.remove_prefixes,
            "separator": s.separator,
        },
        "quantile_breaks": {r.key: list(r.breaks) for r in trained.breaks.collect()} if trained.breaks is not None else {},
        "discovered_stages": sorted(r.stage for r in trained.stages.collect()) if trained.stages is not None else [],
    }


def load(spark: SparkSession, doc: dict[str, Any]) -> Trained:
    """The tables of a vocabulary document; one without a config counts as joint with the usual settings."""
    c = doc.get("config") or {}
    settings = Settings(
        mode=c.get("tokenization_mode", "joint"),
        vocab_size=max(1, len(doc["vocab"])),
        quantiles=c.get("num_quantiles", 10),
        emit_quantiles=c.get("emit_quantiles", True),
        emit_text=c.get("emit_text", True),
        emit_stage=c.get("emit_stage", True),
        remove_prefixes=c.get("remove_prefixes", True),
        separator=c.get("separator", "/"),
    )
    rows = [(i, e["type"], e.get("code_string") if e["type"] == "code" else e.get("label"), e.get("weight")) for i, e in enumerate(doc["vocab"])]
    entries = literal(spark, rows, "token_id int, type string, token string, weight double")
    ages = literal(spark, [(float(doc["age_stats"]["mean"]), float(doc["age_stats"]["std"]))], "mean double, std double")
    breaks = literal(spark, [(k, [float(x) for x in v]) for k, v in (doc.get("quantile_breaks") or {}).items()], "key string, breaks array<double>")
    stages = literal(spark, [(s,) for s in doc.get("discovered_stages") or []], "stage string")
    return Trained(settings, entries, ages, breaks if settings.emit_quantiles else None, stages)


def key_column(trained: Trained) -> Column:
    return tokens.joint(trained.settings.separator)
