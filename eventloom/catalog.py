"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import oracle as o
from eventloom import schema
from eventloom.constants import FEMALE_CODES, HALF_YEAR, MALE_CODES, demographic_labels, interval_labels, quantile_labels
from eventloom.functions import text, values
from eventloom.operators import batching, cohort, embedding, model, sequence, statistics, tokens, visits, vocabulary, windows
from eventloom.operators.order import numbered
from eventloom.plans import pretokenize, training
from eventloom.sources import events as files
from eventloom.sources import tables
from eventloom.streaming import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

JOINT = training.Settings(mode="joint", vocab_size=o.JOINT_SIZE, quantiles=o.QUANTILES, reservoir_size=o.RESERVOIR)
FACTORIZED = training.Settings(mode="factorized", vocab_size=o.FACTORIZED_SIZE, quantiles=o.QUANTILES, reservoir_size=o.RESERVOIR)


def query(sql: str | None, recursive: bool = False, whole: bool = False) -> Callable[[Query], Query]:
    """Registers a query and its final select over the shared expressions (whole: SQL of its own)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if whole else o.sql(sql, recursive)
        return f

    return register


def _samples(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    return files.read_samples(tables.samples(spark, d), split)


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return training.train(tables.events(spark, d), _samples(spark, d))


def _trained(spark: SparkSession, d: str, settings: training.Settings) -> training.Trained:
    return training.build(tables.events(spark, d), _samples(spark, d), settings)


def _fitted(spark: SparkSession, d: str, settings: training.Settings) -> training.Trained:
    return training.fit(tables.events(spark, d), _samples(spark, d), settings)


def _prepended(spark: SparkSession, d: str) -> training.Trained:
    own = _fitted(spark, d, JOINT)
    own.vocabulary = vocabulary.with_intervals(vocabulary.with_demographics(own.vocabulary, o.JOINT_SIZE + 40), o.JOINT_SIZE + 40)
    return own


def _parts(spark: SparkSession, d: str, settings: training.Settings) -> DataFrame:
    own = _cohort(spark, d)
    return training.parts(own, *training.scan(own, settings), settings)


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return pretokenize.sequences(tables.events(spark, d), _samples(spark, d), _fitted(spark, d, FACTORIZED))[0]


def _windows(spark: SparkSession, d: str, **more) -> DataFrame:
    return windows.windows(_sequences(spark, d), o.WINDOW, o.STRIDE, **more)


def _long(df: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """One row an element of parallel arrays, floats as doubles."""
    each = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "x"))
    kinds = {a: df.schema[a].dataType.elementType.simpleString() for a in arrays}
    return each.select(*keys, "pos", *(F.col(f"x.{a}").cast("double" if kinds[a] == "float" else kinds[a]).alias(a) for a in arrays))


# Scans, projections, filters


@query("select subject_id, time, code, description, numeric_value, text_value, unit, workflow_stage, ref_low, ref_high, embedding_text, event_ord from ev")
def meds_events(spark, d):
    return tables.events(spark, d)


@query("select unnest(['description', 'numeric_value', 'text_value', 'unit', 'visit_id', 'workflow_stage', 'ref_low', 'ref_high', 'embedding_text']) as missing")
def meds_schema_guard(spark, d):
    own = tables.table(spark, d, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").alias("time"), F.col("event_type").alias("code"))
    assert set(schema.OPTIONAL) <= set(schema.complete(own).columns)
    return spark.createDataFrame([(c,) for c in schema.missing(own)], "missing string")


@query("select sample_id, id as subject_id, index_t, split from sm where split = 'train'")
def samples_split(spark, d):
    return _samples(spark, d, "train")


_VISITS = """with li as (select l.*, o.o_orderkey, o.o_custkey, o.o_orderdate, p.p_type, p.p_brand from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey),
v as (
  select o_custkey as subject_id, o_orderkey as visit_id, o_orderdate as time, 'VISIT/IP' as code, 'START' as workflow_stage, null as description, null::double as numeric_value from orders
  union all select o_custkey, o_orderkey, max(l_shipdate), 'VISIT/IP', 'End', null, null from li group by 1, 2
  union all select o_custkey, o_orderkey, o_orderdate, 'DIAGNOSIS/' || p_type, l_linestatus, null, null from li
  union all select o_custkey, o_orderkey, o_orderdate, 'NOTE/' || l_returnflag, l_linestatus, 'PROCEDURE/' || p_brand, null from li
  union all select o_custkey, o_orderkey, l_shipdate, 'LAB/' || l_returnflag, l_linestatus, null, l_quantity from li
),
vt as (select * from (select visit_id, min(case when lower(workflow_stage) = 'start' then time end) as visit_start, max(case when lower(workflow_stage) = 'end' then time end) as visit_end from v where regexp_matches(code, 'VISIT') and visit_id is not null group by 1) where visit_start is not null and visit_end is not null),
mv as (
  select v.*, coalesce(starts_with(code, 'DIAGNOSIS/') or starts_with(code, 'PROCEDURE/') or starts_with(code, 'OBSERVATION/') or coalesce(starts_with(description, 'DIAGNOSIS/') or starts_with(description, 'PROCEDURE/') or starts_with(description, 'OBSERVATION/'), false), false)
    and coalesce(time = visit_start, false) as hit, visit_end from v left join vt using (visit_id)
)
"""
@query(_VISITS + "select visit_id, visit_start, visit_end from vt", whole=True)
def visit_times(spark, d):
    return visits.visit_times(tables.visits(spark, d))


@query(_VISITS + "select subject_id, visit_id, case when hit then visit_end else time end as time, code, workflow_stage, description, numeric_value from mv", whole=True)
def visit_end_move(spark, d):
    return visits.transform_chain(tables.visits(spark, d), [visits.move_to_visit_end])


@query(_VISITS + "select split_part(code, '/', 1) as kind, count(*) as n, count(*) filter (hit and visit_end <> time) as moved from mv group by 1", whole=True)
def visit_move_counts(spark, d):
    own = visits.move_to_visit_end(tables.visits(spark, d), flag=True)
    return own.groupBy(F.substring_index("code", "/", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("moved").cast("bigint")).alias("moved"))


@query("select sample_id, ord, time, code, event_ord, n_events from co")
def cohort_events(spark, d):
    return cohort.cohort(tables.events(spark, d), _samples(spark, d)).select("sample_id", "ord", "time", "code", "event_ord", "n_events")


@query(f"select sample_id, ord, code, birth_t from co where n_events - ord <= {o.LAST_K}")
def cohort_last_k(spark, d):
    return cohort.last_events(cohort.cohort(tables.events(spark, d), _samples(spark, d)), o.LAST_K).select("sample_id", "ord", "code", "birth_t")


@query("select sample_id, subject_id, index_t, time, code, birth_t from co where ord = 0")
def birth_pinned_sequence(spark, d):
    return cohort.cohort(tables.events(spark, d), _samples(spark, d)).where("ord = 0").select("sample_id", "subject_id", "index_t", "time", "code", "birth_t")


# Scalar functions


@query("select distinct code, case when split_part(code, '/', 2) <> '' then split_part(code, '/', 2) else code end as base, case when split_part(code, '_', 2) <> '' then split_part(code, '_', 2) else code end as by_underscore, code as kept from ev")
def base_code(spark, d):
    c = F.col("code")
    return tables.events(spark, d).select("code").distinct().select("code", text.base_code(c).alias("base"), text.base_code(c, "_").alias("by_underscore"), text.base_code(c, "/", False).alias("kept"))


@query(f"select doc_id, length(n) as chars, md5(n) as digest from (select doc_id, {o.norm('text')} as n from documents)")
def normalize_text(spark, d):
    own = tables.table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    return own.select("doc_id", F.char_length("n").cast("bigint").alias("chars"), F.md5(F.col("n").cast("binary")).alias("digest"))


@query(f"select text_value, 'TXT:' || {o.norm('text_value')} as token, count(*) as n from ev where text_value is not null group by all")
def text_tokens(spark, d):
    return tables.events(spark, d).where("text_value is not null").groupBy("text_value", text.text_token(F.col("text_value")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select event_ord, round(x[1], 9) as x, x[2] as by_range, x[3] as by_log, x[4] as present from (select event_ord, {o.FEATURES} as x from ev where event_ord >= 0)")
def numeric_features(spark, d):
    own = tables.events(spark, d).where("event_ord >= 0").select("event_ord", values.numeric_features(F.col("numeric_value"), F.col("ref_low"), F.col("ref_high")).alias("f"))
    parts = {n: F.get("f", F.lit(i)) for i, n in enumerate(("x", "by_range", "by_log", "present"))}
    return own.select("event_ord", F.round(parts.pop("x"), 9).alias("x"), *(c.alias(n) for n, c in parts.items()))


# Statistics


@query("select key, v as numeric_value from rs")
def reservoir_first(spark, d):
    return statistics.reservoir(_cohort(spark, d), o.RESERVOIR)


@query("select key, unnest(range(1, len(b) + 1)) as place, unnest(b) as value from bk")
def quantile_breaks(spark, d):
    own = statistics.quantile_breaks(statistics.reservoir(_cohort(spark, d), o.RESERVOIR), o.QUANTILES)
    return own.select("key", F.posexplode("breaks").alias("place", "value")).withColumn("place", (F.col("place") + 1).cast("bigint"))


@query(
    f"""select key, unnest(range(1, len(b) + 1)) as place, unnest(b) as value from (
 select key, case when v[1] = v[n] then []::double[] else list_sort(list_distinct(list_transform(range(1, {o.QUANTILES}), lambda i: v[(i * n) // {o.QUANTILES} + 1]))) end as b
 from (select concat_ws('|', code, unit) as key, list_sort(list(numeric_value)) as v, count(*) as n from co where numeric_value is not null group by 1))"""
)
def quantile_breaks_by_unit(spark, d):
    own = statistics.quantile_breaks(statistics.reservoir(_cohort(spark, d), mode="exact", by_unit=True), o.QUANTILES)
    return own.select("key", F.posexplode("breaks").alias("place", "value")).withColumn("place", (F.col("place") + 1).cast("bigint"))


@query("select sample_id, ord, q from tk where numeric_value is not null")
def quantile_bucket(spark, d):
    return _parts(spark, d, JOINT).where("numeric_value is not null").select("sample_id", "ord", "q")


@query("select code, q, count(*) as n from tk where numeric_value is not null group by all")
def bucket_histogram(spark, d):
    return _parts(spark, d, JOINT).where("numeric_value is not null").groupBy("code", "q").agg(F.count(F.lit(1)).alias("n"))


@query("select stage from st")
def discovered_stages(spark, d):
    return statistics.stages(_cohort(spark, d))


@query("select workflow_stage, 'STAGE:' || lower(workflow_stage) as token, count(*) as n from co where workflow_stage is not null group by all")
def stage_tokens_joint(spark, d):
    none = spark.createDataFrame([], "stage string")
    own = tokens.with_parts(_cohort(spark, d), None, none, True).where("workflow_stage is not null")
    return own.groupBy("workflow_stage", F.col("stg").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("select workflow_stage, 'STAGE:UNK' as token, count(*) as n from co where workflow_stage is not null group by all")
def stage_tokens_factorized(spark, d):
    none = spark.createDataFrame([], "stage string")
    own = tokens.with_parts(_cohort(spark, d), None, none, False).where("workflow_stage is not null")
    return own.groupBy("workflow_stage", F.col("stg").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("select round(mean, 3) as mean, round(std, 3) as std from ag")
def age_stats_weighted(spark, d):
    return statistics.age_moments(_cohort(spark, d)).select(F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


# Vocabularies

_LEGACY = """lw0 as (select *, case when numeric_value is not null then 'numeric' when text_value is not null then 'text' else 'code' end as type from co),
lw as (select type, code, case when type = 'text' then text_value end as text, sum(w) as w, count(*) as n from lw0 group by all)"""
_BINS = f"""nb0 as (select key, v, n, cast(ceil(n / 10.0) as bigint) as per from rl),
nb1 as (select *, unnest(range(0, 10)) as bin from nb0),
nb2 as (select key, n, bin, case when bin = 0 then '-infinity'::double else v[bin * per + 1] end as val_start, case when bin = 9 or (bin + 1) * per >= n then 'infinity'::double else v[(bin + 1) * per + 1] end as val_end from nb1 where bin = 0 or bin * per < n),
nb3 as (select * from nb2 where val_start <> val_end union all select key, n, 0, '-infinity'::double, 'infinity'::double from nb0 where key not in (select key from nb2 where val_start <> val_end)),
nb as (select nb3.key, bin, val_start, val_end, {o.plain_entropy("(w / 10)")} as weight from nb3 join lw on lw.type = 'numeric' and lw.code = nb3.key)"""


@query(f", {_LEGACY} select type, code, text, round(w, 10) as w, n from lw")
def legacy_vocab_weights(spark, d):
    return vocabulary.legacy_weights(_cohort(spark, d)).select("type", "code", "text", F.round("w", 10).alias("w"), "n")


@query(f", {_LEGACY}, {_BINS} select key, cast(bin as int) as bin, val_start, val_end, round(weight, 10) as weight from nb")
def legacy_numeric_bins(spark, d):
    own = _cohort(spark, d)
    counts = vocabulary.legacy_weights(own).where("type = 'numeric'").select(F.col("code").alias("key"), "w")
    return vocabulary.numeric_bins(statistics.reservoir(own, o.RESERVOIR), counts).select("key", "bin", "val_start", "val_end", F.round("weight", 10).alias("weight"))


@query(
    f""", {_LEGACY}, {_BINS},
le as (select type, code as code_string, text as text_string, null::double as val_start, null::double as val_end, {o.plain_entropy("w")} as weight from lw where type <> 'numeric' union all select 'numeric', key, null, val_start, val_end, weight from nb)
select type, code_string, text_string, val_start, val_end, round(weight, 10) as weight, cast(row_number() over (order by round(weight, 12) nulls first, type, code_string, text_string nulls first, val_start nulls first) - 1 as int) as token_id from le qualify token_id < 40"""
)
def legacy_vocab(spark, d):
    own = _cohort(spark, d)
    out = vocabulary.legacy_vocabulary(own, statistics.reservoir(own, o.RESERVOIR), 40)
    return out.select("type", "code_string", "text_string", "val_start", "val_end", F.round("weight", 10).alias("weight"), "token_id")


@query("select token, n, round(w, 10) as w from jw")
def joint_tokens(spark, d):
    own = _parts(spark, d, JOINT).withColumn("token", tokens.joint())
    return own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 10).alias("w"))


@query("select token, round(weight, 10) as weight from js")
def joint_vocab(spark, d):
    own = vocabulary.token_weights(_parts(spark, d, JOINT).withColumn("token", tokens.joint()))
    return own.select("token", F.round(values.entropy_score(F.col("w")), 10).alias("weight"))


@query("select cast(token_id as int) as token_id, token, round(weight, 10) as weight from jv")
def joint_vocab_topk(spark, d):
    return _trained(spark, d, JOINT).vocabulary.select("token_id", "token", F.round("weight", 10).alias("weight"))


@query("select sample_id, ord, i - 1 as place, x[i] as token from (select sample_id, ord, x, unnest(range(1, len(x) + 1)) as i from (select sample_id, ord, list_filter([base, q, txt, stg], lambda t: t is not null) as x from tk))")
def factorized_tokens(spark, d):
    own = _parts(spark, d, FACTORIZED)
    return own.select("sample_id", "ord", F.posexplode(tokens.factorized()).alias("place", "token")).withColumn("place", F.col("place").cast("bigint"))


@query("select cast(token_id as int) as token_id, type, token, round(weight, 10) as weight, num_ntp_classes from fv")
def factorized_vocab(spark, d):
    return _trained(spark, d, FACTORIZED).vocabulary.select("token_id", "type", "token", F.round("weight", 10).alias("weight"), "num_ntp_classes")


@query("select type, token, cast(place as bigint) as place from sl union all select 'quantile', 'Q:' || i, i - 1 from range(1, 11) t(i) union all select 'quantile', 'Q:UNK', 10")
def static_tokens(spark, d):
    own = [("interval", x) for x in interval_labels()] + [("demographic", x) for x in demographic_labels()]
    rows = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(own)], "type string, token string, place bigint")
    return rows.unionByName(vocabulary.static_entries(spark, "quantile", quantile_labels(10)).select("type", "token", "place"))


@query("select cast(token_id as int) as token_id, type, token from pv")
def vocab_prepended(spark, d):
    return _prepended(spark, d).vocabulary.select("token_id", "type", "token")


@query("select token as label from sl where token not in (select token from pv) union all select 'INT_none'")
def vocab_coverage_check(spark, d):
    return vocabulary.missing_labels(_prepended(spark, d).vocabulary, [*interval_labels(), *demographic_labels(), "INT_none"])


@query("select key, unnest(range(1, 4)) as place, unnest(case when key in ('EVT/view', 'EVT/click') then [10.0, 20.0, 30.0] else b end) as value from (select key, b from bk where len(b) = 3)")
def breaks_override(spark, d):
    base = statistics.quantile_breaks(statistics.reservoir(_cohort(spark, d), o.RESERVOIR), o.QUANTILES)
    new = spark.createDataFrame([("EVT/view", [10.0, 20.0, 30.0]), ("EVT/click", [10.0, 20.0, 30.0]), ("EVT/none", [1.0])], "key string, breaks array<double>")
    own = statistics.override_breaks(base.where(F.size("breaks") == 3), new)
    return own.select("key", F.posexplode("breaks").alias("place", "value")).withColumn("place", (F.col("place") + 1).cast("bigint"))


# Ids and sequences


@query("select sample_id, ord, cast(token_id as int) as token_id from kj")
def token_ids_joint(spark, d):
    own = pretokenize.known_events(_cohort(spark, d), _prepended(spark, d))
    return own.select("sample_id", "ord", F.get("ids", F.lit(0)).alias("token_id"))


@query("select sample_id, ord, i - 1 as place, cast(ids[i] as int) as token_id from (select *, unnest(range(1, len(ids) + 1)) as i from kf)")
def token_ids_factorized_no_orphans(spark, d):
    own = pretokenize.known_events(_cohort(spark, d), _fitted(spark, d, FACTORIZED))
    return own.select("sample_id", "ord", F.posexplode("ids").alias("place", "token_id")).withColumn("place", F.col("place").cast("bigint"))


@query(f"select sample_id, count(*) as n from kj where token_id < {o.CUTOFF + 59} group by 1")
def vocab_cutoff(spark, d):
    return pretokenize.known_events(_cohort(spark, d), _prepended(spark, d), o.CUTOFF + 59).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"select sample_id, ord, {o.seconds('birth_t', 'time')} / 86400.0 as age, round(({o.seconds('birth_t', 'time')} - mean) / std, 6) as age_normalized from co, ag")
def age_days_norm(spark, d):
    own = _cohort(spark, d)
    s = values.seconds_between(F.col("birth_t"), F.col("time"))
    stats = statistics.age_moments(own)
    return own.join(F.broadcast(stats)).select("sample_id", "ord", values.age_days(s).alias("age"), F.round(values.age_normalized(s, F.col("mean"), F.col("std")), 6).alias("age_normalized"))


@query("select sample_id, cast(pos as int) as pos, cast(token_id as int) as token_ids, cast(age as double) as age, round(cast(age_normalized as double), 5) as age_normalized from sq")
def sequence_assembled(spark, d):
    return _long(_sequences(spark, d), ["sample_id"], "token_ids", "age", "age_normalized").withColumn("age_normalized", F.round("age_normalized", 5))


@query("select s.sample_id, cast(coalesce(length, 0) as int) as length from (select distinct sample_id from co) s left join sn using (sample_id)")
def sequence_lengths(spark, d):
    return _sequences(spark, d).select("sample_id", "length")


@query("select sample_id, ord, prev_t, gap from gp")
def interval_gaps(spark, d):
    own = pretokenize.known_events(_cohort(spark, d), _prepended(spark, d))
    return sequence.with_gaps(own).select("sample_id", "ord", "prev_t", "gap")


def _gap_sql(most: int | None) -> str:
    n = "case when gap >= 15552000 then cast(floor((gap + 15551999.0) / 15552000.0) as int) else 0 end"
    n = n if most is None else f"least({n}, {most})"
    return f"select sample_id, ord, {HALF_YEAR!r} as half, half_n, {o.bin_label('(gap - half_n * 15552000)')} as bin_label from (select *, coalesce({n}, 0) as half_n from gp)"


def _gap_tokens(spark, d, most):
    trained = _prepended(spark, d)
    own = pretokenize.with_half_and_bins(pretokenize.known_events(_cohort(spark, d), trained), trained, most, None)
    return own.select("sample_id", "ord", F.lit(HALF_YEAR).alias("half"), "half_n", "bin_label")


@query(_gap_sql(None))
def interval_tokens(spark, d):
    return _gap_tokens(spark, d, None)


@query(_gap_sql(o.MOST_HALVES))
def interval_tokens_capped(spark, d):
    return _gap_tokens(spark, d, o.MOST_HALVES)


_WITH_GAPS = f"""gt as (select *, {o.seconds("birth_t", "time")} as age, {o.seconds("birth_t", "prev_t")} as since from ({_gap_sql(o.MOST_HALVES).replace("select sample_id, ord,", "select sample_id, ord, birth_t, time, prev_t, token_id,", 1)})),
gi as (
  select sample_id, ord, 0 as part, unnest(range(1, half_n + 1)) as k, 12 as token_id, since, age from gt where half_n > 0
  union all select gt.sample_id, gt.ord, 1, 0, pv.token_id, null, gt.age from gt join pv on pv.type = 'interval' and pv.token = gt.bin_label
  union all select sample_id, ord, 2, 0, token_id, null, age from gt
)"""


@query(f", {_WITH_GAPS} select sample_id, cast(row_number() over (partition by sample_id order by ord, part, k) - 1 as int) as pos, cast(token_id as int) as token_ids, cast(cast(case when part = 0 then least(since + k * 15552000, age) else age end / 86400.0 as float) as double) as age from gi")
def sequence_with_intervals(spark, d):
    own, _ = pretokenize.sequences(tables.events(spark, d), _samples(spark, d), _prepended(spark, d), intervals=True, max_interval_repeat=o.MOST_HALVES)
    return _long(own, ["sample_id"], "token_ids", "age")


def _prefixed(spark, d, include_year):
    return sequence.demographic_prefix(sequence.leading_run(_cohort(spark, d)), _prepended(spark, d).vocabulary, include_year)


@query("select sample_id, cast(first_ord as int) as first_ord, first_t, sex_label, age_label from dm")
def demographic_prefix(spark, d):
    return _prefixed(spark, d, False).select("sample_id", "first_ord", "first_t", "sex_label", "age_label")


@query("select sample_id, year_label from dm")
def demographic_year(spark, d):
    return _prefixed(spark, d, True).select("sample_id", "year_label")


@query("select case when first_ord is null then 'no_medical_events_after_birth_or_sex' when year_label is null then 'first_event_year_out_of_range' else 'kept' end as reason, count(*) as n from dm group by 1")
def skip_reasons(spark, d):
    return sequence.skip_counts(_prefixed(spark, d, True))


@query(
    """, ds as (
  select d.sample_id, -1 as ord, i as k, p.token_id from (select sample_id, unnest([sex_label, age_label, year_label]) as label, unnest([0, 1, 2]) as i from dm where first_ord is not null and year_label is not null) d join pv p on p.token = d.label
  union all select kj.sample_id, kj.ord, 0, kj.token_id from kj join dm using (sample_id) where kj.ord >= dm.first_ord and dm.year_label is not null
) select sample_id, cast(row_number() over (partition by sample_id order by ord, k) - 1 as int) as pos, cast(token_id as int) as token_ids, cast(row_number() over (partition by sample_id order by ord, k) - 1 as double) as age, 0.0::double as age_normalized from ds"""
)
def sequence_demographic(spark, d):
    own, _ = pretokenize.sequences(tables.events(spark, d), _samples(spark, d), _prepended(spark, d), demographics=True, include_year=True)
    return _long(own, ["sample_id"], "token_ids", "age", "age_normalized")


@query("select d.sample_id, cast(p.token_id as int) as first_id from dm d join pv p on p.token = case d.sex_label when 'DEMO_SEX_MALE' then 'DEMO_SEX_FEMALE' when 'DEMO_SEX_FEMALE' then 'DEMO_SEX_MALE' else d.sex_label end where d.first_ord is not null")
def demographic_sex_codes(spark, d):
    codes = (FEMALE_CODES, MALE_CODES, ())  # exchanged, so that given codes are seen to count
    own, _ = pretokenize.sequences(tables.events(spark, d), _samples(spark, d), _prepended(spark, d), demographics=True, sex_codes=codes)
    return own.select("sample_id", F.get("token_ids", F.lit(0)).alias("first_id"))


# Embedding branch


@query("select embedding_text from ut")
def unique_texts(spark, d):
    return embedding.unique_texts(tables.events(spark, d))


@query("select embedding_text, cast(embedding_text_id as int) as embedding_text_id from ti")
def embedding_text_ids(spark, d):
    return embedding.text_ids(embedding.unique_texts(tables.events(spark, d)))


@query("select sha256(string_agg(embedding_text || chr(0), '' order by embedding_text)) as digest, count(*) as n from ut")
def string_set_hash(spark, d):
    own = embedding.unique_texts(tables.events(spark, d))
    return spark.createDataFrame([(embedding.string_set_hash(own), own.count())], "digest string, n bigint")


def _embedding_rows(spark, d):
    return pretokenize.embedding_rows(tables.events(spark, d), _samples(spark, d), _prepended(spark, d), embedding.text_ids(embedding.unique_texts(tables.events(spark, d))))


@query("select sample_id, ord, cast(embedding_text_id as int) as embedding_text_id, cast(label as int) as label, round(features[1], 9) as x, features[4] as present, s / 86400.0 as age, round((s - mean) / std, 6) as age_normalized from er, ag")
def embedding_rows(spark, d):
    own = _embedding_rows(spark, d)
    return own.select("sample_id", "ord", "embedding_text_id", "label", F.round(F.get("features", F.lit(0)), 9).alias("x"), F.get("features", F.lit(3)).alias("present"), "age", F.round("age_normalized", 6).alias("age_normalized"))


@query("select er.sample_id, er.ord, cast(er.embedding_text_id as int) as embedding_text_id, cast(e.embedding[1] as double) as first, cast(e.embedding[64] as double) as last from er join embeddings e on e.vec_id = er.embedding_text_id")
def embedding_lookup_join(spark, d):
    vectors = tables.table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("embedding_text_id"), "embedding")
    rows = _embedding_rows(spark, d).select("sample_id", "ord", "embedding_text_id").join(vectors, "embedding_text_id")
    return rows.select("sample_id", "ord", "embedding_text_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(63)).cast("double").alias("last"))


@query("select sample_id, cast(row_number() over (partition by sample_id order by ord) - 1 as int) as pos, cast(embedding_text_id as int) as embedding_text_ids, cast(label as int) as token_ids, cast(cast(s / 86400.0 as float) as double) as age from er")
def embedding_sequences(spark, d):
    return _long(embedding.assembled(_embedding_rows(spark, d)), ["sample_id"], "embedding_text_ids", "token_ids", "age")


# Windows


@query(f"select sample_id, cast(start as int) as start, cast(least({o.WINDOW}, length) as int) as length from (select *, last as start from wn0)")
def windows_one(spark, d):
    return _windows(spark, d, one=True).select("sample_id", "start", "length")


@query("select sample_id, cast(start as int) as start, cast(length as int) as length from ws")
def windows_sliding(spark, d):
    return _windows(spark, d).select("sample_id", "start", "length")


@query(f"select sample_id, cast(start as int) as start, cast(length as int) as length from ws where total >= {o.LEAST} and length >= {o.LEAST}")
def windows_min_length(spark, d):
    return _windows(spark, d, least=o.LEAST).select("sample_id", "start", "length")


_LABELS = f"wl as (select *, case when coalesce(nxt, {o.CLASSES}) >= {o.CLASSES} then -100 else nxt end as label from (select *, lead(token_id) over (partition by sample_id, start order by place) as nxt from wt))"


def _labelled(spark, d):
    return _windows(spark, d).withColumn("labels", windows.labels(F.col("token_ids"), o.CLASSES))


@query(f", {_LABELS} select sample_id, cast(start as int) as start, cast(place as int) as pos, cast(label as int) as labels from wl")
def ntp_labels(spark, d):
    return _long(_labelled(spark, d), ["sample_id", "start"], "labels")


@query("select sample_id, cast(start as int) as start, cast(place as int) as pos, cast(place as double) as age, 0.0::double as age_normalized from wt")
def age_positions(spark, d):
    return _long(windows.positions(_windows(spark, d)), ["sample_id", "start"], "age", "age_normalized")


@query(
    f""", dr as (select *, {o.chance(7, "sample_id", "start", "place")} >= 0.3 as stays from wt),
da as (select *, bool_or(stays) over (partition by sample_id, start) as kept_any from dr)
select sample_id, cast(start as int) as start, cast(row_number() over (partition by sample_id, start order by place) - 1 as int) as pos, cast(token_id as int) as token_ids, cast(age as double) as age from da where stays or not kept_any"""
)
def token_dropout(spark, d):
    return _long(windows.dropout(_windows(spark, d), 0.3, 7), ["sample_id", "start"], "token_ids", "age")


# Batches


_PACK = f"""pi as (select *, row_number() over (partition by shard order by r, sample_id, start) as seq from (select sample_id, start, length, {o.chance(5, "sample_id", "start")} as r, sample_id % 4 as shard from ws)),
pk as (
  select shard, seq, sample_id, start, length, 0 as batch, length as total, 1 as n from pi where seq = 1
  union all
  select pi.shard, pi.seq, pi.sample_id, pi.start, pi.length,
    case when pk.total + pi.length > {o.BUDGET} and pk.n >= 2 then pk.batch + 1 else pk.batch end,
    case when pk.total + pi.length > {o.BUDGET} and pk.n >= 2 then pi.length else pk.total + pi.length end,
    case when pk.total + pi.length > {o.BUDGET} and pk.n >= 2 then 1 else pk.n + 1 end
  from pk join pi on pi.shard = pk.shard and pi.seq = pk.seq + 1
)"""


def _packed(spark, d):
    return batching.packed(_windows(spark, d), o.BUDGET, 2, 5, 4)


@query(f", {_PACK} select cast(shard as int) as shard, cast(batch as int) as batch, cast(row_number() over (partition by shard, batch order by seq) - 1 as int) as place, sample_id, cast(start as int) as start, cast(length as int) as length from pk", recursive=True)
def token_budget_batches(spark, d):
    return _packed(spark, d)


@query(f", {_PACK} select cast(shard as int) as shard, cast(batch as int) as batch, sample_id, cast(start as int) as start, cast(sum(length) over (partition by shard, batch order by seq) - 1 as bigint) as last_index from pk", recursive=True)
def packed_offsets(spark, d):
    return batching.with_offsets(_packed(spark, d)).select("shard", "batch", "sample_id", "start", "last_index")


@query(
    f""", {_PACK}, {_LABELS}
select cast(pk.shard as int) as shard, cast(pk.batch as int) as batch, count(*) as tokens, count(distinct (pk.sample_id, pk.start)) as patients, count(*) filter (label <> -100) as labelled, sum(token_id)::bigint as id_sum, coalesce(sum(label) filter (label <> -100), 0)::bigint as label_sum
from pk join wl on wl.sample_id = pk.sample_id and wl.start = pk.start group by 1, 2""",
    recursive=True,
)
def collated_batches(spark, d):
    own = batching.collated(_packed(spark, d), _labelled(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    size = lambda c: F.size(c).cast("bigint")
    return own.select("shard", "batch", size("input_ids").alias("tokens"), size("patient_lengths").alias("patients"), size("label_indices").alias("labelled"), total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


@query(
    f"""select sample_id, cast(start as int) as start, cast(length as int) as length from (
 select *, sum(length) over (order by r, sample_id, start rows unbounded preceding) as running from (select *, {o.chance(3, "sample_id", "start")} as r from ws)) where running // {o.BUDGET} < 3"""
)
def eval_subset(spark, d):
    return batching.eval_subset(_windows(spark, d), 3, o.BUDGET, 3).select("sample_id", "start", "length")


@query(f"select sample_id, cast(start as int) as start, cast(row_number() over (order by {o.chance(11, 'sample_id', 'start')}, sample_id, start) - 1 as bigint) as place from ws")
def shuffled_windows(spark, d):
    return numbered(_windows(spark, d).select("sample_id", "start"), batching.shuffled_order(11, "sample_id", "start"), "place")


# Model data


@query("select vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) / 64 + 1e-6), 6) as first, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) / 64), 6) as size from embeddings")
def rms_norm(spark, d):
    own = tables.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    own = own.withColumn("y", model.rms_norm(F.col("x")))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / F.size("x"))
    return own.select("vec_id", F.round(F.get("y", F.lit(0)), 6).alias("first"), F.round(size, 6).alias("size"))


@query("select sample_id, cast(start as int) as start, max(length) >= 2 as placed, false as aged from ws group by all")
def positions_mode(spark, d):
    own = _windows(spark, d)
    placed = windows.positions(own).select("sample_id", "start", windows.by_position(F.col("age"), F.col("age_normalized")).alias("placed"))
    aged = own.select("sample_id", "start", windows.by_position(F.col("age"), F.col("age_normalized")).alias("aged"))
    return placed.join(aged, ["sample_id", "start"])


@query(f"select sample_id, ord, i, round(sin(a), 6) as sin, round(cos(a), 6) as cos from (select sample_id, ord, i, {o.seconds('birth_t', 'time')} / 86400.0 * pow(10000.0, -(i * (2.0 / 3))) as a from co, (values (0), (1), (2), (3)) t(i))")
def rope_features(spark, d):
    own = _cohort(spark, d)
    age = values.age_days(values.seconds_between(F.col("birth_t"), F.col("time")))
    each = own.select("sample_id", "ord", F.posexplode(model.rope(age, 8)).alias("i", "x"))
    return each.select("sample_id", "ord", "i", F.round("x.sin", 6).alias("sin"), F.round("x.cos", 6).alias("cos"))


@query("select sample_id, ord, features[4] > 0.5 as present, round(case when features[4] > 0.5 then 2.0 * features[1] + 1.0 else features[1] end, 9) as first from er")
def film_gate(spark, d):
    own = _embedding_rows(spark, d)
    four = lambda x: F.array(*[F.lit(x)] * 4)
    moved = model.film(F.col("features"), four(2.0), four(1.0), F.col("features"))
    return own.select("sample_id", "ord", model.present(F.col("features")).alias("present"), F.round(F.get(moved, F.lit(0)), 9).alias("first"))


@query("select sample_id, cast(start as int) as start, cast(arg_max(token_id, place) as int) as token, cast(arg_max(age, place) as double) as age from wt group by 1, 2")
def last_token(spark, d):
    own = _windows(spark, d)
    return own.select("sample_id", "start", model.last_token(F.col("token_ids")).alias("token"), model.last_token(F.col("age")).cast("double").alias("age"))


@query("select round(avg(ln(list_sum(list_transform(embedding, lambda x: exp(cast(x as double))))) - embedding[label + 1]), 6) as loss, count(*) as n from embeddings")
def cross_entropy(spark, d):
    own = tables.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("logits"), "label")
    return model.cross_entropy(own).select(F.round("loss", 6).alias("loss"), "n")


@query("select date_trunc('day', ts) as window_start, event_type as code, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def windowed_event_counts(spark, d):
    own = tables.table(spark, d, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("code"), F.col("value").alias("numeric_value"))
    return windowed_counts(own).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "code", "n", F.round("total", 6).alias("total"))
