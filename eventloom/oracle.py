"""DuckDB SQL for the registered queries: shared common table expressions, and one final select a query."""

from __future__ import annotations

from eventloom.constants import INTERVAL_BINS, WHITE, demographic_labels, interval_labels

QUANTILES, RESERVOIR, JOINT_SIZE, FACTORIZED_SIZE, CUTOFF = 4, 50, 120, 22, 60
LAST_K, WINDOW, STRIDE, LEAST, CLASSES, BUDGET, MOST_HALVES = 20, 32, 20, 12, 15, 256, 2

_NAMES = "code, description, numeric_value, text_value, unit, workflow_stage, ref_low, ref_high, embedding_text, event_ord"


def norm(x: str) -> str:
    trimmed = rf"regexp_replace(lower({x}), '\A{WHITE}+|{WHITE}+\z', '', 'g')"
    return rf"nullif(regexp_replace(regexp_replace({trimmed}, '{WHITE}+', '_', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g'), '')"


def seconds(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 1e6)"


def entropy(w: str) -> str:
    w = f"least(greatest({w}, 1e-8), 1 - 1e-8)"
    return f"({w} * ln({w}) + (1 - {w}) * ln(1 - {w}))"


def plain_entropy(w: str) -> str:
    return f"(case when {w} > 0 and {w} < 1 then {w} * ln({w}) + (1 - {w}) * ln(1 - {w}) end)"


def bin_label(dt: str) -> str:
    return "case " + " ".join(f"when {dt} >= {a} and {dt} < {b} then '{label}'" for a, b, label in INTERVAL_BINS) + " end"


def values(kind: str, labels: list[str]) -> str:
    return ", ".join(f"({i}, '{kind}', '{x}')" for i, x in enumerate(labels))


def chance(seed: int, *parts: str) -> str:
    text = " || '-' || ".join([f"'{seed}'", *(f"cast({p} as varchar)" for p in parts)])
    return f"(cast('0x' || substr(md5({text}), 1, 8) as bigint) / 4294967296.0)"


AGE_BAND = "case when {y} >= 100 then 'DEMO_AGE_100P' else 'DEMO_AGE_' || cast(floor({y} / 5) * 5 as int) || '_' || (cast(floor({y} / 5) * 5 as int) + 4) end"
YEARS = "greatest(floor({s} / 31557600.0), 0)"

FEATURES = """case when numeric_value is null or isnan(numeric_value) or isinf(numeric_value) then [0.0, 0.0, 0.0, 0.0]
 when coalesce(not isnan(ref_low) and not isinf(ref_low) and not isnan(ref_high) and not isinf(ref_high) and ref_high - ref_low > 0.01, false)
 then [least(greatest((numeric_value - ref_low) / (ref_high - ref_low), -2.0), 3.0), 1.0, 0.0, 1.0]
 else [least(greatest(ln(1 + abs(numeric_value)) / 7.0, 0.0), 1.5), 0.0, 1.0, 1.0] end"""

CTES = rf"""
e0 as (select *, cast(regexp_extract(props, '[0-9]+') as int) as k from events),
u as (select distinct user_id, timestamp '1980-01-01' + to_days(cast(user_id * 37 % 12000 as int)) as born from events),
ev as (
  select user_id as subject_id, ts as time, 'EVT/' || event_type as code, 'event ' || event_type as description,
    case when event_type <> 'signup' then value end as numeric_value,
    case when k % 5 = 0 then '  Route (' || (k % 7) || ')  Oral ' end as text_value,
    case k % 3 when 0 then 'mg' when 1 then 'ml' end as unit,
    case k % 4 when 0 then 'Start' when 1 then 'end' when 2 then 'Taken' end as workflow_stage,
    case when k % 2 = 0 then cast(k % 3 + 10 as double) end as ref_low, case when k % 2 = 0 then cast(k % 5 + 60 as double) end as ref_high,
    case when k % 10 <> 7 then event_type || ' ' || (k % 10) end as embedding_text, event_id as event_ord
  from e0
  union all select user_id, born, 'MEDS_BIRTH', null, null, null, null, null, null, null, null, -3 from u where user_id % 17 <> 0
  union all select user_id, born + interval 1 day, 'MEDS_BIRTH', null, null, null, null, null, null, null, null, -2 from u where user_id % 17 <> 0 and user_id % 11 = 0
  union all select user_id, born, case when user_id % 3 = 0 then '8507' else '8532' end, null, null, null, null, null, null, null, null, -1 from u where user_id % 3 < 2
),
sm as (
  select user_id * 2 + n as sample_id, user_id as id,
    case n when 0 then timestamp '2024-01-05' + to_days(cast(user_id % 5 as int)) else timestamp '2024-01-25 12:00:00' end as index_t,
    case when user_id % 5 = 0 then 'tuning' else 'train' end as split
  from u, (values (0), (1)) t(n)
),
br as (select * from (select *, row_number() over (partition by subject_id order by time, event_ord) as rn from ev where code = 'MEDS_BIRTH') where rn = 1),
co0 as (
  select s.sample_id, s.id as subject_id, s.index_t, s.split, b.time as birth_t, 0 as later, b.time, {", ".join("b." + c for c in _NAMES.split(", "))}
  from sm s join br b on b.subject_id = s.id
  union all
  select s.sample_id, s.id, s.index_t, s.split, b.time, 1, e.time, {", ".join("e." + c for c in _NAMES.split(", "))}
  from sm s join br b on b.subject_id = s.id join ev e on e.subject_id = s.id and e.time <= s.index_t and e.code <> 'MEDS_BIRTH'
),
co1 as (select *, cast(row_number() over (partition by sample_id order by later, time, event_ord) - 1 as int) as ord, count(*) over (partition by sample_id) as n_events from co0),
co as (select *, 1.0::double / ((select count(*) from sm)::double * n_events) as w from co1),
rs as (select code as key, numeric_value as v from (select *, row_number() over (partition by code order by sample_id, ord) as rk from co where numeric_value is not null) where rk <= {RESERVOIR}),
rl as (select key, list_sort(list(v)) as v, count(*) as n from rs group by 1),
bk as (select key, case when v[1] = v[n] then []::double[] else list_sort(list_distinct(list_transform(range(1, {QUANTILES}), lambda i: v[(i * n) // {QUANTILES} + 1]))) end as b from rl),
st as (select distinct lower(workflow_stage) as stage from co where workflow_stage is not null),
ag0 as (select w, {seconds("birth_t", "time")} as x from co where time <> birth_t),
ag1 as (select sum(w * x) / sum(w) as mean from ag0),
ag as (select any_value(mean) as mean, sqrt(sum(w * (x - mean) * (x - mean)) / sum(w)) as std from ag0, ag1),
tk as (
  select co.*, case when split_part(code, '/', 2) <> '' then split_part(code, '/', 2) else code end as base,
    case when numeric_value is not null then case when bk.b is null then 'Q:UNK' else 'Q:' || (1 + len(list_filter(bk.b, lambda x: numeric_value >= x))) end end as q,
    'TXT:' || {norm("text_value")} as txt, 'STAGE:' || lower(workflow_stage) as stg
  from co left join bk on bk.key = co.code
),
jt as (select *, concat_ws('/', base, q, txt, stg) as token from tk),
jw as (select token, sum(w) as w, count(*) as n from jt group by 1),
js as (select token, {entropy("w")} as weight from jw),
jv as (select token, weight, row_number() over (order by round(weight, 12), token) - 1 as token_id from js qualify token_id < {JOINT_SIZE}),
fs as (
  select 0 as section, place, 'quantile' as type, label as token, -1.0::double as weight from (values {", ".join(f"({i}, 'Q:{i}')" for i in range(1, QUANTILES + 1))}, ({QUANTILES + 1}, 'Q:UNK')) t(place, label)
  union all select 1, row_number() over (order by last, label), 'stage', label, -1.0 from (select 'STAGE:' || stage as label, 0 as last from st union all select 'STAGE:UNK', 1)
  union all select 2, row_number() over (order by round(s, 12), token), 'text', token, s from (select txt as token, {entropy("sum(w)")} as s from tk where txt is not null group by 1)
  union all select 3, row_number() over (order by round(s, 12), token), 'code', token, s from (select base as token, {entropy("sum(w)")} as s from tk group by 1)
),
fv as (select type, token, weight, row_number() over (order by section, place) - 1 as token_id, (select count(*) from fs) as num_ntp_classes from fs qualify token_id < {FACTORIZED_SIZE}),
sl as (select * from (values {values("interval", interval_labels())}) a(place, type, token) union all select place + 13, type, token from (values {values("demographic", demographic_labels())}) d(place, type, token)),
pv as (
  select type, token, token_id from (
    select type, token, place as token_id from sl union all select 'code', token, token_id + {len(interval_labels()) + len(demographic_labels())} from jv
  ) where token_id < {JOINT_SIZE + 40}
),
kj as (select jt.*, pv.token_id from jt join pv on pv.type = 'code' and pv.token = jt.token),
kf as (
  select tk.*, list_filter([b.token_id, q.token_id, t.token_id, s.token_id], lambda x: x is not null) as ids
  from tk join fv b on b.type = 'code' and b.token = tk.base left join fv q on q.type = 'quantile' and q.token = tk.q
    left join fv t on t.type = 'text' and t.token = tk.txt left join fv s on s.type = 'stage' and s.token = tk.stg
),
sq0 as (select sample_id, subject_id, index_t, ord, i, ids[i] as token_id, {seconds("birth_t", "time")} as s from (select *, unnest(range(1, len(ids) + 1)) as i from kf)),
sq as (
  select sample_id, subject_id, index_t, row_number() over (partition by sample_id order by ord, i) - 1 as pos, token_id, cast(s / 86400.0 as float) as age, cast((s - mean) / std as float) as age_normalized
  from sq0, ag
),
sn as (select sample_id, subject_id, index_t, count(*) as length from sq group by all),
gp as (select *, {seconds("prev_t", "time")} as gap from (select *, lag(time) over (partition by sample_id order by ord) as prev_t from kj)),
lr0 as (select *, case when code = '8507' then 'DEMO_SEX_MALE' when code = '8532' then 'DEMO_SEX_FEMALE' end as sex, code in ('MEDS_BIRTH', '8507', '8532') as passed from co),
lr1 as (select sample_id, subject_id, index_t, birth_t, min(ord) filter (not passed) as first_ord from lr0 group by all),
lr as (
  select a.*, (select o.time from lr0 o where o.sample_id = a.sample_id and o.ord = a.first_ord) as first_t,
    coalesce((select arg_max(o.sex, o.ord) from lr0 o where o.sample_id = a.sample_id and o.sex is not null and (a.first_ord is null or o.ord < a.first_ord)), 'DEMO_SEX_UNKNOWN') as sex_label
  from lr1 a
),
dm as (
  select *, {AGE_BAND.format(y=YEARS.format(s=seconds("birth_t", "first_t")))} as age_label,
    case when year(first_t) between 1970 and 2079 then 'DEMO_YEAR_' || ((year(first_t) - 1970) // 5 * 5 + 1970) || '_' || ((year(first_t) - 1970) // 5 * 5 + 1974) end as year_label
  from lr
),
ut as (select distinct embedding_text from ev where embedding_text is not null),
ti as (select embedding_text, row_number() over (order by embedding_text) - 1 as embedding_text_id from ut),
er as (
  select jt.sample_id, jt.subject_id, jt.index_t, jt.ord, ti.embedding_text_id, coalesce(pv.token_id, -100) as label, {FEATURES} as features, {seconds("birth_t", "time")} as s
  from jt join ti using (embedding_text) left join pv on pv.type = 'code' and pv.token = jt.token
),
wn0 as (select *, greatest(length - {WINDOW}, 0) as last from sn),
ws as (select sample_id, subject_id, index_t, length as total, start, least({WINDOW}, length - start) as length
  from (select *, unnest(list_distinct(list_concat(list_transform(range(0, last // {STRIDE} + 1), lambda i: last - i * {STRIDE}), [0]))) as start from wn0)),
wt as (select ws.*, sq.pos - ws.start as place, sq.token_id, sq.age, sq.age_normalized from ws join sq on sq.sample_id = ws.sample_id and sq.pos >= ws.start and sq.pos < ws.start + ws.length)
"""


def sql(select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{CTES}\n{select}"
