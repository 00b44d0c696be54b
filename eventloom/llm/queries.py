"""The registered text queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from eventloom.llm import decontam, langid, lines, lm, pieces, pii, quality, secrets, sharding, simhash
from eventloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents")).select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text_lines", "removed_lines", "near_lines", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents"), shards=24)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, pii.DEMONSTRATION_KEY)
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key.encode())


#: Lines linked by one edit are found by their halves: of two lines within one edit, the first or the last half is equal.
_LINES_SQL = f"""
with recursive line as (
  select doc_id, i - 1 as line_no, string_split(text, chr(10))[i] as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)
), own as (
  select line, length(line) as n, min(row(doc_id, line_no)) as at, count(*) as lines from line where length(line) > 0 group by 1, 2
), long as (select * from own where n >= {lines.NEAR_CHARS}
), half as (
  select line, n, 1 as s, left(line, n // 2) as part, line[n // 2 + 1:] as rest from long
  union all select line, n, 2, line[n // 2 + 1:], left(line, n // 2) from long
  union all select line, n - 1, 3, left(line, (n - 1) // 2), line[(n - 1) // 2 + 1:] from long
  union all select line, n - 1, 4, line[n - ((n - 1) - (n - 1) // 2) + 1:], line[:n - ((n - 1) - (n - 1) // 2)] from long
), link as (
  select a.line as a, b.line as b from half a join half b on a.n = b.n and a.part = b.part and a.s = b.s and a.s < 3 and a.line <> b.line
  where len(list_filter(range(1, length(a.rest) + 1), lambda i: a.rest[i] <> b.rest[i])) = 1
  union select a.line, b.line from half a join half b on a.n = b.n and a.part = b.part and a.s = b.s + 2
  where len(list_filter(range(1, length(a.rest) + 1), lambda i: a.rest[:i - 1] || a.rest[i + 1:] = b.rest)) > 0
), edge as (select a, b from link union select b, a from link
), reach as (select a, a as b from (select distinct a from edge) union select r.a, e.b from reach r join edge e on r.b = e.a
), class as (select r.a as line, min(o.at) as at from reach r join own o on r.b = o.line group by 1
), near as (select distinct a as line from edge
), kept as (
  select l.doc_id, l.line_no, l.line, o.line is null or row(l.doc_id, l.line_no) = coalesce(c.at, o.at) as stays, x.line is not null as near
  from line l left join own o on l.line = o.line left join class c on l.line = c.line left join near x on l.line = x.line
), text as (
  select doc_id, count(*) as text_lines, count(*) filter (not stays) as removed_lines, count(*) filter (not stays and near) as near_lines,
    coalesce(string_agg(line, chr(10) order by line_no) filter (stays), '') as text
  from kept group by 1
)
select d.doc_id, coalesce(t.text_lines, 0) as text_lines, coalesce(t.removed_lines, 0) as removed_lines, coalesce(t.near_lines, 0) as near_lines, md5(t.text) as kept_md5
from documents d left join text t on d.doc_id = t.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_secrets, op3_quality, op4_lm, op5_lines, op6_pieces, op7_sharding, op8_decontam, op9_langid, op10_pii)
}
#: The others hash with XXH64, pack, align, search or sum over segmentations, which SQL has no means for; their tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op5_lines": _LINES_SQL}
