"""The driver's tables as events, samples and visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with attributes drawn from its payload, and a birth and a sex code for most users."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    pick = lambda c, n, *values: F.expr(f"element_at(array({', '.join(values)}), {c} % {n} + 1)")
    own = e.select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("time"),
        F.concat(F.lit("EVT/"), "event_type").alias("code"),
        F.concat(F.lit("event "), "event_type").alias("description"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("numeric_value"),
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("  Route ("), (F.col("k") % 7).cast("string"), F.lit(")  Oral "))).alias("text_value"),
        pick("k", 3, "'mg'", "'ml'", "null").alias("unit"),
        pick("k", 4, "'Start'", "'end'", "'Taken'", "null").alias("workflow_stage"),
        F.when(F.col("k") % 2 == 0, (F.col("k") % 3 + 10).cast("double")).alias("ref_low"),
        F.when(F.col("k") % 2 == 0, (F.col("k") % 5 + 60).cast("double")).alias("ref_high"),
        F.when(F.col("k") % 10 != 7, F.concat("event_type", F.lit(" "), (F.col("k") % 10).cast("string"))).alias("embedding_text"),
        F.col("event_id").alias("event_ord"),
    )
    born = F.expr("timestamp_ntz'1980-01-01' + make_dt_interval(cast(user_id * 37 % 12000 as int))")
    users = e.select("user_id").distinct()
    first = users.where("user_id % 17 != 0").select("user_id", born.alias("t"), F.lit("MEDS_BIRTH").alias("c"), F.lit(-3).alias("o"))
    again = users.where("user_id % 11 = 0 and user_id % 17 != 0").select("user_id", (born + F.expr("interval 1 day")).alias("t"), F.lit("MEDS_BIRTH").alias("c"), F.lit(-2).alias("o"))
    sex = users.where("user_id % 3 < 2").select("user_id", born.alias("t"), F.expr("if(user_id % 3 = 0, '8507', '8532')").alias("c"), F.lit(-1).alias("o"))
    static = first.unionByName(again).unionByName(sex)
    rest = {c: F.lit(None).cast(kind) for c, kind in own.dtypes if c not in ("subject_id", "time", "code", "event_ord")}
    static = static.select(F.col("user_id").alias("subject_id"), F.col("t").alias("time"), F.col("c").alias("code"), F.col("o").cast("bigint").alias("event_ord"), *(v.alias(c) for c, v in rest.items()))
    return own.unionByName(static)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples a user: (sample_id, id, index_t, split)."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    early = F.expr("timestamp_ntz'2024-01-05' + make_dt_interval(cast(user_id % 5 as int))")
    late = F.expr("timestamp_ntz'2024-01-25 12:00:00'")
    both = users.select("user_id", F.posexplode(F.array(early, late)).alias("n", "index_t"))
    split = F.when(F.col("user_id") % 5 == 0, F.lit("tuning")).otherwise(F.lit("train"))
    return both.select((F.col("user_id") * 2 + F.col("n")).alias("sample_id"), F.col("user_id").alias("id"), "index_t", split.alias("split"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits: a start event each, an end event for those with line items, and events within."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    row = lambda time, code, stage, description="null", value="null": F.struct(
        F.expr(time).alias("time"), F.expr(code).alias("code"), F.expr(f"cast({stage} as string)").alias("workflow_stage"), F.expr(f"cast({description} as string)").alias("description"), F.expr(f"cast({value} as double)").alias("numeric_value")
    )
    starts = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("visit_id"), row("o_orderdate", "'VISIT/IP'", "'START'").alias("e"))
    ends = lines.groupBy("o_custkey", "o_orderkey").agg(F.max("l_shipdate").alias("t")).select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("visit_id"), row("t", "'VISIT/IP'", "'End'").alias("e"))
    inner = lines.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("visit_id"),
        F.explode(
            F.array(
                row("o_orderdate", "'DIAGNOSIS/' || p_type", "l_linestatus"),
                row("o_orderdate", "'NOTE/' || l_returnflag", "l_linestatus", "'PROCEDURE/' || p_brand"),
                row("l_shipdate", "'LAB/' || l_returnflag", "l_linestatus", "null", "l_quantity"),
            )
        ).alias("e"),
    )
    return starts.unionByName(ends).unionByName(inner).select("subject_id", "visit_id", "e.*")
