"""The series that the registered queries use, from the events and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t and the mean value of each event type by hour; NULL where an hour has none."""
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(*(F.avg(F.when(F.col("event_type") == c, F.col("value"))).alias(f"{c}_m") for c in CHANNELS))


def daily(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """t and the mean quantity, discount and price by day (and key) of shipping."""
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(*keys, F.col("l_shipdate").cast("timestamp_ntz").alias("t")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_extendedprice").alias("price"))


def vectors(spark: SparkSession, sf_dir: str, p: int = 64) -> DataFrame:
    """vec_id and the components of the embeddings as columns e0, e1, .."""
    return read(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(p)))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


F1_SQL = """f1 as (select date_trunc('hour', ts)::timestamp as t, avg(case when event_type = 'click' then value end) as click_m, avg(case when event_type = 'error' then value end) as error_m,
  avg(case when event_type = 'purchase' then value end) as purchase_m, avg(case when event_type = 'signup' then value end) as signup_m, avg(case when event_type = 'view' then value end) as view_m from events group by 1),
s as (select *, row_number() over (order by t) as rn, count(*) over () as n from f1)"""
F2_SQL = """f2 as (select l_shipdate::timestamp as t, avg(l_quantity) as qty, avg(l_discount) as disc, avg(l_extendedprice) as price from lineitem group by 1)"""
F4_SQL = """f4 as (select l_returnflag, l_shipdate::timestamp as t, avg(l_quantity) as qty, avg(l_discount) as disc, avg(l_extendedprice) as price from lineitem group by 1, 2),
s as (select *, row_number() over (partition by l_returnflag order by t) as rn, count(*) over (partition by l_returnflag) as n from f4)"""
