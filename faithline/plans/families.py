"""The driver's tables as table families, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..dsl.compiler import Family


def events(spark: SparkSession, sf_dir: str) -> Family:
    """A table of events for each user, in the order of their ids."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return Family(df, ("user_id",), "event_id", ("event_id", "event_type", "value"), dense=False)


EV = "ev AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> Family:
    """A table of lines for each order."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return Family(df.withColumn("__at", order), ("l_orderkey",), "__at", tuple(df.columns[1:]), dense=False)


LI = ("li AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, row_number() OVER "
      "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r FROM lineitem)")
