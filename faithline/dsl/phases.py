"""Rows that meet a value of their table again, however many rows that table has.

A join on the tables' keys puts all rows of one table into one task. The largest tables, ``SALTS`` at most and of more than ``LEAST`` rows each, are therefore
counted first and known to every task; their rows are dealt by a hash of their place over ``SALTS`` keys, and their values are there
once for each. All other tables' rows have one key and their value one copy; a table beyond these has less than one in ``SALTS`` of all rows."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a large table's rows are dealt over, and how many tables are taken for large; rows that one task can well take.
SALTS, LEAST = 256, 100_000


class Hot(NamedTuple):
    """The keys of large tables."""

    keys: tuple[str, ...]
    tables: list


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def hot_tables(rows: DataFrame, keys: tuple[str, ...], salts: int = SALTS, least: int = LEAST) -> Hot:
    """The largest tables: one count, of which the driver gets ``salts`` keys at most."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > least)
    return Hot(keys, sizes.orderBy(F.desc("__n"), *keys).limit(salts).select(*keys).collect())


def joined_back(rows: DataFrame, tables: DataFrame, keys: tuple[str, ...], place: str, hot: Hot, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``tables`` of equal keys (nulls are equal); ``place`` tells a table's rows apart."""
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    pairs = list(names.items())
    if not hot.tables:
        right = tables.withColumnsRenamed(names)
        return rows.join(right, same(rows, right, pairs)).drop(*names.values())
    known = rows.select(*hot.keys).schema
    large = rows.sparkSession.createDataFrame(hot.tables, known).withColumnsRenamed({k: f"__h{i}" for i, k in enumerate(hot.keys)})
    at = [(k, f"__h{i}") for i, k in enumerate(hot.keys)]
    large = F.broadcast(large.withColumn("__hot", F.lit(True)))  # ``salts`` rows at most

    def marked(df: DataFrame) -> DataFrame:
        return df.join(large, same(df, large, at), "left").drop(*[h for _, h in at])
    left = marked(rows).withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(place), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(tables).withColumn("__dealt", F.explode(copies)).drop("__hot").withColumnsRenamed(names)
    return left.join(right, same(left, right, [*pairs, ("__salt", "__dealt")])).drop(*names.values(), "__salt", "__dealt")
