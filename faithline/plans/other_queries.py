"""Queries without a SQL twin: program texts as data, and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import batch
from ..functions import structures, trace
from . import families
from .dsl_queries import CATALOGUE, oracle

_EV = [p for kind, p, _, _ in CATALOGUE.values() if kind == "ev"]


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three programs of the catalogue for every user."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    pool = F.array(*[F.lit(p) for p in _EV])
    return users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("user_id", F.get(pool, ((F.col("user_id") * 3 + F.col("k")) % len(_EV)).cast("int")).alias("program"))


def program_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.run_programs(programs(spark, sf_dir), families.events(spark, sf_dir))


def columns_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.columns_and_values(programs(spark, sf_dir)).select("user_id", "program", "columns", "values")


def set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = columns_values(spark, sf_dir)
    other = d.select(F.col("user_id"), F.col("columns").alias("c2"), F.col("values").alias("v2"), F.col("program").alias("program2"))
    return d.join(other, "user_id").select("user_id", "program", "program2", structures.set_match(F.col("columns"), F.col("values"), F.col("c2"), F.col("v2"), F.col("program"), F.col("program2")).alias("match"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace text for every order: a step for each of its lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag").alias("x"))
    g = li.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("x")).alias("s"))
    line = lambda x: F.concat(F.lit("line "), x["l_linenumber"].cast("string"), F.lit(":\n  q = "), x["q"].cast("string"), F.lit("\n  flag = '"), x["l_returnflag"], F.lit("'"))
    return g.select("l_orderkey", F.array_join(F.transform("s", line), "\n").alias("text"))


SOURCE = "def f(q, flag):\n    if q > 3:\n        return [q * 2, flag.lower()]\n    return q"
_trace = lambda s, d: trace.parsed(traces(s, d), "text")
QUERIES = {
    "dsl_program_parse": lambda s, d: columns_values(s, d).select("program").distinct(),
    "dsl_program_batch": program_batch,
    "dsl_columns_values": columns_values,
    "dsl_set_match": set_match,
    "trace_parse": lambda s, d: _trace(s, d).select("l_orderkey", "trace"),
    "trace_serialize": lambda s, d: _trace(s, d).select("l_orderkey", trace.serialized(F.col("trace")).alias("text")),
    "trace_applicable_levels": lambda s, d: trace.levels(traces(s, d), "text").select("l_orderkey", "levels"),
    "trace_drop": lambda s, d: _trace(s, d).select("l_orderkey", trace.serialized(trace.first_step_dropped(F.col("trace"))).alias("text")),
    "trace_duplicate": lambda s, d: _trace(s, d).select("l_orderkey", trace.serialized(trace.duplicated(F.col("trace"))).alias("text")),
    "trace_mutate": lambda s, d: trace.perturbed(traces(s, d), "text", "l_orderkey", 1).select("l_orderkey", "perturbed"),
    "trace_coerce": lambda s, d: trace.perturbed(traces(s, d), "text", "l_orderkey", 3).select("l_orderkey", "perturbed"),
    "trace_reorder": lambda s, d: trace.perturbed(traces(s, d), "text", "l_orderkey", 6).select("l_orderkey", "perturbed"),
    "trace_simulate": lambda s, d: trace.simulated(traces(s, d), "text", SOURCE).select("l_orderkey", "answer"),
}
_TEXTS = ("t AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_returnflag FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, l_returnflag) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, "
          "'line ' || l_linenumber::VARCHAR || ':' || chr(10) || '  q = ' || q::VARCHAR || chr(10) || '  flag = ''' || l_returnflag || '''' AS x FROM t)")
_NAMES = [name for name, (kind, _, _, _) in CATALOGUE.items() if kind == "ev"]
_PICKS = f"picks AS (SELECT DISTINCT user_id, k, (user_id * 3 + k) % {len(_EV)} AS i FROM events, (VALUES (0), (1), (2)) AS t(k))"
_TEXT = lambda p: "'" + p.replace("'", "''") + "'"
ORACLES = {
    "dsl_program_parse": f"WITH {_PICKS} SELECT DISTINCT [{', '.join(map(_TEXT, _EV))}][i + 1] AS program FROM picks",
    "dsl_program_batch": f"WITH {_PICKS}, said AS (" + " UNION ALL ".join(f"SELECT {i} AS i, user_id, {_TEXT(p)} AS program, final, executable FROM ({oracle(n)}) AS o{i}" for i, (n, p) in enumerate(zip(_NAMES, _EV, strict=True)))
                         + ") SELECT user_id, program, final, executable FROM picks JOIN said USING (user_id, i)",
    "trace_simulate": f"WITH {_TEXTS} SELECT l_orderkey, q::VARCHAR AS answer FROM s WHERE k = n",
    "trace_applicable_levels": f"WITH {_TEXTS} SELECT l_orderkey, CASE WHEN max(n) > 1 THEN [0, 1, 2, 3, 4, 5, 6, 7, 8] ELSE [0, 1, 2, 3, 7, 8] END AS levels FROM s GROUP BY l_orderkey",
    "trace_coerce": f"WITH {_TEXTS} SELECT l_orderkey, string_agg(CASE WHEN k = n THEN replace(x, 'q = ' || q::VARCHAR, 'q = [' || q::VARCHAR || ', ' || q::VARCHAR || ']') ELSE x END, chr(10) ORDER BY k) AS perturbed FROM s GROUP BY l_orderkey",
    "trace_serialize": f"WITH {_TEXTS} SELECT l_orderkey, string_agg(x, chr(10) ORDER BY k) AS text FROM s GROUP BY l_orderkey",
    "trace_drop": f"WITH {_TEXTS} SELECT l_orderkey, string_agg(x, chr(10) ORDER BY k) AS text FROM s WHERE k > 1 OR n = 1 GROUP BY l_orderkey",
    "trace_duplicate": f"WITH {_TEXTS} SELECT l_orderkey, string_agg(x, chr(10) ORDER BY k) AS text FROM (SELECT * FROM s UNION ALL SELECT * FROM s WHERE n > 1 AND k = n // 2 + 1) GROUP BY l_orderkey",
}

#: What the programs mention: (columns, other literals without a number), read off their texts.
MENTIONED = {
    "dsl_filter_eq": ("event_type", "click"), "dsl_filter_not_eq": ("event_type", "click"), "dsl_filter_greater": ("value", ""), "dsl_filter_less": ("value", ""), "dsl_greater": ("event_type value", "click"),
    "dsl_and": ("event_type", "click purchase"), "dsl_argmax": ("event_type value", "click"), "dsl_argmin": ("event_type value", "click"), "dsl_top": ("event_type value", "click"), "dsl_bottom": ("event_type value", "click"),
    "dsl_before": ("value", ""), "dsl_after": ("event_type", "click purchase"), "dsl_first": ("event_type value", "click"), "dsl_count": ("", ""), "dsl_min": ("event_type value", "click"),
    "dsl_most_freq": ("event_type", "click"), "dsl_not_within": ("event_type value", "click"),
}
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]::VARCHAR[]"
_SAID = "said AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {_TEXT(p)} AS program, {_list(MENTIONED[n][0])} AS columns, {_list(MENTIONED[n][1])} AS vals" for i, (n, p) in enumerate(zip(_NAMES, _EV, strict=True))) + ")"
ORACLES |= {
    "dsl_columns_values": f"WITH {_PICKS}, {_SAID} SELECT user_id, program, columns, vals AS values FROM picks JOIN said USING (i)",
    "dsl_set_match": f"WITH {_PICKS}, {_SAID}, d AS (SELECT user_id, program, list_sort(list_concat(columns, vals)) AS m FROM picks JOIN said USING (i)) SELECT a.user_id, a.program, b.program AS program2, "
                     "CASE WHEN len(a.m) = 0 AND len(b.m) = 0 THEN a.program = b.program ELSE a.m = b.m END::INTEGER AS match FROM d AS a JOIN d AS b ON a.user_id = b.user_id",
}
