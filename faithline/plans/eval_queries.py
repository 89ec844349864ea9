"""Queries over synthetic runs. One SQL text makes the runs from ``labels`` in either engine: a faithful model answers what
its structure says, a stubborn one keeps to its first answer, a noisy one strays on a hash of the sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import faithfulness, metrics
from ..operators.faithfulness import RUN
from ..sources import sinks

_MODELS = ", ".join(f"('{d}', '{m}', '{r}', {i * 12 + j * 4 + k})" for i, d in enumerate(("averitec", "tabfact")) for j, m in enumerate(("faithful", "stubborn", "noisy")) for k, r in enumerate(("standard", "detailed", "max_detailed", "tool")))
RUNS = f"""
SELECT dataset, model, run_type, idx, gold, h, status, f_before,
       CASE WHEN status = 'error' THEN NULL WHEN model = 'faithful' THEN f_before WHEN model = 'stubborn' THEN gold WHEN h % 10 = 0 THEN 1 - f_before ELSE f_before END AS y_before
FROM (SELECT *, CASE status WHEN 'correct' THEN gold WHEN 'incorrect' THEN 1 - gold END AS f_before
      FROM (SELECT *, CASE WHEN h < 50 THEN 'error' WHEN h < 250 + k * 5 THEN 'incorrect' ELSE 'correct' END AS status
            FROM (SELECT dataset, model, run_type, k, doc_id AS idx, quality AS gold, (doc_id * 7919 + k * 104729) % 1000 AS h
                  FROM $labels CROSS JOIN (VALUES {_MODELS}) AS m(dataset, model, run_type, k)) AS t) AS u) AS w
"""
EDITS = """
SELECT dataset, model, run_type, idx, kind, edit_no, f_after,
       CASE WHEN model = 'faithful' THEN f_after WHEN model = 'stubborn' THEN y_before WHEN (h + edit_no * 37) % 4 = 0 THEN 1 - f_after ELSE f_after END AS y_after
FROM (SELECT r.*, edit_no, CASE status WHEN 'correct' THEN 'Local Edits' ELSE 'Correction' END AS kind, CASE status WHEN 'correct' THEN 1 - gold ELSE gold END AS f_after
      FROM $runs AS r JOIN (VALUES (0), (1), (2)) AS e(edit_no) ON (status = 'correct' AND edit_no <= idx % 3) OR (status = 'incorrect' AND edit_no = 0)) AS t
"""
BASELINE = """
SELECT dataset, model, idx, gold, CASE WHEN h % 9 = 0 THEN NULL WHEN h % 5 = 0 THEN 1 - gold ELSE gold END AS predicted FROM $runs WHERE run_type = 'standard'
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS.replace("$labels", "{labels}"), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def edits(r: DataFrame) -> DataFrame:
    return r.sparkSession.sql(EDITS.replace("$runs", "{runs}"), runs=r)


def baseline(r: DataFrame) -> DataFrame:
    return r.sparkSession.sql(BASELINE.replace("$runs", "{runs}"), runs=r)


#: A hash that both engines compute, to pick one edit.
ORDER = "(idx * 97 + edit_no * 31) % 1009"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return faithfulness.fact_table(r, edits(r), F.expr(ORDER))


_WITH = "WITH runs AS (" + RUNS.replace("$labels", "labels") + "), edits AS (" + EDITS.replace("$runs", "runs") + "), base AS (" + BASELINE.replace("$runs", "runs") + """),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, run_type, idx ORDER BY kind <> 'Local Edits', (idx * 97 + edit_no * 31) % 1009, edit_no) AS n FROM edits) WHERE n = 1),
facts AS (SELECT r.dataset, r.run_type, r.model, r.idx, status <> 'error' AND coalesce(f_before = y_before, false) AS f_id, status <> 'error' AND kind IS NOT NULL AND coalesce(f_after = y_after, false) AS f_ood,
          status <> 'error' AND kind IS NOT NULL AND coalesce(f_before = y_before, false) AND coalesce(f_after = y_after, false) AS f_strong,
          CASE WHEN kind = 'Local Edits' THEN 'counterfact' WHEN kind IS NOT NULL THEN 'correction' ELSE 'no_intervention' END AS type
          FROM runs r LEFT JOIN one o ON r.dataset = o.dataset AND r.model = o.model AND r.run_type = o.run_type AND r.idx = o.idx) """
_G = "dataset, run_type, model"

QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, _WITH + sql


_hit = lambda: F.when(F.col("status") != "error", (F.col("y_before") == F.col("gold")).cast("int"))
_add("eval_summarize", lambda s, d: metrics.summarize(runs(s, d).withColumn("x", _hit()), "x", RUN).withColumn("std", F.round("std", 6)),
     f"SELECT {_G}, avg(x) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n_total, count(x) AS n_valid, count(*) - count(x) AS n_none FROM (SELECT *, CASE WHEN status <> 'error' THEN (y_before = gold)::INT END AS x FROM runs) GROUP BY {_G}")
for _over, _sql in ((False, "count(*) FILTER (WHERE status <> 'error')"), (True, "count(*)")):
    _add("eval_counts_all" if _over else "eval_counts", lambda s, d, o=_over: metrics.counts(runs(s, d), RUN, over_all=o),
         f"SELECT {_G}, count(*) AS n_total, count(*) FILTER (WHERE status = 'correct') AS n_correct, count(*) FILTER (WHERE status = 'incorrect') AS n_incorrect, count(*) FILTER (WHERE status = 'error') AS n_error, "
         f"count(*) FILTER (WHERE status = 'correct') / {_sql} AS correct_rate, count(*) FILTER (WHERE status = 'incorrect') / {_sql} AS incorrect_rate, count(*) FILTER (WHERE status = 'error') / count(*) AS error_rate FROM runs GROUP BY {_G}")
_add("eval_perf_match", lambda s, d: runs(s, d).groupBy(*RUN).agg(metrics.rate(F.col("status") == "correct").alias("structure_match"), metrics.rate(F.col("y_before") == F.col("gold")).alias("target_match")),
     f"SELECT {_G}, avg((status = 'correct')::INT) AS structure_match, avg(coalesce((y_before = gold)::INT, 0)) AS target_match FROM runs GROUP BY {_G}")
for _name, _kind in (("eval_faith_local_edits", "Local Edits"), ("eval_faith_correction", "Correction")):
    _add(_name, lambda s, d, k=_kind: faithfulness.edits_mean(edits(runs(s, d)).filter(F.col("kind") == k), RUN),
         f"SELECT {_G}, kind, avg(coalesce((f_after = y_after)::INT, 0)) AS follow_rate, count(*) AS n FROM edits WHERE kind = '{_kind}' GROUP BY {_G}, kind")
_add("eval_mediator_tool", lambda s, d: runs(s, d).filter("run_type = 'tool'").groupBy(*RUN).agg(metrics.rate(F.col("f_before") == F.col("y_before")).alias("mediator_tool_match"), F.count("y_before").alias("n_calls")),
     f"SELECT {_G}, avg(coalesce((f_before = y_before)::INT, 0)) AS mediator_tool_match, count(y_before) AS n_calls FROM runs WHERE run_type = 'tool' GROUP BY {_G}")
_add("eval_by_level", lambda s, d: edits(runs(s, d)).groupBy(*RUN, F.concat(F.lit("L"), (F.col("edit_no") + 1).cast("string")).alias("level")).agg(metrics.rate(F.col("f_after") == F.col("y_after")).alias("s")),
     f"SELECT {_G}, 'L' || (edit_no + 1)::VARCHAR AS level, avg(coalesce((f_after = y_after)::INT, 0)) AS s FROM edits GROUP BY {_G}, edit_no")
_add("eval_baseline", lambda s, d: metrics.baseline(baseline(runs(s, d)), ["dataset", "model"], "predicted", "gold", 0.01),
     "SELECT dataset, model, count(*) AS n_total, count(predicted) AS n_parsed, count(*) - count(predicted) AS n_parse_error, count(predicted) / count(*) AS parse_rate, count(*) FILTER (WHERE predicted = gold) / count(predicted) AS accuracy, "
     "count(*) FILTER (WHERE predicted = gold) / count(*) AS accuracy_total, avg(abs(predicted - gold)) AS mae FROM base GROUP BY ALL")
_add("eval_baseline_per_label", lambda s, d: metrics.baseline(baseline(runs(s, d)), ["dataset", "model", "gold"], "predicted", "gold"),
     "SELECT dataset, model, gold, count(*) AS n_total, count(predicted) AS n_parsed, count(*) - count(predicted) AS n_parse_error, count(predicted) / count(*) AS parse_rate, count(*) FILTER (WHERE predicted = gold) / count(predicted) AS accuracy, "
     "count(*) FILTER (WHERE predicted = gold) / count(*) AS accuracy_total FROM base GROUP BY dataset, model, gold")
_add("eval_macro_f1", lambda s, d: metrics.macro_f1(baseline(runs(s, d)), ["dataset", "model"], "predicted", "gold").withColumn("macro_f1", F.round("macro_f1", 9)),
     "SELECT dataset, model, round(avg(f), 9) AS macro_f1 FROM (SELECT b.dataset, b.model, l, 2 * count(*) FILTER (WHERE predicted = l AND gold = l) / (count(*) FILTER (WHERE gold = l) + count(*) FILTER (WHERE predicted = l)) AS f "
     "FROM base b, (VALUES (0), (1)) AS t(l) GROUP BY ALL HAVING count(*) FILTER (WHERE gold = l) > 0) GROUP BY dataset, model")
_add("an_fact_table", facts, "SELECT * FROM facts")
_add("an_f_id", lambda s, d: facts(s, d).groupBy(*RUN).agg(F.avg(F.col("f_id").cast("int")).alias("f_id")), f"SELECT {_G}, avg(f_id::INT) AS f_id FROM facts GROUP BY {_G}")
_add("an_f_ood_strong", lambda s, d: facts(s, d).groupBy(*RUN).agg(F.avg(F.col("f_ood").cast("int")).alias("f_ood"), F.avg(F.col("f_strong").cast("int")).alias("f_strong")),
     f"SELECT {_G}, avg(f_ood::INT) AS f_ood, avg(f_strong::INT) AS f_strong FROM facts GROUP BY {_G}")
_mean = lambda c, d: f"round_even(avg({c}::INT) FILTER (WHERE dataset = '{d}') * 100, 0) / 100"
_piv = ", ".join([*(f"{_mean('f_' + c, d)} AS {d}_{c}" for d in ("averitec", "tabfact") for c in ("id", "ood", "strong")), *(f"round_even(({_mean('f_id', d)} - {_mean('f_strong', d)}) * 100, 0) / 100 AS {d}_delta" for d in ("averitec", "tabfact"))])
_add("an_faith_table", lambda s, d: faithfulness.faith_table(facts(s, d).filter("run_type = 'standard'"), ["averitec", "tabfact"]), f"SELECT model, {_piv} FROM facts WHERE run_type = 'standard' GROUP BY model")
_add("an_accuracy", lambda s, d: (lambda r: faithfulness.accuracy_table(r, baseline(r)))(runs(s, d)),
     f"SELECT r.dataset, r.run_type, r.model, avg(coalesce((y_before = r.gold)::INT, 0)) AS acc_with_m, avg(coalesce((predicted = b.gold)::INT, 0)) AS acc_baseline, avg((y_before = predicted)::INT) AS agreement, count((y_before = predicted)::INT) AS n_pairs "
     "FROM runs r JOIN base b ON r.dataset = b.dataset AND r.model = b.model AND r.idx = b.idx GROUP BY ALL")
_add("an_agreement", lambda s, d: (lambda r: faithfulness.agreement(r, baseline(r)))(runs(s, d)),
     "SELECT r.dataset, r.run_type, r.model, avg((y_before = predicted)::INT) AS agreement, count(*) AS n_pairs FROM runs r JOIN base b ON r.dataset = b.dataset AND r.model = b.model AND r.idx = b.idx WHERE y_before IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of one dataset as graded answers, some of them off by a little, some by too much."""
    off = F.col("idx") % 3 * 0.006
    return runs(spark, sf_dir).filter("dataset = 'tabfact'").withColumns({"dataset": F.lit("ricechem"), "y_before": F.col("y_before") + off, "gold": F.col("gold").cast("double")})


_add("an_graded_accuracy", lambda s, d: faithfulness.accuracy_table(graded(s, d), baseline(runs(s, d)).filter("dataset = 'tabfact'").withColumn("dataset", F.lit("ricechem"))),
     "SELECT 'ricechem' AS dataset, r.run_type, r.model, avg(coalesce((y_before = r.gold AND r.idx % 3 < 2)::INT, 0)) AS acc_with_m, avg(coalesce((predicted = b.gold)::INT, 0)) AS acc_baseline, "
     "avg((y_before = predicted AND r.idx % 3 < 2)::INT) FILTER (WHERE y_before IS NOT NULL AND predicted IS NOT NULL) AS agreement, count(y_before + predicted) AS n_pairs "
     "FROM runs r JOIN base b ON r.dataset = b.dataset AND r.model = b.model AND r.idx = b.idx WHERE r.dataset = 'tabfact' GROUP BY ALL")
_add("an_prompt_pivot", lambda s, d: faithfulness.prompt_pivot(facts(s, d), ["standard", "detailed", "max_detailed"]),
     "SELECT model, dataset, " + ", ".join(f"avg(f_strong::INT) FILTER (WHERE run_type = '{r}') AS {r}" for r in ("standard", "detailed", "max_detailed")) + " FROM facts GROUP BY model, dataset")
_add("an_prompt_summary", lambda s, d: faithfulness.prompt_summary(facts(s, d)).select("dataset", "run_type", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std")),
     f"SELECT dataset, run_type, round(avg(m), 9) AS mean, round(stddev_samp(m), 6) AS std FROM (SELECT {_G}, avg(f_strong::INT) AS m FROM facts GROUP BY {_G}) GROUP BY dataset, run_type")
_add("an_symmetry", lambda s, d: faithfulness.symmetry(facts(s, d)),
     f"SELECT {_G}, " + ", ".join(f"avg(f_strong::INT) FILTER (WHERE type = '{t}') AS {t}, count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in ("correction", "counterfact")) + f" FROM facts GROUP BY {_G} HAVING n_correction > 10 AND n_counterfact > 10")
_add("an_tool_delta", lambda s, d: faithfulness.tool_delta(facts(s, d)),
     "SELECT dataset, model, avg(f_strong::INT) FILTER (WHERE run_type = 'standard') AS standard, avg(f_strong::INT) FILTER (WHERE run_type = 'tool') AS tool, "
     "avg(f_strong::INT) FILTER (WHERE run_type = 'tool') - avg(f_strong::INT) FILTER (WHERE run_type = 'standard') AS delta FROM facts GROUP BY dataset, model")
_ANCHORS = ((0.0, 0.26, "5DBB89", "D3CF70"), (0.26, 0.36, "D3CF70", "FFD466"), (0.36, 0.65, "FFD466", "EB8C70"))
_part = lambda h, k: int(h[2 * k : 2 * k + 2], 16)
_channel = lambda k: "CASE " + " ".join(f"WHEN d <= {hi}::DOUBLE THEN round_even({_part(a, k)}::DOUBLE + (d - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE) * {_part(b, k) - _part(a, k)}, 0)::INTEGER" for lo, hi, a, b in _ANCHORS) + f" ELSE {_part('EB8C70', k)} END"
QUERIES["an_delta_colour"] = lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", sinks.colour((F.col("o_orderkey") % 131 - 15) / 100).alias("colour"))
ORACLES["an_delta_colour"] = f"SELECT o_orderkey, printf('%02X%02X%02X', {', '.join(map(_channel, range(3)))}) AS colour FROM (SELECT o_orderkey, least(greatest((o_orderkey % 131 - 15) / 100, 0), 1)::DOUBLE AS d FROM orders)"
QUERIES["an_latest_run"] = lambda s, d: faithfulness.latest(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
ORACLES["an_latest_run"] = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL"
