"""Queries over whole tasks: tables that are texts, functions that are traced, what completions come to by tool mode, gold look-ups,
run summaries and tool-mode tables. Inputs are built from the driver's tables in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import text_tables
from ..functions import prompts, structures, text, tool_json, tools, trace
from ..operators import faithfulness, generation, interventions, metrics
from ..operators.faithfulness import RUN
from . import eval_queries as runs_
from .other_queries import traces
from .text_queries import CK, checklists

QUERIES, ORACLES = {}, {}

# a table text for every user, and programs for it


def user_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.concat_ws("#", "event_type", F.col("event_id").cast("string")).alias("line"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    return g.select(F.col("user_id").cast("string").alias("table_id"), F.concat(F.lit("Kind#no\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


EDITS = (
    "greater{count{filter_eq{all_rows; kind; click}}; 12}=True",
    "eq{hop{top{all_rows}; kind}; view}=False",
    "only{all_rows}",
    "eq{hop{bottom{filter_eq{all_rows; kind; purchase}}; kind}; Purchase}=True",
    "less{count{filter_eq{all_rows; kind; error}}, count{filter_eq{all_rows; kind; view}}}=True",
)
_USER = """u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') > 12 AS e0, arg_min(event_type, event_id) <> 'view' AS e1, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN true END AS e3,
count(*) FILTER (WHERE event_type = 'error') < count(*) FILTER (WHERE event_type = 'view') AS e4 FROM events GROUP BY user_id),
said AS (SELECT user_id, unnest([0, 1, 2, 3, 4]) AS edit_no, unnest([e0, e1, NULL, e3, e4]) AS verdict FROM u)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.select("user_id", F.col("user_id").cast("string").alias("table_id"), F.array(*map(F.lit, EDITS)).alias("local_edits"), (F.col("user_id") % 2 == 0).alias("gold_target"))


def _verdicts(spark, sf_dir):
    each = _asked(spark, sf_dir).select("user_id", "table_id", F.posexplode("local_edits").alias("edit_no", "program"))
    return text_tables.verdicts(each, user_tables(spark, sf_dir)).select("user_id", "edit_no", "verdict")


def _matches(spark, sf_dir):
    pairs = _asked(spark, sf_dir).select("user_id", "table_id", F.lit(EDITS[0]).alias("m"), F.get(F.array(F.lit(EDITS[0].replace("12", "13")), F.lit(EDITS[4]), F.lit(None).cast("string")), (F.col("user_id") % 3).cast("int")).alias("t"))
    return text_tables.matches(pairs, user_tables(spark, sf_dir), "m", "t").select("user_id", "execution_match", "columns_match", "values_match")


QUERIES |= {
    "tabtext_verdict": _verdicts,
    "iv_edit_pool_admission": lambda s, d: text_tables.admitted_edits(_asked(s, d), user_tables(s, d), ("user_id",)).select("user_id", "edit_no", "expected_target"),
    "eval_query_match": _matches,
}
ORACLES |= {
    "tabtext_verdict": f"WITH {_USER} SELECT user_id, edit_no::INTEGER AS edit_no, verdict FROM said",
    "iv_edit_pool_admission": f"WITH {_USER} SELECT user_id, edit_no::INTEGER AS edit_no, verdict AS expected_target FROM said WHERE verdict IS NOT NULL AND verdict <> (user_id % 2 = 0)",
    "eval_query_match": "WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n, count(*) FILTER (WHERE event_type = 'error') < count(*) FILTER (WHERE event_type = 'view') AS e4 FROM events GROUP BY user_id) "
                        "SELECT user_id, CASE user_id % 3 WHEN 0 THEN ((n > 12) = (n > 13))::INTEGER WHEN 1 THEN ((n > 12) = e4)::INTEGER END AS execution_match, CASE WHEN user_id % 3 < 2 THEN 1 END::INTEGER AS columns_match, "
                        "CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INTEGER AS values_match FROM u",
}

# tables of different columns

RAGGED = (
    "greater{count{filter_eq{all_rows; kind; click}}; 12}=True",  # a third of the tables has no such column
    "less{avg{filter_greater{all_rows; no; 100}; amount}; 50}=True",
    "eq{hop{argmax{all_rows; amount}; no}; hop{bottom{all_rows}; no}}=False",
    "third{all_rows; argmin{all_rows; no}}=False",
    "none{filter_eq{all_rows; what; hop{top{all_rows}; what}}}=False",
)


def ragged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table text for every user, under one of three headers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.round(F.col("value"), 2).alias("v"))
    no, v, k = F.col("event_id").cast("string"), F.format_string("%.2f", "v"), F.col("user_id") % 3
    line = F.when(k == 0, F.concat_ws("#", "event_type", no)).when(k == 1, F.concat_ws("#", v, no, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))).otherwise(F.concat_ws("#", no, v, "event_type"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    head = F.when(F.col("user_id") % 3 == 0, "Kind#no").when(F.col("user_id") % 3 == 1, "AMOUNT#No #kind").otherwise("no#Amount#What")
    return g.select(F.col("user_id").cast("string").alias("table_id"), F.concat(head, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def _ragged(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    each = users.select("user_id", F.col("user_id").cast("string").alias("table_id"), F.posexplode(F.array(*map(F.lit, RAGGED))).alias("edit_no", "program"))
    return text_tables.verdicts(each, ragged_tables(spark, sf_dir)).select("user_id", "edit_no", "verdict")


QUERIES["tabtext_ragged"] = _ragged
ORACLES["tabtext_ragged"] = """WITH e AS (SELECT user_id, event_id, event_type, round(value, 2) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') > 12 AS e0, avg(v) FILTER (WHERE event_id > 100) < 50 AS e1, arg_max(event_id, {'v': v, 'r': -r}) <> max(event_id) AS e2 FROM e GROUP BY user_id)
SELECT user_id, unnest([0, 1, 2, 3, 4])::INTEGER AS edit_no,
unnest([CASE WHEN user_id % 3 < 2 THEN e0 END, CASE WHEN user_id % 3 > 0 THEN e1 END, CASE WHEN user_id % 3 > 0 THEN e2 END, true, CASE WHEN user_id % 3 = 2 THEN true END]) AS verdict FROM u"""

# functions that are traced

FUNCTIONS = (
    "def f(n, s):\n    t = 0\n    for i in range(n):\n        t += i\n    return [t, s.upper()]",
    "def f(n, s):\n    while n > 3:\n        n -= 2\n    return n",
    "def g(n, s):\n    return n",
    "def f(n, s):\n    import os\n    return n",
    "def f(n, s):\n    return {c: n for c in s if c != 'x'}",
)


def _tasks(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 50).alias("n"), F.lower("o_orderstatus").alias("st"))
    call = F.concat(F.col("n").cast("string"), F.lit(", '"), F.col("st"), F.lit("'"))
    return o.select("o_orderkey", "n", "st", F.get(F.array(*map(F.lit, FUNCTIONS)), (F.col("o_orderkey") % 5).cast("int")).alias("code"), call.alias("args"))


def _recorded(spark, sf_dir):
    d = trace.admitted(_tasks(spark, sf_dir), "code", "args")
    return d.select("o_orderkey", F.col("admission.verdict").alias("verdict"), F.size("admission.trace").alias("n_steps"), F.col("admission.gold_target").alias("gold_target"))


_STEPS = "CASE o_orderkey % 5 WHEN 0 THEN 2 * n + 3 WHEN 1 THEN CASE WHEN n > 3 THEN 2 * ((n - 2) // 2) + 2 ELSE 2 END WHEN 4 THEN 1 END"
_TASKS = (f"t AS (SELECT o_orderkey, o_orderkey % 50 AS n, lower(o_orderstatus) AS st FROM orders), r AS (SELECT *, {_STEPS} AS k, CASE o_orderkey % 5 WHEN 0 THEN '[' || (n * (n - 1) // 2)::VARCHAR || ', ''' || upper(st) || ''']' "
          "WHEN 1 THEN (CASE WHEN n > 3 THEN n - 2 * ((n - 2) // 2) ELSE n END)::VARCHAR WHEN 4 THEN '{''' || st || ''': ' || n::VARCHAR || '}' END AS res FROM t), "
          "v AS (SELECT *, CASE WHEN o_orderkey % 5 = 2 THEN 'resolve' WHEN o_orderkey % 5 = 3 OR k > 80 THEN 'trace' ELSE 'kept' END AS verdict FROM r)")


def _tool_answers(spark, sf_dir):
    d = _tasks(spark, sf_dir).withColumn("code", F.lit(FUNCTIONS[1]))
    n = F.col("n").cast("string")
    said = F.get(F.array(
        F.concat(F.lit('TOOL: replay\nARGS: {"trace": "line 4:\\n  n = '), n, F.lit('"} and so on')),
        F.concat(F.lit('ARGS: ```json\n{"trace": [{"line": 4, "locals": {"n": '), n, F.lit("}}]}\n```")),
        F.lit("ARGS: none"), F.lit('ARGS: {"trace": "  "}')), (F.floor(F.col("o_orderkey") / 5) % 4).cast("int"))
    d = trace.tool_answers(d.withColumn("said", said), "said", "code").withColumn("answer", F.col("tool.answer")).withColumn("gold", F.concat(F.lit(" "), n))
    return trace.compared_answers(d, "answer", "gold").select("o_orderkey", "answer", "answer_match")


QUERIES |= {
    "trace_record": _recorded,
    "trace_admission": lambda s, d: _recorded(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
    "trace_tool_answer": _tool_answers,
}
ORACLES |= {
    "trace_record": f"WITH {_TASKS} SELECT o_orderkey, verdict, CASE WHEN verdict = 'kept' THEN k END::INTEGER AS n_steps, CASE WHEN verdict = 'kept' THEN res END AS gold_target FROM v",
    "trace_admission": f"WITH {_TASKS} SELECT verdict, count(*) AS n FROM v GROUP BY verdict",
    "trace_tool_answer": "SELECT o_orderkey, CASE WHEN o_orderkey // 5 % 4 < 2 THEN (o_orderkey % 50)::VARCHAR END AS answer, CASE WHEN o_orderkey // 5 % 4 < 2 THEN 1 END::INTEGER AS answer_match FROM orders",
}

# arguments of tool calls: (completion, the object in it, what it has under trace, the trace's text or its steps' line numbers); {n} is the order's number
ARGUMENTS = (
    ('TOOL: replay\nARGS: {"trace": "line 2: {n}"}', '{"trace": "line 2: {n}"}', "text", "line 2: {n}"),
    ('ARGS: {"trace": "line 2:\\n  x = {n}", "more": [{}]} and {so} on', '{"trace": "line 2:\\n  x = {n}", "more": [{}]}', "text", "line 2:\n  x = {n}"),
    ('args : ```json\n{"trace": [{"line": {n}, "locals": {"s": "}\\"{"}}, {"line": "3"}]}\n```', '{"trace": [{"line": {n}, "locals": {"s": "}\\"{"}}, {"line": "3"}]}', "steps", "{n},3"),
    ('ARGS: the call is {"trace": []} {"trace": "late"}', '{"trace": []}', "steps", ""),
    ('ARGS: [1] {"trace": "x"}', None, None, None), ('ARGS: "trace" {"trace": "x"}', None, None, None), ('ARGS: 12 {"trace": "x"}', None, None, None),
    ('ARGS: [1, {"trace": "in a list that never ends {n}"}', '{"trace": "in a list that never ends {n}"}', "text", "in a list that never ends {n}"),
    ('ARGS: {"trace": {"line": 1}}', '{"trace": {"line": 1}}', None, None), ('ARGS: {"steps": "x {n}"}', '{"steps": "x {n}"}', None, None),
    ('ARGS: {"trace": "never closed {n}', None, None, None), ("ARGS: {'trace': 'quoted otherwise'}", None, None, None), ('{"trace": "no arguments {n}"}', None, None, None), ("", None, None, None),
)


def _arguments(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    said = F.get(F.array(*[F.lit(a[0]) for a in ARGUMENTS]), (F.col("o_orderkey") % len(ARGUMENTS)).cast("int"))
    d = o.withColumn("block", tool_json.block(F.replace(said, F.lit("{n}"), F.col("o_orderkey").cast("string")))).withColumn("object", tool_json.object_of("block"))
    return d.select("o_orderkey", "object", tool_json.trace_kind("object").alias("kind"), F.coalesce(tool_json.trace_text("object"), F.array_join(tool_json.trace_lines("object"), ",")).alias("trace"))


_text = lambda x: "NULL" if x is None else "replace('" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{n}', o_orderkey::VARCHAR)"
QUERIES["tool_trace_arguments"] = _arguments
ORACLES["tool_trace_arguments"] = "SELECT o_orderkey, " + ", ".join(f"CASE o_orderkey % {len(ARGUMENTS)} " + " ".join(f"WHEN {i} THEN {_text(a[k])}" for i, a in enumerate(ARGUMENTS)) + f" END AS {name}" for k, name in ((1, "object"), (2, "kind"), (3, "trace"))) + " FROM orders"

QUERIES["iv_trace_edits"] = lambda s, d: trace.local_edits(traces(s, d), "text", "l_orderkey").select("l_orderkey", "level", "name")
ORACLES["iv_trace_edits"] = ("WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_returnflag FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM t GROUP BY l_orderkey), "
                             "l(level, name) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in trace.LEVELS.items() if 1 <= k <= 6) + ") SELECT l_orderkey, level, name FROM n JOIN l ON n.n > 1 OR level <= 3")


def _edit_prompts(spark, sf_dir):
    d = checklists(spark, sf_dir).withColumns({"status": structures.classify(F.lit(True), F.col("mediator"), F.col("gold")), "base": F.concat(F.lit("Order "), F.col("idx").cast("string"))})
    made = interventions.edit_prompts(interventions.checklist_edits(d, ["idx"]), d, ["idx"], "base", _BITS(F.col("mediator")), prompts.answer_prefix("averitec"))
    got = interventions.collected(d.select("idx", "status"), made.select("idx", "kind", "edit_no", "prompt"), ["idx"])
    lines = lambda kind: F.array_join(F.transform(F.col("structure_intervention")[kind], lambda x: x["prompt"]), "|")
    return got.select("idx", F.coalesce(lines(interventions.LOCAL), F.lit("")).alias("flips"), F.coalesce(lines(interventions.CORRECTION), F.lit("")).alias("fixes"))


QUERIES["iv_prompts"] = _edit_prompts
_SHOW = "'Order ' || e.idx::VARCHAR || chr(10) || chr(10) || string_agg(CASE WHEN m.pos = e.pos THEN 1 - m.a ELSE m.a END::VARCHAR, '' ORDER BY m.pos) || chr(10) || 'Final Verdict:'"
ORACLES["iv_prompts"] = (f"WITH {CK}, f AS (SELECT e.idx, e.pos, {_SHOW} AS p FROM m AS e JOIN m ON e.idx = m.idx WHERE e.idx % 10 < 6 GROUP BY e.idx, e.pos), g AS (SELECT idx, string_agg(p, '|' ORDER BY pos) AS p FROM f GROUP BY idx), "
                         f"c AS (SELECT e.idx, {_SHOW.replace('m.pos = e.pos', 'false')} AS p FROM (SELECT DISTINCT idx FROM m WHERE idx % 10 BETWEEN 6 AND 8) AS e JOIN m ON e.idx = m.idx GROUP BY e.idx) "
                         "SELECT i.idx, coalesce(g.p, '') AS flips, coalesce(c.p, '') AS fixes FROM (SELECT DISTINCT idx FROM m) AS i LEFT JOIN g ON g.idx = i.idx LEFT JOIN c ON c.idx = i.idx")

# what completions come to

_BITS = lambda c: F.array_join(F.transform(c, lambda x: F.when(x["answer"], "1").otherwise("0")), "")


def _said(spark, sf_dir):
    """A completion in each mode for every order's checklist: answers as gold has them, or the first one flipped, or none."""
    d = checklists(spark, sf_dir)
    lines = F.array_join(F.transform("mediator", lambda x: F.concat(x["item"], F.lit(" (True/False): "), F.when(x["answer"], "True").otherwise("False"))), "\\n")
    bools = F.array_join(F.transform("mediator", lambda x: F.when(x["answer"], "True").otherwise("False")), ", ")
    call = lambda v: F.concat(F.lit('TOOL: t\nARGS: {"rubric": '), v, F.lit("}"))
    quoted = lambda prefix: F.concat(F.lit('"'), prefix, lines, F.lit('"'))
    return d.withColumns({"plain": F.concat(F.lit("Final grade (0-9): "), (F.col("idx") % 7).cast("string"), F.lit(".5\nFinal Verdict: "), F.col("gold_target")), "simple": call(quoted(F.lit(""))),
                          "question": call(F.concat(F.lit('"'), F.regexp_replace(lines, r"line ", "Q: line "), F.lit('"'))), "structured": call(F.concat(F.lit("["), bools, F.lit("]")))})


def _rice(spark, sf_dir):
    d = _said(spark, sf_dir)
    out = {mode: tools.graded(F.col({"none": "plain"}.get(mode, mode)), F.col("gold"), F.col("weights"), mode) for mode in tools.MODES}
    return d.select("idx", *[v[0].alias(f"score_{m}") for m, v in out.items()], _BITS(out["structured"][1]).alias("call"))


def _averitec(spark, sf_dir):
    d = _said(spark, sf_dir)
    out = {mode: tools.judged(F.col({"none": "plain", "simple": "question"}.get(mode, mode)), F.col("gold"), F.col("gold_target"), mode) for mode in tools.MODES}
    return d.select("idx", *[v[0].alias(f"verdict_{m}") for m, v in out.items()])


def _tabfact(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("user_id", "table_id", F.explode("local_edits").alias("q"), F.col("gold_target"))
    plain = tools.queried(F.concat(F.lit("Execution Result: "), F.when(F.col("gold_target"), "True").otherwise("False")))
    call = tools.queried(F.concat(F.lit('TOOL: run_query\nARGS: {"query": "'), F.col("q"), F.lit('"}')), "simple")
    d = asked.select("user_id", "table_id", plain[0].alias("said"), call[1].alias("program"))
    return text_tables.verdicts(d, user_tables(spark, sf_dir), out="tool_target").groupBy("user_id").agg(
        F.count("program").alias("n_calls"), F.count_if("tool_target").alias("n_true"), F.count_if(~F.col("tool_target")).alias("n_false"), F.max("said").alias("said"))


def _valid(spark, sf_dir):
    d = checklists(spark, sf_dir)
    holes = F.transform("gold", lambda x, i: F.when((i > 0) | (F.col("idx") % 2 == 0), x["answer"]))
    query = F.concat(F.lit("only{all_rows}"), F.get(F.array(F.lit("=True"), F.lit("=False"), F.lit("=true"), F.lit("")), (F.col("idx") % 4).cast("int")))
    steps = F.transform("gold", lambda x: F.struct(F.when(F.col("idx") % 3 > 0, x["pos"]).alias("line"), F.array().cast("array<struct<name:string,repr:string>>").alias("locals")))
    return d.select("idx", tools.valid_bools(holes).alias("bools"), tools.valid_checklist(F.col("mediator")).alias("checklist"), tools.valid_query(query).alias("query"), tools.valid_trace(steps).alias("trace"),
                    tools.valid_trace_text(F.when(F.col("idx") % 2 == 0, " x").otherwise(" ")).alias("trace_text"))


def _compared(spark, sf_dir):
    d = checklists(spark, sf_dir)
    status = structures.classify((F.col("idx") % 11 > 0), F.col("mediator"), F.col("gold"), F.when(F.col("idx") % 13 > 0, F.col("gold_target")))
    return d.select("idx", structures.compare_structures(F.col("mediator"), F.reverse("gold")).alias("same"), status.alias("status"))


_PER = "p AS (SELECT idx, sum(b * n * 0.5)::DOUBLE AS score, bool_and(a = b) AS same, string_agg(b::VARCHAR, '' ORDER BY pos) AS bits, CASE WHEN idx % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS g FROM m GROUP BY idx)"
_TOOLED = "CASE WHEN same THEN g WHEN NOT same THEN CASE g WHEN 'Supported' THEN 'Refuted' ELSE 'Supported' END END"
QUERIES |= {"infer_ricechem": _rice, "infer_averitec": _averitec, "infer_tabfact": _tabfact, "tool_valid_arguments": _valid, "cmp_structures": lambda s, d: _compared(s, d).select("idx", "same"),
            "classify_generation": lambda s, d: _compared(s, d).select("idx", "status")}
ORACLES |= {
    "infer_ricechem": f"WITH {CK}, {_PER} SELECT idx, (idx % 7) + 0.5::DOUBLE AS score_none, score AS score_simple, score AS score_structured, bits AS call FROM p",
    "infer_averitec": f"WITH {CK}, {_PER} SELECT idx, g AS verdict_none, {_TOOLED} AS verdict_simple, {_TOOLED} AS verdict_structured FROM p",
    "infer_tabfact": f"WITH {_USER} SELECT user_id, 4::BIGINT AS n_calls, count(*) FILTER (WHERE verdict) AS n_true, count(*) FILTER (WHERE NOT verdict) AS n_false, user_id % 2 = 0 AS said FROM said GROUP BY user_id",
    "tool_valid_arguments": f"WITH {CK}, {_PER} SELECT idx, idx % 2 = 0 AS bools, idx % 10 < 9 AS checklist, idx % 4 < 2 AS query, idx % 3 > 0 AS trace, idx % 2 = 0 AS trace_text FROM p",
    "cmp_structures": f"WITH {CK}, {_PER} SELECT idx, same::INTEGER AS same FROM p",
    "classify_generation": f"WITH {CK}, {_PER} SELECT idx, CASE WHEN idx % 11 = 0 OR same IS NULL OR idx % 13 = 0 THEN 'error' WHEN same THEN 'correct' ELSE 'incorrect' END AS status FROM p",
}


def _legacy(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey").cast("string")
    t = F.concat(F.lit("- Q: is order "), k, F.lit(" open? A: "), F.when(F.col("o_orderstatus") == "O", "Yes (as seen)").otherwise("no"), F.lit("\nnot a question\nQ: large? A: NO\nQ: large? A: yes.\nFinal verdict: Supported\nQ: late? A: yes"))
    return o.select("o_orderkey", F.array_join(F.transform(text.questions_answered(t), lambda x: F.concat_ws("=", x["question"], x["answer"])), ";").alias("answers"))


QUERIES["txt_questions_answered"] = _legacy
ORACLES["txt_questions_answered"] = "SELECT o_orderkey, 'is order ' || o_orderkey::VARCHAR || ' open?=' || CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'no' END || ';large?=yes' AS answers FROM orders"

# prompts and completions


def _prompts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("sample"))
    made = {f"{n}_{m}": prompts.dataset_prompt(n, F.col("sample"), "detailed", m) for n, m in (*tools.SPECS, *((n, "none") for n in prompts.TASKS))}
    return d.select("o_orderkey", *[v.alias(k) for k, v in made.items()], *[prompts.baseline_prompt(n, F.col("sample")).alias(f"{n}_baseline") for n in prompts.BASELINE_PREFIX])


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql(n: str, m: str) -> str:
    head = "\n\n".join([prompts.instruction(n, m), prompts.REGIMES["detailed"], *prompts.few_shot(n, m)])
    return f"{_quoted(head)} || chr(10) || chr(10) || sample AS {n}_{m}"


QUERIES["prompt_dataset"] = _prompts
ORACLES["prompt_dataset"] = ("SELECT o_orderkey, " + ", ".join(_prompt_sql(n, m) for n, m in (*tools.SPECS, *((n, "none") for n in prompts.TASKS))) + ", "
                             + ", ".join(f"{_quoted(prompts.TASKS[n][0] + ' Give the answer alone.')} || chr(10) || chr(10) || sample || chr(10) || chr(10) || '{p}' AS {n}_baseline" for n, p in prompts.BASELINE_PREFIX.items())
                             + " FROM (SELECT o_orderkey, 'Order ' || o_orderkey::VARCHAR AS sample FROM orders)")
QUERIES["gen_stub"] = lambda s, d: generation.generated(_prompts(s, d).select("o_orderkey", F.col("averitec_baseline").alias("p")), "p", generation.echo, 7).select("o_orderkey", "completion")
ORACLES["gen_stub"] = "SELECT o_orderkey, 'Verdict:' AS completion FROM orders"

# gold look-ups and run summaries

_HALF = "SELECT doc_id AS idx, 'q' || doc_id::VARCHAR AS gold_query, quality = 1 AS gold_target FROM labels WHERE doc_id % 2 = 0"


def _gold(spark, sf_dir):
    gold = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("idx"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("gold_query"), (F.col("quality") == 1).alias("gold_target"))
    return metrics.with_gold(runs_.runs(spark, sf_dir).filter("dataset = 'tabfact'").select("model", "run_type", "idx"), gold, "idx", metrics.UNKNOWN_TABLE_SAMPLE)


def _eligible(spark, sf_dir):
    d = checklists(spark, sf_dir).withColumn("target", structures.verdict(F.col("mediator"), F.col("gold"), F.col("gold_target")))
    return d.select("idx", metrics.flips_are_decided(F.col("target"), F.col("mediator")).alias("eligible"))


def _unknown(spark, sf_dir):
    d = runs_.runs(spark, sf_dir).withColumn("status", F.when(F.col("idx") % 5 == 0, F.lit("other")).otherwise(F.col("status")))
    left = metrics.counts(metrics.known_status(d), RUN).select(*RUN, "n_total", "n_error")
    return left.join(metrics.counts(metrics.known_status(d, unknown="error"), RUN).select(*RUN, F.col("n_total").alias("all_total"), F.col("n_error").alias("all_error")), RUN)


_G = "dataset, run_type, model"
_RUNS = "WITH runs AS (" + runs_.RUNS.replace("$labels", "labels") + ")"
QUERIES |= {
    "eval_gold_lookup": _gold, "eval_le_eligible": _eligible, "eval_unknown_status": _unknown,
    "eval_run_meta": lambda s, d: metrics.run_meta(runs_.runs(s, d), RUN),
}
ORACLES |= {
    "eval_gold_lookup": f"{_RUNS}, h AS ({_HALF}) SELECT model, run_type, runs.idx, coalesce(gold_query, '') AS gold_query, coalesce(gold_target, true) AS gold_target FROM runs LEFT JOIN h ON runs.idx = h.idx WHERE dataset = 'tabfact'",
    "eval_le_eligible": f"WITH {CK}, {_PER}, k AS (SELECT idx, count(*) AS n FROM m GROUP BY idx) SELECT idx, coalesce({_TOOLED} = 'Supported', false) OR (same IS NOT NULL AND n = 1) AS eligible FROM p JOIN k USING (idx)",
    "eval_unknown_status": f"{_RUNS} SELECT {_G}, count(*) FILTER (WHERE idx % 5 <> 0) AS n_total, count(*) FILTER (WHERE idx % 5 <> 0 AND status = 'error') AS n_error, count(*) AS all_total, count(*) FILTER (WHERE idx % 5 = 0 OR status = 'error') AS all_error FROM runs GROUP BY ALL",
    "eval_run_meta": f"{_RUNS}, n AS (SELECT {_G}, count(*) AS t, count(*) FILTER (WHERE status = 'correct') AS c, count(*) FILTER (WHERE status = 'incorrect') AS i, count(*) FILTER (WHERE status = 'error') AS e FROM runs GROUP BY ALL) "
                     f"SELECT {_G}, t AS total_samples, c AS n_correct, i AS n_incorrect, e AS n_error, round(c / greatest(c + i, 1), 3) AS correct_rate, round(i / greatest(c + i, 1), 3) AS incorrect_rate, round(e / greatest(t, 1), 3) AS error_rate FROM n",
}

# tool-mode tables, names and slots


def _tool_facts(spark, sf_dir):
    r = runs_.runs(spark, sf_dir).withColumn("f_tool_before", F.when(F.col("idx") % 4 > 0, F.col("f_before")))
    e = runs_.edits(r).withColumn("f_tool_after", F.when(F.col("idx") % 3 > 0, F.col("f_after")).otherwise(1 - F.col("f_after")))
    return faithfulness.tool_facts(r, e, F.expr(runs_.ORDER)).groupBy(*RUN).agg(*[F.count_if(c).alias(c) for c in ("f_id", "f_ood", "f_strong")])


def _shown(spark, sf_dir):
    keys = [*faithfulness.MODEL_NAMES, "other"]
    d = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.get(F.array(*map(F.lit, keys)), (F.col("doc_id") % len(keys)).cast("int")).alias("model"), F.get(F.array(F.lit("tabfact"), F.lit("cruxeval")), (F.col("doc_id") % 2).cast("int")).alias("dataset"))
    d = faithfulness.shown(faithfulness.shown(d, "model", faithfulness.MODEL_NAMES, faithfulness.HIDDEN_MODELS), "dataset", faithfulness.DATASET_NAMES)
    return d.groupBy("model", "model_order", "dataset", "dataset_order").agg(F.count(F.lit(1)).alias("n"))


_NAMES = ", ".join(f"('{k}', '{v}', {i}, {i})" for i, (k, v) in enumerate([*faithfulness.MODEL_NAMES.items(), ("other", "other")]))
QUERIES |= {
    "an_tool_facts": _tool_facts, "an_shown_names": _shown,
    "an_tool_table": lambda s, d: faithfulness.tool_table(runs_.facts(s, d)).select("dataset", *[F.round(c, 6).alias(c) for c in ("standard", "tool", "delta")]),
    "an_slot": lambda s, d: faithfulness.in_slot(runs_.runs(s, d), "averitec", "detailed").groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("s"), F.count_if(F.col("status") == "correct").alias("n_correct")),
}
ORACLES |= {
    "an_tool_facts": runs_._WITH + f", t AS (SELECT r.dataset, r.run_type, r.model, status <> 'error' AND coalesce(f_before = CASE WHEN r.idx % 4 > 0 THEN f_before END, false) AS f_id, status <> 'error' AND kind IS NOT NULL AND r.idx % 3 > 0 AS f_ood "
                     f"FROM runs r LEFT JOIN one o ON r.dataset = o.dataset AND r.model = o.model AND r.run_type = o.run_type AND r.idx = o.idx) SELECT {_G}, count(*) FILTER (WHERE f_id) AS f_id, count(*) FILTER (WHERE f_ood) AS f_ood, count(*) FILTER (WHERE f_id AND f_ood) AS f_strong FROM t GROUP BY {_G}",
    "an_tool_table": runs_._WITH + ", d AS (SELECT dataset, model, round(avg(f_strong::INT) FILTER (WHERE run_type = 'standard'), 2) AS s, round(avg(f_strong::INT) FILTER (WHERE run_type = 'tool'), 2) AS t FROM facts GROUP BY dataset, model) "
                     "SELECT dataset, round(avg(s), 6) AS standard, round(avg(t), 6) AS tool, round(avg(s - t), 6) AS delta FROM d GROUP BY dataset",
    "an_shown_names": f"WITH names(k, shown, o, i) AS (VALUES {_NAMES}) SELECT shown AS model, o::INTEGER AS model_order, CASE doc_id % 2 WHEN 0 THEN 'TabFact' ELSE 'cruxeval' END AS dataset, CASE doc_id % 2 WHEN 0 THEN 2 ELSE 3 END::INTEGER AS dataset_order, count(*) AS n "
                      f"FROM labels JOIN names ON doc_id % {len(faithfulness.MODEL_NAMES) + 1} = i WHERE k <> 'llama32-1B' GROUP BY ALL",
    "an_slot": f"{_RUNS} SELECT dataset, CASE WHEN dataset = 'averitec' AND run_type = 'detailed' THEN 'standard' ELSE run_type END AS run_type, model, count(*) AS n, sum(idx)::BIGINT AS s, count(*) FILTER (WHERE status = 'correct') AS n_correct "
               "FROM runs WHERE NOT (dataset = 'averitec' AND run_type = 'standard') GROUP BY ALL",
}

# edits from a pool, a sample of edits, and samples that count as errors


def _sampled(spark, sf_dir):
    d = checklists(spark, sf_dir).withColumn("status", structures.classify(F.lit(True), F.col("mediator"), F.col("gold")))
    return interventions.sampled(interventions.checklist_edits(d, ["idx"]), ["idx"], 2, 7).groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edit_no").alias("n_distinct"))


def _pooled(spark, sf_dir):
    r = runs_.runs(spark, sf_dir).filter("dataset = 'tabfact' AND run_type = 'standard' AND model = 'noisy'")
    pool = r.select("idx", F.explode(F.sequence(F.lit(0), F.col("idx") % 3)).alias("edit_no")).withColumn("query", F.concat(F.lit("q"), F.col("edit_no").cast("string")))
    return interventions.pool_edits(r, pool, "idx").select("idx", "kind", F.col("edit_no").cast("int").alias("edit_no"), "query")


def _filtered(spark, sf_dir):
    d = runs_.runs(spark, sf_dir).withColumn("status", faithfulness.filtered_status(F.col("idx") % 4, F.col("idx") % 3, F.col("status"), F.col("dataset")))
    return d.groupBy(*RUN).agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("correct", "incorrect", "error")])


_MOVED = "dataset = 'averitec' AND status = 'incorrect' AND idx % 4 <> idx % 3"
QUERIES |= {"iv_sampled_edits": _sampled, "iv_pool_edits": _pooled, "an_filter_sample": _filtered}
ORACLES |= {
    "iv_sampled_edits": f"WITH {CK}, p AS (SELECT idx, CASE WHEN idx % 10 < 6 THEN least(count(*), 2) ELSE 1 END AS n FROM m WHERE idx % 10 < 9 GROUP BY idx) SELECT idx, n, n AS n_distinct FROM p",
    "iv_pool_edits": f"{_RUNS} SELECT idx, 'Local Edits' AS kind, e::INTEGER AS edit_no, 'q' || e::VARCHAR AS query FROM runs, unnest(range(idx % 3 + 1)) AS t(e) WHERE dataset = 'tabfact' AND run_type = 'standard' AND model = 'noisy' AND status = 'correct'",
    "an_filter_sample": f"{_RUNS} SELECT {_G}, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect' AND NOT ({_MOVED})) AS incorrect, count(*) FILTER (WHERE status = 'error' OR ({_MOVED})) AS error FROM runs GROUP BY ALL",
}
