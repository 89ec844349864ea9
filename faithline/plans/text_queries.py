"""Queries over completions, which one SQL text builds from ``orders`` in either engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl import values
from ..functions import prompts, sql, structures, text
from ..operators import interventions

_A = "CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END"
_B = "CASE WHEN o_totalprice > 150000 THEN 'yes' ELSE 'No' END"
_V = "CASE WHEN o_orderkey % 3 = 0 THEN 'SUPPORTED' WHEN o_orderkey % 3 = 1 THEN 'refuted' ELSE 'Supported' END"
_L = "'Checklist:' || chr(10) || '- Q: is it open (True/False): ' || a || chr(10) || 'Q: is it dear? - ' || b || chr(10) || '- Q: is it open: ' || a2"
COMPLETIONS = f"""
SELECT idx, k, a, b, a2, v, g, CASE k
  WHEN 0 THEN {_L} || chr(10) || chr(10) || 'Final Verdict: ' || v || chr(10) || 'Final grade (0-8): ' || g
  WHEN 1 THEN '<|im_start|> ' || {_L} || chr(10) || 'Final verdict - ' || v || '</s>'
  WHEN 2 THEN 'Sure! ' || {_L} || chr(10) || 'final grade: ' || g || ' points'
  WHEN 3 THEN ' ' || v || ' '
  WHEN 4 THEN ' ' || g || ' '
  WHEN 5 THEN 'Verifier Query: eq{{count{{all_rows}}; ' || g || '}}=True' || chr(10) || 'Execution Result: ' || a
  WHEN 6 THEN 'TOOL: score' || chr(10) || 'ARGS: {{"rubric": [' || a || ', ' || a2 || ', maybe]}}'
  WHEN 7 THEN 'TOOL: score' || chr(10) || 'ARGS: {{"rubric": [' || a || ', ' || a2 || ']}}'
  ELSE '' END AS completion
FROM (SELECT o_orderkey AS idx, CAST(o_orderkey % 9 AS INT) AS k, {_A} AS a, {_B} AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS a2, {_V} AS v,
      CAST(CAST(o_orderkey % 7 AS INT) AS VARCHAR(9)) || '.5' AS g FROM $orders) AS t
"""
ORACLE_C = f"c AS ({COMPLETIONS.replace('$orders', 'orders')})"


def _spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The shared SQL over the orders table, in Spark's spelling."""
    sql = sql.replace("VARCHAR(9)", "STRING").replace("{", "{{").replace("}", "}}").replace("$orders", "{orders}")
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(spark, sf_dir, COMPLETIONS)


def _select(*columns):
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        return completions(spark, sf_dir).select("idx", *[c() for c in columns])
    return go


C = lambda: F.col("completion")
QUERIES, ORACLES = {}, {}


def _add(name: str, columns: dict, sql: str) -> None:
    QUERIES[name] = _select(*[lambda c=c, n=n: c().alias(n) for n, c in columns.items()])
    ORACLES[name] = f"WITH {ORACLE_C} {sql}"


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_CLEAN = _TRIM.format(r"regexp_replace(completion, '<\|im_end\|>|<\|im_start\|>|</s>', '', 'g')")
_X = lambda p, g=1: f"CASE WHEN regexp_matches(completion, '{p}') THEN regexp_extract(completion, '{p}', {g}) END"
_VP, _GP = r"(?i)final\s*verdict\s*[:\-]\s*(supported|refuted)\b", r"(?i)final\s*grade(?:\s*\([^)]*\))?\s*[:\-]\s*([-+]?\d+(?:\.\d+)?)\b"
_title = lambda x: f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"

_add("txt_clean", {"cleaned": lambda: text.clean(C())}, f"SELECT idx, {_CLEAN} AS cleaned FROM c")
_add("txt_format_gate", {"checklist": lambda: text.well_formed(C(), "checklist"), "query": lambda: text.well_formed(C(), "query"), "anywhere": lambda: text.well_formed(C(), "checklist", True)},
     r"SELECT idx, regexp_matches(ltrim(completion), '(?i)^checklist\s*:') AS checklist, regexp_matches(ltrim(completion), '(?i)^verifier\s+query\s*:') AS query, regexp_matches(completion, '(?i)checklist\s*:') AS anywhere FROM c")
_add("txt_final_verdict", {"verdict": lambda: text.final_verdict(C()), "short": lambda: text.final_verdict(C(), True)},
     f"SELECT idx, {_title(_X(_VP))} AS verdict, {_title('coalesce(' + _X(_VP) + ', ' + _X('(?i)^[ ]*(supported|refuted)[ ]*$') + ')')} AS short FROM c")
_add("txt_final_grade", {"grade": lambda: text.final_grade(C()), "short": lambda: text.final_grade(C(), True)},
     f"SELECT idx, CAST({_X(_GP)} AS DOUBLE) AS grade, CAST(coalesce({_X(_GP)}, {_X('^[ ]*([0-9]+[.]?[0-9]*)[ ]*$')}) AS DOUBLE) AS short FROM c")
_add("txt_exec_result", {"result": lambda: text.execution_result(C()), "query": lambda: text.verifier_query(C())},
     "SELECT idx, CASE WHEN k = 5 THEN a = 'True' END AS result, CASE WHEN k = 5 THEN 'eq{count{all_rows}; ' || g || '}=True' END AS query FROM c")


def _flat(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["item"], F.lit("="), x["answer"].cast("string"))), ";")


_add("txt_checklist", {"checklist": lambda: _flat(text.checklist(C(), "question"))},
     "SELECT idx, CASE WHEN k < 3 THEN 'is it open=' || lower(a2) || ';is it dear?=' || CASE WHEN b = 'yes' THEN 'true' ELSE 'false' END END AS checklist FROM c")
_add("txt_bool_list_args", {"answers": lambda: F.array_join(F.transform(text.bool_list(C()), lambda b: b.cast("string")), ",")},
     "SELECT idx, CASE WHEN k = 7 THEN lower(a) || ',' || lower(a2) END AS answers FROM c")
_add("txt_baseline_answer", {"grade": lambda: text.baseline_grade(C()), "verdict": lambda: text.baseline_verdict(C()), "result": lambda: text.baseline_result(C())},
     f"SELECT idx, CASE WHEN k IN (0, 2, 4) THEN CAST(g AS DOUBLE) END AS grade, CASE WHEN k IN (0, 1, 3) THEN {_title('v')} END AS verdict, "
     "CASE WHEN k = 5 THEN a = 'True' END AS result FROM c")

# answers in model text, case by case: how a text is read, the text, and what the rules of the evaluation make of it ({n} is the order's number)

CASES = (
    ("verdict", "Final verdict - refuted.", "Refuted"), ("verdict", "The final verdict is Supported", None), ("verdict", "Final Verdict: supportedly", None), ("verdict", "note {n}\nFINAL  VERDICT :\nSupported, as said", "Supported"),
    ("verdict_short", " refuted\n", "Refuted"), ("verdict_short", "Supported.", None), ("verdict_short", "I say Supported", None),
    ("result", "Verifier Query: only{all_rows}=True\nExecution Result: True or False?", None), ("result", "note {n}\nexecution  result:\tFALSE  \nmore", "false"), ("result", "  Execution Result: True", None), ("result", "Execution Result - True", None),
    ("result_short", "True!", "true"), ("result_short", " false. ", "false"), ("result_short", "True, I think", None),
    ("answer", "Final answer - {n}", "{n}"), ("answer", "Trace:\nline 1:\nFinal Answer: [{n}, 2] \nFinal Answer: 4", "[{n}, 2]"), ("answer", "final answer:\n\n  'x'\nrest", "'x'"), ("answer", "The answer: 3", None),
    ("answer_short", " {n}\nand more", "{n}"), ("answer_short", "so, Final Answer: 7", "7"),
    ("base_verdict", "The claim is not supported by it, I think so", None), ("base_verdict", "It is, I say, Refuted!", "Refuted"), ("base_verdict", "first\n supported \nthen refuted", "Supported"), ("base_verdict", "verdict - refuted, not supported", "Refuted"), ("base_verdict", "Final Verdict: Supported<|im_end|>", "Supported"),
    ("base_result", "It may be true that cats fly", None), ("base_result", "Answer: True\nnot false", "true"), ("base_result", "Verdict: True", "true"), ("base_result", "I would say that it is False.", "false"), ("base_result", "so\nTrue .\nor false", "true"), ("base_result", "result=true or so", None),
    ("base_grade", "2.5\nFinal grade: 3", "2.5"), ("base_grade", "grade (0-8): 3 of {n}\n7", "3.0"), ("base_grade", "Score - 4.5, for {n} points", "4.5"), ("base_grade", "a grade of 5", None), ("base_grade", "some words\n1e1", "10.0"), ("base_grade", "score (of 9): 3", None),
    ("query", "Verifier Query:\n\n  eq{count{all_rows}; {n}}=True \nExecution Result: True", "eq{count{all_rows}; {n}}=True"), ("query", "Verifier Query: bad{{=True", None), ("query", "verifier query: only{all_rows}=true", None), ("query", " Verifier Query: only{all_rows}=True", None),
    ("query", 'Verifier Query: eq{"a=True', None), ("query", "Verifier Query: only{all_rows}\nVerifier Query: only{all_rows}=True", None),
    ("tool_query", 'TOOL: run\nARGS: {"query": "only{all_rows}=False", "why": "n {n}"}', "only{all_rows}=False"), ("tool_query", 'ARGS: ```json\n{"query": " eq{a; {n}}=True "}\n```', "eq{a; {n}}=True"), ("tool_query", 'ARGS: {"other": 1}\n\n{"query": "only{all_rows}=True"}', None),
    ("tool_query", 'ARGS: {"query": "eq{x; \\"b\\"}=True"}', None),
    ("trace", "Trace:\nline 1:\n  x = {n}\n Final Answer: 3", "line 1:\n  x = {n}"), ("trace", "so trace : line 2:\n  y = 1\nFinal tool call:\nTOOL: replay", "line 2:\n  y = 1"), ("trace", "Trace:\n\n", None), ("trace", "line 1:\n  x = 1", None),
    ("gemma", "a <end_of_turn> b {n} <end_of_turn> c", "a <end_of_turn> b {n} "), ("qwen", "x<|im_end|>y {n}<|endoftext|><|im_end|>z", "xy {n}"), ("qwen", " no token {n} ", " no token {n} "), ("gpt", "done {n}<|return|>", "done {n}"),
    ("llama", "a<|eot_id|>b <|end_of_text|>", "ab <|end_of_text|>"), ("falcon", "a<|endoftext|> b</s>", "a b</s>"),
    ("legacy", "- Q: is it? A: True", "is it?=true"), ("legacy", "so Q: n {n}? A: yes because\nQ: n {n}? A: No (seen)", "n {n}?=no"), ("legacy", "Q: sure? A: yesterday\nFinal verdict: Refuted\nQ: late? A: no", None), ("legacy", "Q: a A: b? A: FALSE", "a A: b?=false"),
)


def read_as() -> dict[str, Column]:
    """How texts are read, by name."""
    t, truth = F.col("t"), lambda c: c.cast("string")
    old = F.transform(text.questions_answered(t), lambda x: F.concat_ws("=", x["question"], x["answer"]))
    return {"verdict": text.final_verdict(t), "verdict_short": text.final_verdict(t, True), "result": truth(text.execution_result(t)), "result_short": truth(text.execution_result(t, True)), "answer": text.final_answer(t), "answer_short": text.final_answer(t, True),
            "base_verdict": text.baseline_verdict(t), "base_result": truth(text.baseline_result(t)), "base_grade": text.baseline_grade(t).cast("string"), "query": text.verifier_query(t), "tool_query": text.tool_query(t), "trace": text.trace_block(t),
            **{f: text.clean_for_model(t, f) for f in text.FAMILIES}, "legacy": F.nullif(F.array_join(old, ";"), F.lit(""))}


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, ways = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), read_as()
    case = F.get(F.array(*[F.struct(F.lit(way).alias("way"), F.lit(t).alias("t")) for way, t, _ in CASES]), (F.col("o_orderkey") % len(CASES)).cast("int"))
    d = o.select("o_orderkey", case.alias("c")).select("o_orderkey", "c.way", F.replace("c.t", F.lit("{n}"), F.col("o_orderkey").cast("string")).alias("t"))
    return d.select("o_orderkey", "way", F.coalesce(*[F.when(F.col("way") == w, c) for w, c in ways.items()]).alias("read"))


_said = lambda x: "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
QUERIES["txt_answers"] = _cases
ORACLES["txt_answers"] = ("WITH c(k, way, read) AS (VALUES " + ", ".join(f"({i}, '{way}', {_said(r)})" for i, (way, _, r) in enumerate(CASES))
                          + f") SELECT o_orderkey, way, replace(read, '{{n}}', o_orderkey::VARCHAR) AS read FROM orders JOIN c ON o_orderkey % {len(CASES)} = k")

# numbers and normal forms

NUMBERS = """
SELECT o_orderkey AS idx, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN '1,' || n || '00' WHEN 1 THEN n || ':30.5' WHEN 2 THEN n || ' - 1 / 4' WHEN 3 THEN n || '/8'
  WHEN 4 THEN 'about ' || n || ' laps' WHEN 5 THEN '"Quoted" ' WHEN 6 THEN '' ELSE '&quot;X ' || n || '&quot;' END AS s, CAST(n AS DOUBLE) AS x
FROM (SELECT o_orderkey, CAST(CAST(o_orderkey % 40 + 10 AS INT) AS VARCHAR(9)) AS n FROM $orders) AS t
"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(spark, sf_dir, NUMBERS)


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, sf_dir).select("idx", values.parse_number("s").alias("number"))


def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, sf_dir).select("idx", values.norm_text("s").alias("norm"))


_N = "WITH n AS (" + NUMBERS.replace("$orders", "orders") + ") "
QUERIES |= {"val_parse_number": _parse, "val_norm_text": _norm}
ORACLES |= {
    "val_parse_number": _N + "SELECT idx, CASE idx % 8 WHEN 0 THEN 10000 + x * 100 WHEN 1 THEN x * 60 + 30.5 WHEN 2 THEN x + 0.25 WHEN 3 THEN x / 8 WHEN 4 THEN x WHEN 7 THEN x END AS number FROM n",
    "val_norm_text": _N + "SELECT idx, CASE idx % 8 WHEN 5 THEN 'quoted' WHEN 7 THEN 'x ' || CAST(CAST(x AS INT) AS VARCHAR) ELSE lower(trim(s)) END AS norm FROM n",
}
# tools, comparators, classification and interventions over orders with their lines as checklists

def checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, gold, mediator (gold, or with its first answer flipped, or missing), weights, gold_target, h."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_returnflag") == "R")).alias("answer"))
    item = F.struct(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("item"), F.col("l_linenumber").alias("pos"), F.col("answer"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), item.alias("x")))).alias("s"))
    g = g.select(F.col("l_orderkey").alias("idx"), F.transform("s", lambda y: y["x"]).alias("gold"))
    h = F.col("idx") % 10
    wrong = F.transform("gold", lambda x, i: F.struct(x["item"].alias("item"), x["pos"].alias("pos"), F.when(i == 0, ~x["answer"]).otherwise(x["answer"]).alias("answer")))
    weights = F.transform("gold", lambda x: F.struct(x["item"].alias("item"), (x["pos"] * 0.5).alias("weight")))
    return g.select("idx", "gold", F.when(h < 6, F.col("gold")).when(h < 9, wrong).alias("mediator"), weights.alias("weights"), F.when(F.col("idx") % 2 == 0, "Supported").otherwise("Refuted").alias("gold_target"))


CK = """
l AS (SELECT l_orderkey AS idx, l_linenumber AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n) AS pos, CASE WHEN idx % 10 < 6 THEN a WHEN idx % 10 < 9 THEN CASE WHEN row_number() OVER (PARTITION BY idx ORDER BY n) = 1 THEN 1 - a ELSE a END END AS b FROM l)"""


def _rice(spark, sf_dir):
    d = checklists(spark, sf_dir)
    return d.select("idx", structures.rubric_score(F.col("gold"), F.col("weights")).alias("gold_score"), structures.rubric_score(F.col("mediator"), F.col("weights")).alias("score"),
                    structures.compare_scores(structures.rubric_score(F.col("mediator"), F.col("weights")), structures.rubric_score(F.col("gold"), F.col("weights"))).alias("score_match"))


def _verdict(spark, sf_dir):
    d = checklists(spark, sf_dir).withColumn("target", structures.verdict(F.col("mediator"), F.col("gold"), F.col("gold_target")))
    return d.select("idx", "target", structures.compare_structures(F.col("mediator"), F.col("gold")).alias("match"), structures.compare_targets(F.col("target"), F.col("gold_target")).alias("target_match"),
                    structures.classify(F.lit(True), F.col("mediator"), F.col("gold")).alias("status"))


def edits(spark, sf_dir) -> DataFrame:
    d = checklists(spark, sf_dir).withColumn("status", structures.classify(F.lit(True), F.col("mediator"), F.col("gold")))
    return interventions.checklist_edits(d, ["idx"])


def _edits(kind):
    def go(spark, sf_dir):
        return edits(spark, sf_dir).filter(F.col("kind") == kind).select("idx", "kind", "edit_no", F.array_join(F.transform("mediator", lambda x: F.when(x["answer"], "1").otherwise("0")), "").alias("answers"))
    return go


def _prompt(regime):
    def go(spark, sf_dir):
        d = checklists(spark, sf_dir)
        return d.select("idx", prompts.with_structure(prompts.prompt("Judge the order.", F.concat(F.lit("Order "), F.col("idx").cast("string")), regime), prompts.checklist_text(F.col("gold")), "Final Verdict:").alias("prompt"))
    return go


_ST = "CASE WHEN idx % 10 < 6 THEN 'correct' WHEN idx % 10 < 9 THEN 'incorrect' ELSE 'error' END"
QUERIES |= {"tool_rice_score": _rice, "tool_verdict": _verdict, "iv_local_edits": _edits(interventions.LOCAL), "iv_correction": _edits(interventions.CORRECTION),
            **{f"prompt_{r}": _prompt(r) for r in prompts.REGIMES}}
ORACLES |= {
    "tool_rice_score": f"WITH {CK} SELECT idx, sum(a * n * 0.5)::DOUBLE AS gold_score, sum(b * n * 0.5)::DOUBLE AS score, CASE WHEN idx % 10 < 6 THEN 1 ELSE 0 END::INTEGER AS score_match FROM m GROUP BY idx",
    "tool_verdict": f"WITH {CK}, t AS (SELECT DISTINCT idx, CASE WHEN idx % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS g FROM m) SELECT idx, CASE WHEN idx % 10 < 6 THEN g WHEN idx % 10 < 9 THEN CASE g WHEN 'Supported' THEN 'Refuted' ELSE 'Supported' END END AS target, "
                    f"CASE WHEN idx % 10 < 6 THEN 1 WHEN idx % 10 < 9 THEN 0 END::INTEGER AS match, CASE WHEN idx % 10 < 6 THEN 1 ELSE 0 END::INTEGER AS target_match, {_ST} AS status FROM t",
    "iv_local_edits": f"WITH {CK} SELECT e.idx, 'Local Edits' AS kind, (e.pos - 1)::INTEGER AS edit_no, string_agg(CASE WHEN m.pos = e.pos THEN 1 - m.a ELSE m.a END::VARCHAR, '' ORDER BY m.pos) AS answers FROM m AS e JOIN m ON e.idx = m.idx WHERE e.idx % 10 < 6 GROUP BY e.idx, e.pos",
    "iv_correction": f"WITH {CK} SELECT idx, 'Correction' AS kind, 0::INTEGER AS edit_no, string_agg(a::VARCHAR, '' ORDER BY pos) AS answers FROM m WHERE idx % 10 BETWEEN 6 AND 8 GROUP BY idx",
    **{f"prompt_{r}": f"WITH {CK} SELECT idx, 'Judge the order.' || chr(10) || chr(10) || '{t + chr(10) + chr(10) if t else ''}' || 'Order ' || idx::VARCHAR || chr(10) || chr(10) || 'Checklist:' || chr(10) || "
       "string_agg('- Q: line ' || n::VARCHAR || ' (True/False): ' || CASE WHEN a = 1 THEN 'True' ELSE 'False' END, chr(10) ORDER BY pos) || chr(10) || 'Final Verdict:' AS prompt FROM m GROUP BY idx" for r, t in prompts.REGIMES.items()},
}


def _edits_in_sql(spark, sf_dir):
    sql.register(spark, "faithline_")
    return spark.sql("SELECT s.idx, e.kind, e.edit_no, array_join(transform(e.edited, x -> if(x.answer, '1', '0')), '') AS answers "
                     "FROM (SELECT *, faithline_generation_status(true, mediator, gold) AS status FROM {samples}) AS s, LATERAL faithline_checklist_edits(s.mediator, s.gold, s.status) AS e WHERE e.kind = 'Local Edits'", samples=checklists(spark, sf_dir))


QUERIES["sql_local_edits"], ORACLES["sql_local_edits"] = _edits_in_sql, ORACLES["iv_local_edits"]
