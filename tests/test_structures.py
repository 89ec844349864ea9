"""Completions, traces, readers, sinks and the stream extension."""

import ast
import json
import os

from pyspark.sql import functions as F

from faithline.functions import structures, text, tool_json, trace
from faithline.operators import faithfulness, interventions, metrics
from faithline.sources import readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first()["v"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.clean(t), t="<|im_start|> hi​</s>\n") == "hi"
    assert one(spark, text.final_grade(t), t="Final Grade (0-3): 1.5 of 3") == 1.5
    assert one(spark, text.final_grade(t, True), t=" -2 ") == -2
    assert one(spark, text.final_verdict(t), t="x\nFINAL verdict - refuted.") == "Refuted"
    assert one(spark, text.execution_result(t, True), t="True!") is True
    assert one(spark, text.final_answer(t), t="Trace:\nFinal Answer: 8\nmore") == "8"
    assert one(spark, text.verifier_query(t), t="Verifier Query: only{all_rows}=True\nx") == "only{all_rows}=True"
    assert one(spark, text.bool_list(t), t='TOOL: x\nARGS: {{"rubric": [True, false]}}') == [True, False]
    assert one(spark, text.bool_list(t), t='ARGS: {"rubric": [True, 1]}') is None
    got = one(spark, text.checklist(t, "rubric"), t="Checklist:\nA 'q' (weight: 1.5) (True/False): True\nB - false\nA q: False\nFinal grade: 1")
    assert [(x.item, x.pos, x.answer) for x in got] == [("A q", 0, False), ("B", 1, False)]
    got = one(spark, text.tool_checklist(t, "question"), t='ARGS: {"rubric": "- Q: one (True/False): Yes\\n- Q: two: No"}')
    assert [(x.item, x.answer) for x in got] == [("one", True), ("two", False)]
    assert one(spark, text.baseline_grade(t), t="thinking\n2.5\n") == 2.5
    assert one(spark, text.well_formed(t, "trace"), t="  Trace: x") is True


TRACE = "line 2:\n  x = 3\n  s = 'ab'\nline 3:\n  x = 3\n  y = [1, 2]\n  # note\nline 4:\n  y = oops("


def test_trace():
    steps = trace.parse(TRACE)
    assert [s.line for s in steps] == [2, 3, 4] and steps[1].locals == {"x": 3, "y": [1, 2]} and steps[1].nl_comment == "note" and steps[2].locals == {"y": "oops("}
    assert trace.canonical(trace.parse(trace.to_text(steps))) == trace.canonical(steps)
    assert trace.parse("no header") is None and trace.applicable(None) == [0, 7, 8] and trace.applicable(steps) == list(range(9))
    for level in range(9):
        assert trace.perturb(steps, level, "k") == trace.perturb(steps, level, "k")
    assert [s.line for s in trace.perturb(steps, 4, "k")] == [3, 4] and [s.line for s in trace.perturb(steps, 5, "k")] == [2, 3, 3, 4]
    assert trace.perturb(steps, 3, "k")[2].locals["y"] == 5 and trace.perturb(steps, 1, "k")[2].locals["y"] == "(spoo"
    code = "def f(x):\n    return x * 2 if x else len('ab')"
    assert trace.simulate(trace.parse("line 1:\n  x = 4"), code) == 8
    assert str(trace.simulate(trace.parse("line 1:\n  x = 4"), "def f(x):\n    return __import__('os')")).startswith("ERROR")
    assert str(trace.simulate(trace.parse("line 1:\n  x = 4"), "def f(x):\n    return 'a' * 999999999")).startswith("ERROR")


def test_interventions_and_metrics(spark):
    c = "array<struct<item:string,pos:int,answer:boolean>>"
    gold, wrong = [("a", 0, True), ("b", 1, False)], [("a", 0, False), ("b", 1, False)]
    df = spark.createDataFrame([(1, gold, gold), (2, wrong, gold), (3, None, gold)], f"idx int, mediator {c}, gold {c}")
    df = df.withColumn("status", structures.classify(F.lit(True), F.col("mediator"), F.col("gold")))
    assert [r.status for r in df.orderBy("idx").collect()] == ["correct", "incorrect", "error"]
    edits = interventions.checklist_edits(df, ["idx"]).orderBy("idx", "edit_no").collect()
    assert [(e.idx, e.kind, [x.answer for x in e.mediator]) for e in edits] == [(1, "Local Edits", [False, False]), (1, "Local Edits", [True, True]), (2, "Correction", [True, False])]
    counts = metrics.counts(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert (counts.n_total, counts.correct_rate, counts.error_rate) == (3, 0.5, 1 / 3)
    table = metrics.summarize(spark.createDataFrame([(1, 1), (1, None)], "g int, x int"), "x", ["g"]).first()
    assert (table["mean"], table["std"], table.n_valid, table.n_none) == (1.0, 0.0, 1, 1)


def test_faithful_and_stubborn(spark):
    """A model that follows its structure scores 1 on both measures; one that keeps its answer 1 on the first only."""
    from faithline.plans import eval_queries as e

    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    r = spark.sql(e.RUNS.replace("$labels", "{labels}"), labels=labels).filter("status = 'correct'")
    facts = faithfulness.fact_table(r, e.edits(r), F.expr(e.ORDER))
    got = {x.model: (x.i, x.s) for x in facts.groupBy("model").agg(F.avg(F.col("f_id").cast("int")).alias("i"), F.avg(F.col("f_strong").cast("int")).alias("s")).collect()}
    assert got["faithful"] == (1.0, 1.0) and got["stubborn"] == (1.0, 0.0) and 0 < got["noisy"][1] < 1


def test_readers_and_sinks(spark, tmp_path):
    q = {"t1.html.csv": [{"main_question": "is it\nso", "main_program": "only{all_rows}=True", "table_name": "cap", "local_edits": ["x"]}]}
    (tmp_path / "q.json").write_text(json.dumps(q))
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables/t1.html.csv").write_text("a#b\n1#x\n2#\n3#y#z\n")
    (tmp_path / "tables/t2.html.csv").write_text("a\n1\n")
    queries = readers.tabfact_queries(spark, str(tmp_path / "q.json"))
    row = queries.first()
    assert row.idx.startswith("t1@") and len(row.idx) == 11 and row.statement == "is it so"
    cells = readers.table_cells(readers.tables(spark, str(tmp_path / "tables"), queries)).orderBy("__row").collect()
    assert [(c["__row"], c.cells) for c in cells] == [(0, ["1", "x"]), (1, ["2", ""])]
    assert readers.table_cells(readers.tables(spark, str(tmp_path / "tables"), queries), na_mode="pandas").orderBy("__row").collect()[1].cells == ["2", "nan"]
    claims = [{"claim": "c1", "label": "Supported", "questions": [{"question": "q", "answers": [{"answer": "Yes", "boolean_explanation": "e"}]}]}, {"claim": "c2", "label": "Refuted", "questions": [{"question": x, "answers": [{"answer": "No"}]} for x in "ab"]}]
    (tmp_path / "a.json").write_text(json.dumps(claims))
    got = readers.averitec(spark, str(tmp_path / "a.json")).collect()
    assert [(g.idx, g.gold_target, g.gold_rubric[0].answer) for g in got] == [("0", "Supported", True)]
    for name in ("m_20250101", "m_20250202"):
        (tmp_path / "runs/tabfact/standard").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"runs/tabfact/standard/{name}.json").write_text(json.dumps({"meta": {"n": "1"}, "result": [{"idx": name}]}))
    got = readers.run_dumps(spark, str(tmp_path / "runs"), "struct<idx:string>").collect()
    assert [(g.dataset, g.run_type, g.model, g.idx) for g in got] == [("tabfact", "standard", "m", "m_20250202")]
    os.utime(tmp_path / "runs/tabfact/standard/m_20250101.json", (2e9, 2e9))
    assert [g.idx for g in readers.run_dumps(spark, str(tmp_path / "runs"), "struct<idx:string>", newest="modified").collect()] == ["m_20250101"]
    df = spark.createDataFrame([("m_1", 0.25), ("x", None)], "model string, delta double")
    assert "| m_1 | 0.250 |" in sinks.markdown(df) and r"\cellcolor[HTML]{CECE71}0.25" in sinks.latex(df, ("delta",))
    sinks.run_dump(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream(spark, tmp_path):
    from faithline.streaming import dumps

    (tmp_path / "in").mkdir()
    line = lambda i, s: json.dumps({"dataset": "d", "run_type": "r", "model": "m", "idx": i, "status": s}) + "\n"
    (tmp_path / "in/a.json").write_text(line("1", "correct"))
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    dumps.counted(spark, *args)
    (tmp_path / "in/b.json").write_text(line("2", "error"))
    dumps.counted(spark, *args)
    assert spark.read.parquet(args[1]).first().n_total == 2


def test_lines_of_checklists(spark):
    t = F.col("t")
    rubric = "Checklist:\nnames (all) parts (weight: 2) (True/False): True\n(x): false\nno answer here\n 'quoted' - TRUE  \nFinal grade: 1"
    assert [(x.item, x.answer) for x in one(spark, text.checklist(t, "rubric"), t=rubric)] == [("names (all) parts", True), ("(x)", False), ("quoted", True)]
    question = "Checklist:\n• Q: Is it (so) (True/False): Yes, it is\nQ : 'was it: once?' - no.\n- Q: nothing: Nobody\nfinal verdict: Supported"
    assert [(x.item, x.answer) for x in one(spark, text.checklist(t, "question"), t=question)] == [("Is it (so)", True), ("was it: once?", False)]
    assert one(spark, text.checklist(t, "rubric"), t="Checklist:\nnothing") is None


def test_kept_samples(spark):
    df = spark.createDataFrame([(3, "def f(x):\n    y = x\n    return y", "1"), (1, "def g(x):\n    return x", "1"), (2, "def f(x):\n    y = [x]\n    return y", "2")], "id int, code string, args string")
    admitted = trace.admitted(df, "code", "args")
    assert [r.id for r in trace.kept(admitted, "id", 1).collect()] == [2] and trace.kept(admitted, "id").count() == 2


def test_tracing(spark):
    """Programs are interpreted as Python would run them, a step for every line that is reached."""
    import sys

    def real(code, *args):
        space, lines = {}, []
        exec(code, space)  # noqa: S102  the test's own programs

        def tracer(frame, event, _):
            if event == "line" and frame.f_code.co_name == "f":
                lines.append((frame.f_lineno, {k: repr(v) for k, v in frame.f_locals.items()}))
            return tracer
        sys.settrace(tracer)
        try:
            result = space["f"](*args)
        finally:
            sys.settrace(None)
        return lines, result

    programs = [
        ("def f(a, b=2):\n    out = []\n    for x, y in enumerate(a):\n        if y % b == 0:\n            continue\n        out.append([x, y])\n    else:\n        out += [b]\n    return out", "[3, 4, 5]"),
        ("def f(s):\n    d = {}\n    for c in s:\n        d[c] = d.get(c, 0) + 1\n    while len(d) > 1:\n        d.pop(max(d))\n        if 'b' not in d:\n            break\n    return sorted(d.items())", "'abcab'"),
        ("def f(n):\n    a, b = 0, 1\n    while a < n:\n        a, b = b, a + b\n    return a, b", "9"),
        ("def f(x):\n    x.sort()\n    x[0] *= 3\n    return x[::-1]", "[3, 1, 2]"),
    ]
    for code, args in programs:
        steps, result = trace.record(code, args)
        lines, want = real(code, *eval(f"({args},)"))  # noqa: S307
        assert result == want and [s.line for s in steps] == [n for n, _ in lines]
        assert [{k: repr(v) for k, v in s.locals.items()} for s in steps] == [v for _, v in lines]
    # how often Python reports a comprehension's line depends on its version; here it is one step
    steps, result = trace.record("def f(n):\n    return [x * 2 for x in range(n) if x % 3], {k: -k for k in (1, 2)}, ''.join(str(v) for v in [3, 4])", "5")
    assert len(steps) == 1 and result == ([2, 4, 8], {1: -1, 2: -2}, "34")
    assert trace.admission("def f(x):\n    return open(x)", "'a'")[0] == "trace" and trace.admission("def g(x):\n    return x", "1")[0] == "resolve"
    assert trace.admission("def f():\n    while True:\n        pass", "")[0] == "trace" and trace.admission("def f(x):\n    return -x", "1.5")[2] == "-1.5"
    said = lambda t, short=False: trace.tool_steps(spark.createDataFrame([(t,)], "t string").select(tool_json.block(F.col("t"), short).alias("b")).select(tool_json.object_of("b").alias("o")).first()["o"])
    assert said('x ARGS: {"trace": [{"line": "3", "locals": {"a": "[1]"}}]} junk') == [trace.Step(3, {"a": [1]})]
    assert said('ARGS: {"trace": [{"line": "x", "locals": {}}]}') is None and said('{"trace": "line 1:"}', True) == "line 1:" and said('{"trace": "line 1:"}') is None
    assert [trace.same_answer(*p) for p in (("[1,2]", "[1, 2]"), ("a", "b"), ("1", None), (" x ", "x"))] == [1, 0, None, 1]


def test_changes_of_values():
    draws = trace._Draws("k")
    same = {True: False, 2.0: -3.0, "ab": "ba", "": "CORRUPTED"}
    assert {v: trace.mutated(v, draws) for v in same} == same and trace.mutated([], draws) == [0] and trace.mutated({"a": "xy", "b": 1}, draws) == {"a": "yx", "b": 1}
    assert abs(trace.mutated(5, draws) - 5) in (1, 2, 3) and trace.mutated(("ab", True), draws) == ("ba", False) and trace.mutated(None, draws) is None
    assert (trace.coerced(3), trace.coerced("abc"), trace.coerced([7, 8]), trace.coerced([]), trace.coerced(True), trace.coerced(1.5)) == ([3, 3], 3, "7", None, None, None)


def test_generation_and_folders(spark, tmp_path):
    from faithline.operators import generation

    df = spark.createDataFrame([(i, f"part\n\nlast {i}" if i != 3 else None) for i in range(10)], "id int, p string")
    got = {r.id: r.completion for r in generation.generated(df, "p", generation.echo, 3).collect()}
    assert got == {i: f"last {i}" if i != 3 else None for i in range(10)}
    assert generation.generated(df, "p", generation.mock).filter("id = 0").first().completion == "mock completion for part\n\nlast"
    runs = df.withColumn("status", F.lit("correct"))
    sinks.run_folder(runs, {"model": "m", "seed": 1}, metrics.run_meta(runs, ["status"]), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/result")).count() == 10 and spark.read.json(str(tmp_path / "run/meta")).first().seed == "1"
    assert spark.read.json(str(tmp_path / "run/metrics")).first().n_correct == 10
    assert sinks.markdown(spark.range(1500).selectExpr("id")).count("\n") == 1502


def test_ricechem_files(spark, tmp_path):
    """The first data row of every file goes, whatever the number of files; line breaks in cells are no rows."""
    (tmp_path / "rubric").mkdir()
    (tmp_path / "answers").mkdir()
    for n in (1, 2):
        (tmp_path / f"rubric/r{n}.csv").write_text("SID,states law,units,Score\nx,x,x,x\n" + "".join(f"s{n}{i},TRUE,FALSE,{i}\n" for i in range(3)))
        (tmp_path / f"answers/a{n}.csv").write_text("SID,Answer,Rubric\nx,x,x\n" + "".join(f's{n}{i},"line one\nline two {i}",r\n' for i in range(3)))
    got = readers.ricechem(spark, str(tmp_path / "rubric"), str(tmp_path / "answers"), 4).orderBy("idx").collect()
    assert [(r.idx, r.student_answer, r.gold_score, [x.answer for x in r.gold_rubric]) for r in got] == [(f"4@s{n}{i}", f"line one line two {i}", float(i), [True, False]) for n in (1, 2) for i in range(3)]


def test_a_broken_run_leaves_no_half_dump(spark, tmp_path):
    import pytest

    runs = spark.createDataFrame([("a", "correct"), ("b", "error")], "idx string, status string")
    path = tmp_path / "run"
    breaks = runs.select(F.when(F.col("idx") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("status")).alias("n"))
    for metrics_ in (breaks, None):
        with pytest.raises(Exception):  # noqa: B017  the second table fails, or is none
            sinks.run_folder(runs, {"model": "m"}, metrics_, str(path))
        assert os.listdir(tmp_path) == []
    sinks.run_folder(runs, {"model": "m"}, runs.groupBy("status").count(), str(path))
    assert sorted(os.listdir(path)) == ["meta", "metrics", "result"] and spark.read.json(str(path / "result")).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        sinks.run_folder(runs.limit(1), {"model": "m"}, breaks, str(path))
    assert os.listdir(tmp_path) == ["run"] and spark.read.json(str(path / "result")).count() == 2  # the one that was there


def test_tables_without_the_driver(spark, tmp_path):
    df = spark.range(500).selectExpr("CAST(id AS STRING) AS m_1", "IF(id = 3, NULL, id / 4) AS delta", "id AS k").repartition(7)
    sinks.markdown_lines(df, ["k"]).write.text(str(tmp_path / "t"))
    lines = "".join(open(p).read() for p in sorted(map(str, (tmp_path / "t").glob("part-*")))).splitlines()
    assert len(lines) == 502 and lines[:3] == ["| m_1 | delta | k |", "| --- | --- | --- |", "| 0 | 0.000 | 0 |"] and lines[5] == "| 3 |  | 3 |" and lines[-1] == "| 499 | 124.750 | 499 |"
    deltas = spark.createDataFrame([(x,) for x in (None, float("nan"), -1.0, 0.0, 0.13, 0.26, 0.31, 0.36, 0.5, 0.65, 0.9)], "d double")
    assert [r.c for r in deltas.select(sinks.colour(F.col("d")).alias("c")).collect()] == [None, None, "5DBB89", "5DBB89", "98C57C", "D3CF70", "E9D26B", "FFD466", "F5B16B", "EB8C70", "EB8C70"]


def test_sql_functions(spark):
    from faithline.functions import sql

    assert sql.register(spark, "fl_") == ["fl_" + n for n in sql.FUNCTIONS]
    got = spark.sql("SELECT fl_same_answer('1.005', '1.0', 'ricechem') a, fl_same_answer('1.005', '1.0', 'tabfact') b, fl_same_answer(NULL, NULL, 'x') c").first()
    assert tuple(got) == (True, False, False)
    c = "array<struct<item:string,pos:int,answer:boolean>>"
    gold, wrong = [("a", 0, True), ("b", 1, False)], [("a", 0, False), ("b", 1, False)]
    df = spark.createDataFrame([(1, gold[::-1], gold), (2, wrong, gold), (3, None, gold)], f"idx int, mediator {c}, gold {c}")
    status = spark.sql("SELECT idx, mediator, gold, fl_same_checklist(mediator, gold) AS same, fl_generation_status(true, mediator, gold) AS status FROM {df}", df=df)
    assert [(r.same, r.status) for r in status.orderBy("idx").collect()] == [(1, "correct"), (0, "incorrect"), (None, "error")]
    mine = spark.sql("SELECT s.idx, e.* FROM {s} AS s, LATERAL fl_checklist_edits(s.mediator, s.gold, s.status) AS e", s=status)
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, interventions.checklist_edits(status, ["idx"]).withColumnRenamed("mediator", "edited").collect()))


def test_a_later_dump_replaces_an_earlier_one(spark, tmp_path):
    from faithline.streaming import dumps

    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    kinds = "model string, idx string, status string, stamp string"

    def arrive(*rows):
        spark.createDataFrame(rows, kinds).selectExpr("'d' AS dataset", "'standard' AS run_type", "*").coalesce(1).write.mode("append").json(source)
        dumps.latest(spark, source, out, checkpoint)
        return {r.model: (r.stamp, r.n_total, r.n_correct, r.n_incorrect, r.n_error) for r in dumps.current(spark, out).collect()}

    assert arrive(("a", "1", "correct", "2024"), ("a", "2", "error", "2024"), ("b", "1", "correct", None)) == {"a": ("2024", 2, 1, 0, 1), "b": ("", 1, 1, 0, 0)}
    assert arrive(("a", "3", "correct", "2024")) == {"a": ("2024", 3, 2, 0, 1), "b": ("", 1, 1, 0, 0)}  # more of the same dump
    assert arrive(("a", "1", "incorrect", "2025"), ("a", "9", "correct", "2023"), ("b", "2", "other", None)) == {"a": ("2025", 1, 0, 1, 0), "b": ("", 2, 1, 0, 0)}
    assert arrive(("a", "9", "correct", "2024"))["a"] == ("2025", 1, 0, 1, 0)  # late


def test_trace_edits_share_steps_and_lines(spark, monkeypatch):
    """A trace is read once for all its edits, a line that recurs once for all traces, and unchanged steps are written once; results are those of single edits."""
    text = "\n".join(f"line {i % 3}:\n  x = {i}\n  s = 'ab'\n  l = [1, 2]\n  f = -0.5\n  t = it's\n  # so" for i in range(6))
    written = []
    monkeypatch.setattr(trace, "_step_text", lambda s, was=trace._step_text: written.append(s.line) or was(s))
    got = trace.edits_of(text, "7")
    assert len(written) < 2 * 6  # six edits of six steps
    steps = trace.parse(text)
    assert got == [(k, trace.LEVELS[k], trace.to_text(trace.perturb(steps, k, "7"))) for k in range(1, 7)]
    trace._known.cache_clear()
    assert trace.parse(text) == steps and trace._known.cache_info().hits > 20
    for v in ("0", "-7", "007", "1_0", "-0.0", "1.", "1e3", "'a\"b'", '"it\'s"', "'a\\n'", "'a' 'b'", "True", "None", "[1, 'a']", "{1: (2,)}", "it's", "'é'", "--1", "1" * 200):
        try:
            want = ast.literal_eval(v)
        except (ValueError, SyntaxError):
            want = v
        assert repr(trace.literal(v)) == repr(want) and type(trace.literal(v)) is type(want)
    one, two = trace.parse("line 1:\n  l = [1]"), trace.parse("line 1:\n  l = [1]")
    one[0].locals["l"].append(2)
    assert two[0].locals["l"] == [1] and trace.perturb(two, 0, "k")[0].locals["l"] is not two[0].locals["l"]
    d = spark.createDataFrame([(1, text, 5), (2, "nothing", 6), (3, "line 1:\n  x = 1", 7)], "k int, t string, more int")
    rows = trace.local_edits(d, "t", "k").collect()
    assert rows[0].asDict().keys() == {"k", "more", "level", "name", "perturbed"} and [(r.k, r.more, r.level) for r in rows] == [*[(1, 5, i) for i in range(1, 7)], *[(3, 7, i) for i in (1, 2, 3)]]


def test_trace_columns_and_shuffles(spark):
    """Trace columns hold what parse gives, with nulls, empty steps and repeated locals; an order's lines meet in one shuffle, repeated lines once."""
    from faithline.plans import other_queries

    texts = [None, "no header", "line 1:", TRACE, "line 2:\n  x = 1\n  x = 2\n  # a\n  # b", "line 3:\n  é = 1\n  s = 'é'"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = {r.k: r.trace for r in trace.parsed(df, "t").collect()}
    for k, t in enumerate(texts):
        steps = trace.parse(t)
        assert (got[k] is None) == (steps is None)
        assert [(s.line, [tuple(x) for x in s.locals], s.nl_comment) for s in got[k] or []] == [(s.line, [(n, repr(v)) for n, v in s.locals.items()], s.nl_comment) for s in steps or []]
    plan = other_queries.traces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_coerced_without_deep_copies(spark, monkeypatch):
    """Steps that a perturbation leaves alone are not copied, and no number or text ever is."""
    text = "\n".join(f"line {i}:\n  x = {i}\n  s = 'ab'" for i in range(20))
    steps = trace.parse(text)
    monkeypatch.setattr(trace.copy, "deepcopy", lambda *_: 1 / 0)
    got = trace.perturb(steps, 3, "k")
    assert got[-1].locals == {"x": [19, 19], "s": "ab"} and got[:-1] == steps[:-1] and steps[-1].locals["x"] == 19
    assert sum(a is b for a, b in zip(trace._perturbed(steps, 3, "k"), steps, strict=True)) == 19


def test_simulated_source_read_once(monkeypatch):
    """A function's source is parsed once for all traces, also where its return fails or its values are changed in place."""
    calls = []
    monkeypatch.setattr(trace.ast, "parse", lambda s, *a, was=ast.parse, **k: calls.append(s) or was(s, *a, **k))
    code = "def f(q, l):\n    return 1 // q"
    for f in (trace._known_tree, trace._first_return):
        f.cache_clear()
    assert [trace.simulate([trace.Step(1, {"q": q, "l": [q]})], code) for q in range(5)] == ["ERROR: integer division or modulo by zero", 1, 0, 0, 0]
    assert len(calls) == 1
    grown = "def f(l):\n    return l.append(3) or l"
    assert [trace.simulate(trace.parse("line 1:\n  l = [1]"), grown) for _ in range(3)] == [[1, 3]] * 3
    assert trace.simulate([trace.Step(1)], "def f(:") == trace.simulate([trace.Step(1)], "def f(:") and trace.simulate([trace.Step(1)], "x = 1") == "ERROR: no return found"


def test_admission_asked_once(monkeypatch):
    """Equal tasks are run once in a task of Spark, whatever comes of them; long traces are not kept, and so many tasks at most are."""
    asked = []
    monkeypatch.setattr(trace, "admission", lambda s, a, most, was=trace.admission: asked.append(a) or was(s, a, most))
    trace._asked.clear()
    code = "def f(n, s):\n    t = [n] * len(s)\n    return t"
    for _ in range(3):
        assert trace._known_admission(code, "4, 'ab'", 80) == ("kept", trace.record(code, "4, 'ab'")[0], "[4, 4]")
        assert trace._known_admission(code, "4", 80)[0] == "resolve" and trace._known_admission(code, "4, 5", 80)[0] == "trace" and trace._known_admission(code, "4, 'ab'", 1)[0] == "trace"
    assert len(asked) == 4
    long = f"1, '{'x' * 10_000}'"
    assert trace._known_admission(code, long, 80)[2] == trace._known_admission(code, long, 80)[2] and asked.count(long) == 2
    for i in range(trace.TASKS + 5):
        trace._known_admission(code, f"{i}, 'a'", 80)
    assert len(trace._asked) == trace.TASKS


def test_recorded_without_deep_copies(monkeypatch):
    """A function is parsed once for all its calls; what a step holds is its own, and no number, text or flat list needs a deep copy."""
    code = "def f(n, l):\n    for i in range(n):\n        l.append(i)\n    return l"
    want = [({"n": 2, "l": [9]}), {"n": 2, "l": [9], "i": 0}, {"n": 2, "l": [9, 0], "i": 0}, {"n": 2, "l": [9, 0], "i": 1}, {"n": 2, "l": [9, 0, 1], "i": 1}, {"n": 2, "l": [9, 0, 1], "i": 1}]
    calls = []
    trace._known_tree.cache_clear()
    monkeypatch.setattr(trace.ast, "parse", lambda s, *a, was=ast.parse, **k: calls.append(s) or was(s, *a, **k))
    monkeypatch.setattr(trace.copy, "deepcopy", lambda *_: 1 / 0)
    for _ in range(3):
        steps, result = trace.record(code, "2, [9]")
        assert [s.locals for s in steps] == want and [s.line for s in steps] == [2, 3, 2, 3, 2, 4] and result == [9, 0, 1]
    assert sum(c == code for c in calls) == 1


def test_arguments_worked_out_once(spark):
    """What a tool call's answer is made of stands once in its expression (the arguments twice: found, then cut out); question lines of odd forms read as before."""
    for c in (text.bool_list(F.col("t")), text.tool_checklist(F.col("t"), "question")):
        assert spark.createDataFrame([("x",)], "t string").select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("ARGS") == 2
    lines = [" - Q : a - b: yes, c: no", "Q: : True", "q:\u2028x (note) - FALSE more", "\u2022Q: 'one' (True/False): True", "- - Q: x: True", "Q: x: Trueish", "Q:   : yes: no", "Q: same: yes", "Q: same: no", "x Q: y: no", "Q: (only): yes"]
    got = one(spark, text.checklist_of(F.col("t"), "question"), t="\n".join(lines))
    assert [(x.item, x.pos, x.answer) for x in got] == [("a - b", 0, True), ("x", 1, False), ("one", 2, True), ("same", 3, False), ("(only)", 4, True)]
    assert one(spark, text.checklist_of(F.col("t"), "question"), t="Q: x (x") is None


def test_table_texts_dealt_by_size(spark, monkeypatch):
    """How many table texts a task gets goes by their characters and by the programs asked of a table, not by what they take compressed; verdicts stay."""
    from faithline.dsl import text_tables

    d = spark.createDataFrame([(str(i), "kind#no\n" + "click#1\n" * 100) for i in range(64)], "table_id string, text string")
    asked = d.select("table_id", F.explode(F.array(F.lit("eq{count{all_rows}; 100}=True"), F.lit("eq{count{all_rows}; 99}=True"))).alias("program"))
    size = 64 * (8 + 800)
    assert text_tables.dealt(d, "table_id", "text").rdd.getNumPartitions() <= 4  # left to Spark
    monkeypatch.setattr(text_tables, "PART", size // 10)
    assert text_tables.dealt(d, "table_id", "text").rdd.getNumPartitions() == 11
    assert text_tables.dealt(d, "table_id", "text", 2).rdd.getNumPartitions() == 21
    assert text_tables.dealt(d.limit(0), "table_id", "text").count() == 0
    got = text_tables.verdicts(asked, d).groupBy("program", "verdict").count().collect()
    assert sorted((r.program[-8:-6], r.verdict, r["count"]) for r in got) == [("99", False, 64), ("00", True, 64)][::-1]


def test_recurring_steps_read_once(spark):
    """Steps that recur in traces are read, retyped and written once in a task; texts of any cut read as before, and nothing that is shared is changed."""
    texts = [None, "", "no header", TRACE, "  x = 0\nline 1:\n  x = 1", "line 1:\njunk\n  x = 1", "line 1:\r\n  x = [1]\r\nline 2:\n  x = [2]\x1c  y = 3", " line 1:\n  x = 1\nLINE\t2 :\n  y = 'a'\n\n  # so", f"line 1:\n  s = '{'x' * 300}'"]
    for t in texts:
        for level in trace.LEVELS:
            assert trace.shared(t) == trace.parse(t) and (t is None or trace.parse(t) is None or trace.to_text(trace._perturbed(trace.shared(t), level, "k")) == trace.to_text(trace.perturb(trace.parse(t), level, "k")))
    trace._known_steps.cache_clear()
    rows = [(i, f"line 1:\n  q = {i % 7}\nline 2:\n  q = {i % 5}\n  flag = 'A'") for i in range(100)]
    assert [trace.shared(t) for _, t in rows] == [trace.parse(t) for _, t in rows] and trace._known_steps.cache_info().misses == 7 + 5
    twice = trace._perturbed(trace._perturbed(trace.shared(rows[0][1]), 3, "k"), 3, "k")
    assert twice[1].locals == {"q": "0", "flag": "A"}
    got = trace.perturbed(spark.createDataFrame(rows, "k int, t string"), "t", "k", 3).collect()
    assert [r.perturbed for r in got] == [f"line 1:\n  q = {i % 7}\nline 2:\n  q = [{i % 5}, {i % 5}]\n  flag = 'A'" for i in range(100)]
    grown = "def f(l):\n    return l.append(3) or l"
    said = trace.simulated(spark.createDataFrame([("line 1:\n  l = [1]",)] * 3, "t string").coalesce(1), "t", grown).collect()
    assert [r.answer for r in said] == ["[1, 3]"] * 3


def test_trace_batches_by_line(monkeypatch):
    """A batch of traces becomes an Arrow array with each different line read once, equal to what the texts give one by one."""
    import pyarrow as pa

    step = pa.struct([("line", pa.int32()), ("locals", pa.list_(pa.struct([("name", pa.string()), ("repr", pa.string())]))), ("nl_comment", pa.string())])
    kind = pa.list_(step)
    texts = [None, "", "no header", TRACE, "  x = 0\nline 1:\n  x = 1\n  y = 2\n  x = [3]", "line 1:\n  # a\n  # b\nline 2:", "line 1:\r\n  x = it's\x1c  y = {1: (2,)}\u2028line 2:\n  x = 1", "  x = 9\n  # before"]
    for batch in (texts, texts[:1], [], ["line 4:"]):
        got = trace._parsed_array(pa.array(batch, pa.string()), kind)
        got.validate(full=True)
        assert got.to_pylist() == trace._trace_array([trace.parse(t) for t in batch], kind).to_pylist()
    asked = []
    monkeypatch.setattr(trace, "_known", lambda line: asked.append(line) or trace._said(line))
    trace._parsed_array(pa.array([f"line 1:\n  x = {i % 3}" for i in range(1000)]), kind)
    assert len(asked) == 4


def test_equal_tasks_become_rows_once():
    """What is asked of equal tasks of a batch is worked out and made an Arrow array once; nulls are values of their own."""
    import pyarrow as pa

    asked = []
    make = trace._once(lambda a, b: asked.append((a, b)) or f"{a}-{b}", lambda found, kind: pa.array(found, kind))
    a, b = ["x", None, "y", "x", None, "x"] * 50, ["1", "1", None, "1", "1", None] * 50
    assert make([pa.array(a), pa.array(b)], pa.string()).to_pylist() == [f"{x}-{y}" for x, y in zip(a, b, strict=True)]
    assert len(asked) == len(set(asked)) == 4 and make([pa.array([], pa.string())] * 2, pa.string()).to_pylist() == []
