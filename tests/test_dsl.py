"""The table language: parser, golden programs, and compiler against the independent row interpreter."""

import random

import pytest

import interpreter
from pyspark.sql import functions as F

from faithline.dsl import batch, text_tables
from faithline.dsl.compiler import Compiler, Family, Value, run, truth_of
from faithline.dsl.parser import Call, Literal, ProgramError, parse_expr, parse_program
from faithline.dsl.phases import hot_tables, joined_back
from faithline.dsl.registry import ARITY

BOATS = {"boat": ["Heron", "Gull", "Tern", "Gull"], "Home Port": ["Oban", "oban", "Leith", "Wick"], "length": ["9.5 m", "1,200", "7 / 2", ""], "time": ["3:05", "0:59.5", "2:30", "10:00"], "pos": ["3", "none", "1", "2"]}

GOLDEN = [
    (BOATS, "eq{count{all_rows}; 4}=True", True),
    (BOATS, "eq{count{filter_eq{all_rows; home port; OBAN}}; 2}=True", True),
    (BOATS, "gt{hop{all_rows; boat}; 1}=True", None),  # a list is no number
    (BOATS, "greater{hop{filter_eq{all_rows; boat; tern}; boat}; 1}=False", None),  # a text without digits neither
    (BOATS, "eq{count{filter_greater{all_rows; length, 5}}; 2}=True", True),  # a comma for a semicolon
    (BOATS, "eq{count{filter_eq{all_rows; length; }}; 1}=True", True),  # blank cells
    (BOATS, "zero{count{filter_eq{all_rows; boat; puffin}}}=True", True),
    (BOATS, "fourth{all_rows; bottom{filter_eq{all_rows; boat; gull}}}=True", True),
    (BOATS, 'eq{hop{argmin{filter_less{all_rows; length; 50}}; boat}; "Tern"}=True', True),  # the filter's column
    (BOATS, 'eq{hop{argmax{all_rows; time}; boat}; "gull"}=True', True),
    (BOATS, "eq{uniq{all_rows; home port}; 3}=True", True),
    (BOATS, 'eq{most_freq{all_rows; boat}; "Gull"}=True', True),
    (BOATS, "eq{avg{filter_less{all_rows; length; 50}; length}; 6.5}=True", True),
    (BOATS, "all_eq{hop{filter_eq{all_rows; boat; gull}; boat}; GULL}=True", True),
    (BOATS, 'eq{rank{all_rows; boat}; "Heron"}=True', True),  # no column named rank: the first row
    ({"rank": ["-", "4", "", "2"], "who": ["Ann", "Bo", "Cy", "Di"]}, 'eq{rank{all_rows; who}; "Di"}=True', True),
    (BOATS, "count{all_rows}=False", None),
    (BOATS, "less{hop{top{filter_eq{all_rows; boat; tern}}; length}; hop{top{filter_eq{all_rows; boat; heron}}; length}}=True", True),
    (BOATS, "greater{hop{top{filter_eq{all_rows; boat; heron}}; time}; hop{top{filter_eq{all_rows; boat; tern}}; time}}=True", True),
    ({"k": ["p", "q"], "w": ["2 - 1 / 4", "2"]}, "greater{hop{top{filter_eq{all_rows; k; p}}; w}; hop{top{filter_eq{all_rows; k; q}}; w}}=True", True),
    (BOATS, "none{hop{filter_eq{all_rows; boat; puffin}; time}}=True", True),
    (BOATS, "within{all_rows; captain; x}=False", None),
    (BOATS, "sail{all_rows}=True", None),
    (BOATS, "only{all_rows}", None),
    (BOATS, "all_less{filter_not_eq{all_rows; pos; none}; pos; 4}=True", True),
    (BOATS, "all_less{all_rows; pos; 4}=True", None),  # a cell that is no number
    ({"x": ["9", "soon"]}, "all_less{all_rows; x; 4}=False", True),  # decided before it is reached
    ({"x": ["12 oars"]}, 'eq{hop{top{all_rows}; x}; "12 sails"}=True', True),
]


def family(spark, tables):
    names = list(tables[0])
    rows = [(t, r, *[table[c][r] for c in names]) for t, table in enumerate(tables) for r in range(len(table[names[0]]))]
    schema = ", ".join(["key int", "__row long", *[f"`{c}` string" for c in names]])
    return Family(spark.createDataFrame(rows, schema), ("key",))


@pytest.mark.parametrize("columns,program,final", GOLDEN, ids=[g[1][:40] for g in GOLDEN])
def test_golden(spark, columns, program, final):
    assert interpreter.execute(program, columns) == (final, final is not None)
    got = run(program, family(spark, [columns])).collect()
    assert [(r.final, r.executable) for r in got] == [(final, final is not None)]


def test_aggregates_of_other_values_are_other_aggregates(spark):
    """Values die as soon as they are used, so no aggregate may be named after where one lay in memory."""
    import gc

    f = family(spark, [{"k": ["p", "q"], "w": ["1", "2"]}])
    program = parse_program("greater{hop{top{filter_eq{all_rows; k; q}}; w}; hop{top{filter_eq{all_rows; k; p}}; w}}=True")
    for _ in range(100):
        c = Compiler(f)
        c.eval(program.expr)
        gc.collect(0)
        assert len(c.aggs) == len(set(c.seen)) == 4
    assert c.eval(Literal("all_rows")).uid == c.eval(Literal("all_rows")).uid  # equal expressions are one value
    assert len({Value("rows").uid for _ in range(1000)}) == 1000


def test_parser():
    assert parse_expr("gt{a; b}") == Call("greater", (Literal("a"), Literal("b")))
    assert parse_expr("count{all_rows; x; y}") == Call("count", (Literal("all_rows"),))
    assert parse_expr("filter_eq{all_rows; a; b; c}").args[2] == Literal("b, c")
    assert parse_expr("filter_eq{all_rows; a, b, c}").args[1:] == (Literal("a, b"), Literal("c"))
    assert parse_expr("eq{a; b; c}").args[1] == Literal("b, c")
    assert parse_expr("and{a; ; b}").args == (Literal("a"), Literal("b"))
    assert parse_expr("not{}").args == (Literal(""),)
    assert parse_expr("eq{a; b} tail") == Literal("eq{a; b} tail")
    assert parse_expr("eq{a; b") == Literal("eq{a; b")
    assert parse_expr('eq{"x; y"; b}').args[0] == Literal('"x; y"')
    assert parse_expr("eq{&quot;x; y&quot;; b}").args[0] == Literal('"x; y"')
    assert parse_program("eq{a=b; c} = FALSE").expected is False
    with pytest.raises(ProgramError):
        parse_program("eq{a; b}=maybe")
    assert len(ARITY) == 50


WORDS = ["a", "b", "A ", "", "1", "2", "1,000", "3 laps", "1/2", "1:30", '"b"', "1 - 1 / 4", "x9", "nan"]
PROGRAMS = [
    "eq{count{filter_eq{all_rows; x; a}}; 2}=True", "eq{count{filter_not_eq{all_rows; x; 1}}; 2}=False", "less{sum{filter_less_eq{all_rows; x; 2}; y}; 3}=True",
    "eq{hop{argmax{all_rows; x}; y}; b}=True", "eq{hop{argmin{all_rows; x}; y}; 1}=True", "before{argmax{all_rows; x}; argmin{all_rows; y}}=True",
    "fifth{all_rows; bottom{filter_greater_eq{all_rows; x; 1}}}=True", "last{filter_eq{all_rows; y; b}; bottom{all_rows}}=True", "second{filter_not_eq{all_rows; x; a}; argmax{all_rows; y}}=True",
    "eq{most_freq{all_rows; x}; most_freq{all_rows; y}}=True", "greater{uniq{all_rows; x}; uniq{filter_less{all_rows; y; 2}; y}}=True", "all_less{filter_greater{all_rows; y; 0}; x; 1000}=True",
    "all_greater{hop{all_rows; x}; 0}=False", "sum{hop{all_rows; x}}=True", "eq{sum{hop{all_rows; x}}; 3}=True", "any{hop{filter_eq{all_rows; x; a}; y}}=True", "none{filter_eq{all_rows; x; hop{top{all_rows}; y}}}=True",
    "within{filter_greater{all_rows; x; avg{all_rows; y}}; y; 1}=True", "or{hop{top{all_rows}; x}; only{all_rows}}=True", "and{hop{all_rows; x}; not{within{all_rows; y; a}}}=True", "eq{max{all_rows; x}; max{all_rows; y}}=True",
    "greater{diff{max{all_rows; x}; min{all_rows; x}}; half{all_rows}}=True", "all_not_eq{all_rows; x; a}=True", "all_eq{all_rows; x; hop{all_rows; y}}=True", "not_within{filter_eq{all_rows; x; zz}; nope; 1}=True", "eq{rank{all_rows; x}; a}=True",
    "eq{uniq{filter_greater{all_rows; x; uniq{all_rows; y}}; x}; 1}=True", "zero{add{hop{top{all_rows}; x}; hop{bottom{all_rows}; y}}}=False",
]


def test_compiler_against_interpreter(spark):
    rng = random.Random(7)
    tables = [{"x": [rng.choice(WORDS) for _ in range(n)], "y": [rng.choice(WORDS) for _ in range(n)]} for n in [rng.randint(1, 6) for _ in range(40)]]
    f = family(spark, tables)
    f = Family(f.df.cache(), f.keys)
    for p in PROGRAMS:
        got = {r.key: (r.final, r.executable) for r in run(p, f).collect()}
        for t, table in enumerate(tables):
            assert got[t] == interpreter.execute(p, table), (p, table)


def test_columns_of_programs(spark):
    """Every golden program and every program of the random tables, as data on all tables at once."""
    rng = random.Random(11)
    tables = [{"x": [rng.choice(WORDS) for _ in range(n)], "y": [rng.choice(WORDS) for _ in range(n)]} for n in [rng.randint(1, 6) for _ in range(8)]]
    more = ["only{all_rows}", "eq{count{filter_eq{all_rows; x, a, b}}; 1}=True", 'eq{count{filter_eq{all_rows; X; "a"}}; 1}=False', "true = TRUE", "false=True", "eq{a; b", "sail{all_rows}=True", "nothing", "", None,
            "eq{count{filter_eq{all_rows; y; 1, 000}}; 0}=True", "and{only{all_rows}; ; any{all_rows}}=True", "eq{hop{top{all_rows}; &quot;y&quot;}; &#34;A &#34;}=True", "not{}=False", "before{true; argmax{all_rows; x}}=True",
            "eq{hop{only{all_rows}; x}; a}=False", "eq{argmax{all_rows; x}; 1}=True", "filter_eq{all_rows; x; {}}=True", 'eq{"x; y}"; b}=False', "eq{ a  b ;A  B}=True", "eq{uniq{all_rows;x};  2 }= true", "eq{\x01; a}=True",
            "all_greater{all_rows; x; hop{top{all_rows}; y}}=True", "within{filter_eq{all_rows; x; hop{bottom{all_rows}; x}}; y; b}=True", "eq{hop{all_rows; y}; b}=True"]
    every = PROGRAMS + more
    for dense in (True, False):
        f = family(spark, tables)
        f = f if dense else Family(f.df.withColumn("at", F.col("__row") * 10).drop("__row"), ("key",), "at", ("x", "y"), dense=False)
        asked = spark.createDataFrame([(t, p, "kept") for t in [*range(8), 99, None] for p in every] + [(0, every[0], "twice")], "key int, program string, more string")
        got = {(r.key, r.program): (r.final, r.executable) for r in batch.run_programs(asked, f).collect()}
        assert len(got) == 10 * len(every) and batch.run_programs(asked, f).count() == 10 * len(every) + 1
        for t, p in got:
            expected = interpreter.execute(p, tables[t]) if t in range(8) and p is not None and "\x01" not in p else (None, False)
            assert got[t, p] == expected, (p, tables[t] if t in range(8) else t)


def test_mentioned_columns_and_values(spark):
    texts = [*PROGRAMS, *(p for _, p, _ in GOLDEN), 'eq{hop{all_rows; "Home Port"}; Oban}=True', "filter_eq{all_rows; a, b, c}=True", "eq{a; b; c}=True", "eq{12; x 3}=True"]
    got = batch.columns_and_values(spark.createDataFrame([(p,) for p in [*texts, "none", None]], "program string")).collect()
    for r in got:
        try:
            expected = interpreter.columns_and_values(r.program) if r.program else (None, None)
        except ProgramError:
            expected = ([], [])
        assert (r.columns, r["values"]) == expected, r.program


TEXTS = {
    "boats": "Boat#Home Port#length\nHeron#Oban#9.5 m\nGull#oban\n\nTern#Leith#7 / 2#too many\n\"Great # auk\"#\"the \"\"old\"\" port\"#12\r\n",
    "no length": "boat#home port#boat\nHeron#Oban#x\nTern#Wick#y",
    "one row": "length\n4", "header only": "boat#length", "empty": "", "blank names": "##x\na#b#c", "none": None,
}
TEXT_PROGRAMS = {  # program -> its verdict by table, null where not listed
    "eq{count{filter_eq{all_rows; home port; oban}}; 2}=True": {"boats": True, "no length": False},
    "greater{max{all_rows; length}; 10}=True": {"boats": True, "one row": False},
    "eq{count{all_rows}; 3}=False": {"boats": False, "no length": True, "one row": True, "blank names": True},
    "eq{hop{bottom{all_rows}; boat}; Great # auk}=True": {"boats": True, "no length": False},
    'eq{hop{bottom{all_rows}; home port}; the "old" port}=True': {"boats": True, "no length": False},
    "eq{hop{top{all_rows}; boat.1}; x}=True": {"no length": True},
    "eq{hop{filter_eq{all_rows; length; }; boat}; gull}=True": {"boats": True},
    "eq{hop{all_rows; Unnamed: 1}; b}=True": {"blank names": True},
    "none{filter_greater{all_rows; length; 100}}=True": {"boats": True, "one row": True},
    "second{all_rows; argmin{all_rows; length}}=True": {"boats": False, "one row": False},
    "only{all_rows}=true": {},
}


def test_ragged_tables(spark):
    tables = spark.createDataFrame(list(TEXTS.items()), "table_id string, text string")
    asked = spark.createDataFrame([(t, p) for t in [*TEXTS, "missing", None] for p in [*TEXT_PROGRAMS, None]], "table_id string, program string")
    got = text_tables.verdicts(asked, tables)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == asked.count()
    for r in got.collect():
        assert r.verdict == TEXT_PROGRAMS.get(r.program, {}).get(r.table_id), r
    asked = asked.filter("table_id = 'boats'")
    twice = tables.unionAll(spark.createDataFrame([("boats", "a#b\nc#d")], "table_id string, text string"))
    assert [r.verdict for r in text_tables.verdicts(asked, twice).collect()].count(True) == [r.verdict for r in text_tables.verdicts(asked, tables).collect()].count(True)  # the least text
    nan = text_tables.verdicts(spark.createDataFrame([("boats", "eq{hop{filter_eq{all_rows; length; nan}; boat}; gull}=True")], "table_id string, program string"), tables, blanks=True)
    assert [r.verdict for r in nan.collect()] == [None]  # no number equals a number that is none


def test_rows_of_a_hot_table_are_spread(spark):
    """A computed filter value and a rank, on a family in which one table has nearly all rows: no window, and many tasks have its rows."""
    df = spark.range(0, 200_000, numPartitions=8).selectExpr("IF(id < 199000, NULL, id) AS t", "id AS at", "CAST(id * 7919 % 200003 AS DOUBLE) AS x")
    f = Family(df, ("t",), "at", ("x",), dense=False)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        c = Compiler(f)
        v = truth_of(c, parse_program("greater{count{filter_greater{all_rows; x; avg{all_rows; x}}}; 90000}=True"))
        got = c.grouped(v.needs)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        hot = hot_tables(df, ("t",))
        assert hot.tables == [(None,)] and not hot_tables(df, ("at",)).tables
        tables = df.groupBy("t").agg((F.count(F.lit(1)) * 2).alias("v"))
        spread = joined_back(df, tables, ("t",), "at", hot)
        tasks = spread.filter("t IS NULL").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).collect()
        assert len(tasks) >= 24 and sum(r.n for r in tasks) == 199_000 and max(r.n for r in tasks) < 30_000 and {r.v for r in tasks} == {398_000}
        assert spread.count() == 200_000
        out = {r.t: r.final for r in run("greater{count{filter_greater{all_rows; x; avg{all_rows; x}}}; 90000}=True", f).collect()}
        assert len(out) == 1001 and out[None] is True and sum(out.values()) == 1
        third = {r.t: r.final for r in run("third{all_rows; argmax{filter_less{all_rows; x; 30000}; x}}=True", Family(df.filter("at % 3 = 0"), ("t",), "at", ("x",), dense=False)).collect()}
        assert third[None] is False
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_grouped_plan(spark):
    """A program without computed filter values shuffles the family once at most, and runs no Python."""
    df = spark.range(1000).selectExpr("id % 10 AS t", "id AS __row", "CAST(id % 7 AS STRING) AS x")
    plan = run("and{greater{sum{filter_greater{all_rows; x; 2}; x}; 5}; within{all_rows; x; 3}}=True", Family(df, ("t",)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_registered_plans(spark):
    """Over rows that are only ordered, a program without computed values is one grouped aggregate; where rows are compared with a value of their
    table, it is joined back to them. No plan numbers rows, and the results are those of numbered rows."""
    import os

    from faithline.plans import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    for name in ("dsl_filter_eq", "dsl_argmax", "dsl_before", "dsl_last", "dsl_sum"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1, name
    for name in ("dsl_second", "dsl_fifth", "dsl_nested_stratified", "dsl_list_forms", "dsl_program_batch", "tabtext_verdict", "iv_edit_pool_admission", "eval_query_match", "dsl_columns_values"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Python", "Pandas", "Arrow")), name
        assert "collect_list" not in plan or name not in ("dsl_list_forms",), name
    df = spark.createDataFrame([(t, 10 * r + t, str(r * 7 % 5)) for t in range(3) for r in range(t + 1)], "key int, at int, x string")
    loose, numbered = Family(df, ("key",), "at", ("x",), dense=False), Family(df.selectExpr("key", "CAST((at - key) / 10 AS long) AS __row", "x"), ("key",), "__row", ("x",))
    for p in ("eq{argmax{all_rows; x}; 1}=True", "or{top{all_rows}; only{all_rows}}=True", "second{all_rows; bottom{all_rows}}=True", "eq{hop{only{all_rows}; x}; 2}=True"):
        assert sorted(run(p, loose).collect()) == sorted(run(p, numbered).collect()), p
