"""Programs as data: a column of program texts, each run on the table of its row, without leaving the JVM.

A program is its form and its literals. ``form`` takes the literals out of a text by one regular expression: what is left, with a mark for each
literal, is shared by all programs that differ in columns and values only. The driver sees nothing but distinct forms; it parses each once (marks are
ordinary characters to the parser, so every repair works as it does on the text) and compiles PLANS of them into one aggregation at a time: one scan
of the tables, one join with the programs asked of them (dealt like any hot table, see ``phases``), one ``groupBy`` with each form's
aggregates under the condition that the program has that form. Literals and column names are Columns there.

Defined results: a null program, one without ``=True`` or ``=False`` at its end, or one that holds the two characters used as marks is not
executable; nor is any on a table that has no rows. Programs that are asked twice of a table are run once."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiler import Compiler, Fails, Family, Value, runs, truth_of
from .parser import Call, Literal, Node, ProgramError, parse_program
from .phases import Hot, hot_tables, joined_back, same
from .values import number_sql, quoted, strip, strip_sql, text_sql, unquoted_sql

#: Forms compiled into one plan.
PLANS = 16
OPEN, CLOSE = "\x01", "\x02"
_MARK = re.compile(f"{OPEN}(\\d+){CLOSE}")
# a literal stands between delimiters and is no word of the language; quotes hide delimiters
_LITERAL = r'(?U)([{;,]\s*+)(?!(?i:true|false)\s*+[};,]|all_rows\s*+[};,])((?:"[^"]*+"|[^{};,"\s]++|\s++(?=[^\s{};,]))++)(?=\s*+[};,])'
_PROGRAM = r"(?is)^([a-z_][a-z_0-9]*\{.*|\s*(true|false)\s*)=\s*(true|false)\s*$"


def _plain(program: Column) -> Column:
    return F.replace(F.replace(strip(program), F.lit("&#34;"), F.lit('"')), F.lit("&quot;"), F.lit('"'))


def form(program: Column) -> Column:
    """A program without its literals; null for a text that cannot be one."""
    t = _plain(program)
    return F.when(t.rlike(_PROGRAM) & ~t.rlike(f"[{OPEN}{CLOSE}]"), F.regexp_replace(t, _LITERAL, f"$1{OPEN}"))


def literals(program: Column) -> Column:
    """The literals that ``form`` took out, in order."""
    return F.regexp_extract_all(_plain(program), F.lit(_LITERAL), 2)


def each(array: str, rule: Callable[[str], str]) -> Column:
    """A SQL rule for every element of an array."""
    return F.expr(f"transform({array}, x -> {rule('x')})")


def literal_sql(x: str) -> str:
    """What a literal says: without blanks, and without quotes, around it."""
    return unquoted_sql(strip_sql(x))


def marked(form_text: str) -> str:
    """A form whose marks are numbered."""
    n = itertools.count()
    return re.sub(OPEN, lambda _: f"{OPEN}{next(n)}{CLOSE}", form_text)


def _pieces(text: str) -> list[tuple[str, int]]:
    """A literal as (text, -1) and ('', number of a mark)."""
    return [(p, -1) if i % 2 == 0 else ("", int(p)) for i, p in enumerate(_MARK.split(text)) if p]


class _Literals:
    """The Values of a form's literals, from the program's own."""

    def __call__(self, raw: str) -> Value:
        pieces = _pieces(raw)
        if all(n < 0 for _, n in pieces):
            return Value("text", F.lit(raw), literal=raw)
        if len(pieces) == 1:
            n = pieces[0][1]
            return Value("text", F.get("__lits", F.lit(n)), number=F.get("__nums", F.lit(n)), text=F.get("__texts", F.lit(n)))
        whole = "concat(" + ", ".join(quoted(t) if n < 0 else f"get(__args, {n})" for t, n in pieces) + ")"
        said = literal_sql(whole)
        return Value("text", F.expr(said), number=F.expr(number_sql(said)), text=F.expr(text_sql(said)))


def with_literals(df: DataFrame, program: str) -> DataFrame:
    """The columns that a program's text gives: its form, its literals, and what they are as numbers and texts."""
    df = df.withColumns({"__form": form(F.col(program)), "__args": literals(F.col(program))}).withColumn("__lits", each("__args", literal_sql))
    return df.withColumns({"__nums": each("__lits", number_sql), "__texts": each("__lits", text_sql)})


def _block(asked: DataFrame, family: Family, hot: Hot, forms: list[str], program: str) -> DataFrame | None:
    """keys, program, final and executable of the programs of some forms; None if none of them can be run."""
    keys = (*family.keys, program)
    mine = with_literals(asked.filter(F.col("__form").isin(forms)).select(*keys), program)
    rows = joined_back(family.df.select(*family.keys, family.row, *family.stored()), mine, family.keys, family.row, hot)
    c = Compiler(family.over(rows, keys), _Literals(), lambda tables: with_literals(tables, program), hot)
    done: list[tuple[Column, Column, bool, Value]] = []
    for f in forms:
        here = F.col("__form") == f
        c.scope(f, here)
        before = dict(c.back)
        try:
            p = parse_program(marked(f))
            v = truth_of(c, p)
        except (ProgramError, Fails):
            c.back = before
            continue
        ok = runs(v)
        done.append((here, F.when(ok, F.coalesce(v.col, F.lit(False)) == p.expected), ok, v))
    if not done:
        return None
    which = lambda pairs: reduce(lambda acc, x: acc.when(*x), pairs[1:], F.when(*pairs[0]))
    got = c.grouped(frozenset().union(*(v.needs for _, _, _, v in done)))
    return got.select(*keys, which([(here, final) for here, final, _, _ in done]).alias("final"), which([(here, ok) for here, _, ok, _ in done]).otherwise(False).alias("executable"))


def run_programs(programs: DataFrame, family: Family, program: str = "program") -> DataFrame:
    """The rows of ``programs`` (the family's keys, a program, other columns) with final and executable: each program on the table of its keys."""
    keys = (*family.keys, program)
    asked = programs.select(*keys).distinct().withColumn("__form", form(F.col(program))).filter("__form IS NOT NULL")
    forms = sorted(r[0] for r in asked.select("__form").distinct().collect())
    hot = hot_tables(family.df, family.keys)
    blocks = [b for lo in range(0, len(forms), PLANS) if (b := _block(asked, family, hot, forms[lo : lo + PLANS], program)) is not None]
    if not blocks:
        return programs.withColumns({"final": F.lit(None).cast("boolean"), "executable": F.lit(False)})
    names = {k: f"__r{i}" for i, k in enumerate(keys)}
    got = reduce(DataFrame.unionAll, blocks).withColumnsRenamed(names)
    out = programs.join(got, same(programs, got, list(names.items())), "left").drop(*names.values())
    return out.withColumn("executable", F.coalesce("executable", F.lit(False)))


# what programs mention

#: Operators whose second argument is no column.
_NO_FIELD = frozenset("eq not_eq greater less and or add diff before after first second third fourth fifth last".split())


def mentioned(node: Node) -> tuple[list[str], list[str]]:
    """(columns, other literals) of a tree, as they stand there."""
    columns: list[str] = []
    others: list[str] = []
    if isinstance(node, Call):
        for i, a in enumerate(node.args):
            if isinstance(a, Call):
                c, o = mentioned(a)
                columns += c
                others += o
            else:
                (columns if i == 1 and node.name not in _NO_FIELD else others).append(a.text)
    return columns, others


def columns_and_values(programs: DataFrame, program: str = "program") -> DataFrame:
    """``programs`` with columns and values: the column names and the literals without a number that a program mentions, each sorted and
    once; both are empty for a text that is no program, and null for a null."""
    spark = programs.sparkSession
    d = programs.withColumn("__form", form(F.col(program)))
    found = []
    for r in d.select("__form").filter("__form IS NOT NULL").distinct().collect():
        try:
            columns, others = mentioned(parse_program(marked(r[0])).expr)
        except ProgramError:
            columns, others = [], []
        found.append((r[0], [_pieces(t) for t in columns], [_pieces(t) for t in others]))
    piece = "array<array<struct<t:string,n:int>>>"
    forms = spark.createDataFrame(found, f"__f string, __c {piece}, __o {piece}")
    d = d.withColumn("__args", literals(F.col(program))).join(forms, F.col("__form") == F.col("__f"), "left")

    def texts(templates: str) -> Column:
        whole = f"transform({templates}, t -> array_join(transform(t, p -> CASE WHEN p.n < 0 THEN p.t ELSE get(__args, p.n) END), ''))"
        return F.filter(each(whole, lambda x: text_sql(literal_sql(x))), lambda x: ~x.isin("", "all_rows"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.col(program).isNotNull(), F.coalesce(F.array_sort(F.array_distinct(c)), none))
    d = d.withColumn("__others", texts("__o"))
    values = F.expr(f"filter(__others, x -> ({number_sql('x')}) IS NULL)")
    return d.withColumns({"columns": listed(texts("__c")), "values": listed(values)}).drop("__others", "__form", "__args", "__f", "__c", "__o")
