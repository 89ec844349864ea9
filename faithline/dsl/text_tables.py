"""Programs over tables that are texts: a header line and a line for each row, cells divided by '#'.

``rows`` makes one family of tables of any headers: a line is a row that holds its cells beside its table's column names, and columns are looked up by
name where a program asks for them. Programs meet their tables in ``batch``; nothing here leaves the JVM.

As the dataset's own reader has it: a field in double quotes may hold the separator, doubled quotes stand for one; blank lines and rows with more fields than the
header are left out, missing fields are empty; of equal names later ones get a number. A field that says that there is no value (or says nothing) is
the text ``nan`` if ``blanks`` says so; by default it stays as it is. Line breaks within quotes are not looked for. Where one id has several texts,
the least of them counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batch
from .compiler import Ragged
from .values import strip

# What a reader of CSV takes for no value.
NO_VALUE = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Characters of table texts in a task, times the programs asked of a table: a task's rows are some twenty times that.
PART = 16_000_000


def fields(line: Column, sep: str = "#") -> Column:
    """The fields of a line, divided by one character."""
    parts = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{re.escape(sep)}("(?:[^"]++|"")*+"[^{re.escape(sep)}]*+|[^{re.escape(sep)}]*+)'), 1)
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, r'^"((?:[^"]++|"")*+)"', "$1"), '""', '"')
    return F.transform(parts, lambda x: F.when(x.startswith('"'), whole(x)).otherwise(x))


def _told_apart(names: Column) -> Column:
    """Column names: blank ones by their place, repeated ones numbered."""
    named = F.transform(names, lambda x, i: F.when(x == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x))
    def numbered(x: Column, i: Column, every: Column) -> Column:
        before = F.size(F.filter(every, lambda y, j: (y == x) & (j < i)))
        return F.when(before > 0, F.concat(x, F.lit("."), before.cast("string"))).otherwise(x)
    return F.transform(F.array(named), lambda every: F.transform(every, lambda x, i: numbered(x, i, every)))[0]


def dealt(tables: DataFrame, table: str, text: str, programs: int = 1) -> DataFrame:
    """Tables by their ids in partitions of about PART characters for each program. A text is much smaller than its rows beside all the programs asked of it, which a task
    sorts, so what is known of the texts' compressed size must not decide how many a task gets."""
    size = tables.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    parts = -(-size * max(programs, 1) // PART)
    if parts <= tables.sparkSession.sparkContext.defaultParallelism:
        return tables.repartition(table)
    return tables.repartition(parts, table)


def rows(tables: DataFrame, table: str = "table_id", text: str = "text", sep: str = "#", blanks: bool = False, programs: int = 1) -> Ragged:
    """Tables of (id, text) as one family, keyed by the id; ``programs`` says how many are asked of a table, about."""
    one = dealt(tables.select(F.col(table).alias(table), F.col(text).alias("__of")), table, "__of", programs).groupBy(table).agg(F.min("__of").alias("__text"))
    lines = one.select(table, F.filter(F.split("__text", r"\r\n|\n|\r"), lambda x: strip(x) != "").alias("__lines"))
    head = lines.select(table, _told_apart(fields(F.get("__lines", F.lit(0)), sep)).alias("__head"), "__lines")
    names = F.transform("__head", lambda x: F.lower(strip(x)))
    each = head.filter(F.size("__lines") > 1).select(table, names.alias("__names"), F.posexplode(F.slice("__lines", F.lit(2), F.size("__lines") - 1)).alias("__row", "__line"))
    cells = each.select(table, "__row", "__names", fields(F.col("__line"), sep).alias("__found")).filter(F.size("__found") <= F.size("__names"))
    full = F.concat("__found", F.array_repeat(F.lit(""), F.size("__names") - F.size("__found")))
    full = F.transform(full, lambda x: F.when(x.isin(*NO_VALUE), "nan").otherwise(x)) if blanks else full
    return Ragged(cells.select(table, "__row", "__names", full.alias("__cells")), (table,), dense=False)


def verdicts(programs: DataFrame, tables: DataFrame, program: str = "program", table: str = "table_id", text: str = "text", out: str = "verdict", blanks: bool = False) -> DataFrame:
    """The rows of ``programs`` with the verdict of each on its table: null without =True or =False at its end, for a table that is
    unknown or has no row, and for a program that fails there."""
    asked = programs.select(table, program).distinct().filter(F.col(program).rlike("=(True|False)$"))
    each = asked.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(table).alias("t")).first()
    family = rows(tables.select(F.col(table).alias(table), F.col(text).alias("__of")), table, "__of", blanks=blanks, programs=-(-each["n"] // max(each["t"], 1)))
    got = batch.run_programs(asked, family, program).select(F.col(table).alias("__t"), F.col(program).alias("__p"), F.col("final").alias(out))
    return programs.join(got, (programs[table] == got["__t"]) & (programs[program] == got["__p"]), "left").drop("__t", "__p")


def admitted_edits(queries: DataFrame, tables: DataFrame, keys: tuple[str, ...] = ("idx",), edits: str = "local_edits", gold: str = "gold_target", table: str = "table_id") -> DataFrame:
    """keys, edit_no, query, expected_target: the edits of a query that run on its table and say something else than gold."""
    each = queries.select(*keys, table, F.col(gold).alias("__gold"), F.posexplode(edits).alias("edit_no", "query"))
    said = verdicts(each, tables, "query", table, out="expected_target")
    return said.filter(F.col("expected_target").isNotNull() & (F.col("expected_target") != F.col("__gold"))).select(*keys, "edit_no", "query", "expected_target")


def matches(pairs: DataFrame, tables: DataFrame, first: str, second: str, table: str = "table_id") -> DataFrame:
    """``pairs`` with execution_match, columns_match and values_match of two queries: null if either is missing, the first one too
    if either does not run."""
    d = verdicts(verdicts(pairs, tables, first, table, out="__one"), tables, second, table, out="__two")
    for p, name in ((first, "__a"), (second, "__b")):
        d = batch.columns_and_values(d, p).withColumn(name, F.struct("columns", "values")).drop("columns", "values")
    there = F.col(first).isNotNull() & F.col(second).isNotNull()
    equal = lambda c: F.when(there, F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")).cast("int"))
    return d.withColumns({"execution_match": (F.col("__one") == F.col("__two")).cast("int"), "columns_match": equal("columns"), "values_match": equal("values")}).drop("__one", "__two", "__a", "__b")
