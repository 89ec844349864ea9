"""Dataset and run readers. All are lazy scans; keys come from rows or paths, never from file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\n\r", "  "))


def tabfact_queries(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry of a JSON object of lists by table: idx, table_id, statement, gold_query, local_edits. Each file is one value of
    one task, so of 2 GB at most; larger collections come as several files."""
    entry = "struct<main_question:string,main_program:string,table_name:string,local_edits:array<string>>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,array<{entry}>>")).alias("table_id", "entries")).select("table_id", F.explode("entries").alias("e"))
    statement = one_line(F.col("e.main_question"))
    idx = F.concat(F.replace(F.col("table_id"), F.lit(".html.csv"), F.lit("")), F.lit("@"), F.substring(F.md5(statement), 1, 8))
    return rows.select(idx.alias("idx"), "table_id", statement.alias("statement"), F.col("e.main_program").alias("gold_query"), F.col("e.table_name").alias("caption"), F.col("e.local_edits").alias("local_edits"), F.lit(True).alias("gold_target"))


def tables(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """table_id and text of a folder of '#'-separated tables, only those wanted (by table_id)."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("table_id"), F.trim("value").alias("text"))
    return t if wanted is None else t.join(wanted.select("table_id").distinct(), "table_id", "left_semi")


def table_cells(tables: DataFrame, sep: str = "#", na_mode: str = "literal", skip_bad: bool = True) -> DataFrame:
    """table_id, header array, __row, cells array; all cells are text. na_mode 'pandas' turns the usual missing
    markers to 'nan', as a reader without keep_default_na=False does. Rows with too many cells are skipped."""
    lines = F.filter(F.split("text", r"\r\n|\n|\r"), lambda s: F.trim(s) != "")
    rows = tables.select("table_id", F.split(F.get(lines, F.lit(0)), sep, -1).alias("header"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("__pos", "line"))
    cells = F.split("line", sep, -1)
    rows = rows.withColumn("cells", cells)
    if skip_bad:
        rows = rows.filter(F.size("cells") <= F.size("header"))
    cells = F.concat("cells", F.array_repeat(F.lit(""), F.size("header") - F.size("cells")))
    if na_mode == "pandas":
        missing = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>", "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#NA", "#N/A N/A"]
        cells = F.transform(cells, lambda c: F.when(c.isin(missing), F.lit("nan")).otherwise(c))
    row = F.row_number().over(Window.partitionBy("table_id").orderBy("__pos")).cast("long") - 1
    return rows.select("table_id", "header", row.alias("__row"), cells.alias("cells"))


def joined_queries(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Queries with the text of their table, as table_html_csv; those without a table go."""
    return queries.join(tables.select("table_id", F.col("text").alias("table_html_csv")), "table_id")


def ricechem(spark: SparkSession, rubric_path: str, answers_path: str, task: int) -> DataFrame:
    """idx, task_idx, student_answer, rubric (checklist) and gold_score. Rows with missing rubric cells go, the first
    data row of each file is skipped, and both sides must be there. Files with quoted line breaks are never split, so within a
    file the numbers of the rows ascend, whatever other files there are."""
    read = lambda p: _numbered(spark.read.csv(p, header=True, multiLine=True, escape='"'))
    rubric, answers = read(rubric_path), read(answers_path)
    items = [c for c in rubric.columns if c not in ("SID", "Score", "__n")]
    rubric = rubric.dropna(subset=[*items, "Score"])
    skip = lambda d: d.filter("__n > 0")
    clean = F.replace(F.replace(one_line(F.col("Answer")), F.lit("Â"), F.lit("")), F.lit("â€™"), F.lit("'"))
    a = skip(answers).filter(F.length(F.trim("Answer")) > 0).select("SID", clean.alias("student_answer"))
    checklist = F.array(*[F.struct(F.lit(c).alias("item"), F.lit(i).alias("pos"), (F.lower(F.col(f"`{c}`").cast("string")).isin("true", "1", "1.0")).alias("answer")) for i, c in enumerate(items)])
    r = skip(rubric).select("SID", checklist.alias("gold_rubric"), F.col("Score").try_cast("double").alias("gold_score"))
    return a.join(r, "SID").select(F.concat(F.lit(f"{task}@"), "SID").alias("idx"), F.lit(task).alias("task_idx"), "student_answer", "gold_rubric", "gold_score")


def _numbered(d: DataFrame) -> DataFrame:
    """Rows with __n, their number in their file, for files that are read whole by one task each."""
    d = d.withColumns({"__n": F.monotonically_increasing_id(), "__file": F.col("_metadata.file_path")})
    first = d.groupBy("__file").agg(F.min("__n").alias("__first"))
    return d.join(F.broadcast(first), "__file").withColumn("__n", F.col("__n") - F.col("__first")).drop("__first", "__file")  # a row for each file


def averitec(spark: SparkSession, path: str, excluded: DataFrame | None = None, explanations: bool = True) -> DataFrame:
    """idx (original position), claim, gold_rubric, explanations, gold_target: first answers that are yes or no, claims
    that are Supported, or Refuted by exactly one question; few-shot claims excluded. The array's entries are read one by one."""
    q = "struct<question:string,answers:array<struct<answer:string,boolean_explanation:string>>>"
    d = _numbered(spark.read.schema(f"claim string, label string, questions array<{q}>").option("multiLine", True).json(path))
    d = d.select(F.col("__n").alias("pos"), F.struct("claim", "label", "questions").alias("c"))
    first = F.transform("c.questions", lambda x: F.struct(x["question"].alias("item"), F.lower(F.trim(F.get(x["answers"], F.lit(0))["answer"])).alias("a"), F.get(x["answers"], F.lit(0))["boolean_explanation"].alias("text")))
    usable = F.filter(first, lambda x: x["a"].isin("yes", "no"))
    d = d.select(F.col("pos").cast("string").alias("idx"), F.trim("c.claim").alias("claim"), F.col("c.label").alias("gold_target"), usable.alias("u"))
    d = d.filter((F.size("u") > 0) & ((F.col("gold_target") == "Supported") | ((F.col("gold_target") == "Refuted") & (F.size("u") == 1))))
    rubric = F.transform("u", lambda x, i: F.struct(x["item"].alias("item"), i.alias("pos"), (x["a"] == "yes").alias("answer")))
    notes = F.transform("u", lambda x: F.struct(x["item"].alias("question"), x["text"].alias("text")))
    d = d.select("idx", "claim", "gold_target", rubric.alias("gold_rubric"), (notes if explanations else F.slice(notes, 1, 0)).alias("explanations"))
    return d if excluded is None else d.join(excluded.select("claim").distinct(), "claim", "left_anti")


def cruxeval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, code string, input string, output string").json(path)


def run_dumps(spark: SparkSession, root: str, schema: str, runs: bool = True, newest: str = "file_name") -> DataFrame:
    """Samples of run dumps {root}/dataset[/run]/model_*.json with dataset, run_type, model and file_name from the path;
    of each model the file with the last name, or, with ``newest`` as modified, the one that was written last (of equal times the last name)."""
    from ..operators.faithfulness import latest

    d = spark.read.schema(f"meta map<string,string>, result array<{schema}>").option("multiLine", True).json(f"{root}/*{'/*' if runs else ''}/*.json")
    path = F.split(F.col("_metadata.file_path"), "/")
    part = lambda k: F.element_at(path, -k)
    d = d.select("meta", "result", part(3 if runs else 2).alias("dataset"), (part(2) if runs else F.lit("baseline")).alias("run_type"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"))
    d = d.withColumn("model", F.regexp_extract("file_name", r"^(.*?)(?:_\d.*)?\.json$", 1))
    if newest not in ("file_name", "modified"):
        raise ValueError(f"dumps are not told apart by {newest}")
    d = d.withColumn("__newest", F.struct(newest, "file_name"))
    return latest(d, ["dataset", "run_type", "model"], "__newest").select("dataset", "run_type", "model", "file_name", "meta", F.explode("result").alias("r")).select("dataset", "run_type", "model", "file_name", "meta", "r.*")
