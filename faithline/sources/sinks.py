"""Result sinks. Tables for people are small; they alone are collected, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_dump(df: DataFrame, path: str) -> None:
    """A run's samples as JSON lines, in parallel."""
    df.write.mode("overwrite").json(path)


def run_folder(df: DataFrame, meta: dict[str, object], metrics: DataFrame, path: str) -> None:
    """A run's dump as a folder: result/ has the samples as JSON lines, metrics/ the measures, meta/ one line about the run. All three
    are written beside the folder and put in its place by one renaming, so that a run that breaks off leaves none or the one that was there."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, made = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}.pending"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    keys = ", ".join(f"`{k}` string" for k in meta)
    about = spark.createDataFrame([tuple(None if v is None else str(v) for v in meta.values())], keys)
    try:
        for part, rows in (("result", df), ("metrics", metrics), ("meta", about)):
            rows.write.json(f"{made}/{part}")
        files.delete(target, True)
        if not files.rename(made, target):
            raise OSError(f"{path} cannot be put in place")
    finally:
        files.delete(made, True)


def csv(df: DataFrame, path: str) -> None:
    """A table as CSV files with headers, one for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A table in Markdown, every row of it."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def markdown_lines(df: DataFrame, order: list[str], digits: int = 3) -> DataFrame:
    """The lines of a Markdown table as rows (value), for tables of any size: sorted by ``order`` over all partitions, the head first. As text files the
    parts in the order of their names are the table."""
    def shown(c: str, kind: str) -> Column:
        said = F.format_string(f"%.{digits}f", F.col(c).cast("double")) if kind in ("double", "float") else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), "").otherwise(said)
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.select(F.lit(2).alias("__part"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], line([shown(c, t) for c, t in df.dtypes]).alias("value"))
    spark, kinds = df.sparkSession, dict(df.dtypes)
    head = spark.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "| " + " | ".join("---" for _ in df.columns) + " |")], "__part int, value string")
    head = head.select("__part", *[F.lit(None).cast(kinds[c]).alias(n) for c, n in zip(order, names, strict=True)], "value")
    return head.unionAll(rows).orderBy("__part", *names, "value").select("value")


#: Differences and their colours, green over yellow to orange; between two of them colours are mixed.
ANCHORS = ((0.00, (0x5D, 0xBB, 0x89)), (0.26, (0xD3, 0xCF, 0x70)), (0.36, (0xFF, 0xD4, 0x66)), (0.65, (0xEB, 0x8C, 0x70)))


def colour(delta: Column) -> Column:
    """The colour of a difference, as six hexadecimal digits; null for null or NaN."""
    d = F.least(F.greatest(delta.cast("double"), F.lit(0.0)), F.lit(1.0))
    channels = []
    for k in range(3):
        mixed = F.lit(ANCHORS[-1][1][k])
        for (low, a), (high, b) in reversed(list(zip(ANCHORS, ANCHORS[1:], strict=False))):
            mixed = F.when(d <= high, F.rint(F.lit(float(a[k])) + (d - low) / (high - low) * (b[k] - a[k])).cast("int")).otherwise(mixed)
        channels.append(mixed)
    return F.when(delta.isNotNull() & ~F.isnan(delta.cast("double")), F.format_string("%02X%02X%02X", *channels))


def latex(df: DataFrame, delta_columns: tuple[str, ...] = (), digits: int = 2) -> str:
    """A table for people in LaTeX, every row of it; differences have their colours."""
    coloured = df.withColumns({f"__{c}": colour(F.col(c)) for c in delta_columns})
    out = [r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\", r"\hline"]
    for r in coloured.collect():
        cells = []
        for c in df.columns:
            v = "" if r[c] is None else f"{r[c]:.{digits}f}" if isinstance(r[c], float) else str(r[c]).replace("_", r"\_")
            if c in delta_columns and r["__" + c] is not None:
                v = rf"\cellcolor[HTML]{{{r['__' + c]}}}{v}"
            cells.append(v)
        out.append(" & ".join(cells) + r" \\")
    return "\n".join([*out, r"\end{tabular}"]) + "\n"
