"""Evaluation aggregates. Means stay raw here; presentation rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, population standard deviation, n_total, n_valid, n_none."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(F.col(value).cast("double")).alias("std"), F.count(F.lit(1)).alias("n_total"), F.count(value).alias("n_valid"), F.count_if(F.col(value).isNull()).alias("n_none"))


def counts(df: DataFrame, by: list[str], status: str = "status", over_all: bool = False) -> DataFrame:
    """Numbers by status and rates: correct and incorrect over samples without error (or over all), errors over all."""
    n = {s: F.count_if(F.col(status) == s) for s in ("correct", "incorrect", "error")}
    base = F.count(F.lit(1)) if over_all else n["correct"] + n["incorrect"]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), *[c.alias(f"n_{s}") for s, c in n.items()],
        *[F.try_divide(n[s], base).alias(f"{s}_rate") for s in ("correct", "incorrect")], F.try_divide(n["error"], F.count(F.lit(1))).alias("error_rate"))


def rate(condition: Column) -> Column:
    """Share of rows that meet a condition; rows where it is unknown do not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def baseline(df: DataFrame, by: list[str], predicted: str, gold: str, tolerance: float | None = None) -> DataFrame:
    """n_total, n_parsed, parse_rate, accuracy of what was parsed and of all, and the mean absolute error of numbers."""
    p, g = F.col(predicted), F.col(gold)
    hit = p == g if tolerance is None else F.abs(p - g) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(p), F.abs(g)), F.lit(tolerance))
    n, parsed, right = F.count(F.lit(1)), F.count(predicted), F.count_if(hit)
    out = df.groupBy(*by) if by else df.groupBy()
    return out.agg(n.alias("n_total"), parsed.alias("n_parsed"), (n - parsed).alias("n_parse_error"), F.try_divide(parsed, n).alias("parse_rate"),
                   F.try_divide(right, parsed).alias("accuracy"), F.try_divide(right, n).alias("accuracy_total"),
                   *([F.avg(F.abs(p - g)).alias("mae")] if tolerance is not None else []))


def macro_f1(df: DataFrame, by: list[str], predicted: str, gold: str) -> DataFrame:
    """Mean F1 over the gold labels of each group (an extension: no run of the original pipeline has it)."""
    t = F.count_if(F.col(predicted) == F.col(gold))
    right = df.groupBy(*by, F.col(gold).alias("label")).agg(t.alias("tp"), F.count(F.lit(1)).alias("n_gold"))
    said = df.filter(F.col(predicted).isNotNull()).groupBy(*by, F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("n_said"))
    f1 = 2 * F.col("tp") / (F.col("n_gold") + F.coalesce("n_said", F.lit(0)))
    return right.join(said, [*by, "label"], "left").groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def with_gold(df: DataFrame, gold: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """df with the gold columns of its sample; an unknown sample has the defaults."""
    out = df.join(gold.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


#: What an unknown sample of a table task is taken to have.
UNKNOWN_TABLE_SAMPLE = {"gold_query": "", "gold_target": True}


def flips_are_decided(verdict: Column, mediator: Column) -> Column:
    """Whether a flipped answer of a checklist decides the verdict: all hold, or there is a single question."""
    return F.coalesce((verdict == "Supported") | (F.size(mediator) == 1), F.lit(False))


def known_status(df: DataFrame, status: str = "status", unknown: str | None = None) -> DataFrame:
    """Without samples of an unknown status; or with these as ``unknown`` (the table task counts them as errors)."""
    known = F.coalesce(F.col(status).isin("correct", "incorrect", "error"), F.lit(False))
    return df.filter(known) if unknown is None else df.withColumn(status, F.when(known, F.col(status)).otherwise(F.lit(unknown)))


def run_meta(df: DataFrame, by: list[str], status: str = "status", digits: int = 3) -> DataFrame:
    """What a run's dump says of it: numbers by status and rounded rates, 0 where there is nothing to divide by."""
    n = lambda s: F.count_if(F.col(status) == s)
    over = lambda x, y: F.round(x / F.greatest(y, F.lit(1)), digits)
    total, done = F.count(F.lit(1)), n("correct") + n("incorrect")
    return df.groupBy(*by).agg(total.alias("total_samples"), *[n(s).alias(f"n_{s}") for s in ("correct", "incorrect", "error")],
                               over(n("correct"), done).alias("correct_rate"), over(n("incorrect"), done).alias("incorrect_rate"), over(n("error"), total).alias("error_rate"))
