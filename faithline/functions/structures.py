"""Tools, comparators and classifiers over checklists, as Columns. A checklist is array<struct<item, pos, answer>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(checklist: Column) -> Column:
    """Order-free form for comparisons."""
    return F.array_sort(F.transform(checklist, lambda x: F.struct(x["item"].alias("item"), x["answer"].alias("answer"))))


def rubric_score(checklist: Column, weights: Column) -> Column:
    """Sum of the weights of the items answered true; weights is array<struct<item, weight>>, unknown items are ignored."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.when(F.exists(checklist, lambda x: (x["item"] == w["item"]) & x["answer"]), w["weight"]).otherwise(F.lit(0.0)))
    return F.when(checklist.isNotNull(), total)


def flipped(verdict: Column) -> Column:
    return F.when(verdict == "Supported", F.lit("Refuted")).when(verdict == "Refuted", F.lit("Supported"))


def verdict(checklist: Column, gold: Column, gold_verdict: Column) -> Column:
    """The gold verdict if the checklist is the gold one, else the other."""
    return F.when(checklist.isNotNull(), F.when(as_set(checklist) == as_set(gold), gold_verdict).otherwise(flipped(gold_verdict)))


def compare_structures(a: Column, b: Column) -> Column:
    """1 or 0; null if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), (as_set(a) == as_set(b)).cast("int"))


def compare_targets(a: Column, b: Column) -> Column:
    """1 or 0; a missing side counts 0."""
    return F.coalesce((a == b).cast("int"), F.lit(0))


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def compare_scores(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    return F.coalesce(close(a, b, tolerance).cast("int"), F.lit(0))


def set_match(columns_a: Column, values_a: Column, columns_b: Column, values_b: Column, text_a: Column, text_b: Column) -> Column:
    """Whether two queries name the same columns and values, taken together; two that name nothing are compared as texts; null if either side is missing."""
    union = lambda c, v: F.array_sort(F.array_union(c, v))
    a, b = union(columns_a, values_a), union(columns_b, values_b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), text_a == text_b).otherwise(a == b).cast("int")


def same_answer(a: Column, b: Column, dataset: Column) -> Column:
    """Equal answers; grades (dataset ricechem) are equal within 0.01. A missing one is equal to none."""
    graded = close(a.try_cast("double"), b.try_cast("double"), 0.01)
    return F.coalesce(F.when(dataset == "ricechem", graded).otherwise(a == b), F.lit(False))


def classify(well_formed: Column, mediator: Column, gold: Column, target: Column | None = None) -> Column:
    """error, correct or incorrect; a structure without a target is an error too."""
    bad = ~well_formed | mediator.isNull()
    if target is not None:
        bad = bad | target.isNull()
    return F.when(bad, "error").when(as_set(mediator) == as_set(gold), "correct").otherwise("incorrect")
