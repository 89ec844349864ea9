"""Row generators: what is put in place of a model's structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, CORRECTION = "Local Edits", "Correction"


def checklist_edits(samples: DataFrame, keys: list[str], mediator: str = "mediator", gold: str = "gold", status: str = "status") -> DataFrame:
    """keys, kind, edit_no, mediator: a correct checklist gives a copy for each item with that answer flipped, an
    incorrect one a single copy of the gold checklist, an error none. Only keys and the edited structure are copied."""
    m = F.col(mediator)
    flips = F.transform(m, lambda _, i: F.struct(F.lit(LOCAL).alias("kind"), i.alias("edit_no"), F.transform(m, lambda x, j: F.struct(
        x["item"].alias("item"), x["pos"].alias("pos"), F.when(i == j, ~x["answer"]).otherwise(x["answer"]).alias("answer"))).alias("mediator")))
    fix = F.array(F.struct(F.lit(CORRECTION).alias("kind"), F.lit(0).alias("edit_no"), F.col(gold).alias("mediator")))
    edits = F.when(F.col(status) == "correct", flips).when(F.col(status) == "incorrect", fix)
    return samples.select(*keys, F.explode(edits).alias("__e")).select(*keys, "__e.*")


def pool_edits(samples: DataFrame, pool: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Correct samples joined to their pre-verified edits."""
    return samples.filter(F.col(status) == "correct").select(key).join(pool, key).withColumn("kind", F.lit(LOCAL))


def picked(edits: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One edit of each sample: local ones first, then by ``order``, a hash of the row."""
    names = [c for c in edits.columns if c not in keys]
    first = F.struct((F.col("kind") != LOCAL).alias("l"), order.alias("o"), F.col("edit_no").alias("n"))
    return edits.groupBy(*keys).agg(F.min_by(F.struct(*names), first).alias("__e")).select(*keys, "__e.*")


def sampled(edits: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """At most n edits of each sample, in the order of a keyed hash."""
    from pyspark.sql import Window

    order = F.xxhash64(F.lit(seed), *keys, "edit_no")
    return edits.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "edit_no"))).filter(F.col("__k") <= n).drop("__k")


def edit_prompts(edits: DataFrame, samples: DataFrame, keys: list[str], base: str, structure: Column, prefix: str) -> DataFrame:
    """Edits with the prompt that shows a model its own task with the edited structure. An edit keeps its key (sample, kind, number), so
    completions are never matched by position."""
    from ..functions.prompts import with_structure

    return edits.join(samples.select(*keys, base), keys).withColumn("prompt", with_structure(F.col(base), structure, prefix)).drop(base)


def collected(samples: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with their edits as structure_intervention: a list for each kind, in the order of the edits; empty where there are none."""
    names = [c for c in edits.columns if c not in (*keys, "kind")]
    entry = F.struct("edit_no", *[c for c in names if c != "edit_no"])
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind)
    lists = edits.groupBy(*keys).agg(F.struct(of(LOCAL), of(CORRECTION)).alias("structure_intervention"))
    return samples.join(lists, keys, "left")
