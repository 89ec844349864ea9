"""Does the answer follow from the structure? Sample-level measures and the tables over runs.

A run row has dataset, run_type, model, idx, status, f_before (the tool's answer on the model's own structure) and y_before
(the model's answer); an edit row the same keys, kind, edit_no, f_after and y_after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structures
from .interventions import LOCAL, picked

KEYS = ["dataset", "run_type", "model", "idx"]
RUN = KEYS[:-1]


def follows(f: Column, y: Column, none_counts: bool = False) -> Column:
    """The answer is the structure's; two missing ones are only where ``none_counts``."""
    return f.eqNullSafe(y) if none_counts else F.coalesce(f == y, F.lit(False))


def fact_table(runs: DataFrame, edits: DataFrame, order: Column, none_counts: bool = False) -> DataFrame:
    """One row a sample: f_id, f_ood on one edit picked by ``order``, f_strong (both), and type: counterfact,
    correction or no_intervention. Errors count as unfaithful."""
    one = picked(edits, KEYS, order)
    d = runs.join(one, KEYS, "left")
    ok = F.col("status") != "error"
    f_id = ok & follows(F.col("f_before"), F.col("y_before"), none_counts)
    f_ood = ok & F.col("kind").isNotNull() & follows(F.col("f_after"), F.col("y_after"), none_counts)
    kind = F.when(F.col("kind") == LOCAL, "counterfact").when(F.col("kind").isNotNull(), "correction").otherwise("no_intervention")
    return d.select(*KEYS, f_id.alias("f_id"), f_ood.alias("f_ood"), (f_id & f_ood).alias("f_strong"), kind.alias("type"))


def edits_mean(edits: DataFrame, by: list[str]) -> DataFrame:
    """Mean over all edits instead of one picked edit (a variant)."""
    return edits.groupBy(*by, "kind").agg(F.avg(follows(F.col("f_after"), F.col("y_after")).cast("int")).alias("follow_rate"), F.count(F.lit(1)).alias("n"))


def rounded(c: Column, digits: int = 2) -> Column:
    """Rounded as tables show it: ties go to the even digit."""
    return F.rint(c * 10**digits) / 10**digits


def faith_table(facts: DataFrame, datasets: list[str]) -> DataFrame:
    """For each model the means of f_id, f_ood and f_strong for every dataset, rounded, and the difference of the first and last as shown."""
    m = lambda c: rounded(F.avg(F.col(c).cast("int")))
    delta = rounded(m("f_id") - m("f_strong"))
    return facts.groupBy("model").pivot("dataset", datasets).agg(m("f_id").alias("id"), m("f_ood").alias("ood"), m("f_strong").alias("strong"), delta.alias("delta"))


def accuracy_table(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Accuracy with the structure (the run's answers against gold, over all samples), the baseline's, and the share of samples on which both agree."""
    right = structures.same_answer(F.col("y_before"), F.col("gold"), F.col("dataset"))
    with_m = runs.groupBy(*RUN).agg(F.avg(right.cast("int")).alias("acc_with_m"))
    hit = structures.same_answer(F.col("predicted"), F.col("gold"), F.col("dataset"))
    without = baseline.groupBy("dataset", "model").agg(F.avg(hit.cast("int")).alias("acc_baseline"))
    return with_m.join(without, ["dataset", "model"], "left").join(agreement(runs, baseline), RUN, "left")


def agreement(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """The share of samples with both answers on which they are the same."""
    both = runs.join(baseline.select("dataset", "model", "idx", "predicted"), ["dataset", "model", "idx"]).filter(F.col("y_before").isNotNull() & F.col("predicted").isNotNull())
    same = structures.same_answer(F.col("y_before"), F.col("predicted"), F.col("dataset"))
    return both.groupBy(*RUN).agg(F.avg(same.cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n_pairs"))


def prompt_pivot(facts: DataFrame, regimes: list[str]) -> DataFrame:
    return facts.groupBy("model", "dataset").pivot("run_type", regimes).agg(F.avg(F.col("f_strong").cast("int")))


def prompt_summary(facts: DataFrame) -> DataFrame:
    """Mean and sample standard deviation, over models, of mean f_strong."""
    each = facts.groupBy("dataset", "run_type", "model").agg(F.avg(F.col("f_strong").cast("int")).alias("m"))
    return each.groupBy("dataset", "run_type").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def symmetry(facts: DataFrame, more_than: int = 10) -> DataFrame:
    """Mean f_strong on corrections and on counterfacts, where both have more than so many samples."""
    s = F.col("f_strong").cast("int")
    of = lambda t: F.avg(F.when(F.col("type") == t, s)).alias(t)
    n = lambda t: F.count_if(F.col("type") == t)
    out = facts.groupBy(*RUN).agg(of("correction"), of("counterfact"), n("correction").alias("n_correction"), n("counterfact").alias("n_counterfact"))
    return out.filter((F.col("n_correction") > more_than) & (F.col("n_counterfact") > more_than))


def tool_delta(facts: DataFrame) -> DataFrame:
    """f_strong with a tool less without, by dataset and model."""
    d = prompt_pivot(facts, ["standard", "tool"])
    return d.select("dataset", "model", "standard", "tool", (F.col("tool") - F.col("standard")).alias("delta"))


def latest(dumps: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last dump of each run."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return dumps.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def filtered_status(gold_size: Column, mediator_size: Column, status: Column, dataset: Column) -> Column:
    """Verdict samples that are incorrect with another number of questions become errors."""
    return F.when((dataset == "averitec") & (status == "incorrect") & (gold_size != mediator_size), "error").otherwise(status)


def tool_facts(runs: DataFrame, edits: DataFrame, order: Column) -> DataFrame:
    """The fact table with the answer to the tool call's own arguments (f_tool) in the place of the model's answer."""
    say = lambda d, f, y: d.withColumn(y, F.col(f))
    return fact_table(say(runs, "f_tool_before", "y_before"), say(edits, "f_tool_after", "y_after"), order)


def tool_table(facts: DataFrame, digits: int = 2) -> DataFrame:
    """By dataset, the mean over models of rounded f_strong without and with a tool, and of the former less the latter."""
    d = prompt_pivot(facts, ["standard", "tool"]).select("dataset", F.round("standard", digits).alias("standard"), F.round("tool", digits).alias("tool"))
    return d.groupBy("dataset").agg(F.avg("standard").alias("standard"), F.avg("tool").alias("tool"), F.avg(F.col("standard") - F.col("tool")).alias("delta"))


#: Names of models and datasets as tables show them, in their order; the first model is not shown.
MODEL_NAMES = {
    "llama32-1B": "Llama-3.2 1B", "qwen3-1.7B": "Qwen-3 1.7B", "gemma2-2B": "Gemma-2 2B", "falcon3-3B": "Falcon-3 3B", "llama32-3B": "Llama-3.2 3B", "qwen3-4B": "Qwen-3 4B", "falcon3-7B": "Falcon-3 7B",
    "qwen3-8B": "Qwen-3 8B", "llama31-8B": "Llama-3.1 8B", "qwen3-14B": "Qwen-3 14B", "qwen3-32B": "Qwen-3 32B", "llama31-70B": "Llama-3.1 70B", "qwen3-235B-a22B": "Qwen3-235B-A22B",
}
DATASET_NAMES = {"ricechem": "RiceChem", "averitec": "AVeriTeC", "tabfact": "TabFact"}
HIDDEN_MODELS = ("llama32-1B",)


def shown(df: DataFrame, column: str, names: dict[str, str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """df with names for keys in a column and a column <column>_order to sort by; hidden keys go, unknown ones stay as they are, last."""
    dim = df.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(names.items())], f"`{column}` string, __name string, __order int")
    out = df.filter(~F.coalesce(F.col(column).isin(*hidden), F.lit(False))) if hidden else df
    out = out.join(F.broadcast(dim), column, "left")  # a name table fixed by the code
    return out.withColumns({column: F.coalesce("__name", column), f"{column}_order": F.coalesce("__order", F.lit(len(names)))}).drop("__name", "__order")


def in_slot(df: DataFrame, dataset: str, run_type: str, slot: str = "standard") -> DataFrame:
    """df with one dataset's runs of a type in the place of its runs of the slot's type."""
    if run_type == slot:
        return df
    mine = F.col("dataset") == dataset
    return df.filter(~(mine & (F.col("run_type") == slot))).withColumn("run_type", F.when(mine & (F.col("run_type") == run_type), slot).otherwise(F.col("run_type")))
