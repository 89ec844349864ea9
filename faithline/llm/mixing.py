"""Mixing sources to target weights by temperature.

Source shares p of all tokens become weights w proportional to p**a. The exponent a in [0, 1] is bisected: the flattest
mixture in which no source is passed more than ``repetition`` times, or the most natural one whose entropy is at least
``entropy`` of its maximum. The budget lets the least repeated source pass exactly once, unless one in tokens is given.

The weights are realised by block permutations. A source's documents are dealt by a keyed hash into blocks of about
``block_tokens`` tokens; within a block they stand in a keyed random order. A source to be repeated r times takes each
block floor(r) times whole, and once more as far as frac(r) of the block's own tokens reach. So every block keeps to
its own budget, blocks of one source are independent tasks, and no running sum crosses a whole source.

All built-in functions. Defined results: a null source is a source of its own; null and blank texts have no tokens and
share their block's whole passes; repeated rows are rows of their own (the same keyed order, so a tie is settled
between equals); an empty table gives an empty result; other columns are kept by ``mixed`` and ignored by the plan."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, shuffled, table, written
from .quality import words_of

ROUNDS = 24


@dataclass(frozen=True)
class Mixture:
    repetition: float | None = 2.0
    entropy: float | None = None  # share of log(number of sources)
    budget: int | None = None  # tokens
    block_tokens: int = 200_000
    block_docs: int = 100_000  # so that a source of blank texts is dealt out too
    seed: int = 17


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, row (key of id and text), source, n_tokens (words)."""
    n = let(words_of(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.size(w))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(source_col).alias("source"), n.cast("long").alias("n_tokens"))


def exponent(sources: DataFrame, mix: Mixture) -> float:
    """The bisected exponent. Each step aggregates the source table to two sums; only they reach the driver.

    With log shares l, the weights' normaliser is Z = sum exp(a l), their entropy log Z - a sum(l exp(a l)) / Z; the
    repetition of a source relative to the largest is (p / p_max)**(a - 1), largest for the smallest source."""
    logs = sources.filter("tokens > 0")
    span = logs.agg(F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("all")).first()
    if span["k"] < 2:
        return 1.0
    if mix.entropy is None:
        meets = lambda a: mix.repetition is None or (1 - a) * math.log(span["most"] / span["least"]) <= math.log(mix.repetition)
    else:
        l = F.log(F.col("tokens") / F.lit(float(span["all"])))  # noqa: E741
        target = mix.entropy * math.log(span["k"])

        def meets(a: float) -> bool:
            r = logs.agg(F.sum(F.exp(l * a)).alias("z"), F.sum(l * F.exp(l * a)).alias("s")).first()
            return math.log(r["z"]) - a * r["s"] / r["z"] >= target
    flat = mix.entropy is None  # the limit allows the exponents near 1, the entropy those near 0
    lo, hi = 0.0, 1.0
    if meets(lo if flat else hi):
        return lo if flat else hi
    for _ in range(ROUNDS):
        mid = (lo + hi) / 2
        if meets(mid) == flat:
            hi = mid
        else:
            lo = mid
    return hi if flat else lo


def weights(counts: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """source, n_docs, tokens, share, weight, repeat (times that the source is passed)."""
    sources = written(counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")), "sources")
    a = exponent(sources, mix)
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(F.lit(0.0))
    sums = sources.agg(F.sum("tokens").alias("all"), F.sum(raw).alias("z"), F.min(F.when(F.col("tokens") > 0, raw / F.col("tokens"))).alias("low"))
    budget = F.lit(float(mix.budget)) if mix.budget is not None else F.col("z") / F.col("low")
    share, weight = F.try_divide(F.col("tokens"), F.col("all")), F.try_divide(raw, F.col("z"))
    times = F.when(F.col("tokens") > 0, weight * budget / F.col("tokens")).otherwise(F.lit(1.0))
    return sources.join(F.broadcast(sums)).select("source", "n_docs", "tokens", share.alias("share"), weight.alias("weight"), F.round(times, 9).alias("repeat"))


def plan(docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row, source, n_tokens, weight, block, pos (place in the block's order), copies."""
    counts = written(token_counts(docs, id_col, text_col, source_col), "mix-counts")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    salts = 32
    table_ = weights(counts, mix).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = table_.select(key(F.col("source")).alias("key"), "salt", "weight", "repeat", F.greatest(F.ceil(F.col("tokens") / mix.block_tokens), F.ceil(F.col("n_docs") / mix.block_docs), F.lit(1)).alias("n_blocks"))
    shuffled = F.xxhash64(F.lit(mix.seed), "doc_id", "row")
    left = counts.withColumns({"key": key(F.col("source")), "h": shuffled, "salt": F.pmod(shuffled, F.lit(salts)).cast("int")})
    d = left.join(right, ["key", "salt"]).withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), F.col("n_blocks")))
    return _realised(d, F.col("repeat"))


def _realised(d: DataFrame, repeat: Column) -> DataFrame:
    order = Window.partitionBy("key", "block").orderBy("h", "doc_id", "row")
    so_far = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_all = F.sum("n_tokens").over(Window.partitionBy("key", "block"))
    whole = F.floor(repeat)
    # a document is taken once more if its middle lies in the fraction: over blocks that is unbiased
    extra = (so_far - F.col("n_tokens") / 2 < (repeat - whole) * in_all) & (F.col("n_tokens") > 0)
    return d.select("doc_id", "row", "source", "n_tokens", "weight", "block", F.row_number().over(order).cast("long").alias("pos"),
                    (whole + extra.cast("long")).cast("long").alias("copies"))


def mixed(docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it."""
    of, row, n, key, again = fresh(docs, 5)
    copies = plan(docs, mix, id_col, text_col, source_col).groupBy("doc_id", "row").agg(F.max("copies").alias("copies"))
    copies = written(copies.select(F.col("doc_id").alias(of), F.col("row").alias(row), F.col("copies").alias(n)), "copies")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    out = keyed.join(shuffled(copies), (F.col(key) == F.col(row)) & docs[id_col].eqNullSafe(F.col(of)))
    times = F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("long"), F.col(n))).otherwise(F.array().cast("array<bigint>")))
    return out.select(*docs.columns, times.alias(again)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "block", "pos", "copies")
