"""An extension: run dumps as a file stream, with per-run counts kept up to date. The original pipeline is batch only.

``counted`` adds up all samples of a run; ``latest`` knows that a later dump of a run replaces an earlier one: the state of a run is the stamp of its latest dump and that
dump's counts, and samples of a later stamp withdraw them. Each batch writes the runs that it changed into a folder of its own, which a
batch that is run again overwrites; ``current`` reads the last word on each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import metrics

RUN = ["dataset", "run_type", "model"]
STATUSES = ("correct", "incorrect", "error")


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """Samples that arrive as JSON lines of dataset, run_type, model, idx and status, and perhaps the stamp of their dump."""
    return spark.readStream.schema("dataset string, run_type string, model string, idx string, status string, stamp string").json(path)


def counted(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Process all files that are there and stop; each run replaces the counts table by complete ones."""
    counts = metrics.counts(statuses(spark, path), RUN)
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


_COUNTS = "n_total long, " + ", ".join(f"n_{s} long" for s in STATUSES)


def latest_counts(samples: DataFrame) -> DataFrame:
    """run, stamp and counts of each run's latest dump by stamp (as texts are ordered; a missing one is the earliest), as it changes. Samples of earlier dumps are passed over."""
    def update(key, parts, state):
        import pandas as pd

        stamp, *n = state.get if state.exists else (None, *[0] * (len(STATUSES) + 1))
        for part in parts:
            said = part["stamp"].fillna("")
            newest = said.max()
            if stamp is None or newest > stamp:
                stamp, n = newest, [0] * len(n)
            mine = part["status"][said == stamp]
            n = [n[0] + len(mine), *(k + int((mine == s).sum()) for k, s in zip(n[1:], STATUSES, strict=True))]
        state.update((stamp, *n))
        yield pd.DataFrame([(*key, stamp, *n)], columns=[*RUN, "stamp", "n_total", *(f"n_{s}" for s in STATUSES)])

    schema = ", ".join(f"{c} string" for c in (*RUN, "stamp")) + ", " + _COUNTS
    return samples.groupBy(*RUN).applyInPandasWithState(update, schema, "stamp string, " + _COUNTS, "update", GroupStateTimeout.NoTimeout)


def latest(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Process all files that are there and stop: the runs that changed, by batch."""
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    latest_counts(statuses(spark, path)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The counts of each run's latest dump."""
    d = spark.read.parquet(out)
    names = [c for c in d.columns if c not in (*RUN, "batch")]
    return d.groupBy(*RUN).agg(F.max_by(F.struct(*names), "batch").alias("__n")).select(*RUN, "__n.*")
