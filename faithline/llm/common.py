"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in every contract here, as a Java class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder already
    set on the context. Where neither exists, a temporary folder is made on one machine; a cluster has to name one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_OWN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    while _OWN:
        spark, path = _OWN.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def passing(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared one, deleted at the end of the program."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def written(df: DataFrame, label: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder, apart by some columns if asked, and read it again. Unlike a
    local checkpoint the files outlive executors; unlike ``checkpoint()`` they are columnar and compressed."""
    spark = df.sparkSession
    path = passing(spark, label)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what ``written`` stored for ``df`` (once nothing reads it any more)."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)
        _OWN[:] = [x for x in _OWN if x[1] != path]


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: both sides are shuffled at every size, never broadcast, so that what a job
    writes grows in proportion to its input. Adaptive execution still splits hot keys."""
    return side.hint("merge")


def fresh(df: DataFrame, n: int) -> list[str]:
    """So many column names that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    free = (f"__{i}" for i in itertools.count())
    return list(itertools.islice((c for c in free if c not in taken), n))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: higher-order functions then refer to it without
    computing it again for each element."""
    return F.transform(F.array(value), body)[0]


def own(df: DataFrame, *names: str, **computed: Column) -> DataFrame:
    """Only the columns an operator works on, so extra columns can never clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names], *[c.alias(n) for n, c in computed.items()])


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of a text column (nulls count nothing)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"])
