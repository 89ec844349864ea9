"""Whitening of integer vectors from an exact scatter matrix.

Every entry c becomes x = floor(scale * c) + offset. Tasks subtract the offset again (a scatter is the same after any shift) and
accumulate sums and cross-products of whole numbers: by products of doubles or longs where a block's largest entry proves
that no bit can be lost, by Python's integers elsewhere. A task sends each entry as digits of 32 bits; Spark adds the
digits, so that no sum has a bound. From S and X'X the matrix n X'X - SS' is formed in integers; only then is it
divided, as correctly rounded doubles, and decomposed. No order of rows, tasks or retries changes a bit of it.

What reaches the driver is the scatter, its size fixed by the vectors' width. The whitened values are stored once; their covariance is
measured on what was stored, centred and mergeable, and not derived from the decomposition.

Defined results: vectors that are null or hold null or non-finite entries take no part; repeated rows and rows under one id (or a null one)
count each; shorter vectors count as padded with entries of zero; entries beyond 2**52 in size after scaling count as that. A
deviation beyond a long is null. Components without variance (or no more than rounding leaves, relative to the first) have
null whitened values and take no part in the measured error; without any variance, explained is null too. Eigenvectors of equal
eigenvalues are any basis, the same for all rows; each has its largest entry positive. An empty table gives an empty result;
other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Rows that a task multiplies at a time, and the largest size of a scaled entry.
ROWS, LARGEST = 4096, 1 << 52
DIGIT = 32


@dataclass(frozen=True)
class Whitening:
    """The fit of n vectors: sums of x, eigenvalues and unit eigenvectors (rows) by falling eigenvalue, trace of the covariance."""

    n: int
    sums: list
    values: object
    vectors: object
    trace: float


def shifted(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, y array<long>: floor(scale * c) of valid vectors."""
    v = F.col(f"`{vector_col}`")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    bound = F.lit(float(LARGEST))
    y = F.transform(v, lambda c: F.floor(F.greatest(-bound, F.least(bound, c.cast("double") * F.lit(float(scale))))))
    return df.filter(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), y.alias("y"))


def _rows(column, width: int):
    """Vectors of longs as a matrix, padded with zeros."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = c.flatten().to_numpy(zero_copy_only=False)
    return out


def products(y) -> tuple[list, list]:
    """Column sums and cross-products of a matrix of longs as Python integers, exact whatever the entries."""
    import numpy as np

    reach = int(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object
    z = y.astype(kind)
    cross = z.T @ z
    return [int(s) for s in y.astype(object if reach >= 1 << 63 else np.int64).sum(axis=0)], [[int(c) for c in row] for row in cross.tolist()]


def digits(value: int) -> list[int]:
    """Digits of 32 bits, lowest first; the last one carries the sign."""
    out = []
    while not -(1 << DIGIT - 1) <= value < 1 << DIGIT - 1:
        out.append(value & (1 << DIGIT) - 1)
        value >>= DIGIT
    return [*out, value]


def scatter(vectors: DataFrame, width: int) -> tuple[int, list, list]:
    """n, sums and cross-products (upper triangle, as rows) of all vectors, in Python integers."""
    import pyarrow as pa

    def run(batches):
        n, total, cross = 0, [0] * width, [[0] * width for _ in range(width)]
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = _rows(b.column("y").slice(lo, ROWS), width)
                n += len(part)
                s, c = products(part)
                total = [p + q for p, q in zip(total, s, strict=True)]
                cross = [[p + q for p, q in zip(*rows, strict=True)] for rows in zip(cross, c, strict=True)]
        if not n:
            return
        found = [(-1, -1, n), *((-1, i, s) for i, s in enumerate(total)), *((i, j, cross[i][j]) for i in range(width) for j in range(i, width))]
        out = [(i, j, k, d) for i, j, v in found for k, d in enumerate(digits(v)) if d]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "d"])

    sums = vectors.select("y").mapInArrow(run, "i int, j int, k int, d long").groupBy("i", "j", "k").agg(F.sum("d").alias("d"))
    n, total, cross = 0, [0] * width, [[0] * width for _ in range(width)]
    for i, j, k, d in sums.collect():  # width * (width + 3) / 2 numbers of a few digits, whatever the table's size
        part = d << DIGIT * k
        if i >= 0:
            cross[i][j] += part
        elif j >= 0:
            total[j] += part
        else:
            n += part
    return n, total, cross


def fitted(n: int, total: list, cross: list, offset: int) -> Whitening:
    """The eigenvectors of the covariance whose n**2-fold is n X'X - SS'."""
    import numpy as np

    width = len(total)
    exact = [[n * cross[min(i, j)][max(i, j)] - total[i] * total[j] for j in range(width)] for i in range(width)]
    v = np.array([[c / (n * n) for c in row] for row in exact], np.float64).reshape(width, width)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(width), np.abs(vectors).argmax(axis=1)]) if width else np.ones(0)
    return Whitening(n, [s + n * offset for s in total], values, vectors * signs[:, None], float(Fraction(sum(exact[i][i] for i in range(width)), n * n)))


def _transformed(vectors: DataFrame, fit: Whitening, components: int, offset: int) -> DataFrame:
    """id, deviation, w array<double> of the first components that have variance."""
    import numpy as np
    import pyarrow as pa

    width, n = len(fit.sums), fit.n
    use = [k for k in range(min(components, width)) if fit.values[k] > fit.values[0] * width * 1e-14]
    onto = (fit.vectors[use] / np.sqrt(fit.values[use])[:, None]).T if use else np.zeros((width, 0))
    centre = [s - n * offset for s in fit.sums]
    most = max(map(abs, centre), default=0)

    def run(batches):
        for b in batches:
            y = _rows(b.column("y"), width)
            reach = n * int(np.abs(y).max(initial=0)) + most
            kind = np.int64 if reach < 1 << 63 else object
            apart = y.astype(kind) * n - np.array(centre, dtype=kind)
            square = apart if reach * reach * max(1, width) < 1 << 63 else apart.astype(object)
            deviation = [int(d) for d in (square * square).sum(axis=1)]
            w = (apart / n).astype(np.float64) @ onto
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * len(use), pa.int32()), pa.array(w.ravel(), pa.float64()))], names=["id", "deviation", "w"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(rows: DataFrame, wide: int) -> float | None:
    """The largest entry of |cov(w) - I|, the covariance centred and with divisor n."""
    if not wide:
        return None
    pairs = [(i, j) for i in range(wide) for j in range(i, wide)]
    got = rows.select(*[F.col("w")[i].alias(f"w{i}") for i in range(wide)]).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(df: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = df.sparkSession
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = written(shifted(df, id_col, vector_col, scale), "vectors")
    width = vectors.agg(F.max(F.size("y")).alias("w")).first()["w"]
    if not width:
        return spark.createDataFrame([], schema)
    n, total, cross = scatter(vectors, width)
    fit = fitted(n, total, cross, offset)
    rows = written(_transformed(vectors, fit, components, offset), "whitened")
    shown = min(components, width)
    error = identity_error(rows, sum(1 for k in range(shown) if fit.values[k] > fit.values[0] * width * 1e-14))
    of = F.array(*[F.lit(float(fit.values[k]) / fit.trace if fit.trace else None).cast("double") for k in range(shown)])
    (name,) = fresh(df, 1)
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(shown)))).select(
        F.col("id").alias(id_col), F.col(name).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.try_element_at("w", F.col(name)).alias("whitened"),
        F.element_at(of, F.col(name)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
