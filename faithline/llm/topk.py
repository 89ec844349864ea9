"""Exact top-k inner products by no-random-access aggregation.

Vectors are integers; a query's score for a vector is the sum of one contribution per dimension. Candidates are dealt
into blocks, queries into blocks of the same size, and each pair of blocks is one task, so a vector is copied once for 8,192 queries. A block keeps, for every dimension, the
list of its vectors sorted by that component. For a query the lists are read sequentially from their better end, to growing
depths. Every vector then has a lower score bound (what was read, plus the worst component left) and an
upper one (what was read, plus the last component read of each list it has not appeared in). Reading stops when no vector
outside the kept set can reach the k-th lower bound; final scores of that set are then resolved exactly.
A block's k best of each query, ties to the smaller id, are merged by rank.

Arrow tasks for the blocks (their size is fixed, whatever the table's); DataFrame operations around them.
Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
repeated rows count once; different vectors under one id count each, but not for a query of that id; shorter vectors
count as padded with zeros; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors of a block, queries of a block (they are gone over AT_ONCE at a time, which bounds memory), and the shares
#: of the lists at which reading pauses.
BLOCK, QUERIES, AT_ONCE, DEPTHS = 8192, 8192, 256, (1 / 16, 1 / 4, 1)


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v array<long> of floor(scale * x), valid vectors only."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column, width: int):
    """Integer vectors as rows, padded with zeros to one width."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(c).to_numpy(zero_copy_only=False)
    flat = c.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class SortedLists:
    """A block's vectors with one sorted list per dimension. A list read down to a depth has given all entries at or
    beyond the last value read; of the others that value is the better bound and the list's far end the worse one. For
    all queries of a block at once, both bounds are then products with the so bounded vectors."""

    def __init__(self, ids, vectors, largest_query: int = 0):
        import numpy as np

        self.np, self.ids = np, ids
        reach = int(np.abs(vectors).max(initial=0)) * largest_query * max(1, vectors.shape[1])
        self.exact = np.float64 if reach < 1 << 53 else np.int64  # doubles hold these sums exactly
        self.vectors = vectors.astype(self.exact)
        self.lists = np.sort(self.vectors, axis=0)
        self.reads = 0

    def best(self, queries, own_ids, k: int):
        """For each query (ids, scores) of its k best, best first, without its own id."""
        np, n, v = self.np, len(self.ids), self.vectors
        queries = queries.astype(self.exact)
        rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
        out: list = [([], [])] * len(queries)
        open_ = np.arange(len(queries))
        least = np.iinfo(np.int64).min if self.exact is np.int64 else -np.inf
        before = 0
        for share in DEPTHS:
            depth = max(1, math.ceil(n * share))
            top, bottom = self.lists[n - depth], self.lists[depth - 1]
            up, down = rising[open_], falling[open_]
            self.reads += (depth - before) * int(np.count_nonzero(queries[open_]))
            before = depth
            upper = up @ np.maximum(v, top).T + down @ np.minimum(v, bottom).T
            lower = up @ np.where(v >= top, v, self.lists[0]).T + down @ np.where(v <= bottom, v, self.lists[-1]).T
            mine = own_ids[open_][:, None] == self.ids[None, :]
            lower[mine] = least
            upper[mine] = least
            kth = np.partition(lower, max(0, n - k), axis=1)[:, max(0, n - k)]
            kept = (upper >= kth[:, None]) & ~mine
            done = (kept.sum(axis=1) <= 8 * k) | (depth == n)
            for i in np.flatnonzero(done):
                rows = np.flatnonzero(kept[i])
                scores = v[rows] @ queries[open_[i]]
                order = np.lexsort((self.ids[rows], -scores))[:k]
                out[open_[i]] = (self.ids[rows][order].tolist(), [int(x) for x in scores[order]])
            open_ = open_[~done]
            if not len(open_):
                break
        return out


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: every row with ``is_query``, a condition on ``id``, against all rows."""
    import pyarrow as pa

    rows = written(quantized(df, id_col, vector_col, scale).distinct(), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
    n_blocks, n_query_blocks, width = max(1, -(-n["n"] // BLOCK)), max(1, -(-n["q"] // QUERIES)), n["w"]
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")
    queries = rows.filter(is_query).select(block(n_query_blocks).alias("qb"), every(n_blocks).alias("cb"), "id", "v")
    candidates = rows.select(every(n_query_blocks).alias("qb"), block(n_blocks).alias("cb"), "id", "v")

    def run(left, right):
        import numpy as np

        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            own_ids, queries = left.column("id").to_numpy(), _matrix(left.column("v"), width)
            lists = SortedLists(right.column("id").to_numpy(), _matrix(right.column("v"), width), int(np.abs(queries).max(initial=0)))
            for lo in range(0, len(own_ids), AT_ONCE):
                part = slice(lo, lo + AT_ONCE)
                for own_id, found in zip(own_ids[part].tolist(), lists.best(queries[part], own_ids[part], k), strict=True):
                    out += [(own_id, i, s) for i, s in zip(*found, strict=True)]
        return pa.table({name: pa.array([x[i] for x in out], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
