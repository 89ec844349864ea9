"""Near-duplicates by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes), 256 minima, band keys over full minima, and a
   signature of the lowest two (remixed) bits of every minimum packed in eight longs.
2. Documents with equal sets form a class, by a hash aggregate that combines on the map side; from here on only the
   classes' first documents count.
3. Bands: classes that share a band key are candidates. Each class is tested against a hub of its bucket; the
   similarity estimated from bit counts, corrected for chance agreement, orders and thins the tests, and every link
   is confirmed on full shingle sets.
4. Components of the confirmed links. What is left are bucket mates in different components: in buckets of up to
   ``SMALL`` classes their pairs are listed (a bounded number for each class) and confirmed; larger buckets are joined
   to super-groups whose unlinked members meet all others block by block inside a Python task, which emits only
   confirmed links between components. So no link between candidates is lost and no bucket is expanded to pairs.

The bands miss a pair at the threshold with a chance under 1e-6, the bit estimate with about 3e-7 (five standard errors).
Defined results: null or blank texts have no shingles and link with nothing; with fewer words than a shingle the whole
sequence is one shingle; rows that share an id are one document (each row is returned); rows with a null id take part
as exact copies only, and of copies that all have none the one with the least hash is kept; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, shuffled, table, written
from .graph import components

HASHES, BITS, ROWS, SMALL, BLOCK, SHINGLES = 256, 2, 5, 64, 2048, 4_000_000
LANES = 0x5555555555555555
WORD_CACHE = 150_000


@dataclass(frozen=True)
class Near:
    """Shingle length in words and similarity threshold in per cent."""

    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return min(HASHES // ROWS, math.ceil(math.log(1e-6) / math.log(1 - (self.percent / 100) ** ROWS)))

    @property
    def max_unequal(self) -> int:
        """Most unequal lanes of a pair at the threshold: its expectation plus five standard errors."""
        p = (1 - self.percent / 100) * (1 - 2.0**-BITS)
        return math.floor(HASHES * p + 5 * math.sqrt(HASHES * p * (1 - p)))


class Sketcher:
    """Shingle sets, minima, band keys and signatures of texts."""

    def __init__(self, near: Near):
        import numpy as np

        self.np, self.near, self.words = np, near, {}
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.xor = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
        self.odd = (rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.mix = [np.uint64(2 * int(x) + 1) for x in rng.integers(1 << 61, 1 << 62, max(8, near.words))]
        self.band_mix = rng.integers(0, 1 << 62, (1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band_add = rng.integers(0, 1 << 63, near.bands, dtype=np.uint64)

    def _hash(self, word: bytes) -> int:
        import xxhash

        if len(self.words) >= WORD_CACHE:
            self.words.clear()
        h = self.words[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, text: str | None):
        """Sorted distinct 64-bit shingle hashes."""
        np, k = self.np, self.near.words
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            h = np.array([known[w] if w in known else self._hash(w) for w in words], np.uint64)
        if len(words) < k:
            k = len(words)
        s = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            s = (s ^ h[i : len(h) - k + 1 + i]) * self.mix[i]
            s ^= s >> np.uint64(29)
        return np.unique(s)

    def sketch(self, s):
        """(band keys int64, signature int64[8]) of a shingle set that isn't empty."""
        np = self.np
        h = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 2048):
            low = np.minimum(low, ((h[None, i : i + 2048] ^ self.xor) * self.odd).min(axis=1))
        n = self.near.bands
        keys = (low[: n * ROWS].reshape(n, ROWS).astype(np.uint64) * self.band_mix).sum(axis=1, dtype=np.uint64) + self.band_add
        keys ^= keys >> np.uint64(31)
        keys *= self.mix[0]
        keys ^= keys >> np.uint64(29)
        bits = (low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        lanes = (bits.astype(np.uint64).reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :]).sum(axis=1, dtype=np.uint64)
        return keys.view(np.int64), lanes.view(np.int64)

    def linked(self, a, b) -> bool:
        p, x, y = self.near.percent, len(a), len(b)
        if 100 * min(x, y) < p * max(x, y):
            return False
        both = len(self.np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= p * (x + y - both)


def sketches(docs: DataFrame, near: Near, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, h (128-bit hash of the set; null if empty), bands, sig."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        s = Sketcher(near)
        for b in batches:
            n, h, bands, sig = [], [], [], []
            for t in b.column(1):
                x = s.shingles(t.as_py())
                n.append(len(x))
                if len(x):
                    k, g = s.sketch(x)
                    h.append(xxhash.xxh3_128_digest(x.tobytes()))
                    bands.append(k)
                    sig.append(g)
                else:
                    h.append(None)
                    bands.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "h", "bands", "sig"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row"))
    return d.mapInArrow(run, "doc_id long, row long, n_shingles long, h binary, bands array<long>, sig array<long>")


def unequal(a: Column, b: Column) -> Column:
    """Lanes in which two packed signatures differ."""
    total = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LANES)))
    return total


def estimate(n_unequal: Column) -> Column:
    """Similarity from the share of equal lanes, corrected for lanes that agree by chance."""
    chance = 2.0**-BITS
    return (1 - n_unequal / F.lit(float(HASHES)) - chance) / (1 - chance)


def _thinned(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """(a, b) -> those that sizes and signatures allow, with est."""
    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    d = pairs.join(left, "a").join(right, "b").withColumn("diff", unequal(F.col("sig_a"), F.col("sig_b")))
    return d.filter((F.col("diff") <= near.max_unequal) & (100 * F.least("n_a", "n_b") >= near.percent * F.greatest("n_a", "n_b"))).select(
        "a", "b", estimate(F.col("diff")).alias("est"))


def _confirmed(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(a, b) -> (u, v) whose full shingle sets are as similar as asked."""
    import pyarrow as pa

    def run(batches):
        s = Sketcher(near)
        last = [None, None]
        for b in batches:
            us, vs = [], []
            for a, c, x, y in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last[0] != a or last[1] is None:
                    last = [a, s.shingles(x)]
                if s.linked(last[1], s.shingles(y)):
                    us.append(a)
                    vs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y")).mapInArrow(run, "u long, v long")


def _blocks(groups: DataFrame, nodes: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(sg, id, label) -> links between components within each super-group: every member outside the group's largest
    component meets all members, in blocks of about BLOCK by BLOCK members, fewer of them where their sets are large (on
    average SHINGLES hashes a side)."""
    import pyarrow as pa

    sizes = groups.join(nodes.select("id", "n"), "id").groupBy("sg", "label").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"))
    largest = F.max(F.struct("count", "n"))
    main = sizes.groupBy("sg").agg(F.max_by("label", "count").alias("main"), F.sum("count").alias("m"), F.sum("n").alias("n"), (F.sum("count") - F.max("count")).alias("r"), (F.sum("n") - largest["n"]).alias("nr"))
    parts = lambda members, hashes: F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(hashes) / SHINGLES)).cast("int")
    main = main.filter("r > 0").select("sg", "main", parts("m", "n").alias("n_all"), parts("r", "nr").alias("n_rest"))
    rows = groups.join(main, "sg").join(nodes.select("id", "sig"), "id").join(texts, "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    everyone = rows.select("sg", block("n_all").alias("ab"), F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("rb"), F.lit(False).alias("rest"), "id", "label", "sig", "text")
    rest = rows.filter("label <> main").select("sg", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("ab"), block("n_rest").alias("rb"), F.lit(True).alias("rest"), "id", "label", "sig", "text")

    def run(t):
        import numpy as np

        s = Sketcher(near)
        rest = np.array(t.column("rest").to_pylist(), bool)
        ids, labels, texts = t.column("id").to_pylist(), t.column("label").to_pylist(), t.column("text")
        sig = np.array(t.column("sig").to_pylist(), np.int64).view(np.uint64).reshape(len(ids), -1)
        r, a = np.flatnonzero(rest), np.flatnonzero(~rest)
        parent: dict[int, int] = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        sets: dict[int, object] = {}

        def of(i):
            if i not in sets:
                sets[i] = s.shingles(texts[i].as_py())
            return sets[i]

        us, vs = [], []
        lab = np.array(labels)
        for lo in range(0, len(r), 256):
            part = r[lo : lo + 256]
            diff = np.zeros((len(part), len(a)), np.uint16)
            for w in range(sig.shape[1]):
                x = sig[part, w][:, None] ^ sig[a, w][None, :]
                diff += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(LANES))
            i, j = np.nonzero((diff <= near.max_unequal) & (lab[part][:, None] != lab[a][None, :]))
            order = np.argsort(diff[i, j], kind="stable")
            for p, q in zip(part[i[order]].tolist(), a[j[order]].tolist(), strict=True):
                f, g = find(labels[p]), find(labels[q])
                if f != g and s.linked(of(p), of(q)):
                    parent[max(f, g)] = min(f, g)
                    us.append(min(ids[p], ids[q]))
                    vs.append(max(ids[p], ids[q]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return everyone.union(rest).groupBy("sg", "rb", "ab").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (is that document)."""
    return _judged(docs, near, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, near: Near, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept."""
    keyed = written(sketches(docs, near, id_col, text_col), "sketches")
    classes = written(keyed.filter("h is not null").groupBy("h").agg(F.min("doc_id").alias("id"), F.min("row").alias("first_row")), "classes")
    first = classes.select(F.col("h").alias("h0"), "id")
    nodes = written(keyed.join(first, (keyed["h"] == first["h0"]) & (keyed["doc_id"] == first["id"])).select(
        "id", F.col("n_shingles").alias("n"), "bands", "sig"), "nodes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    members = nodes.select("id", F.explode("bands").alias("key"))
    hub = F.min(F.col("id").bitwiseXOR(F.col("key"))).bitwiseXOR(F.col("key"))  # as good as random, another in every band
    buckets = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), hub.alias("hub")).filter("m > 1"), "buckets")
    mates = written(members.join(buckets, "key"), "mates")
    stars = mates.filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), "id").distinct()
    links = written(_confirmed(_best(stars, nodes, near), texts, near), "links")
    labels = components(links)

    left = mates.join(labels, "id", "left").select("key", "id", "m", "hub", F.coalesce("label", "id").alias("label"))
    left = written(left, "left")
    mixed = left.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key")
    left = left.join(mixed, "key", "left_semi")
    small = left.filter(F.col("m") <= SMALL)
    x, y = small.select("key", F.col("id").alias("a"), F.col("label").alias("la")), small.select("key", F.col("id").alias("b"), F.col("label").alias("lb"))
    pairs = x.join(y, "key").filter("a < b and la <> lb").select("a", "b").distinct()
    more = _confirmed(_thinned(pairs, nodes, near), texts, near)
    large = written(left.filter(F.col("m") > SMALL), "large")
    if large.limit(1).count():
        groups = components(large.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct())
        groups = groups.select("id", F.col("label").alias("sg")).join(large.select("id", "label").distinct(), "id")
        more = more.union(_blocks(groups, nodes, texts, near))
    more = written(more, "links")
    if more.limit(1).count():
        labels = components(links.union(more))

    final = written(classes.join(labels, "id", "left").select("h", F.coalesce("label", "id").alias("component"), "first_row"), "final")
    for t in (mates, buckets, nodes, left, large):
        dropped(t)
    out = keyed.select("doc_id", "row", "n_shingles", "h").join(final, "h", "left")
    out = out.select("doc_id", "row", "n_shingles", "first_row", F.coalesce("component", "doc_id").alias("component_id"))
    first = F.col("doc_id").isNotNull() | F.col("first_row").isNull() | (F.col("row") == F.col("first_row"))
    return out.select("doc_id", "row", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & first).alias("kept"))


def _best(stars: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Of each class's hubs the two that look most similar; its other bucket mates wait for the second pass."""
    from pyspark.sql import Window

    d = _thinned(stars.select("a", "b").distinct(), nodes, near).join(stars, ["a", "b"])
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("est"), "a", "b")))
    return d.filter("k <= 2").select("a", "b").distinct()


def filtered(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of every component, all columns."""
    of, row = fresh(docs, 2)
    gone = _judged(docs, near, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(of), F.col("row").alias(row)).distinct()
    key = docs[id_col].cast("long")
    return docs.join(shuffled(written(gone, "near-copies")), key.eqNullSafe(F.col(of)) & (F.xxhash64(key, docs[text_col]) == F.col(row)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
      UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT sym.b, r.reach FROM r JOIN sym ON r.id = sym.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.id = w.doc_id
"""
