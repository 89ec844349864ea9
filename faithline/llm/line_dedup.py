"""Line dedup by a deletion-neighbourhood join.

A line is dropped if an earlier line of the corpus, by (document id, text, line number), is within one edit (insertion,
deletion or substitution of a character) of it; the earliest always stays. Lines are compared trimmed and in lower
case; lines under ``min_chars`` characters take no part and stay.

1. Every line becomes a 128-bit hash and a place; equal lines form a class with its earliest place (a hash aggregate).
2. Two lines within one edit share their first or second half, cut by the shorter one's length. Half keys find the
   classes that can have a partner at all, without loss; only these fetch their text, each text split once.
3. The same argument cuts the rest of the line in four again and again, until at most SEGMENT characters are left that
   hold the edit, if there is one. A segment carries its own characters and one chained hash for each side of it, so a
   level never holds more characters than the lines have, however long they are.
4. Variants within the edit bound, as hashed keys: the segment itself and the segment without its i-th character, and for
   substitutions the latter together with i, each with the hashes of both sides. Lines that share a substitution key are all
   within one edit of each other; a line that is another's variant is within one edit of it. So the earliest member of a key's
   group stands for all partners in it: groups are aggregated, not expanded to pairs.
5. The edit distance of each line to its representative is verified; lines go, by their numbers, from their documents.

All built-in functions. Defined results: a null text stays null and has no lines; rows equal in id and text keep the same
lines as each other, different texts under one id are ordered by a hash of the text; a null id orders after all others; an
empty table gives an empty result; other columns, of whatever names, are kept by ``deduplicated`` and ignored by the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, let, shuffled, table, written

MIN_CHARS = 30
SEGMENT = 8
PARTS = 4


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _compared(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _row(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line that takes part: where it is, its place in the order, hashes and half keys."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    d = d.select("doc_id", _row(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(_split(F.col("text"))).alias("line_no", "line"))
    d = d.withColumn("s", _compared(F.col("line"))).withColumn("n", F.length("s")).filter(F.col("n") >= min_chars)
    # 64 bits of id, 31 of the row, 31 of the line number: under 10**38
    place, wide = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")), F.lit(2**31).cast("decimal(10,0)")
    part = F.shiftrightunsigned("row", 33).cast("decimal(10,0)")
    at = ((place * wide + part).cast("decimal(29,0)") * wide + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    keys = {}
    for name, m in (("own", F.col("n")), ("long", F.col("n") - 1)):
        half = F.floor(m / 2).cast("int")
        keys[f"{name}_p"] = F.xxhash64(F.substring(F.col("s"), F.lit(1), half), m, F.lit("p"))
        keys[f"{name}_s"] = F.xxhash64(F.right(F.col("s"), m - half), m, F.lit("s"))
    return d.select("doc_id", "row", "line_no", at.alias("at"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), F.col("s")).alias("h2"), *[c.alias(k) for k, c in keys.items()])


def _shared(keyed: DataFrame) -> DataFrame:
    """The keys under which two lines of the shorter length, or one of it and one longer by a character, meet."""
    return keyed.groupBy("key").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_long")).filter("n_own > 1 or (n_own > 0 and n_long > 0)").select("key")


def _wanted(classes: DataFrame) -> DataFrame:
    """(h1, h2, at) of the classes whose half keys allow a partner, and which of the four do."""
    role = lambda side, own: F.struct(F.lit(side).alias("side"), F.lit(own).alias("own"), F.col(f"{'own' if own else 'long'}_{side}").alias("key"))
    halves = classes.select("h1", "h2", "at", F.explode(F.array(*[role(s, o) for s in "ps" for o in (True, False)])).alias("k")).select("h1", "h2", "at", "k.*")
    return halves.join(_shared(halves), "key", "left_semi").groupBy("h1", "h2").agg(F.min("at").alias("at"), *[
        F.coalesce(F.bool_or((F.col("side") == s) & (F.col("own") == o)), F.lit(False)).alias(f"{'own' if o else 'long'}_{s}") for s in "ps" for o in (True, False)])


def _texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The wanted classes with the text s of their first line."""
    flags = ["own_p", "own_s", "long_p", "long_s"]
    first = lines.select("doc_id", "row", "line_no", "h1", "h2", "at").join(shuffled(wanted), ["h1", "h2", "at"]).dropDuplicates(["h1", "h2"])
    by_text = written(first.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "at", "h1", "h2", *flags)).alias("asked")), "asked")
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null").withColumn("row", _row(F.col("id"), F.col("text")))
    found = mine.join(shuffled(by_text), "row").filter(F.col("id").eqNullSafe(F.col("doc_id")))
    pick = let(_split(F.col("text")), lambda parts: F.transform("asked", lambda a: F.struct(a.alias("a"), F.get(parts, a["line_no"]).alias("line"))))
    found = found.select(F.explode(pick).alias("f")).select("f.a.*", _compared(F.col("f.line")).alias("s"))
    out = written(found.select("at", "h1", "h2", "s", *flags).dropDuplicates(["h1", "h2"]), "candidates")
    dropped(by_text)
    return out


def _children(parts: int) -> Column:
    """A segment [lo, hi) of the shorter line's m characters in so many: what lies before and behind a part joins the chained hashes.
    The piece x of a line longer by one character (d = 1) has one more."""
    x, d, size = F.col("x"), F.when(F.col("own"), 0).otherwise(1), F.col("hi") - F.col("lo")
    out = []
    for j in range(parts):
        a, b = F.floor(size * j / parts).cast("int"), F.floor(size * (j + 1) / parts).cast("int")
        out.append(F.struct((F.col("lo") + a).alias("lo"), (F.col("lo") + b).alias("hi"), F.xxhash64("p", F.substring(x, F.lit(1), a)).alias("p"),
                            F.xxhash64("q", F.substring(x, b + d + 1, F.length(x))).alias("q"), F.substring(x, a + 1, b - a + d).alias("x")))
    return F.explode(F.array(*out))


def _segments(lines: DataFrame) -> DataFrame:
    """at, own, m, lo, hi, p, q, x: the segments of at most SEGMENT characters whose outsides two lines share."""
    n = F.length("s")
    starts = []
    for own in (True, False):
        name, m, d = ("own", n, 0) if own else ("long", n - 1, 1)
        half = F.floor(m / 2).cast("int")
        for side, lo, hi in (("p", half, m), ("s", F.lit(0), half)):
            starts.append(F.when(F.col(f"{name}_{side}"), F.struct(
                F.lit(own).alias("own"), m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.xxhash64(F.substring(F.col("s"), F.lit(1), lo)).alias("p"),
                F.xxhash64(F.substring(F.col("s"), hi + d + 1, n)).alias("q"), F.substring(F.col("s"), lo + 1, hi - lo + d).alias("x"))))
    now = lines.select("at", F.explode(F.filter(F.array(*starts), lambda p: p.isNotNull())).alias("c")).select("at", "c.*")
    small = None
    while True:
        long = F.col("hi") - F.col("lo") > SEGMENT
        done = now.filter(~long)
        small = done if small is None else small.unionByName(done)
        if now.filter(long).limit(1).count() == 0:
            return small
        parts = now.filter(long).select("at", "own", "m", _children(PARTS).alias("c")).select("at", "own", "m", "c.*").withColumn("key", F.xxhash64("m", "lo", "hi", "p", "q"))
        parts = written(parts, "segments")
        now = written(parts.join(_shared(parts), "key", "left_semi").drop("key"), "alive")
        dropped(parts)


def _within_one(s: Column, t: Column) -> Column:
    """Whether two texts are within one edit: the common prefix is bisected, what follows the edit must be equal. Linear but for a
    logarithm, where levenshtein, threshold or not, takes the square of the length."""
    n = F.least(F.length(s), F.length(t))

    def closer(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"] + 1) / 2).cast("int")
        same = F.substring(s, F.lit(1), mid) == F.substring(t, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(at["lo"]).alias("lo"), F.when(same, at["hi"]).otherwise(mid - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    common = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), closer, lambda at: at["lo"])
    rest = lambda x, i: F.substring(x, i, F.length(x))
    more = F.length(s) - F.length(t)
    return let(common, lambda k: F.when(more == 0, rest(s, k + 2) == rest(t, k + 2)).when(more == 1, rest(s, k + 2) == rest(t, k + 1)).when(more == -1, rest(s, k + 1) == rest(t, k + 2)).otherwise(F.lit(False)))


def _near(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the classes that have an earlier line within one edit."""
    x = F.col("x")
    without = lambda i: F.concat(F.substring(x, F.lit(1), i), F.substring(x, i + 2, F.length(x)))
    side = ("m", "lo", "hi", "p", "q")
    key = lambda kind, text, i: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*side, text, i).alias("v1"), F.xxhash64(i, text, *side).alias("v2"))
    over = lambda kind, last, i_of: F.transform(F.sequence(F.lit(0), last), lambda i: key(kind, without(i), i_of(i)))
    size, whole = F.col("hi") - F.col("lo"), F.lit(-1)
    itself = F.array(key("o", x, whole))
    variants = F.when(~F.col("own"), over("l", size, lambda i: whole)).when(size > 0, F.concat(over("s", size - 1, lambda i: i), itself)).otherwise(itself)
    emitted = written(_segments(lines).select("at", F.explode(variants).alias("v")).select("at", "v.*").distinct(), "variants")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at"))).alias(f"least_{kind}")
    groups = emitted.groupBy("v1", "v2").agg(least("s"), least("o"), least("l"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    mate = F.when(F.col("kind") == "s", F.col("least_s")).when(F.col("kind") == "o", F.col("least_l")).otherwise(F.col("least_o"))
    pairs = emitted.join(groups, ["v1", "v2"]).withColumn("mate", mate).filter("mate < at").select("at", "mate").distinct()
    other = lines.select(F.col("at").alias("mate"), F.col("s").alias("t"))
    return pairs.join(lines.select("at", "h1", "h2", "s"), "at").join(other, "mate").filter(_within_one(F.col("s"), F.col("t"))).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, line_no) of every line that goes; row is xxhash64(id, text)."""
    lines = written(_lines(docs, id_col, text_col, min_chars), "lines")
    keys = ["own_p", "own_s", "long_p", "long_s"]
    classes = written(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("c"), *[F.max(k).alias(k) for k in keys]), "line-classes")
    wanted = written(_wanted(classes), "wanted")
    candidates = _texts(docs, lines, wanted, id_col, text_col)
    near = _near(candidates).withColumn("near", F.lit(True))
    verdict = classes.select("h1", "h2", F.col("at").alias("first"), "c").join(near, ["h1", "h2"], "left").filter("near or c > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    verdict = written(verdict, "line-verdicts")
    gone = lines.select("doc_id", "row", "line_no", "at", "h1", "h2").join(shuffled(verdict), ["h1", "h2"]).filter("near or at > first")
    gone = written(gone.select("doc_id", "row", "line_no"), "line-drops")
    for t in (lines, classes, wanted, candidates, verdict):
        dropped(t)
    return gone


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` with its text less the dropped lines, and n_lines, n_dropped (in place of columns so named)."""
    lines = dropped_lines(docs, id_col, text_col, min_chars).distinct().groupBy("doc_id", "row").agg(F.collect_list("line_no").alias("gone"))
    key, of, row, gone = fresh(docs, 4)
    drops = shuffled(written(lines.select(F.col("doc_id").alias(of), F.col("row").alias(row), F.col("gone").alias(gone)), "gone"))
    keyed = docs.withColumn(key, _row(F.col(id_col).cast("long"), F.col(text_col)))
    out = keyed.join(drops, (F.col(key) == F.col(row)) & docs[id_col].cast("long").eqNullSafe(F.col(of)), "left")
    text = let(_split(F.col(text_col)), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_split(F.col(text_col)))).cast("long")
    n_gone = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    out = out.withColumns({"n_lines": n_lines, "n_dropped": n_gone, text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(text)})
    return out.drop(key, of, row, gone)


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of ``docs`` with deduplicated texts; a document of which nothing stays goes, n_chars follows."""
    out = deduplicated(docs, id_col, text_col, min_chars).filter((F.col("n_dropped") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))
