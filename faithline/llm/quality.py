"""Quality rules with host-level verdicts.

Every document gets word statistics and a set of rule flags. Failures are summed by host (the ``source``
column), each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts by the
method of moments, and the host's verdict goes back to its documents: on a host whose shrunken rate is over
``max_rate``, or ``host_sds`` standard deviations of the prior above its mean, a document has to pass every rule,
elsewhere only the base rule and no soft rule's limit by a factor of ``gross``.

All built-in functions; the word arrays stay inside the row, so nothing of the texts is shuffled.
Defined results: a null text has no words; a null host is a host of its own; repeated rows are rows of their
own; an empty table gives an empty result; columns other than id, text and host are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, shuffled, table, written


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_pct: int = 50  # of words in repeated 3-word windows
    max_symbol_pct: int = 10  # symbols per 100 words
    max_dup_line_pct: int = 30
    min_word_chars: int = 2  # mean length of a word
    max_word_chars: int = 15
    max_rate: float = 0.5  # shrunken failure rate over which a host is strict
    host_sds: float = 0  # a host is strict, too, that many standard deviations of the prior above its mean; 0: not by this
    gross: int = 0  # a document fails by itself that many times beyond the limit of a soft rule; 0: never


#: What the pipeline goes by. The query's SQL fixes Rules(), under which no host at realistic rates is strict.
STRICT = Rules(host_sds=2, gross=3)


def words_of(text: Column) -> Column:
    """Words of a text: ASCII white space becomes blanks by plain byte searches, and a split at single blanks
    needs no regular expression."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at these ascending positions."""
    return F.when(F.size(positions) == 0, F.lit(0)).otherwise(
        F.lit(3) + F.aggregate(
            F.transform(positions, lambda x, i: F.when(i == 0, 0).otherwise(F.least(F.lit(3), (x - positions[i - 1]).cast("int")))),
            F.lit(0), lambda a, x: a + x))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the array, first occurrences included.

    A window is its 64-bit hash. Most arrays have no equal windows, which a hash set finds out at once; in the
    others, sorting (hash, position) brings equal windows together, and their words are compared."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def same(a: Column, b: Column) -> Column:
        """Whether two (hash, position) pairs, the second one perhaps null, are equal windows."""
        return F.when(a["h"] == b["h"], F.forall(F.array(*map(F.lit, range(3))), lambda k: F.get(words, a["i"] + k) == F.get(words, b["i"] + k))).otherwise(F.lit(False))

    def spots(p: Column) -> Column:
        flagged = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)))
        return F.sort_array(F.transform(flagged, lambda x: x["i"]))

    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs(h), spots), _covered)))


def statistics(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the word statistics and one flag for each rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"), F.xxhash64(text_col).alias("text_key"))
    lines = F.filter(F.split("t", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "host", "text_key",
        let(words_of(F.col("t")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "host", "text_key", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    soft = (
        (100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("n_lines"))
        | (F.col("word_chars") < rules.min_word_chars * F.col("n_words")) | (F.col("word_chars") > rules.max_word_chars * F.col("n_words")))
    g = rules.gross
    gross = F.lit(False) if not g else (
        (100 * F.col("n_symbols") > g * rules.max_symbol_pct * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > min(g * rules.max_dup_line_pct, (100 + rules.max_dup_line_pct) // 2) * F.col("n_lines"))
        | (g * F.col("word_chars") < rules.min_word_chars * F.col("n_words")) | (F.col("word_chars") > g * rules.max_word_chars * F.col("n_words")))
    return d.withColumns({"base_failed": base, "any_failed": base | soft, "gross_failed": gross})


def host_rates(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """host, n_docs, n_failed, rate shrunk by the empirical beta prior, strict.

    The prior's mean m and strength s come from all hosts: with weights n, the variance of the raw rates
    less the binomial part is m(1-m)/(s+1). One row of sums joins every host, so no host list leaves the
    executors."""
    h = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("any_failed").alias("n_failed"))
    r = F.col("n_failed") / F.col("n_docs")
    moments = h.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.sum(F.col("n_docs") * r * r).alias("q"))
    m = F.when(F.col("n") > 0, F.col("f") / F.col("n"))
    var = F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0))
    noise = m * (1 - m) * F.col("k") / F.col("n")
    between = F.greatest(var - noise, F.lit(1e-6))
    prior = moments.select(m.alias("m"), F.greatest(m * (1 - m) / between - 1, F.lit(1.0)).alias("s"))
    rate = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    strict = rate > rules.max_rate
    if rules.host_sds:
        strict = strict | (rate > F.col("m") + rules.host_sds * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("s") + 1)))
    return h.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"), strict.alias("strict"))


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each document: statistics, base_failed, host_rate, host_strict, kept.

    The statistics are stored once (a few numbers a document); the host table joins them null-safely, its key
    salted on both sides so that a host with a third of all documents is spread."""
    stats = written(statistics(docs, rules, id_col, text_col, host_col), "quality")
    salts = 32
    hosts = host_rates(stats, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    left = stats.withColumns({"key": key(F.col("host")), "salt": F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")})
    right = hosts.select(key(F.col("host")).alias("key"), "salt", F.col("rate").alias("host_rate"), F.col("strict").alias("host_strict"))
    return left.join(right, ["key", "salt"], "left").drop("key", "salt").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("gross_failed") & ~(F.col("host_strict") & F.col("any_failed")))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def filtered(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns. Only the rejected keys travel to the anti join."""
    of, host, key = fresh(docs, 3)
    verdicts = judge(docs, rules, id_col, text_col, host_col).filter("not kept")
    bad = verdicts.select(F.col("doc_id").alias(of), F.col("host").alias(host), F.col("text_key").alias(key)).distinct()
    same = docs[id_col].eqNullSafe(F.col(of)) & docs[host_col].eqNullSafe(F.col(host)) & (F.xxhash64(docs[text_col]) == F.col(key))
    return docs.join(shuffled(written(bad, "rejected")), same, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win2 AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i+1], words[i+2]) AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win2) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS s(o) GROUP BY doc_id),
s AS (SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft FROM s),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft) AS k FROM f GROUP BY host),
m AS (SELECT sum(k) / sum(n) AS m, sum(k * (k / n)) / sum(n) AS q, count(*) / sum(n) AS kn FROM h),
p AS (SELECT m, greatest(m * (1 - m) / greatest(greatest(q - m * m, 0) - m * (1 - m) * kn, 1e-6) - 1, 1) AS s FROM m),
r AS (SELECT host, (k + m * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       NOT base_failed AND NOT (rate > 0.5 AND soft) AS kept
FROM f JOIN r USING (host)
"""
