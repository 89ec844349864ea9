"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content; with the SHA-256 of the tokenizer file it addresses a
stored count. One representative row of each digest that the cache lacks is encoded by the tokenizer library,
its count is appended to the cache, and every document then takes its count from there.

The cache is a Parquet table (tokenizer, digest, n_tokens) in a folder that driver and executors share, and stays for later
calls; without a given folder a fresh one serves one call. A failed run leaves the cache as it was: files are committed with the job.
Only representatives' texts are shuffled, by a row key that no group of copies shares; counts go back to documents
by a sort-merge join on the digest, whose hot keys adaptive execution splits.

Normalised content is the text, less white space at its ends if the tokenizer file drops it.
Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passing, table, written

PIECES = 1_000_000
#: Latin texts (no blanks beyond ASCII's, no special-token brackets) are cut in Python as the tokenizer file says, and
#: each piece is counted once by the library; texts with any other character go to the library whole.
_LATIN = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)]))
#: Characters whose lower case lies elsewhere belong to the others.
_PLAIN = "".join(c for c in _LATIN if set(c.lower()) <= set(_LATIN))
_ODD = re.compile(f"[^{re.escape(_PLAIN)}]|<\\|")
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class Counter:
    """Counts as the library's encode gives them, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _cuts_words(self.tokenizer.to_str())
        self.known: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.by_words or _ODD.search(text):
            return self.library([text])[0]
        pieces, known = _CUT.findall(text.lower()), self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            new = list({p for p in pieces if p not in known})
            if len(known) + len(new) > PIECES:
                known.clear()
                new = list(set(pieces))
            known.update(zip(new, self.library(new), strict=True))
            return sum(map(known.__getitem__, pieces))


def _cuts_words(model: str) -> bool:
    """Whether the tokenizer normalises and cuts text the way ``_CUT`` does."""
    import json

    m = json.loads(model)
    norm = [x["type"] for x in (m.get("normalizer") or {}).get("normalizers", [])]
    cuts = (m.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = cuts[0].get("pattern", {}).get("Regex") if cuts else None
    return norm == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and m.get("post_processor") is None


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


@functools.lru_cache(maxsize=2)
def counter(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceModel(path) if path.endswith(".model") else Counter(path)


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens)."""
    import pyarrow as pa

    def run(batches):
        model = counter(path)
        for b in batches:
            n = [model.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def normalised(text: Column, path: str) -> Column:
    """What a text's digest is made of: white space at the ends goes where the tokenizer file drops it."""
    drops = not path.endswith(".model") and counter(path).by_words
    return F.btrim(text, F.lit(" \t\n\r")) if drops else text


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"row": F.xxhash64("doc_id", "text"), "n_bytes": F.octet_length("text").cast("long")})
    keyed = written(rows.select("doc_id", "row", "n_bytes", F.unhex(F.sha2(normalised(F.col("text"), tokenizer_path), 256)).alias("digest")), "digests")
    cache = cache or passing(spark, "token-counts")
    misses = keyed.groupBy("digest").agg(F.min(F.struct("row", "n_bytes")).alias("r")).select("digest", "r.row", "r.n_bytes")
    known = _cached(spark, cache, version)
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    # repeated rows are one before they are shuffled, so each missing digest has one text
    texts = rows.select("row", "n_bytes", "text").dropDuplicates(["row", "n_bytes"]).join(misses, ["row", "n_bytes"])
    encoded(texts, tokenizer_path).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = _cached(spark, cache, version)
    if counts is None:  # an empty table
        return keyed.select(F.col("doc_id").alias(id_col), "n_bytes", F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit"))
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # runs beside each other may have added the same
    return keyed.join(counts, "digest", "left").select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark, cache: str, version: str) -> DataFrame | None:
    """The cache's counts for this tokenizer; None if it has none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={version}")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
