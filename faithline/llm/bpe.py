"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

Text is cut by the pre-token pattern; each pre-token's bytes form a linked list whose adjacent pairs queue under
their merge rank. A bucket per rank holds the list positions; a two-level bitmap over the ranks finds the lowest
non-empty bucket by find-first-set. Popped entries whose pair has changed since are stale and skipped, so
nothing is ever searched for deletion. The work is O(n) queue steps for a pre-token of n bytes, however long.
A bucket of a short pre-token is a bitmap as well, over its positions, and is gone through in one pop.

Equal pre-tokens are mostly merged once: in a task by ``encode``, in all tasks of a Python worker by ``digests`` (caches of bounded bytes,
freed with the task and the worker). Runs as one map over Arrow batches: no
shuffle, and only the id and text columns are read.
Defined results: a null text is the empty text (no ids; empty bytes); each row gives one row, repeated rows
included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame

from .common import table

#: A cache: bytes of a generation as reckoned by an entry's size, and the longest pre-token that it keeps.
CACHE_BYTES, CACHE_CHARS, ENTRY_BYTES = 56 << 20, 64, 200
STRETCH = 4096
#: Longest pre-token, in bytes, whose buckets are bitmaps over positions.
SHORT = 60
_BIT = [1 << i for i in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: In texts of these characters alone, ``_LATIN`` cuts as the usual pattern does, by plain character classes.
_ODD = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]")
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # the library's engine takes \s as the Unicode property White_Space
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.usual = pattern == _USUAL
        # the lower level of the bitmap over the ranks; all zeros again whenever a pre-token is done
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        #: id of every byte, and rank of every pair of bytes, -1 if there is none
        self.one = [ranks.get(bytes((a,))) for a in range(256)]
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return _LATIN.findall(text) if self.usual and not _ODD.search(text) else self.cut(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue's steps stand in line here, as calls would cost more than they do."""
        ranks = self.ranks.get
        whole = ranks(piece)
        if whole is not None:
            return [whole]
        n, low, top = len(piece), self.low, 0
        if n <= SHORT:
            return self._merge_short(piece)
        buckets: dict[int, list[int]] = {}
        after, before = list(range(1, n + 2)), list(range(-1, n))  # of each part's first byte
        now: list[int | None] = [None] * n  # rank of the pair that starts at a part, as last queued
        new = [(i, r) for i in range(n - 1) if (r := ranks(piece[i : i + 2])) is not None]
        while True:
            for i, rank in new:
                now[i] = rank
                bucket = buckets.get(rank)
                if bucket is not None:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
            new = []
            if not top:
                break
            first = top & -top
            word = first.bit_length() - 1
            bit = low[word] & -low[word]
            rank = (word << 8) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] ^= bit
                if not low[word]:
                    top ^= first
            if now[i] != rank:
                continue  # stale
            j = after[i]
            now[i] = now[j] = None
            after[i] = k = after[j]
            before[k] = i
            if k < n and (r := ranks(piece[i : after[k]])) is not None:
                new.append((i, r))
            h = before[i]
            if h >= 0:
                now[h] = None
                if (r := ranks(piece[h:k])) is not None:
                    new.append((h, r))
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks(piece[i:j]))
            i = j
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        """``merge`` where a bucket is a bitmap over positions. A pair that a merge makes is longer than what it merged, so no bucket
        gets its own rank while it is gone through; if it gets a lower one, what is left of the bucket queues again."""
        ranks, two, low, n, top = self.ranks.get, self.two, self.low, len(piece), 0
        now = [two[a << 8 | b] for a, b in itertools.pairwise(piece)]  # rank of the pair that starts at a part, -1 without
        now.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # of each part's first byte
        made = [self.one[b] for b in piece]  # id of the part that starts here
        buckets: dict[int, int] = {}
        for i, rank in enumerate(now):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank] |= _BIT[i]
                else:
                    buckets[rank] = _BIT[i]
                    low[rank >> 8] |= _BIT[rank & 255]
                    top |= _BIT[rank >> 8]
        while top:
            first = top & -top
            word = first.bit_length() - 1
            bits = low[word]
            bit = bits & -bits
            rank = (word << 8) + bit.bit_length() - 1
            bucket = buckets.pop(rank)
            low[word] = bits ^ bit
            if bits == bit:
                top ^= first
            while bucket:
                place = bucket & -bucket
                bucket ^= place
                i = place.bit_length() - 1
                if now[i] != rank:
                    continue  # stale
                j = after[i]
                now[i] = now[j] = -1
                made[i] = rank
                after[i] = k = after[j]
                before[k] = i
                least = rank
                if k < n and (r := ranks(piece[i : after[k]])) is not None:
                    now[i] = r
                    if r in buckets:
                        buckets[r] |= place
                    else:
                        buckets[r] = place
                        low[r >> 8] |= _BIT[r & 255]
                        top |= _BIT[r >> 8]
                    least = r
                h = before[i]
                if h >= 0:
                    now[h] = -1
                    if (r := ranks(piece[h:k])) is not None:
                        now[h] = r
                        if r in buckets:
                            buckets[r] |= _BIT[h]
                        else:
                            buckets[r] = _BIT[h]
                            low[r >> 8] |= _BIT[r & 255]
                            top |= _BIT[r >> 8]
                        if r < least:
                            least = r
                if least < rank and bucket:
                    buckets[rank] = bucket
                    low[word] |= bit
                    top |= first
                    break
        out, i = [], 0
        while i < n:
            out.append(made[i])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.merge(piece.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Cache(dict):
    """Pre-token -> make(pre-token), in two generations of CACHE_BYTES at most: what is still in use when the younger one
    is full survives in the older one, so frequent pre-tokens are never merged again. Long pre-tokens are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.size = make, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if self.size >= CACHE_BYTES:
                self.older, self.size = dict(self), 0
                self.clear()
            self.size += ENTRY_BYTES + 8 * len(key)
            self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


@functools.lru_cache(maxsize=1)
def _lines(path: str, pattern: str) -> _Cache:
    """What a pre-token adds to the digests: its ids as text, a blank before each, and their bytes."""
    codec = _codec(path, pattern)
    said = [f" {i}".encode() for i in range(max(codec.tokens, default=0) + 1)]

    def make(piece):
        ids = codec.merge(piece.encode())
        return b"".join(map(said.__getitem__, ids)), codec.decode(ids)
    return _Cache(make)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> for every row."""
    import pyarrow as pa

    def run(batches):
        codec = _codec(path, pattern)
        cache = _Cache(lambda piece: tuple(codec.merge(piece.encode())))
        for b in batches:
            ids = [[i for p in codec.find(t or "") for i in cache[p]] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded binary (null for null ids)."""
    import pyarrow as pa

    def run(batches):
        codec = _codec(path, pattern)
        for b in batches:
            out = [None if x is None else codec.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    d = encoded.select(id_col, ids_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode and decode each text in one pass."""
    import pyarrow as pa

    def run(batches):
        codec, kept = _codec(path, pattern), _lines(path, pattern)
        for b in batches:
            n, ids_, decoded = [], [], []
            for t in b.column(1):
                count, line, data, first = 0, hashlib.sha256(), hashlib.sha256(), True
                pieces = codec.find(t.as_py() or "")
                for lo in range(0, len(pieces), STRETCH):
                    lines, parts = zip(*map(kept.__getitem__, pieces[lo : lo + STRETCH]), strict=True)
                    ids = b"".join(lines)
                    count += ids.count(b" ")
                    line.update(ids[1:] if first else ids)
                    data.update(b"".join(parts))
                    first = False
                n.append(count)
                ids_.append(line.hexdigest())
                decoded.append(data.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
