"""Byte-pair encoding with a public tokenizer's ranks, by a contiguous array of part boundaries and adjacent ranks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from chunklake.common import spread

#: Fixed value: the pattern that splits a text into words before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30
#: words of more bytes than this are merged by linked parts and a heap, which gives the same ids: the scan for the least rank takes the
#: square of a word's length. CACHE words of at most this length are kept by each worker.
SHORT = 96
CACHE = 1 << 18


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the machine keeps a public vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which the workers find a vocabulary file of the driver: sent to them once per session, they need not have it."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_chunklake_sent", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return path.rpartition("/")[2]


def _on_worker(name: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(name)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word. at[i] is where part i begins; rank[i] that of parts i and i+1 taken together.

    The pair of least rank, the leftmost of equals, is found by a scan; its inner boundary goes and the ranks beside it are renewed."""
    get = ranks.get
    n = len(word)
    at = list(range(n + 1))
    rank = [get(word[i : i + 2], NONE) for i in range(n - 1)]
    while rank:
        low = min(rank)
        if low == NONE:
            break
        i = rank.index(low)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[at[i] : at[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[at[i - 1] : at[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word in n log n steps: linked parts and a heap of pairs."""
    get, n = ranks.get, len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) < NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = nxt[i]
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := get(word[i : end[nxt[i]]], NONE)) < NONE:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := get(word[prv[i] : stop], NONE)) < NONE:
            heapq.heappush(heap, (r, prv[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; words met before come from a cache that is emptied when full."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        b = w.encode("utf-8")
        one = self.ranks.get(b)
        ids = [one] if one is not None else merge_short(b, self.ranks) if len(b) <= SHORT else merge_long(b, self.ranks)
        if len(b) <= SHORT:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, out = self.cache.get, []
        for w in self.words.findall(text):
            ids = get(w)
            out += ids if ids is not None else self.word(w)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _run(path: str, text: str, only_size: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(_on_worker(path)).encode
        for b in batches:
            at = b.schema.get_field_index(text)
            texts = b.column(at).to_pylist()
            rest = [b.column(i) for i in range(b.num_columns) if i != at]
            if only_size:
                made = pa.array([len(encode(t)) for t in texts], pa.int32())
            else:
                ids: list[int] = []
                offsets = [0]
                for t in texts:
                    ids += encode(t)
                    offsets.append(len(ids))
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rest, made], [*[n for i, n in enumerate(b.schema.names) if i != at], "tokens" if only_size else "ids"])

    return run


def _with(df: DataFrame, text: str, path: str | None, only_size: bool) -> DataFrame:
    made = "tokens" if only_size else "ids"
    rest = [c for c in df.columns if c not in (text, made)]
    one = spread(df.select(*[f"`{c}`" for c in rest], f"`{text}`"))
    shape = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "tokens int" if only_size else "ids array<int>"])
    return one.mapInArrow(_run(shipped(df.sparkSession, path or vocabulary_path()), text, only_size), schema=shape)


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with `ids`, the token ids of the whole text, in place of the text. Null and empty texts have an empty list; special
    tokens' strings are ordinary text; a column that was called ids is replaced; repeated rows stay repeated."""
    return _with(df, text, path, False)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with `tokens`, the number of ids that `encode` gives, in place of the text."""
    return _with(df, text, path, True)


def decode(ids: list[int], path: str | None = None) -> bytes:
    back = {i: b for b, i in load_ranks(path or vocabulary_path()).items()}
    return b"".join(back[i] for i in ids)
