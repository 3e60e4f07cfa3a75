"""What the operators of this subpackage share: column guards, Arrow batches as byte arrays, hashing."""

from __future__ import annotations

import ctypes
import functools
import inspect
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it: no space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Text bytes that one numpy pass works on; longer documents are passes of their own.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def passes(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of the batch with about `limit` bytes of text each, and at least one row."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text) if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives freed memory back: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(f):
    """A generator function for mapInArrow, or a function for one group, that leaves no freed memory behind."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            try:
                yield from f(batches)
            finally:
                tidy()

        return run

    @functools.wraps(f)
    def one(*args):
        try:
            return f(*args)
        finally:
            tidy()

    # the number of arguments tells Spark what to pass
    return (lambda key, table: one(key, table)) if f.__code__.co_argcount == 2 else (lambda key, left, right: one(key, left, right))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 8 << 20:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (one more entry at the end)."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a word that are hashed as numbers; longer words are digested one by one.
SHORT_WORD = 16
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two unrelated 64-bit hashes of every word, and the index of each text's first word (one more entry at the end).

    The one hash differs for any two words of up to 8 bytes that are equally long. Words of more than SHORT_WORD bytes
    take both from a cryptographic digest, so that no pattern of letters makes words collide."""
    starts, ends, first = word_spans(data, offsets)
    n = ends - starts
    eights = np.ndarray(len(data) + 9, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))  # at every byte
    low = eights[starts] & _BYTES[np.minimum(n, 8)]
    high = eights[np.minimum(starts + 8, len(data))] & _BYTES[np.clip(n - 8, 0, 8)]
    size = n.astype(np.uint64)
    one, two = mix(low ^ mix(high ^ mix(size, 61), 62), 63), mix(high ^ mix(low ^ mix(size, 64), 65), 66)
    for i in np.flatnonzero(n > SHORT_WORD).tolist():
        one[i], two[i] = np.frombuffer(blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), np.uint64)
    return one, two, first


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one document, and the index of each run's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    running = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words, seed + 1) * powers(_BASE, len(words)), out=running[1:])
    value = mix((running[size:] - running[:-size]) * powers(_INVERSE, n), seed)
    ok = np.ones(n, bool)
    for k in range(1, size):  # a run that reaches into the next document is none
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return value[at], at


def with_text(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text (null: empty) and what else is named; other columns don't disturb."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also)


def place(bounds, point, n: int):
    """Index of the interval that holds the point: a binary search unrolled over the sorted bounds."""
    steps = max(1, math.ceil(math.log2(max(2, n))))
    low, high = F.lit(0), F.size(bounds)
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps + 1)),
        F.struct(low.alias("lo"), high.alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.when(F.get(bounds, ((acc["lo"] + acc["hi"]) / 2).cast("int")) <= point, F.struct((((acc["lo"] + acc["hi"]) / 2).cast("int") + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
                F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi"))
            )
        ),
    )
    return found["lo"]
