"""Removal of repeated word windows, with a count-min prefilter.

Rows are dealt into blocks by a digest of their id and text. Each block sketches its windows: for every row of the
count-min sketch, which cells its windows fall into and whether once or more. The sketches are merged cell range by
cell range (no sketch is ever whole in one place), each block learns which of its cells are counted twice or more,
and only windows whose every cell is go on. Estimates never fall below the true counts, so no repeated window is lost.
The second pass groups these windows exactly, by 128-bit hashes, and each block learns which of them start earlier in
another block. Cell ranges and key ranges hold one packed row per block, so a window that a third of all documents
holds is one entry per block.

A null text has no words. Texts shorter than a window keep all words; a text of any length is handled whole. A null
doc_id comes before all others; rows that share a doc_id come in the order of a digest of their texts. Repeated rows are
documents of their own: the later one loses what the earlier one has. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, passes, tidied, utf8, window_hashes, with_text, word_hashes

WINDOW = 20
DEPTH = 2
#: Text bytes in a block, and sketch cells or keys that one range holds, for up to a gigabyte of text.
BLOCK_BYTES, RANGE_CELLS = 4 << 20, 1 << 21
#: Beyond that both grow with the root of the size, so that packed rows keep their length, up to so many times.
MOST_GROWTH = 8
#: Sketch cells for every word of the corpus.
CELLS_PER_WORD = 4


def growth(total: int) -> float:
    """How many times as large blocks and ranges are for so many bytes of text."""
    return min(MOST_GROWTH, max(1.0, (total / (1 << 30)) ** 0.5))


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending values as their differences, in as few bytes as the largest one takes."""
    steps = np.diff(x, prepend=np.uint64(0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(steps) or steps.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + pack(steps.astype(kind))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x[1:], np.dtype(f"u{x[0]}")).astype(np.uint64))


class Block:
    """The windows of one block's documents in order."""

    def __init__(self, table: pa.Table, size: int):
        table = table.sort_by([("key", "ascending"), ("mark", "ascending"), ("text", "ascending")])
        self.table = table
        self.owners = np.stack([table.column(c).to_numpy() for c in ("key", "mark")])
        words, seconds, firsts, base = [], [], [], 0
        for part in passes(table):
            data, offsets = utf8(part.column("text"))
            one, two, first = word_hashes(data, offsets)
            words.append(one)
            seconds.append(two)
            firsts.append(first[:-1] + base)
            base += len(one)
        self.first = np.concatenate([*firsts, [base]]) if firsts else np.zeros(1, np.int64)
        self.n_words = base
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        seconds = np.concatenate(seconds) if seconds else np.zeros(0, np.uint64)
        self.one, self.at = window_hashes(words, self.first, size)
        self.two, _ = window_hashes(seconds, self.first, size, 5)

    def cells(self, depth: int, n_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of one row of the sketch, whether a cell is met more than once, and each window's cell."""
        cells, which, n = np.unique(mix(self.one, 11 + depth) % np.uint64(n_cells), return_inverse=True, return_counts=True)
        return cells, n > 1, which

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def ranged(values: np.ndarray, n_ranges: int, span: int) -> np.ndarray:
    """Where each range's values begin in the ascending array, and the end."""
    edges = np.array([min(i * span, (1 << 64) - 1) for i in range(n_ranges)], np.uint64)
    return np.append(np.searchsorted(values, edges), len(values))


REPLY = "block int, depth int, range int, bits binary"


def _sketch(size: int, n_cells: int, n_ranges: int):
    span = -(-n_cells // n_ranges)

    def run(key, batch):
        block, rows = Block(batch, size), []
        for depth in range(DEPTH):
            cells, more, _ = block.cells(depth, n_cells)
            edges = ranged(cells, n_ranges, span)
            for i in np.flatnonzero(np.diff(edges)):
                a, b = edges[i], edges[i + 1]
                rows.append((key[0].as_py(), depth, int(i), pack_sorted(cells[a:b] - np.uint64(i * span)), pack(np.packbits(more[a:b]))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["block", "depth", "range", "cells", "more"])

    return run


def _merge(key, table):
    """Sketches of one cell range from all blocks: which cells are counted more than once."""
    cells = [unpack_sorted(x) for x in table.column("cells").to_pylist()]
    more = [np.unpackbits(unpack(m, np.uint8), count=len(c)).astype(bool) for c, m in zip(cells, table.column("more").to_pylist())]
    every = np.concatenate(cells)
    order = np.sort(every)
    twice = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], every[np.concatenate(more)]]))
    bits = [pack(np.packbits(np.isin(c, twice, assume_unique=True))) for c in cells]
    return pa.table([table.column("block"), table.column("depth"), table.column("range"), pa.array(bits, pa.binary())], names=["block", "depth", "range", "bits"])


def _flags(block: Block, replies: pa.Table, n_cells: int, n_ranges: int) -> np.ndarray:
    """Windows whose every cell is counted more than once."""
    span = -(-n_cells // n_ranges)
    got = {(d, r): b for d, r, b in zip(*(replies.column(c).to_pylist() for c in ("depth", "range", "bits")))}
    flags = np.ones(len(block.one), bool)
    for depth in range(DEPTH):
        cells, _, which = block.cells(depth, n_cells)
        edges = ranged(cells, n_ranges, span)
        repeated = np.zeros(len(cells), bool)
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            repeated[a:b] = np.unpackbits(unpack(got[depth, int(i)], np.uint8), count=b - a).astype(bool)
        flags &= repeated[which]
    return flags


def _distinct(block: Block, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the flagged windows: keys in ascending order, each with its first window; and each window's key."""
    at = np.flatnonzero(flags)
    order = at[np.lexsort((at, block.two[at], block.one[at]))]
    one, two = block.one[order], block.two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[new], two[new], order[new], np.stack([order, np.cumsum(new) - 1]) if len(order) else np.zeros((2, 0), np.int64)


def _propose(size: int, n_cells: int, n_ranges: int):
    span = -(-(1 << 64) // n_ranges)

    def run(key, docs, replies):
        if not docs.num_rows:
            return EMPTY_KEYS
        block = Block(docs, size)
        one, two, first, _ = _distinct(block, _flags(block, replies, n_cells, n_ranges))
        owner = block.owners[:, block.document(block.at[first])]
        edges, rows = ranged(one, n_ranges, span), []
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            rows.append((key[0].as_py(), int(i), one[a:b].tobytes(), two[a:b].tobytes(), pack(owner[:, a:b])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=["block", "range", "one", "two", "owner"])

    return run


EMPTY_KEYS = pa.table({"block": pa.array([], pa.int32()), "range": pa.array([], pa.int32()), "one": pa.array([], pa.binary()), "two": pa.array([], pa.binary()), "owner": pa.array([], pa.binary())})


def _decide(key, table):
    """Windows of one key range from all blocks: which ones start earlier in another block."""
    parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), unpack(c, np.int64).reshape(2, -1)) for a, b, c in zip(*(table.column(x).to_pylist() for x in ("one", "two", "owner")))]
    one, two, owner = (np.concatenate([p[i] for p in parts], -1) for i in range(3))
    order = np.lexsort((owner[1], owner[0], two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    later = np.empty(len(order), bool)
    later[order] = ~new  # the same id and text is in one block, so one block is first
    bits, a = [], 0
    for p in parts:
        bits.append(pack(np.packbits(later[a : a + len(p[0])])))
        a += len(p[0])
    return pa.table([table.column("block"), pa.array(np.zeros(table.num_rows, np.int32)), table.column("range"), pa.array(bits, pa.binary())], names=["block", "depth", "range", "bits"])


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(size: int, n_cells: int, n_ranges: int):
    span = -(-(1 << 64) // n_ranges)

    def run(key, docs, replies):
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        depth = np.asarray(replies.column("depth"))
        block = Block(docs, size)
        one, two, first, members = _distinct(block, _flags(block, replies.filter(pa.array(depth >= 0)), n_cells, n_ranges))
        decided = replies.filter(pa.array(depth < 0))
        got = dict(zip(decided.column("range").to_pylist(), decided.column("bits").to_pylist()))
        edges, later = ranged(one, n_ranges, span), np.zeros(len(one), bool)
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            later[a:b] = np.unpackbits(unpack(got[int(i)], np.uint8), count=b - a).astype(bool)
        window, which = members
        gone = window[(later[which]) | (window != first[which])] if len(window) else window
        cover = np.zeros(block.n_words + 1, np.int32)
        np.add.at(cover, block.at[gone], 1)
        np.add.at(cover, np.minimum(block.at[gone] + size, block.n_words), -1)
        removed = np.cumsum(cover[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(removed)])
        lost = sums[block.first[1:]] - sums[block.first[:-1]]
        kept = []
        for i, text in enumerate(block.table.column("text").to_pylist()):
            words = text.encode().split()
            if lost[i]:
                a = block.first[i]
                words = [words[j] for j in np.flatnonzero(~removed[a : a + len(words)])]
            kept.append(b" ".join(words).decode())
        return pa.table([block.table.column("doc_id").cast(pa.int64()), pa.array(np.diff(block.first)), pa.array(lost), pa.array(kept, pa.string())], names=names)

    return run


def dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by one space) for every row."""
    rows = with_text(docs)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, int(-(-total // (BLOCK_BYTES * growth(total)))))
    n_cells = 1 << max(16, int(np.ceil(np.log2(max(1, CELLS_PER_WORD * total // 6)))))
    n_ranges = max(1, int(-(-total // 6 // (RANGE_CELLS * growth(total)))))
    dealt = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text", F.lit(1)).alias("mark"), F.expr(f"cast(pmod(xxhash64(doc_id, text), {n_blocks}) as int)").alias("block"))
    by_block = dealt.groupBy("block")
    sketches = by_block.applyInArrow(tidied(_sketch(size, n_cells, n_ranges)), "block int, depth int, range int, cells binary, more binary")
    counted = sketches.groupBy("depth", "range").applyInArrow(tidied(_merge), REPLY)
    proposed = by_block.cogroup(counted.groupBy("block")).applyInArrow(tidied(_propose(size, n_cells, n_ranges)), "block int, range int, one binary, two binary, owner binary")
    decided = proposed.groupBy("range").applyInArrow(tidied(_decide), REPLY).withColumn("depth", F.lit(-1))
    return by_block.cogroup(counted.unionByName(decided).groupBy("block")).applyInArrow(tidied(_remove(size, n_cells, n_ranges)), RESULT)
