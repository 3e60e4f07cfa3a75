"""Exact search for the largest inner products, by eliminating candidates with a table of distances to pivots.

Vectors are whole numbers, floor(256 x) of each component. Equal vectors are one class, of which only the smallest ids can
be among the answers. PIVOTS vectors, far from each other, are chosen from a bounded sample; every class keeps its distances to all of them.
For a query at distance d(q, p) from a pivot, no candidate x is nearer than the largest |d(q, p) - d(x, p)|, so its score
is at most (|q|^2 + |x|^2 - that bound squared) / 2.

Classes are dealt by their nearest pivot and the distance to it into blocks of equal size, each with the range of its
distances to every pivot, which bounds all of its scores at once. A query first searches the block with the highest bound;
its last score there is what other blocks must reach. In every block that still can reach it, candidates are evaluated in
the order of their bounds until the next bound is below the last score found; where no bound in the block can be so low,
all are evaluated by one product. Rounding only ever raises bounds, and scores are whole numbers without rounding, so
results are exact.

Vectors that are null or hold null or infinite components or nan take no part, nor those whose squared length needs over
62 bits, as their scores wouldn't be longs. Shorter vectors count as followed by zeros; an empty one scores 0. Repeated
rows are rows of their own; a query leaves out one row, its own; null ids are no queries and sort last; an empty table
gives an empty result; other columns don't disturb.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import tidied
from corpusloom.plans.storage import cut_lineage, drop

#: Answers of a query, scale of the components.
TOP, SCALE = 5, 256
#: Pivots, and the sample that they are chosen from (the classes with the smallest digests).
PIVOTS, SAMPLE = 24, 2048
#: Classes of a block: a 64th of all, within these bounds. Queries, and blocks' ranges, that are bounded at a time.
SMALLEST, LARGEST, BLOCKS = 512, 1 << 15, 64
CHUNK, PACK = 512, 1024
#: Candidates that are evaluated first; then twice as many each time.
FIRST = 64
#: Shares by which bounds are raised for the rounding of squares, and of the distances themselves.
SLACK, ROUNDING = 1e-9, 1e-15
NEVER = np.iinfo(np.int64).max


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """vec_id and packed 64-bit components of the vectors that take part."""
    for batch in batches:
        ids, kept, packed = batch.column("vec_id"), [], []
        for i, v in enumerate(batch.column("vector")):
            if not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values, np.float64)
            if np.isfinite(x).all():
                x = np.floor(x * SCALE)
                if x @ x < 2.0**62:
                    kept.append(i)
                    packed.append(x.astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(packed, pa.binary())], ["vec_id", "vector"])


def matrix(packed: list[bytes]) -> np.ndarray:
    """The packed vectors as rows, shorter ones followed by zeros."""
    out = np.zeros((len(packed), max((len(p) // 8 for p in packed), default=0)), np.int64)
    for row, p in zip(out, packed):
        row[: len(p) // 8] = np.frombuffer(p, np.int64)
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if math.sqrt(_squares(a).max(initial=0)) * math.sqrt(_squares(b).max(initial=0)) < 2.0**52:  # no partial sum is rounded
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of the exact squared distances, which have up to 64 bits."""
    square = _squares(a).astype(np.uint64)[:, None] + _squares(b).astype(np.uint64)[None] - np.uint64(2) * inner(a, b).astype(np.uint64)
    return np.sqrt(square.astype(np.float64))


def pivots(classes: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to n vectors of a bounded sample, each as far as possible from those before it."""
    rows = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    found = matrix([bytes(r["vector"]) for r in rows])
    if not len(found):
        return found
    picked, near = [0], distances(found, found[:1])[:, 0]
    while len(picked) < min(n, len(found)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(found, found[picked[-1:]])[:, 0])
    return found[picked]


def highest(q2, x2, apart):
    """The highest possible score at these squared lengths and this distance or more."""
    bound = (q2 + x2 - apart * apart * (1 - SLACK)) / 2
    return bound + SLACK * (q2 + x2) + 1


def _tabled(at: np.ndarray):
    """Classes with their distances to the pivots, the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                vectors = matrix(part.column("vector").to_pylist())
                far = distances(vectors, at)
                cell = far.argmin(axis=1)
                new = [pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell]), pa.array([row.tobytes() for row in far], pa.binary()), pa.array(_squares(vectors).astype(np.float64))]
                yield pa.RecordBatch.from_arrays([part.column("vector"), part.column("ids"), *new], ["vector", "ids", "cell", "depth", "far", "square"])

    return run


BLOCK = "block long, vectors array<binary>, ids array<array<long>>, far binary, low array<double>, high array<double>, least double, most double"


def _blocked(size: int):
    """Consecutive classes as blocks; low, high: ranges of the distances by pivot; least, most: of the squared lengths."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 33, []
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in BLOCK.split(", ")]

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            vectors, far = table.column("vector").to_pylist(), np.array([np.frombuffer(f) for f in table.column("far").to_pylist()])
            square = _squares(matrix(vectors)).astype(np.float64)
            row = [number, vectors, table.column("ids").to_pylist(), far.T.tobytes(), far.min(axis=0).tolist(), far.max(axis=0).tolist(), float(square.min()), float(square.max())]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names)

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    return run


def _nearest(rows: np.ndarray, score: np.ndarray, first: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates and their scores, the best in order: by score, then by their smallest id."""
    if len(rows) > top:
        good = score >= np.partition(score, len(score) - top)[len(score) - top]
        rows, score = rows[good], score[good]
    order = np.lexsort((first[rows], -score))[:top]
    return rows[order], score[order]


class Searched:
    """A block's classes, ready to be searched."""

    def __init__(self, row: dict):
        self.vectors, self.ids = matrix(row["vectors"]), row["ids"]
        self.square = _squares(self.vectors)
        self.first = np.array([x[0] if x[0] is not None else NEVER for x in self.ids], np.int64)
        self.far = np.frombuffer(row["far"]).reshape(-1, len(self.ids))
        self.low, self.high, self.least = np.array(row["low"]), np.array(row["high"]), row["least"]

    def search(self, queries: np.ndarray, far: np.ndarray, least: list[int | None], top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, the best classes' rows and scores, of those that score at least `least`."""
        q2 = _squares(queries)
        # where even the farthest candidate's bound reaches the score, nothing can be passed over
        farthest = np.maximum(far - self.low, self.high - far).max(axis=1, initial=0)
        whole = np.array([t is None for t in least]) | (highest(q2.astype(np.float64), self.least, farthest) >= np.array([t or 0 for t in least]))
        scores = dict(zip(np.flatnonzero(whole).tolist(), inner(queries[whole], self.vectors))) if whole.any() else {}
        every = np.arange(len(self.ids))
        for i in range(len(queries)):
            if i in scores:
                rows, score = every, scores[i]
            else:
                rows, score = self._in_order(queries[i : i + 1], float(q2[i]), far[i], least[i], top)
            if least[i] is not None:
                good = score >= least[i]
                rows, score = rows[good], score[good]
            yield _nearest(rows, score, self.first, top)

    def _in_order(self, query: np.ndarray, q2: float, far: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        apart = np.zeros(len(self.ids))
        for known, d in zip(self.far, far):
            np.maximum(apart, np.abs(known - d) - ROUNDING * (known + d), out=apart)
        bound = highest(q2, self.square.astype(np.float64), apart)
        order = np.argsort(-bound, kind="stable")
        rows, score, done, step = order[:0], np.zeros(0, np.int64), 0, FIRST
        while done < len(order) and bound[order[done]] >= least:
            part = order[done : done + step]
            rows, score = np.concatenate([rows, part]), np.concatenate([score, inner(query, self.vectors[part])[0]])
            if len(score) >= top:
                least = max(least, int(np.partition(score, len(score) - top)[len(score) - top]))
            done, step = done + step, 2 * step
        return rows, score


ANSWER = "query long, score long, ids array<long>, first long, same boolean"


def _searching(top: int):
    """The best classes of one block for the queries sent to it."""

    def run(key, blocks: pa.Table, sent: pa.Table):
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
        out: list[list] = [[] for _ in kinds]
        if blocks.num_rows and sent.num_rows:
            block = Searched(blocks.to_pylist()[0])
            numbers, least = sent.column("query").to_pylist(), sent.column("least").to_pylist()
            queries, far = matrix(sent.column("vector").to_pylist()), np.array([np.frombuffer(f) for f in sent.column("far").to_pylist()])
            squares = _squares(queries)
            for k in range(0, len(numbers), CHUNK):
                some = slice(k, k + CHUNK)
                for i, (rows, score) in enumerate(block.search(queries[some], far[some], least[some], top), k):
                    for r, s in zip(rows.tolist(), score.tolist()):
                        same = int(block.square[r]) == int(squares[i]) == s
                        for column, value in zip(out, (numbers[i], s, block.ids[r], int(block.first[r]), same)):
                            column.append(value)
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=[x.split()[0] for x in ANSWER.split(", ")])

    return run


def _bounded(best_only: bool):
    """Which blocks a query can be answered from: the one with the highest bound, or all whose bound reaches its score."""

    def run(key, chunk: pa.Table, pack: pa.Table):
        queries, blocks, bounds = [], [], []
        if chunk.num_rows and pack.num_rows:
            number, names = np.asarray(chunk.column("query")), np.asarray(pack.column("block"))
            q2, far = np.asarray(chunk.column("square")), np.array([np.frombuffer(f) for f in chunk.column("far").to_pylist()])
            low, high, most = (np.array(pack.column(c).to_pylist()) for c in ("low", "high", "most"))
            for k in range(0, len(number), 64):
                f = far[k : k + 64, None]
                apart = np.maximum(low[None] - f, f - high[None]) - ROUNDING * (high[None] + f)
                bound = highest(q2[k : k + 64, None], most[None], np.maximum(apart, 0).max(axis=2, initial=0))
                if best_only:
                    at = bound.argmax(axis=1)
                    i = np.arange(len(at))
                else:
                    least = np.array([-np.inf if t is None else t for t in chunk.column("least").to_pylist()[k : k + 64]])
                    done = np.asarray(chunk.column("done").to_pylist()[k : k + 64])
                    i, at = np.nonzero((bound >= least[:, None]) & (names[None] != done[:, None]))
                queries.append(number[k + i])
                blocks.append(names[at])
                bounds.append(bound[i, at])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.Table.from_arrays([cat(queries, pa.int64()), cat(blocks, pa.int64()), cat(bounds, pa.float64())], names=["query", "block", "bound"])

    return run


def search(vectors: DataFrame, is_query: Column, top: int = TOP, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of vec_id, embedding where is_query holds, the rows with the
    largest inner products, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = cut_lineage(kept.mapInArrow(tidied(_whole), "vec_id long, vector binary"))
    # equal vectors are one class; of its rows, as many as a query can be answered with, and the query's own
    order = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top + 1)
    classes = few.groupBy("vector").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    classes = cut_lineage(classes)
    at = pivots(classes, n_pivots)
    if not len(at):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tabled = cut_lineage(classes.mapInArrow(tidied(_tabled(at)), "vector binary, ids array<long>, cell int, depth double, far binary, square double"))
    drop(classes)
    n = tabled.count()
    size = max(SMALLEST, min(LARGEST, -(-n // BLOCKS)))
    dealt = tabled.repartitionByRange(max(1, min(-(-n // size), 1 << 14)), "cell", "depth", F.xxhash64("vector")).sortWithinPartitions("cell", "depth")
    blocks = cut_lineage(dealt.mapInArrow(tidied(_blocked(size)), BLOCK))
    asked = rows.where(is_query)
    each = asked.select("vector").distinct().join(tabled.select("vector", "far", "square"), "vector")
    queries = cut_lineage(each.withColumn("query", F.monotonically_increasing_id()))
    n_packs = max(1, -(-2 * n // (size * PACK)))
    packs = blocks.select("block", "low", "high", "most").withColumn("pack", F.expr(f"pmod(xxhash64(block), {n_packs})"))
    n_chunks = max(1, -(-queries.count() // (8 * CHUNK)))
    chunk = F.expr(f"query div {CHUNK}")

    def sent(known: DataFrame, best_only: bool) -> DataFrame:
        """query, block, bound; every chunk of queries meets every pack of blocks' ranges."""
        of = known.withColumn("chunk", chunk).withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_packs - 1).cast("long"))))
        met = of.select(F.col("chunk").alias("_chunk"), F.col("pack").alias("_pack")).distinct()
        copies = packs.join(met, F.col("pack") == F.col("_pack")).drop("pack")
        return of.groupBy("chunk", "pack").cogroup(copies.groupBy("_chunk", "_pack")).applyInArrow(tidied(_bounded(best_only)), "query long, block long, bound double")

    measured = queries.select("query", "far", "square")
    first = cut_lineage(sent(measured, True).groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block")))

    def answers(where: DataFrame) -> DataFrame:
        """where: query, block, least. Queries come to a block in chunks, so that one task has a bounded number of them."""
        given = where.join(queries, "query").withColumn("chunk", F.expr(f"pmod(xxhash64(query), {n_chunks})"))
        met = given.select(F.col("block").alias("_block"), F.col("chunk").alias("_chunk")).distinct()
        copies = blocks.join(met, F.col("block") == F.col("_block")).drop("block")
        return copies.groupBy("_block", "_chunk").cogroup(given.groupBy("block", "chunk")).applyInArrow(tidied(_searching(top + 1)), ANSWER)

    best = cut_lineage(answers(first.withColumn("least", F.lit(None).cast("long"))))
    reached = best.groupBy(F.col("query").alias("_q")).agg(F.when(F.count("*") > top, F.min("score")).alias("least"))
    known = measured.join(first.withColumnRenamed("block", "done"), "query").join(reached, F.col("query") == F.col("_q"), "left").drop("_q")
    known = cut_lineage(known)
    rest = answers(sent(known, False).join(known.select("query", "least"), "query"))
    ranked = best.unionByName(rest).withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).where(F.col("_k") <= top + 1)
    found = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_k", "score", "same", "ids"))).alias("found"))
    # rows of the best classes in order, then without the query's own
    entries = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("down"), i.isNull().alias("none"), i.alias("vec_id"), c["same"].alias("same")))))
    listed = found.join(queries.select("query", "vector"), "query").select("vector", F.slice(F.array_sort(entries), 1, top + 1).alias("entries"))
    met = asked.withColumnRenamed("vec_id", "query_id").join(listed, "vector")
    own = F.array_position(F.transform("entries", lambda e: e["same"] & e["vec_id"].eqNullSafe(F.col("query_id"))), True)
    numbered = met.withColumn("_own", own).select("query_id", F.posexplode(F.slice(F.filter("entries", lambda e, i: i + 1 != F.col("_own")), 1, top)).alias("_i", "_e"))
    return numbered.select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("_e.vec_id").alias("vec_id"), (-F.col("_e.down")).alias("score"))
