"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a shuffled order fixed by a digest of their ids, form a stream of words that is read
cyclically and cut into blocks of equally many words. Golden-ratio points, one for each slot of the mix, are mapped
through the sources' cumulative targets; a slot's rank within its source names the block that the slot takes. So the
schedule alone decides how far a source is read, within a few blocks of its target, and in which order. Null texts have
size 0 and are never taken; a source whose size is 0 has target 0; repeated rows are documents of their own; null ids are
shuffled by their texts; an empty table gives an empty mix. The null source sorts last. Texts may have any length.
Columns beside doc_id, source and text don't disturb, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, place
from corpusloom.plans.storage import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Words of a block at most, and slots that a mix has at least where it has so many words: blocks are as small as that needs.
BLOCK, SLOTS = 1024, 1 << 16
GOLDEN = 0.6180339887498949
#: Pieces into which every source's stream is dealt, so that a source with a third of all rows isn't one task.
DEAL = 1 << 12
#: Consecutive slots that are ranked together.
RUN = 4096


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Words to take from each source: shares by weight of `share` of all words, at most `cap` times the source,
    the excess going to the others by weight until no target is above its cap."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    left, open_, out = share * sum(n for _, n in ordered), dict(ordered), {}
    while open_:
        total = sum(weigh[s] for s in open_)
        full = {s: cap * n for s, n in open_.items() if left * weigh[s] / total >= cap * n}
        if not full:
            out |= {s: round(left * weigh[s] / total, 6) for s in open_}
            break
        out |= full
        left -= sum(full.values())
        open_ = {s: n for s, n in open_.items() if s not in full}
    return out


def block_words(total: float) -> int:
    """Words of a block in a mix of so many words."""
    return max(1, min(BLOCK, int(total // SLOTS)))


def stream(docs: DataFrame) -> DataFrame:
    """docs with size, source, key and _start: the words before the document in its source's shuffled stream.

    Prefix sums in two levels: by piece of the stream, then inside a piece; no source is gathered in one task."""
    shuffled = docs.withColumn("_order", F.sha2("key", 256)).withColumn("_piece", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int") % DEAL)
    pieces = shuffled.groupBy("source", "_piece").agg(F.sum("size").alias("_words"))
    before = pieces.select("source", "_piece", F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_piece").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = shuffled.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    right = before.select(F.col("source").alias("_s"), F.col("_piece").alias("_p"), "_before")
    return placed.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p"))).withColumn("_start", F.col("_before") + F.col("_inside")).drop("_s", "_p", "_before", "_inside", "_piece", "_order", "key")


def schedule(spark, goal: list[tuple[str | None, float]], n: int, run: int = RUN) -> DataFrame:
    """source, rank, slot of n slots: each slot's golden-ratio point falls into one source's share of the targets, and
    rank counts the source's slots from 0.

    Slots are ranked inside runs and the runs' counts summed up before, so ranking is distributed."""
    goal = [(s, t) for s, t in goal if t > 0]
    total, low, bounds = sum(t for _, t in goal), 0.0, []
    for _, t in goal[:-1]:
        low += t
        bounds.append(low / total)
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}D) - floor(id * {GOLDEN}D)").alias("point"))
    at = points.withColumn("_at", place(F.array(*map(F.lit, bounds)).cast("array<double>"), F.col("point"), len(goal))).withColumn("_run", F.expr(f"slot div {run}"))
    runs = at.groupBy("_at", "_run").agg(F.count("*").alias("n"))
    before = runs.select(F.col("_at").alias("_a"), F.col("_run").alias("_r"), F.coalesce(F.sum("n").over(Window.partitionBy("_at").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_at", "_run").orderBy("slot")) - 1
    ranked = at.withColumn("_inside", inside).join(before, (F.col("_at") == F.col("_a")) & (F.col("_run") == F.col("_r"))).select("_at", "slot", (F.col("_before") + F.col("_inside")).alias("rank"))
    named = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(goal)], "_i int, source string")
    return ranked.join(named, F.col("_at") == F.col("_i")).select("source", "rank", "slot")


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, and the key that fixes a document's place in the shuffled stream: its id, or else its text's digest."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.sha2(text, 256), F.lit("")))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Of docs with size: every row's doc_id, source, size, source_size, target and _start; and its turns in the mix (none
    in an empty one): _d, _s, _b, words (doc_id, source, _start, size), turn, taken, slot (its first one) and point, slot by the mix' slots.

    The source totals are the only rows that the driver gets. No document has more than `cap` turns."""
    spark = docs.sparkSession
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"), "key"))
    totals = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(totals, weights, share, cap)
    known = spark.createDataFrame([(s, n, float(goal.get(s, 0.0)), int(cap * n)) for s, n in totals], "_s string, source_size long, target double, _most long")
    placed = stream(rows).join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ordered = sorted(goal.items(), key=lambda x: (x[0] is None, x[0] or ""))
    total = round(sum(t for _, t in ordered), 3)
    block = block or block_words(total)
    n = int(math.floor(total / block + 0.5))
    if not n:
        return placed, None
    turns = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))).alias("turn"))
    spans = turns.withColumn("_from", F.col("_start") + F.col("turn") * F.col("source_size")).withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_most"))).where("_from < _to")
    blocks = spans.select("source", "doc_id", "size", "_start", "turn", "_from", "_to", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")).alias("_rank"))
    parts = blocks.select("source", "doc_id", "size", "_start", "turn", "_rank", (F.least("_to", (F.col("_rank") + 1) * block) - F.greatest("_from", F.col("_rank") * block)).alias("_words"))
    slots = schedule(spark, ordered, n).select(F.col("source").alias("_s"), F.col("rank").alias("_k"), "slot")
    # the block's rank spreads a large source over all tasks
    taken = parts.join(slots, (F.col("_rank") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")))
    return placed, taken.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_start").alias("_b"), "turn", F.col("size").alias("words")).agg(F.sum("_words").alias("taken"), F.min("slot").alias("slot"), (F.min("slot") / n).alias("point"))


def mix(docs: DataFrame, **named) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot (null if never taken) for every row of docs with
    size; named: as in plan."""
    placed, turns = plan(docs, **named)
    kept = ["doc_id", "source", "size", "source_size", "target"]
    if turns is None:
        return placed.select(*kept, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    took = turns.groupBy("_d", "_s", "_b").agg(F.sum("taken").alias("_taken"), F.min("slot").alias("first_slot"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_start") == F.col("_b")) & (F.col("size") > 0)
    return placed.join(took, same, "left").select(*kept, F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
