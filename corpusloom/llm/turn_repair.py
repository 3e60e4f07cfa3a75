"""Conversations put into the order (s?(ua)+)? of role initials by the cheapest edits: a scan over min-plus matrices.

The states are: nothing yet, after the system turn, after a user turn, after an assistant turn. Each turn is a 4x4 matrix
over (cost, audit) elements: keeping it, giving it another role and deleting it are steps between states, and the closure
of insertions follows each of them. Adding elements takes the smaller (cost first, then audit in ASCII order), multiplying them adds
costs and joins audits. No audit is a true prefix of another with the same cost (what would be left were insertions, which
cost), so joining keeps the order and products may be taken in any grouping: turns of one segment are multiplied as a
tree, and segments of one conversation in levels over all partitions, SPAN at a time.

Turns of a conversation are ordered by turn, nulls first, then by a digest of role and text, so that rows with one turn
have a fixed order and copies are neighbours. Turns are dealt in that order, over as many partitions as Spark has, and cut
into segments of a bounded size; no conversation is gathered, however long. Only its audit is one value, a byte for each
edit. A null role or text counts as one space, a null conv_id is a conversation of its own; repeated rows are duplicates
of one another; an empty table gives empty results; other columns don't disturb; texts may have any length (a segment
holds one longer text alone).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import tidied
from corpusloom.plans.storage import cut_lineage, drop

STATES = 4
NOTHING, SYSTEM, USER, ASSISTANT = range(STATES)
#: Where an initial leads from a state, and where a conversation may end.
NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (NOTHING, ASSISTANT)
#: Costs of the edits; CUT is added for a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Turns and characters of a segment; segments that are multiplied at a time.
SEGMENT, SEGMENT_CHARS, SPAN = 1024, 1 << 20, 16
LEGAL = ("su", "ua", "au")

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(STATES):
        row = [(k, a[i * STATES + k]) for k in range(STATES) if a[i * STATES + k] is not None]
        for j in range(STATES):
            sums = [(x[0] + y[0], x[1] + y[1]) for k, x in row if (y := b[k * STATES + j]) is not None]
            out.append(min(sums, default=None))
    return tuple(out)


def chain(matrices: list[Matrix]) -> Matrix:
    """The product of all, as a tree."""
    while len(matrices) > 1:
        matrices = [product(*pair) if len(pair) == 2 else pair[0] for pair in (matrices[i : i + 2] for i in range(0, len(matrices), 2))]
    return matrices[0]


def _matrix(steps: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(steps.get((i, j)) for i in range(STATES) for j in range(STATES))


IDENTITY = _matrix({(i, i): (0, "") for i in range(STATES)})


@lru_cache
def closure() -> Matrix:
    """Any number of insertions; more than one between two states is never cheaper than what two of them reach."""
    one = _matrix({(i, j): (INSERT, "I") for c in "ua" for i, j in NEXT[c].items()})
    upto = tuple(min(filter(None, pair), default=None) for pair in zip(IDENTITY, one))
    return chain([upto] * STATES)


@lru_cache
def turn(sort: str) -> Matrix:
    """A turn of this sort, and insertions after it. Sorts: D (blank or duplicate), or the initial (x: any other), a capital
    if the turn is truncated."""
    steps = {(i, i): (DELETE, "D") for i in range(STATES)}
    if sort != "D":
        more = CUT * sort.isupper()
        for c, cost, edit in ("u", REROLE + more, "R"), ("a", REROLE + more, "R"), (sort.lower(), KEEP + more, "K"):
            for i, j in NEXT.get(c, {}).items():
                steps[i, j] = min((cost, edit), steps.get((i, j), (cost, edit)))
    return product(_matrix(steps), closure())


@lru_cache(maxsize=4096)
def _several(sorts: str) -> Matrix:
    return chain([*map(turn, sorts)])


def turns(sorts: str) -> Matrix:
    """The product of a run of turns."""
    return chain([_several(sorts[i : i + 4]) for i in range(0, len(sorts), 4)]) if sorts else IDENTITY


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of the best way from nothing to an end; insertions before the first turn come first."""
    whole = product(closure(), matrix)
    return min(whole[NOTHING * STATES + j] for j in ENDS if whole[NOTHING * STATES + j] is not None)


def _flow(rows: Iterator[tuple[dict, int]], like: Callable[[], pa.Schema]) -> Iterator[pa.RecordBatch]:
    """The rows, which come with their sizes, in batches of a bounded size."""
    held, chars = [], 0
    for row, n in rows:
        held.append(row)
        chars += n
        if len(held) >= SEGMENT or chars > SEGMENT_CHARS:
            yield pa.RecordBatch.from_pylist(held, like())
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, like())


def _rows(batches, seen: list) -> Iterator[dict]:
    """The rows of all batches; seen: gets the type of conv_id."""
    for batch in batches:
        seen[:] = [batch.schema.field("conv_id").type]
        for part in range(0, batch.num_rows, SPAN):
            yield from batch.slice(part, SPAN).to_pylist()


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial, and fault: blank, duplicate, truncated or none; with _mark, _row, which order turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("_mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    # the first row of each role and text, without gathering them
    firsts = rows.groupBy(F.col("conv_id").alias("_c"), F.col("_mark").alias("_m")).agg(F.min(F.struct("turn", "_row")).alias("_first"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_mark") == F.col("_m")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("_row") != F.col("_first._row"), "duplicate").when(~last.rlike("^[.!?]"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "_mark", "_row")


def _sort(initial: Column, fault: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), "D").when(fault == "truncated", F.upper(known)).otherwise(known)


KEPT = ("turn", "role", "text", "initial", "fault", "sort")


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, part, no, and turn, role, text, initial, fault, sort as arrays: every conversation in pieces, ordered by part, no."""
    rows = ordered(conversations).withColumn("sort", _sort(F.col("initial"), F.col("fault")))
    schema = rows.select("conv_id").schema
    kind = schema["conv_id"].dataType.simpleString()
    dealt = rows.repartitionByRange("conv_id", "turn", "_mark", "_row").sortWithinPartitions("conv_id", "turn", "_mark", "_row").select("conv_id", *KEPT)
    fields = {"turn": pa.int64(), **dict.fromkeys(KEPT[1:], pa.string())}

    def cut(batches):
        part, id_type = TaskContext.get().partitionId(), None

        def pieces():
            nonlocal id_type
            number, held, whose, chars = 1, [], None, 0
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                ids, columns = batch.column("conv_id").to_pylist(), [batch.column(c).to_pylist() for c in KEPT]
                for conv_id, *row in zip(ids, *columns):
                    n = len(row[1]) + len(row[2])
                    if held and (conv_id != whose or len(held) >= SEGMENT or chars + n > SEGMENT_CHARS):
                        yield {"conv_id": whose, "part": part, "no": number} | dict(zip(KEPT, zip(*held))), chars
                        number, held, chars = number + 1, [], 0
                    whose, chars = conv_id, chars + n
                    held.append(row)
            if held:
                yield {"conv_id": whose, "part": part, "no": number} | dict(zip(KEPT, zip(*held))), chars

        yield from _flow(pieces(), lambda: pa.schema([("conv_id", id_type), ("part", pa.int32()), ("no", pa.int64()), *((c, pa.list_(fields[c])) for c in KEPT)]))

    arrays = "turn array<long>, " + ", ".join(f"{c} array<string>" for c in KEPT[1:])
    return cut_lineage(dealt.mapInArrow(tidied(cut), f"conv_id {kind}, part int, no long, {arrays}"))


#: What is known of a run of turns, besides its matrix (costs, audits): its pieces with their numbers of turns, its ends.
SUMMARY = "pieces array<struct<seg: long, turns: int>>, first_role string, last_role string, illegal long, first_turn long, last_turn long, known_turns long, costs array<int>, audits array<string>"
NAMES = [x.split()[0] for x in re.sub(r"<.*?>+", "", SUMMARY).split(", ")]


def _joined(a: dict, b: dict) -> dict:
    """The summary of two neighbouring runs."""
    return {
        "pieces": a["pieces"] + b["pieces"],
        "first_role": a["first_role"],
        "last_role": b["last_role"],
        "illegal": a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"] not in LEGAL),
        "first_turn": b["first_turn"] if a["first_turn"] is None else a["first_turn"],
        "last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"],
        "known_turns": a["known_turns"] + b["known_turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"]),
    } | _cells(product(_elements(a), _elements(b)))


def _cells(matrix: Matrix) -> dict:
    return {"costs": [None if x is None else x[0] for x in matrix], "audits": [None if x is None else x[1] for x in matrix]}


def _elements(row: dict) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))


def _summary(seg: int, turn: list, initial: list, sort: list) -> dict:
    known = [t for t in turn if t is not None]
    return {
        "pieces": [{"seg": seg, "turns": len(sort)}],
        "first_role": initial[0],
        "last_role": initial[-1],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initial, initial[1:])),
        "first_turn": known[0] if known else None,
        "last_turn": known[-1] if known else None,
        "known_turns": len(set(known)),
    } | _cells(turns("".join(sort)))


def _schema(conv_id: pa.DataType) -> pa.Schema:
    piece = pa.list_(pa.struct([("seg", pa.int64()), ("turns", pa.int32())]))
    kinds = [piece, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
    return pa.schema([("conv_id", conv_id), ("seg", pa.int64()), *zip(NAMES, kinds)])


def _summarised(batches) -> Iterator[pa.RecordBatch]:
    seen: list = []
    rows = ({"conv_id": r["conv_id"], "seg": r["seg"]} | _summary(r["seg"], r["turn"], r["initial"], r["sort"]) for r in _rows(batches, seen))
    yield from _flow(((r, STATES * STATES * r["pieces"][0]["turns"]) for r in rows), lambda: _schema(seen[0]))


def _multiplied(batches) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation and one seg, that follow one another, made one."""
    seen: list = []

    def runs():
        for (conv_id, seg), group in groupby(_rows(batches, seen), key=lambda r: (r["conv_id"], r["seg"])):
            held = list(group)
            while len(held) > 1:
                held = [_joined(*pair) if len(pair) == 2 else pair[0] for pair in (held[i : i + 2] for i in range(0, len(held), 2))]
            yield {"conv_id": conv_id, "seg": seg} | {c: held[0][c] for c in NAMES}, sum(len(a or "") for a in held[0]["audits"])

    yield from _flow(runs(), lambda: _schema(seen[0]))


def scanned(pieces: DataFrame) -> DataFrame:
    """One row of conv_id and SUMMARY for every conversation; pieces: as `segments` gives them, with seg."""
    kind = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, seg long, {SUMMARY}"
    runs = cut_lineage(pieces.select("conv_id", "seg", "turn", "initial", "sort").mapInArrow(tidied(_summarised), kind))
    count = runs.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_n"), F.max("seg").alias("_last")).where("_n > 1")
    several = cut_lineage(runs.join(count, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c"))
    single = runs.join(count, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    last = several.agg(F.max("_last")).first()[0]
    several, width = several.drop("_n", "_last"), 1
    while last is not None and width <= last:
        width *= SPAN
        # neighbours go to one task, sorted; an order by place keeps a long conversation's runs in many
        placed = several.withColumn("_at", F.col("seg")).withColumn("seg", F.expr(f"seg div {SPAN}"))
        dealt = placed.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "_at").drop("_at")
        step = cut_lineage(dealt.mapInArrow(tidied(_multiplied), kind))
        drop(several)
        several = step
    return cut_lineage(single.unionByName(several).drop("seg"))


def _best(batches) -> Iterator[pa.RecordBatch]:
    seen: list = []

    def rows():
        for r in _rows(batches, seen):
            cost, audit = cheapest(_elements(r))
            yield {c: v for c, v in r.items() if c not in ("costs", "audits")} | {"cost": cost, "audit": audit}, len(audit)

    yield from _flow(rows(), lambda: pa.schema([("conv_id", seen[0]), *list(_schema(seen[0]))[2:-2], ("cost", pa.int64()), ("audit", pa.string())]))


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, cut for its pieces, with the number of repaired turns before each and in all."""
    seen: list = []

    def shares():
        for row in _rows(batches, seen):
            audit, start, before = row["audit"], 0, 0
            total = len(audit) - audit.count("D")
            for i, piece in enumerate(row["pieces"], 1):
                end, left = start, piece["turns"]
                while left:
                    left -= audit[end] != "I"
                    end += 1
                if i == len(row["pieces"]):
                    end = len(audit)
                yield {"conv_id": row["conv_id"], "seg": piece["seg"], "audit": audit[start:end], "before": before, "total": total}, end - start
                before += end - start - audit.count("D", start, end)
                start = end

    yield from _flow(shares(), lambda: pa.schema([("conv_id", seen[0]), ("seg", pa.int64()), ("audit", pa.string()), ("before", pa.int64()), ("total", pa.int64())]))


def _repaired(batches) -> Iterator[pa.RecordBatch]:
    """The turns that a piece gives, numbered in the conversation from 0, each with its edit."""
    seen: list = []

    def given():
        for row in _rows(batches, seen):
            at, position = 0, row["before"]
            for edit in row["audit"]:
                if edit != "D":
                    # an odd number of turns begins with the system's
                    other = "assistant" if (position - row["total"]) % 2 else "user"
                    old = {"turn": None, "role": other, "text": ""} if edit == "I" else {"turn": row["turn"][at], "role": row["role"][at] if edit == "K" else other, "text": row["text"][at]}
                    yield {"conv_id": row["conv_id"], "position": position, **old, "edit": edit}, len(old["text"])
                    position += 1
                at += edit != "I"

    yield from _flow(given(), lambda: pa.schema([("conv_id", seen[0]), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conv_id, turn, role, text: the report of every conversation and the turns of the repaired ones.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv_id, position, turn (null:
    inserted), role, text, edit (K, R or I)."""
    cut = segments(conversations)
    most = cut.agg(F.max("no")).first()[0] or 0
    pieces = cut.withColumn("seg", F.col("part").cast("long") * (most + 1) + F.col("no"))
    whole = scanned(pieces)
    kind = whole.schema["conv_id"].dataType.simpleString()
    best = cut_lineage(whole.mapInArrow(tidied(_best), f"conv_id {kind}, {SUMMARY.split(', costs')[0]}, cost long, audit string"))
    faults = cut.select("conv_id", F.explode("fault").alias("fault")).groupBy(F.col("conv_id").alias("_c")).agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("known_turns"), F.lit(0)).alias("gaps")
    report = best.join(faults, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    shares = best.select("conv_id", "pieces", "audit").mapInArrow(tidied(_slices), f"conv_id {kind}, seg long, audit string, before long, total long")
    shares = shares.withColumnsRenamed({"conv_id": "_c", "seg": "_s"})
    placed = pieces.join(shares, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_s"))).select("conv_id", "turn", "role", "text", "audit", "before", "total")
    return report, placed.mapInArrow(tidied(_repaired), f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of the turns as `role:text`, joined by line feeds, of every conversation in turns.

    A digest is made from the first byte to the last, so a conversation passes through one task, but as a stream of pieces;
    only this summary of the repaired turns has that bound."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def pack(batches):
        seen: list = []

        def pieces():
            held, chars = [], 0
            for row in _rows(batches, seen):
                if held and (row["conv_id"] != held[0]["conv_id"] or row["position"] != held[-1]["position"] + 1 or chars > SEGMENT_CHARS):
                    yield {"conv_id": held[0]["conv_id"], "position": held[0]["position"], "piece": "\n".join(f"{r['role']}:{r['text']}" for r in held)}, chars
                    held, chars = [], 0
                held.append(row)
                chars += len(row["text"])
            if held:
                yield {"conv_id": held[0]["conv_id"], "position": held[0]["position"], "piece": "\n".join(f"{r['role']}:{r['text']}" for r in held)}, chars

        yield from _flow(pieces(), lambda: pa.schema([("conv_id", seen[0]), ("position", pa.int64()), ("piece", pa.string())]))

    def digest(batches):
        seen: list = []

        def sums():
            for conv_id, pieces in groupby(_rows(batches, seen), key=lambda r: r["conv_id"]):
                h = hashlib.sha256()
                for i, r in enumerate(pieces):
                    h.update((("\n" if i else "") + r["piece"]).encode())
                yield {"conv_id": conv_id, "sha256": h.hexdigest()}, 64

        yield from _flow(sums(), lambda: pa.schema([("conv_id", seen[0]), ("sha256", pa.string())]))

    packed = turns.select("conv_id", "position", "role", "text").mapInArrow(tidied(pack), f"conv_id {kind}, position long, piece string")
    return packed.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(tidied(digest), f"conv_id {kind}, sha256 string")
