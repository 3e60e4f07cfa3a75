"""Byte-level BPE: ranked merges folded over the byte strings of distinct words.

A byte string holds one character per byte (ISO-8859-1), so that string functions work on bytes. The ranks are a
literal in the plan: an array of small maps, addressed by a checksum of the piece. Spark's higher-order functions fold
the merges over the corpus' most frequent distinct words, a table of bounded size. `encode` looks a document's words
up in that table, in Arrow batches, and folds further words where they stand, each distinct one once per task as far
as memory for it is bounded; `encode_native` does the same with higher-order functions alone, at several times the
cost. Decoding concatenates the pieces' bytes.

Null and empty texts have no tokens; their digests are those of no bytes. Repeated rows are encoded alike; an empty
table gives no rows; other columns are carried by `keep` only. A word of any length is encoded whole.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import passes, tidied, utf8
from corpusloom.plans.storage import cut_lineage, drop

#: What the pattern's \s means: Unicode's White_Space.
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
RANK_BUCKETS = 1 << 13
#: Distinct words that are encoded once and shipped with the plan, and the bytes that such a word has at most.
FREQUENT, FREQUENT_BYTES = 131_072, 48
#: Places in that table from which on they're filled with a part of the next less frequent words.
FILL = 1000
WORD_BUCKETS = 1 << 16
#: From so many bytes on, all occurrences of the lowest pair are merged in one step.
LONG = 384


def java_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out, as Java's are ASCII only."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> tuple[str, ...]:
    """Tokens as byte strings, by rank, of a vocabulary file on the driver's disk."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token).decode("latin-1") for token, rank in (line.split() for line in f if line.strip())}
    return tuple(found[i] for i in range(len(found)))


def _buckets(entries: dict[str, object], n: int) -> str:
    held: list[dict] = [{} for _ in range(n)]
    for k, v in entries.items():
        held[zlib.crc32(k.encode()) & (n - 1)][k] = v
    return json.dumps(held, ensure_ascii=False, separators=(",", ":"))


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    return _buckets({t: i for i, t in enumerate(read_ranks(path))}, RANK_BUCKETS)


def _lookup(buckets: Column, n: int, key: Column) -> Column:
    return F.get(buckets, F.crc32(key.cast("binary")).bitwiseAND(F.lit(n - 1)).cast("int"))[key]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def byte_string(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _fold(word: Column, rank) -> Column:
    """The pieces that are left of a byte string when no adjacent pair has a rank. rank: of a byte string or null."""
    none = F.array().cast("array<int>")

    def start(pieces):
        return F.struct(pieces.alias("p"), F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda k: rank(F.concat(F.get(pieces, k), F.get(pieces, k + 1)))).alias("r"))

    def one(acc, _):
        """The leftmost pair of the lowest rank is merged, and its two neighbours' ranks are looked up."""
        p, r = acc["p"], acc["r"]

        def merged(m):
            def at(i):
                new = F.concat(F.get(p, i - 1), F.get(p, i))
                left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(none)
                right = F.when(i + 1 < F.size(p), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(none)
                rest = F.greatest(F.lit(0), F.size(r) - i - 1)
                return F.struct(
                    F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, F.greatest(F.lit(0), F.size(p) - i - 1))).alias("p"),
                    F.concat(F.slice(r, 1, F.greatest(F.lit(0), i - 2)), left, right, F.slice(r, i + 2, rest)).alias("r"),
                )

            return F.when(m.isNull(), F.struct(p.alias("p"), none.alias("r"))).otherwise(let(F.array_position(r, m).cast("int"), at))

        return F.when(F.size(r) == 0, acc).otherwise(let(F.array_min(r), merged))

    def all_(acc, _):
        """Every pair of the lowest rank is merged, from the left."""
        p, r = acc["p"], acc["r"]

        def merged(m):
            marks = F.split(F.regexp_replace(F.array_join(F.transform(r, lambda x: F.when(x == m, F.lit("1")).otherwise(F.lit("0"))), ""), "11", "10"), "")
            pieces = let(marks, lambda s: F.filter(F.transform(p, lambda x, k: F.when(F.get(s, k) == "1", F.concat(x, F.get(p, k + 1))).when(F.get(s, k - 1) == "1", F.lit(None)).otherwise(x)), lambda x: x.isNotNull()))
            again = let(pieces, lambda q: F.when(F.size(q) > 1, start(q)).otherwise(F.struct(q.alias("p"), none.alias("r"))))
            return F.when(m.isNull(), F.struct(p.alias("p"), none.alias("r"))).otherwise(again)

        return F.when(F.size(r) == 0, acc).otherwise(let(F.array_min(r), merged))

    n = F.length(word)
    steps = F.sequence(F.lit(1), n - 1)
    split = lambda w: F.split(w, "")
    return (
        F.when(n < 2, F.array(word))
        .when(n < LONG, let(split(word), lambda p: F.aggregate(steps, start(p), one, lambda acc: acc["p"])))
        .otherwise(let(split(word), lambda p: F.aggregate(steps, start(p), all_, lambda acc: acc["p"])))
    )


def word_ids(word: Column, ranks: Column) -> Column:
    """Ids of one word, a byte string: itself if it has a rank, or else what the fold leaves."""
    rank = lambda piece: _lookup(ranks, RANK_BUCKETS, piece)
    return let(rank(word), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(F.transform(_fold(word, rank), rank)))


def ranks_literal(path: str) -> Column:
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def frequent_words(docs: DataFrame, path: str, pattern: str, most: int = FREQUENT) -> pa.Table:
    """w and ids of the corpus' most frequent words: counted over all documents, each distinct word folded once.

    Words are taken by their counts' sixteenth powers of two, from the top down, as far as all words of a level fit into
    `most`; of the next level as many as there's room for. So words of at most FREQUENT_BYTES bytes and no more than `most` come to the driver, however large the corpus."""
    words = docs.select(F.explode(words_of(F.col("text"), pattern)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.octet_length("w") <= FREQUENT_BYTES)
    counted = cut_lineage(words.withColumn("level", F.floor(16 * F.log2("n"))))
    least, held, part = 1 << 62, 0, F.lit(False)
    for level, n in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        if held + n > most:
            if most - held >= FILL:  # places are left for a part of the level, drawn by a digest
                part = (F.col("level") == level) & (F.pmod(F.xxhash64("w"), F.lit(1 << 20)) < int(0.95 * (most - held) / n * (1 << 20)))
            break
        held += n
        least = level
    top = counted.where((F.col("level") >= least) | part).select(byte_string(F.col("w")).alias("w")).repartition(max(8, most // 4096))
    top = cut_lineage(top)  # the ranks are megabytes in each description of a plan; one without a shuffle is described once
    found = top.select("w", let(ranks_literal(path), lambda ranks: word_ids(F.col("w"), ranks)).alias("ids")).toArrow()
    drop(counted, top)
    return found


def encode_native(docs: DataFrame, path: str, pattern: str, *keep: str, text: str = "text", most: int = FREQUENT) -> DataFrame:
    """The columns named by keep and ids, array<int>, for every row, by higher-order functions alone."""
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = frequent_words(rows, path, pattern, most)
    known = dict(zip(found.column("w").to_pylist(), found.column("ids").to_pylist()))
    table = F.from_json(F.lit(_buckets(known, WORD_BUCKETS)), "array<map<string,array<int>>>")
    one = lambda ranks, table: lambda w: let(byte_string(w), lambda b: F.coalesce(_lookup(table, WORD_BUCKETS, b), word_ids(b, ranks)))
    words = words_of(F.col("text"), pattern)
    ids = let(table, lambda t: let(ranks_literal(path), lambda ranks: F.flatten(F.transform(words, one(ranks, t)))))
    return rows.select(*keep, ids.alias("ids"))


def _strings(values) -> Column:
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), "array<string>")


def decode_native(ids: Column, path: str) -> Column:
    """The bytes that the ids stand for: their pieces' bytes, joined."""
    return let(_strings(read_ranks(path)), lambda pieces: F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1"))


def packed_native(ids: Column, path: str) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""
    four = (i.to_bytes(4, "little").decode("latin-1") for i in range(len(read_ranks(path))))
    return let(_strings(four), lambda b: F.encode(F.array_join(F.transform(ids, lambda i: F.get(b, i)), ""), "ISO-8859-1"))


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: while a pair of neighbours has a rank, the leftmost one of the lowest rank is merged.

    A heap orders the pairs, so long words take n log n steps; pairs that have changed meanwhile are passed over."""
    own = ranks.get(word)
    if own is not None:
        return [own]
    if len(word) < 48:
        pieces = [word[i : i + 1] for i in range(len(word))]
        scores = [ranks.get(pieces[i] + pieces[i + 1], NONE) for i in range(len(pieces) - 1)]
        while scores:
            low = min(scores)
            if low == NONE:
                break
            i = scores.index(low)
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get(pieces[i - 1] + pieces[i], NONE)
            if i < len(scores):
                scores[i] = ranks.get(pieces[i] + pieces[i + 1], NONE)
        return [ranks[p] for p in pieces]
    n = len(word)
    end, before, after, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], after[i], live[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if live[i]]


NONE = 1 << 62


class Words(dict):
    """Packed ids by word. Words beyond the table are folded, and kept while there's room."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int], room: int = 200_000):
        super().__init__(known)
        self.ranks, self.most = ranks, len(known) + room

    def __missing__(self, word: str) -> bytes:
        ids = np.array(fold(word.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(self) < self.most and len(word) <= FREQUENT_BYTES:
            self[word] = ids
        return ids


def _packed(found: pa.Table) -> tuple[bytes, bytes, bytes]:
    """The words' byte strings joined by a character that is no byte, their ids, and how many ids each has: compact to send."""
    ids = found.column("ids").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = np.asarray(ids.flatten()).astype("<u4").tobytes()
    return "\u0100".join(found.column("w").to_pylist()).encode(), flat, np.diff(np.asarray(ids.offsets)).astype("<u4").tobytes() if len(ids) else b""


def _unpacked(table: tuple[bytes, bytes, bytes]) -> dict[str, bytes]:
    words, flat, sizes = table
    ends = (4 * np.cumsum(np.frombuffer(sizes, "<u4"))).tolist()
    held = words.decode().split("\u0100") if ends else []
    return {w.encode("latin-1").decode(): flat[a:b] for w, a, b in zip(held, [0, *ends], ends)}


def encode(docs: DataFrame, path: str, pattern: str, *keep: str, text: str = "text", most: int = FREQUENT, decoded: str | None = None) -> DataFrame:
    """The columns named by keep and ids, binary: each id as a little-endian unsigned 32-bit integer.

    decoded names a further column for what the ids decode to, made in the same tasks."""
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tokens = [t.encode("latin-1") for t in read_ranks(path)]
    shared = docs.sparkSession.sparkContext.broadcast((_packed(frequent_words(rows, path, pattern, most)), tokens))  # FREQUENT and the vocabulary bound it
    split = python_pattern(pattern)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        table, tokens = shared.value
        words, find, pieces = Words(_unpacked(table), {t: i for i, t in enumerate(tokens)}), regex.compile(split).findall, Pieces(tokens)
        for batch in batches:
            for part in passes(batch):
                ids = pa.array([b"".join(map(words.__getitem__, find(x))) for x in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                also = [pieces.joined(ids)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, *also], [*part.schema.names[:-1], "ids", *[decoded] * len(also)])

    return rows.mapInArrow(tidied(run), f"{kinds + ', ' if kinds else ''}ids binary" + (f", `{decoded}` binary" if decoded else ""))


def python_pattern(pattern: str) -> str:
    return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", java_pattern(pattern))


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows and the bytes that their ids stand for: the pieces' bytes, joined."""
    tokens = [t.encode("latin-1") for t in read_ranks(path)]
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        pieces = Pieces(shared.value)
        for batch in batches:
            for part in passes(batch, ids):
                yield pa.RecordBatch.from_arrays([*part.columns, pieces.joined(part.column(part.schema.get_field_index(ids)))], [*part.schema.names, to])

    return rows.mapInArrow(tidied(run), f"{kinds}, `{to}` binary")


class Pieces:
    """The vocabulary's bytes in one array."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: pa.Array) -> pa.Array:
        """The bytes of each row's packed ids."""
        data, offsets = utf8(ids)
        which = np.frombuffer(data.tobytes(), "<u4")
        n = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(self.starts[which] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[offsets // 4].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(out.tobytes())]).cast(pa.binary())
