"""Language identification with bit-sliced Bloom filters over letter trigrams.

Learning counts the trigrams of every labelled document by language. A language holds a trigram that occurs in it often
enough and isn't merely stray there; none is left out for lack of room. All languages share one Bloom filter whose slots
are bit masks over the languages: one lookup returns all languages that hold a trigram. The filter has as many slots as
the fullest language needs for a wanted rate of false positives; where memory doesn't allow so many, the rate rises. A
text's per-language hit counts, corrected for the rate of false positives, decide.

A text that is null or has no letter is `und` with score 0. Without any labelled document everything is `und`; an empty table gives
no rows.
Ties go to the language that sorts first. Repeated rows get equal results, other columns are carried by `keep`. Texts
may be of any length. A document without an id counts as held out: nothing is learned from it.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, passes, tidied
from corpusloom.plans.storage import cut_lineage, drop

#: Memory that the filter may take, in bytes; and the wanted rate of false positives, while it takes less.
MOST_BYTES, FALSE_RATE = 64 << 20, 0.02
HASHES = 3
#: A trigram belongs to a language if it is at least so frequent there, as a share of its frequency where that is highest.
STRAY = 0.05
#: Occurrences in the labelled documents of a language that a trigram needs.
LEAST = 2
#: Score below which `accepted` turns a document away.
ACCEPT = 0.5

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams around every letter of each text's lower case (0: no letter), and where each text's begin."""
    lower = [(x or "").lower() for x in texts]
    points = np.frombuffer("".join(x + "\n" for x in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in lower), np.int64, len(lower)))
    isletter = letters()[points]
    code = np.where(isletter, points, 0).astype(np.uint64)
    before = np.zeros(len(code), np.uint64)
    before[1:] = code[:-1]
    after = np.zeros(len(code), np.uint64)
    after[:-1] = code[1:]
    at = np.flatnonzero(isletter)
    grams = (before[at] << np.uint64(42)) | (code[at] << np.uint64(21)) | after[at]
    return grams, np.searchsorted(at, np.concatenate([[0], ends]))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all labelled rows; each task sums its own rows first."""

    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for part in passes(batch):
                langs = np.asarray(part.column(1).to_pylist(), object)
                grams, first = trigrams(part.column(0).to_pylist())
                doc = np.repeat(np.arange(len(langs)), np.diff(first))
                for lang in set(langs):
                    own = grams[(langs == lang)[doc]]
                    if len(own):
                        parts = held.setdefault(lang, [])
                        parts.append(np.unique(own, return_counts=True))
                        if len(parts) >= 16:
                            held[lang] = [merged(parts)]
        for lang, parts in held.items():
            g, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    slots: np.ndarray  # [slots, words of 64 languages]
    false: np.ndarray  # rate of false positives by language

    def masks(self, grams: np.ndarray) -> np.ndarray:
        m = np.uint64(len(self.slots) - 1)
        found = self.slots[(mix(grams, 0) & m).astype(np.int64)]
        for k in range(1, HASHES):
            found = found & self.slots[(mix(grams, k) & m).astype(np.int64)]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, first = trigrams(texts)
        total = np.diff(first)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        masks = self.masks(grams)
        share = np.zeros((len(self.langs), len(texts)))
        for i in range(len(self.langs)):
            hits = np.concatenate([[0], np.cumsum((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
            found = hits[first[1:]] - hits[first[:-1]]
            share[i] = (found / np.maximum(total, 1) - self.false[i]) / max(1e-9, 1 - self.false[i])
        best = share.argmax(0)
        names = [self.langs[b] if n else "und" for b, n in zip(best, total)]
        return names, np.where(total > 0, np.clip(share.max(0), 0, 1), 0.0)


def slots_for(most: int, langs: int, rate: float = FALSE_RATE, room: int = MOST_BYTES) -> int:
    """Slots, a power of two, that hold `most` trigrams of a language with at most this rate of false positives, in as
    far as masks over so many languages leave room."""
    need = most * HASHES / -math.log(1 - rate ** (1 / HASHES))
    able = room // (8 * max(1, (langs + 63) // 64))
    return min(1 << max(10, math.ceil(math.log2(max(1.0, need)))), 1 << (able.bit_length() - 1))


def held_grams(labelled: DataFrame) -> DataFrame:
    """lang and gram: the trigrams that each language holds."""
    counts = gram_counts(labelled)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.where(F.col("n") >= LEAST).join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    return most.where(F.col("share") >= STRAY * F.col("most")).select("lang", "gram")


def _masks(batches):
    """The slots that each trigram sets, with the language's bit in the right one of its words."""
    for batch in batches:
        grams, which, n = (np.asarray(batch.column(i)) for i in range(3))
        for k in range(HASHES):
            slot = (mix(grams.view(np.uint64), k) & (n - 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(which // 64), pa.array((np.uint64(1) << (which % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "bit"])


def fit(labelled: DataFrame, rate: float = FALSE_RATE, room: int = MOST_BYTES) -> Model:
    """The model of rows with text and lang. Slots are filled by an aggregation and come to the driver packed, in parts:
    `room` bytes at most, besides one row for each language."""
    held = cut_lineage(held_grams(labelled))
    sizes = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    n, words = slots_for(max(sizes.values(), default=1), len(langs), rate, room), (len(langs) + 63) // 64 or 1
    slots = np.zeros((n, words), np.uint64)
    if langs:
        numbered = held.sparkSession.createDataFrame(list(enumerate(langs)), "which long, lang string")
        rows = held.join(F.broadcast(numbered), "lang").select("gram", "which", F.lit(n).cast("long").alias("n"))
        filled = rows.mapInArrow(tidied(_masks), "slot long, word long, bit long").groupBy("slot", "word").agg(F.bit_or("bit").alias("bits"))
        part = filled.groupBy((F.col("slot") / PART).cast("int").alias("part"), "word")
        packed = part.applyInArrow(tidied(_part), "part int, word long, bits binary").coalesce(-(-n // PART) * words)
        for r in packed.toLocalIterator():  # a job for each partition
            at = r["part"] * PART
            end = min(n, at + PART)
            slots[at:end, r["word"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint64)[: end - at]
    drop(held)
    full = [float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
    return Model(langs, slots, np.array([f**HASHES for f in full]))


#: Slots that come to the driver in one row.
PART = 1 << 16


def _part(key, table):
    bits = np.zeros(PART, np.uint64)
    bits[np.asarray(table.column("slot")) % PART] = np.asarray(table.column("bits")).view(np.uint64)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["part", "word", "bits"])


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns named by keep, lang_pred and score for every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_BYTES bounds it
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))  # a text that is kept is sent once
    at = rows.columns.index("text")
    out = [i for i, c in enumerate(rows.columns) if c in keep]

    def tag(batches):
        for batch in batches:
            for part in passes(batch):
                names, score = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in out), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*(part.schema.names[i] for i in out), "lang_pred", "score"])

    kinds = ", ".join(f"`{rows.schema[i].name}` {rows.schema[i].dataType.simpleString()}" for i in out)
    return rows.mapInArrow(tidied(tag), f"{kinds + ', ' if kinds else ''}lang_pred string, score double")


def accepted(tagged: DataFrame, least: float = ACCEPT) -> DataFrame:
    """Rows in a known language; those without letters, or unlike all languages learned, go."""
    return tagged.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
