"""Spelling variants by wildcard groups: words one edit apart, without a list of pairs.

A word of n code points stands in n groups, each named by a position and the word's prefix and suffix around it. Words in
one group differ by one replaced code point, and two words share one group at most, so that a group's size and its two
most frequent words tell every member how many such neighbours it has and which is best. For inserted and deleted code points, every
distinct string that a deletion leaves meets the vocabulary in one group: the whole word there learns the number and the
best of the longer words, each of these the whole word. Prefixes and suffixes are polynomial hashes of 124 bits, so a word costs time
in proportion to its length. A group holds at most as many words as there are letters for each place.

Null and empty texts have no words; a null doc_id counts as the empty string in `damaged` runs; repeated rows are
occurrences of their own; ties of frequency go to the smaller word in code-point order; texts are read in slices, so they
may have any length, and so may words; an empty table gives an empty result; other columns don't disturb.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import tidied
from corpusloom.plans.storage import cut_lineage, drop

#: Fewest code points and occurrences of a word; how many times as frequent a word's form must be.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: Runs of letters, in texts whose A-Z are lower-case already.
LETTER = "[a-zÀ-ÿ]"
#: Code points of a text that are cut into words at a time; words that a task counts before it passes them on.
SLICE, HELD = 1 << 20, 1 << 17
#: Moduli and bases of the hashes.
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = (1103515245, 1664525013, 22695477, 1566083941)
KEYS = "size int, place int, one long, two long, whole boolean, word_id long"


def _slices(text: str) -> Iterator[str]:
    """The text in pieces that end where no word goes on."""
    rest, start = re.compile(f"{LETTER}*"), 0
    while start < len(text):
        end = rest.match(text, min(len(text), start + SLICE)).end()
        yield text[start:end]
        start = end


def damaged(word: str, doc_crc: int, every: int) -> str:
    """The word without one code point, for one in `every` pairs of document and word; doc_crc: checksum of `<doc_id>:`."""
    h = zlib.crc32(word.encode(), doc_crc)
    return word if h % every else word[: (i := h % len(word))] + word[i + 1 :]


def word_counts(docs: DataFrame, every: int | None = None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n of all words in doc_id, text; every: damages runs first, as `damaged` does."""
    runs = re.compile(f"{LETTER}{{{letters},}}")

    def count(batches):
        held: Counter[str] = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in _slices((text.as_py() or "").encode().lower().decode()):
                    for run, n in Counter(runs.findall(part)).items():
                        word = damaged(run, crc, every) if every else run
                        if len(word) >= letters:
                            held[word] += n
                    if len(held) > HELD:
                        yield flushed()
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _powers(n: int) -> np.ndarray:
    """For each modulus, its base's powers 0 to n - 1."""
    out = np.ones((len(_PRIMES), n), np.uint64)
    for row, base, p in zip(out, _BASES, _PRIMES.tolist()):
        done = 1
        while done < n:
            more = min(done, n - done)
            row[done : done + more] = row[:more] * np.uint64(pow(base, done, p)) % np.uint64(p)
            done += more
    return out


def _packed(values: np.ndarray) -> list[np.ndarray]:
    """Four residues of 31 bits as two longs."""
    return [((values[k] << np.uint64(31)) | values[k + 1]).astype(np.int64) for k in (0, 2)]


def _keys(letters: int):
    """Group keys of every word: one for each place, one for each string that a deletion leaves, one for the whole word."""
    inverse = np.array([pow(b, -1, int(p)) for b, p in zip(_BASES, _PRIMES)], np.uint64)[:, None]
    modulus = _PRIMES[:, None]

    def keyed(words: list[str], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(len(code)) - np.repeat(start[:-1], size)
        terms = (code + np.uint64(1)) * _powers(int(size.max()))[:, at] % modulus
        sums = np.concatenate([np.zeros((len(_PRIMES), 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)
        prefix = (sums[:, :-1] - np.repeat(sums[:, start[:-1]], size, axis=1)) % modulus
        suffix = (np.repeat(sums[:, start[1:]], size, axis=1) - sums[:, 1:]) % modulus
        long, word_id = np.repeat(size, size), np.repeat(ids, size)
        other = np.ones(len(code), bool)
        other[1:] = code[1:] != code[:-1]
        kept = np.flatnonzero((other | (at == 0)) & (long > letters))  # deleting either of two equal neighbours leaves the same
        cut = ((prefix + suffix * inverse % modulus) % modulus)[:, kept]
        whole = (sums[:, start[1:]] - sums[:, start[:-1]]) % modulus
        groups = [
            (long, at, (prefix + suffix) % modulus, False, word_id),
            (long[kept] - 1, np.full(len(kept), -1), cut, False, word_id[kept]),
            (size, np.full(len(size), -1), whole, True, ids),
        ]
        for length, place, hashes, is_whole, whose in groups:
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(place, pa.int32()), *map(pa.array, _packed(hashes)), pa.array(np.full(len(whose), is_whole)), pa.array(whose, pa.int64())], ["size", "place", "one", "two", "whole", "word_id"])

    def run(batches):
        for batch in batches:
            words, ids, n, start = batch.column("word").to_pylist(), np.asarray(batch.column("word_id")), 0, 0
            for end, w in enumerate(words, 1):
                n += len(w)
                if n > 1 << 16 or end == len(words):
                    yield from keyed(words[start:end], ids[start:end])
                    n, start = 0, end

    return run


def neighbours(vocabulary: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word_id, n_near and best (the smallest id among them) of every word that has near words; vocabulary: word, word_id."""
    keys = vocabulary.select("word", "word_id").mapInArrow(tidied(_keys(letters)), KEYS)
    group = Window.partitionBy("size", "place", "one", "two")
    ordered = group.orderBy("word_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    members, first, second = F.count("*").over(group), F.min("word_id").over(group), F.nth_value("word_id", 2).over(ordered)
    longer = F.when(~F.col("whole"), F.col("word_id"))
    whole, cuts, best_cut = F.max(F.when(F.col("whole"), F.col("word_id"))).over(group), F.count(longer).over(group), F.min(longer).over(group)
    told = keys.select(
        "word_id",
        F.when(F.col("place") >= 0, members - 1).when(F.col("whole"), cuts).otherwise(F.when(whole.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("place") >= 0, F.when(F.col("word_id") == first, second).otherwise(first)).when(F.col("whole"), best_cut).otherwise(whole).alias("best"),
    )
    return told.where("near > 0").groupBy("word_id").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word_id and root, the last of its forms; forms: word_id, form, of the words that have one. Doubles its steps by joins."""
    found = cut_lineage(forms.select("word_id", F.col("form").alias("root")))
    while True:
        after = found.select(F.col("word_id").alias("_at"), F.col("root").alias("_next"))
        step = cut_lineage(found.join(after, F.col("root") == F.col("_at"), "left").select("word_id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        drop(found)
        found = step
        if not found.where("moved").limit(1).count():
            return found.select("word_id", "root")


def variants(counts: DataFrame, letters: int = LETTERS, ratio: float = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n (its most frequent near word, if at least `ratio` times as frequent), root (the last of
    its forms) for all rows of word, n."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    # ids go up in the order of preference, so that the best word is the smallest id
    vocabulary = cut_lineage(counts.orderBy(F.desc("n"), "word").withColumn("word_id", F.monotonically_increasing_id()))
    near = neighbours(vocabulary, letters)
    other = vocabulary.select(F.col("word_id").alias("_id"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    met = near.join(other, F.col("best") == F.col("_id")).select("word_id", "n_near", F.col("best").alias("_best"), "_word", "_n")
    frequent = F.col("_n") >= ratio * F.col("n")
    linked = vocabulary.join(met, "word_id", "left").select(
        "word_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("_best")).alias("form_id"), F.when(frequent, F.col("_word")).alias("form"), F.when(frequent, F.col("_n")).alias("form_n")
    )
    linked = cut_lineage(linked)
    last = roots(linked.where("form_id IS NOT NULL").select("word_id", F.col("form_id").alias("form")))
    named = last.join(other.drop("_n"), F.col("root") == F.col("_id")).select("word_id", F.col("_word").alias("_root"))
    return linked.join(named, "word_id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root"))
