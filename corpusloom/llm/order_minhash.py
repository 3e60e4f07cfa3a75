"""Order MinHash fingerprints: sketches of a text that follow its edit distance.

Every k-mer of code points is numbered by its occurrence in the text. Each of SKETCHES hash functions picks the TUPLE
numbered k-mers with the smallest values; these are put back into text order and hashed together. The share of equal
positions of two fingerprints is their likeness. A text shorter than k is one k-mer; null counts as the empty text;
equal texts have equal fingerprints, and two empty texts are alike with 1.

Of documents that share a doc_id, the one whose text sorts first comes first; a null doc_id sorts before all others.
The next document of the last one is the first one, so a single document is its own next. An empty table gives no rows. Texts may be of any length. Columns
beside doc_id and text don't disturb, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, passes, place, tidied, with_text

K, TUPLE, SKETCHES = 5, 2, 32
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes in a range of ids, where the session's number of shuffle partitions doesn't make ranges smaller; ranges at
#: most (larger ones are still streamed), and quantiles between which ranges are equally wide.
RANGE_BYTES, MOST_RANGES, QUANTILES = 64 << 20, 1 << 16, 1 << 10
#: Positions are kept in the low bits while k-mers are sorted; longer texts are numbered by a slower sort.
_BITS = np.uint64(24)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kmers(code: np.ndarray) -> np.ndarray:
    n = len(code) - K + 1
    wide = code.astype(np.uint64) + np.uint64(1)
    if n <= 0:
        out = np.uint64(len(code) + 1)
        for x in wide:
            out = out * _STEP + x
        return mix(np.array([out]), 9)
    out = wide[:n].copy()
    for j in range(1, K):
        out *= _STEP
        out += wide[j : j + n]
    return mix(out)


def _numbered(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the occurrence-numbered k-mers, and their positions."""
    n = len(kmers)
    if n < 1 << int(_BITS):
        low = np.uint64((1 << int(_BITS)) - 1)
        held = np.sort((kmers & ~low) | np.arange(n, dtype=np.uint64))
        value, at = held >> _BITS, (held & low).astype(np.int64)
    else:
        at = np.argsort(kmers >> _BITS, kind="stable")
        value = kmers[at] >> _BITS
    index = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = value[1:] != value[:-1]
    occurrence = index - np.maximum.accumulate(np.where(first, index, 0))
    return mix(value * np.uint64(0xD6E8FEB86659FD93) + occurrence.astype(np.uint64), 3), at


def fingerprint(code: np.ndarray) -> np.ndarray:
    """SKETCHES 32-bit values."""
    with np.errstate(over="ignore"):
        value, at = _numbered(_kmers(code))
        n, out = len(value), np.empty(SKETCHES, np.uint32)
        block = max(1, min(SKETCHES, (1 << 17) // n))
        near = np.uint64(min((1 << 64) - 1, (8 * TUPLE + 16) * ((1 << 64) // n)))
        for j in range(0, SKETCHES, block):
            scrambled = value[None, :] * _FACTORS[j : j + block, None]
            rows, cols = np.nonzero(scrambled <= near)
            if np.bincount(rows, minlength=len(scrambled)).min() < min(TUPLE, n):
                rows, cols = np.nonzero(np.ones_like(scrambled, bool))
            order = np.lexsort((scrambled[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            start = np.searchsorted(rows, np.arange(len(scrambled)))
            pick = cols[start[:, None] + np.arange(min(TUPLE, n))]
            pick = np.take_along_axis(pick, np.argsort(at[pick], axis=1), 1)
            held = np.arange(j, j + len(pick), dtype=np.uint64) * _STEP
            for c in range(pick.shape[1]):
                held = mix(held ^ value[pick[:, c]], c + 1)
            out[j : j + block] = (held >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def spelled(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited(code: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last half of the text's code points replaced by as many first ones of the following text."""
    half = len(code) // 2
    return np.concatenate([code[: len(code) - half], following[:half]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Ids are dealt into ranges, by quantiles of a bounded number and by equal widths between these; each range also gets
    the first document of the next one, so a task finds every document's next in its own order. Texts are shuffled once."""
    spark = docs.sparkSession
    rows = with_text(docs).withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    known = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if known["n"] is None:
        return spark.createDataFrame([], SCHEMA)
    n = min(MOST_RANGES, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known["n"] // RANGE_BYTES)))
    wide = min(n, QUANTILES)
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / wide for i in range(1, wide)], 100 * wide).alias("q")).first()["q"] or []))
    edges = [known["low"] or 0, *cuts, (known["high"] or 0) + 1]
    part = -(-n // len(edges[1:]))
    between = place(F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.col("_key"), len(edges) - 1)
    low, high = (F.get(F.array(*[F.lit(float(x)) for x in e]), between) for e in (edges[:-1], edges[1:]))
    inner = F.floor((F.col("_key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * part)
    dealt = rows.withColumn("_range", (between * part + F.greatest(F.lit(0), F.least(F.lit(part - 1), inner))).cast("int"))
    least = dealt.groupBy("_range").agg(F.min("_key").alias("_first"))
    # one row for each range: the range before it takes its first document, the last range that of the first one
    order = Window.orderBy("_range")
    seam = least.select(F.col("_range").alias("_of"), "_first", F.coalesce(F.lag("_range").over(order), F.max("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    firsts = dealt.join(F.broadcast(seam), (F.col("_range") == F.col("_of")) & (F.col("_key") == F.col("_first"))).groupBy("_to").agg(F.min(F.struct("_key", "text")).alias("_f"))
    halo = firsts.select(F.lit(None).cast("long").alias("doc_id"), F.col("_f.text").alias("text"), F.col("_f._key").alias("_key"), F.col("_to").alias("_range"), F.lit(True).alias("_halo"))
    both = dealt.withColumn("_halo", F.lit(False)).unionByName(halo)
    placed = both.repartitionById(part * (len(edges) - 1), F.col("_range")).sortWithinPartitions("_range", "_halo", "_key", "text").select("doc_id", "text", "_range", "_halo")
    return placed.mapInArrow(tidied(_walk), SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches):
    """Rows come in order; a row is finished once its next one is there."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    last, out = None, []
    for batch in batches:
        for part in passes(batch):
            for doc, text, where, halo in zip(*(c.to_pylist() for c in part.columns)):
                code = points(text)
                mark = fingerprint(code)
                if last is not None and last[0] == where:
                    _, id_, mine, own = last
                    other = edited(mine, code)
                    changed = fingerprint(other)
                    sha = hashlib.sha256(other.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((id_, len(mine), sha, spelled(own), spelled(changed), likeness(own, changed), likeness(own, mark)))
                last = None if halo else (where, doc, code, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], names)
                out = []
