"""Checks of translations: scores, choice of attempts, gates, glossaries, review records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.metrics import bleu_column, chrf_column
from corpusloom.functions.text import clamp, is_blank, length_ratio, number_tokens, numbers_kept, repetition_ratio, windows
from corpusloom.operators.rows import arrow

# Penalties and bounds of the heuristic, weights of the scores.
LENGTH = (0.35, 3.0)
COPY, REPEAT = 0.85, 0.35
WEIGHTS = {"heuristic": 0.5, "comet": 0.5, "chrf": 0.3, "bleu": 0.1}
THRESHOLD = 0.72
#: Why a document that passes by rules alone is reviewed.
UNESTIMATED = "quality was not estimated by a model: human review required"


def copy_ratio(source: Column, candidate: Column, least: float = 0.0) -> Column:
    """How much of the source the candidate copies, without regard to case: the share of both that is in matching blocks.

    0 where lengths or the characters in common tell already that it's not above `least`, which takes linear time; only
    other pairs are compared block by block. With `least` 0 it's always the exact ratio."""

    def ratio(a, b):
        a, b = a.casefold(), (b or "").casefold()
        whole = len(a) + len(b)
        if a == b:
            return 1.0
        if 2 * min(len(a), len(b)) <= least * whole or 2 * (Counter(a) & Counter(b)).total() <= least * whole:
            return 0.0
        return SequenceMatcher(None, a, b).ratio()

    return arrow(ratio, "double")(source, candidate)


def missing_terms(source: Column, candidate: Column, glossary: Column) -> Column:
    """Targets of glossary terms that the source has and the candidate lacks."""
    entries = F.filter(F.map_entries(glossary), lambda e: F.contains(F.lower(source), F.lower(e["key"])) & ~F.contains(F.lower(candidate), F.lower(e["value"])))
    return F.transform(entries, lambda e: e["value"])


def heuristic(source: Column, candidate: Column, missing: Column, inherited: Column, copied: Column | None = None) -> Column:
    """score and issues. 0 for an empty candidate; each finding costs its penalty. `copied` is the copy ratio, if known."""
    ratio, repeat = length_ratio(source, candidate), repetition_ratio(candidate)
    odd = (ratio < LENGTH[0]) | (ratio > LENGTH[1])
    kept = numbers_kept(number_tokens(source), number_tokens(candidate))
    same = F.lit(False) if copied is None else (copied > COPY) & (F.lower(source) != F.lower(candidate))
    cost = (
        F.when(odd, 0.25).otherwise(0.0)
        + F.when(same, 0.15).otherwise(0.0)
        + F.when(repeat > REPEAT, 0.15).otherwise(0.0)
        + F.when(~kept, 0.6).otherwise(0.0)
        + F.least(F.lit(0.5), 0.15 * F.size(missing))
        + F.least(F.lit(0.5), 0.15 * F.size(inherited))
    )
    found = F.array_compact(F.array(F.when(odd, F.format_string("suspicious length ratio: %.2f", ratio)), F.when(same, F.lit("source-copy ratio too high")), F.when(repeat > REPEAT, F.lit("repeated phrase ratio too high")), F.when(~kept, F.lit("number mismatch"))))
    issues = F.array_distinct(F.concat(inherited, found, F.transform(missing, lambda t: F.concat(F.lit("missing glossary term: "), t))))
    empty = is_blank(candidate)
    return F.struct(F.when(empty, 0.0).otherwise(clamp(1 - cost)).alias("score"), F.when(empty, F.array_distinct(F.concat(inherited, F.array(F.lit("empty translation"))))).otherwise(issues).alias("issues"))


def combined(**scores: Column) -> Column:
    """Weighted mean of the scores that are there."""
    total = weight = F.lit(0.0)
    for name, x in scores.items():
        total = total + F.coalesce(x * WEIGHTS[name], F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def scored(pairs: DataFrame, estimate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pairs (key, source, candidate, reference, heuristic) with chrf, bleu, comet and score, their weighted mean.

    estimate: a model's function from (key, source, candidate, reference) to (key, comet); without it comet is null, as
    chrf and bleu are without a reference."""
    rows = pairs.withColumn("chrf", chrf_column(F.col("candidate"), F.col("reference"))).withColumn("bleu", bleu_column(F.col("candidate"), F.col("reference")))
    if estimate is None:
        rows = rows.withColumn("comet", F.lit(None).cast("double"))
    else:
        told = estimate(pairs.select("key", "source", "candidate", "reference")).select("key", clamp(F.col("comet")).alias("comet"))
        rows = rows.join(told, "key", "left")
    return rows.withColumn("score", F.round(combined(**{c: F.col(c) for c in ("heuristic", "comet", "chrf", "bleu")}), 4))


def in_order(rows: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """doc, text and place: each document's different texts in the order of their first occurrence."""
    first = rows.groupBy(doc, text).agg(F.min(pos).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("_at", text))).drop("_at")


def best_attempts(attempts: DataFrame, *key: str) -> DataFrame:
    """The attempt that counts for each key, and how many were made up to the first that passed.

    attempts: key columns, attempt, score, passed. Later attempts than the first passing one were never made; it
    counts, or else the highest score, the earliest of equals."""
    w = Window.partitionBy(*key)
    made = attempts.withColumn("_first", F.min(F.when(F.col("passed"), F.col("attempt"))).over(w)).where(F.col("_first").isNull() | (F.col("attempt") <= F.col("_first")))
    numbered = made.withColumn("attempts", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("passed"), F.desc("score"), "attempt")))
    return numbered.where("_k = 1").drop("_k", "_first")


def gate(segments: DataFrame, documents: DataFrame, threshold: float = THRESHOLD, strict: bool = False, estimated: bool = True) -> DataFrame:
    """doc, score, passed, needs_review and issues: a document is as good as its own score and its segments' mean.

    segments: doc, pos, score, passed, issues. documents: doc, score, issues. A strict gate lets no document issue pass.
    Where no model estimated the quality, what passes is reviewed as well, and an issue says so."""
    parts = segments.groupBy("doc").agg(F.round(F.avg("score"), 4).alias("mean"), F.every("passed").alias("all_passed"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "issues"))), lambda x: x["issues"])).alias("found"))
    both = documents.join(parts, "doc").withColumn("total", F.round(F.least("score", "mean"), 4))
    passed = F.col("all_passed") & (F.col("total") >= threshold) & (F.lit(not strict) | (F.size("issues") == 0))
    alone = passed & F.lit(not estimated)
    issues = F.array_distinct(F.concat("found", "issues", F.when(alone, F.array(F.lit(UNESTIMATED))).otherwise(F.array().cast("array<string>"))))
    return both.select("doc", F.col("total").alias("score"), (passed & ~alone).alias("passed"), (~passed | alone).alias("needs_review"), issues.alias("issues"))


def carried_glossary(proposals: DataFrame) -> DataFrame:
    """The first definition of each term in a document, from chunks whose text has the term and whose draft the target.

    proposals: doc, pos, source_text, draft, term, target."""
    ok = proposals.where(F.contains("source_text", F.col("term")) & F.contains("draft", F.col("target")))
    return ok.groupBy("doc", "term").agg(F.min_by("target", "pos").alias("target"), F.min("pos").alias("since"))


def proposals(texts: DataFrame, terms: DataFrame, size: int = 6000) -> DataFrame:
    """doc, window and term where a window of the text literally has the term: terms that may be asked about.

    texts: doc, text. terms: doc, term (a model's answers)."""
    each = texts.select("doc", F.posexplode(windows(F.col("text"), size)).alias("window", "part"))
    return each.join(terms, "doc").where(F.contains("part", F.col("term"))).groupBy("doc", "term").agg(F.min("window").alias("window"))


def review_records(results: DataFrame) -> DataFrame:
    """Results that need review, with their status."""
    return results.where("needs_review").withColumn("status", F.lit("pending_human_review"))


def form_errors(forms: DataFrame) -> DataFrame:
    """id and errors of review forms: approval, unchanged source, languages, no empty or repeated glossary term.

    forms: id, approved, source_sha256, actual_sha256, source_language, target_language, wanted_source, wanted_target,
    glossary array<struct<source,target>>."""
    keys = F.transform("glossary", lambda g: F.lower(g["source"]))
    checks = [
        (~F.coalesce("approved", F.lit(False)), "form is not approved"),
        (~F.col("source_sha256").eqNullSafe(F.col("actual_sha256")), "source text has changed"),
        (~(F.col("source_language").eqNullSafe(F.col("wanted_source")) & F.col("target_language").eqNullSafe(F.col("wanted_target"))), "languages differ"),
        (F.exists("glossary", lambda g: is_blank(F.coalesce(g["source"], F.lit(""))) | is_blank(F.coalesce(g["target"], F.lit("")))), "glossary has empty entries"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "glossary has repeated terms"),
    ]
    return forms.select("id", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks])).alias("errors"))
