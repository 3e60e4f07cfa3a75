"""Translation of whole texts: review forms before, segments with retries, and documents that pass or need review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import protect, segment
from corpusloom.plans import translation
from corpusloom.plans.settings import Translation
from corpusloom.plans.storage import cut_lineage

#: What a review form asks about style.
STYLE = ("register", "tone", "audience", "period", "notes")


def forms(texts: DataFrame, terms: DataFrame, questions: DataFrame, source: str, target: str) -> DataFrame:
    """A form for each text that a person fills in and approves: terms that the text really has, questions once each.

    texts: doc, text. terms: doc, term. questions: doc, pos, text."""
    held = translation.proposals(texts, terms).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("window"), F.col("term")))).alias("ts"))
    asked = translation.in_order(questions, "doc", "pos", "text").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("qs"))
    glossary = F.transform(F.coalesce("ts", F.array().cast("array<struct<window:int,term:string>>")), lambda t: F.struct(t["term"].alias("source"), F.lit("").alias("target")))
    open_ = F.transform(F.coalesce("qs", F.array().cast("array<struct<place:int,text:string>>")), lambda q: F.struct(q["text"].alias("question"), F.lit("").alias("answer")))
    style = F.create_map(*[x for s in STYLE for x in (F.lit(s), F.lit(""))])
    rows = texts.join(held, "doc", "left").join(asked, "doc", "left")
    return rows.select(F.col("doc").alias("id"), F.lit(False).alias("approved"), F.sha2("text", 256).alias("source_sha256"), F.lit(source).alias("source_language"), F.lit(target).alias("target_language"), glossary.alias("glossary"), open_.alias("questions"), style.alias("style"))


def translate(docs: DataFrame, targets: list[str], model: Callable[[DataFrame], DataFrame], settings: Translation = Translation(), glossary: Column | None = None, estimate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc, target, text, score, passed, needs_review, issues: every text in every target language.

    docs: doc, text. model: (key, target, attempt, beam, tone, context, text) to (key, candidate), one call for each attempt
    over all segments that haven't passed yet; context: the neighbouring segments of the source, settings.context on either
    side. glossary: map of terms. Values and terms are behind placeholders meanwhile. estimate: a quality model, (key,
    source, candidate, reference) to (key, comet); scores are combined with its answers. Without it, what passes by the
    rules goes to review."""
    terms = F.create_map().cast("map<string,string>") if glossary is None else glossary
    each = docs.select("doc", "text", F.explode(F.array(*map(F.lit, targets))).alias("target"), terms.alias("terms"))
    parts = each.select("doc", "target", "terms", F.posexplode(segment.segment(F.col("text"), settings.max_source_tokens)).alias("pos", "part"))
    todo = parts.select("doc", "target", "terms", "pos", "part", protect.protected(F.col("part.text"), F.col("terms")).alias("shown"))
    near = Window.partitionBy("doc", "target").orderBy("pos")
    sides = [F.array_join(F.collect_list(F.col("part.text")).over(near.rowsBetween(*span)), "\n") for span in ((-settings.context, -1), (1, settings.context))]
    context = F.struct(sides[0].alias("before"), sides[1].alias("after")) if settings.context else F.struct(F.lit("").alias("before"), F.lit("").alias("after"))
    todo = cut_lineage(todo.withColumn("context", context).withColumn("key", F.sha2(F.concat_ws("\u0000", F.col("doc").cast("string"), "target", F.col("pos").cast("string")), 256)))
    tried, open_ = None, todo
    for attempt, beam in enumerate(settings.beams(), 1):
        asked = open_.select("key", "target", F.lit(attempt).alias("attempt"), F.lit(beam).cast("int").alias("beam"), F.lit(settings.tone).alias("tone"), "context", F.col("shown.text").alias("text"))
        told = asked.join(model(asked).select("key", "candidate"), "key", "left").select("key", F.coalesce("candidate", F.lit("")).alias("candidate"))
        back = open_.join(told, "key").withColumn("said", protect.restored(F.col("candidate"), F.col("shown.replacements")))
        missing = translation.missing_terms(F.col("part.text"), F.col("said.text"), F.col("terms"))
        judged = translation.heuristic(F.col("part.text"), F.col("said.text"), missing, F.col("said.issues"), translation.copy_ratio(F.col("part.text"), F.col("said.text"), translation.COPY))
        rows = back.withColumn("q", judged).select("key", F.lit(attempt).alias("attempt"), F.col("part.text").alias("source"), F.col("said.text").alias("candidate"), F.lit(None).cast("string").alias("reference"), F.col("q.score").alias("heuristic"), "q.issues")
        made = cut_lineage(translation.scored(rows, estimate).select("key", "attempt", "candidate", "score", "issues", (F.col("score") >= settings.threshold).alias("passed")))
        tried = made if tried is None else tried.unionByName(made)
        open_ = open_.join(made.where("passed").select("key"), "key", "left_anti")
        if open_.isEmpty():
            break
    best = translation.best_attempts(tried, "key")
    held = cut_lineage(todo.select("key", "doc", "target", "pos", "part").join(best, "key"))
    whole = held.groupBy("doc", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "candidate"))), lambda x: F.struct(x["part"].alias("part"), x["candidate"].alias("candidate"))).alias("ps"))
    text = segment.joined(F.transform("ps", lambda p: p["part"]), F.transform("ps", lambda p: p["candidate"]))
    texts = each.join(whole, ["doc", "target"], "left").withColumn("said", F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    own = translation.heuristic(F.col("text"), F.col("said"), translation.missing_terms(F.col("text"), F.col("said"), F.col("terms")), none)
    name = F.struct("doc", "target").alias("doc")
    gated = translation.gate(held.select(name, "pos", "score", "passed", "issues"), texts.select(name, own.alias("o")).select("doc", "o.score", "o.issues"), settings.threshold, estimated=estimate is not None)
    done = gated.select("doc.doc", "doc.target", "score", "passed", "needs_review", "issues")
    return texts.select("doc", "target", F.col("said").alias("text")).join(done, ["doc", "target"], "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(True))).withColumn("passed", ~F.col("needs_review"))
