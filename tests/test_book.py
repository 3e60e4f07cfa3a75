"""Whole texts through segments, retries and gates."""

from pyspark.sql import functions as F

from corpusloom.plans import book, translation
from corpusloom.plans.settings import Translation


def test_translate(spark):
    docs = spark.createDataFrame([(1, "First one here.\n\nSecond 1234567 rabbit there."), (2, "Never done well."), (3, "")], "doc int, text string")
    asked = []

    def model(rows):
        asked.append(rows.count())
        # the first attempt drops the placeholders, the second keeps them; one text is always lost
        word = F.concat(F.lit("zz "), F.regexp_replace("text", "[a-z]{3,}", "wwww"))
        first = F.regexp_replace(word, "<x[0-9]+>", "")
        return rows.select("key", F.when(F.col("text").contains("Never"), "").when(F.col("attempt") == 1, first).otherwise(word).alias("candidate"))

    estimate = lambda rows: rows.select("key", F.when(F.length("candidate") > 0, 0.9).otherwise(0.0).alias("comet"))
    terms = F.create_map(F.lit("rabbit"), F.lit("Hase"))
    got = {(r["doc"], r["target"]): r for r in book.translate(docs, ["de", "fr"], model, glossary=terms, estimate=estimate).collect()}
    assert set(got) == {(d, t) for d in (1, 2, 3) for t in ("de", "fr")}
    one = got[1, "de"]
    assert one["passed"] and "1234567" in one["text"] and "Hase" in one["text"] and "\n\n" in one["text"]
    assert got[2, "fr"]["needs_review"] and got[2, "fr"]["text"] == "" and "empty translation" in got[2, "fr"]["issues"]
    assert got[3, "de"]["needs_review"] and got[3, "de"]["text"] == ""
    assert asked[0] == 6 and len(asked) == 3 and asked[-1] == 2
    # without a model's estimate, what passes is reviewed too
    alone = {(r["doc"], r["target"]): r for r in book.translate(docs, ["de"], model, glossary=terms).collect()}
    assert alone[1, "de"]["needs_review"] and not alone[1, "de"]["passed"] and translation.UNESTIMATED in alone[1, "de"]["issues"] and alone[1, "de"]["text"] == one["text"]
    assert translation.UNESTIMATED not in alone[2, "de"]["issues"] and alone[2, "de"]["needs_review"]


def test_translate_shows_neighbours_and_tone(spark):
    seen = []

    def model(rows):
        seen.extend(rows.select("text", "tone", "context.before", "context.after").collect())
        return rows.select("key", F.col("text").alias("candidate"))

    docs = spark.createDataFrame([(1, "One one one.\n\nTwo two two.\n\nThree three three.\n\nFour four four.")], "doc int, text string")
    book.translate(docs, ["de"], model, Translation(context=2, tone="formal", max_retries=0)).collect()
    held = {r["text"].strip(): (r["tone"], r["before"], r["after"]) for r in seen}
    assert held["Three three three."][0] == "formal" and [x.split() for x in held["Three three three."][1:]] == ["One one one. Two two two.".split(), "Four four four.".split()]
    assert held["One one one."][1] == ""


def test_forms(spark):
    texts = spark.createDataFrame([(1, "A rabbit and a hare."), (2, "Nothing.")], "doc int, text string")
    terms = spark.createDataFrame([(1, "rabbit"), (1, "fox"), (2, "rabbit")], "doc int, term string")
    questions = spark.createDataFrame([(1, 0, "Who?"), (1, 1, "Where?"), (1, 2, "Who?")], "doc int, pos int, text string")
    got = {r["id"]: r for r in book.forms(texts, terms, questions, "en", "de").collect()}
    assert [g["source"] for g in got[1]["glossary"]] == ["rabbit"] and [q["question"] for q in got[1]["questions"]] == ["Who?", "Where?"]
    assert got[2]["glossary"] == got[2]["questions"] == [] and not got[1]["approved"]
    filled = book.forms(texts, terms, questions, "en", "de").withColumn("approved", F.lit(True)).withColumn("glossary", F.transform("glossary", lambda g: F.struct(g["source"].alias("source"), F.lit("x").alias("target"))))
    ready = filled.withColumn("actual_sha256", F.col("source_sha256")).withColumn("wanted_source", F.lit("en")).withColumn("wanted_target", F.lit("de"))
    assert all(not r["errors"] for r in translation.form_errors(ready).collect())
