"""Streams give what batches give, also after an interruption, and ask no model twice."""

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import translation
from corpusloom.streaming import ingest


def test_glossary_in_three_batches(spark, tmp_path):
    """Terms come again, late, with another definition, and where the text lacks them."""
    rows = [
        [("d1", 5, "a Term here", "der Begriff", "Term", "Begriff"), ("d1", 6, "a Term here", "das Wort", "Term", "Wort"), ("d2", 1, "nothing", "der Begriff", "Term", "Begriff")],
        [("d1", 2, "the Term", "dies Wort", "Term", "Wort"), ("d2", 4, "Term", "Begriff", "Term", "Begriff"), ("d2", 3, "Term", "nichts", "Term", "Begriff"), (None, 1, "Term", "Begriff", "Term", "Begriff")],
        [("d1", 9, "Term", "Wort", "Term", "Wort"), ("d3", 1, "Übung x", "exercise", "Übung", "exercise"), ("d2", 9, None, None, "Term", "x")],
    ]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in rows:
        spark.createDataFrame(part, ingest.PROPOSALS).write.mode("append").parquet(folder)
        ingest.glossary_stream(spark, folder, out, state)  # a restart each time
    whole = lambda df: sorted(map(tuple, df.select("doc", "term", "target", "since").collect()), key=repr)
    got = whole(ingest.glossary_so_far(spark, out))
    assert got == whole(translation.carried_glossary(spark.read.schema(ingest.PROPOSALS).parquet(folder)))
    assert ("d1", "Term", "Wort", 2) in got and ("d2", "Term", "Begriff", 4) in got and len(got) == 4
    ingest.glossary_stream(spark, folder, out, state)  # nothing new
    assert whole(ingest.glossary_so_far(spark, out)) == got


def test_attempts_survive_interruptions(spark, tmp_path):
    """Key n passes at attempt n % 4, so some never do; the model breaks down at the second batch's second attempt."""
    asked = spark.sparkContext.accumulator(0)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    fails = {"at": None}

    def judged(rows, attempt):
        if fails["at"] == attempt:
            raise RuntimeError("the model is gone")

        def run(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        told = rows.select("key").mapInArrow(run, "key string")
        n = F.col("key").cast("int")
        return told.select("key", F.format_string("%s by %d", "key", F.lit(attempt)).alias("candidate"), (n % 7 / 10 + attempt / 100).alias("score"), (n % 4 == attempt).alias("passed"))

    def feed(keys):
        spark.createDataFrame([(str(k),) for k in keys], "key string").coalesce(1).write.mode("append").parquet(folder)

    feed([*range(20), 3, 3])
    ingest.attempts_stream(spark, folder, "key string", out, state, judged, 3)
    first = asked.value
    assert first == 20 + 15 + 10
    feed(range(10, 40))
    fails["at"] = 2
    with pytest.raises(Exception, match="the model is gone"):
        ingest.attempts_stream(spark, folder, "key string", out, state, judged, 3)
    assert asked.value == first + 20
    fails["at"] = None
    ingest.attempts_stream(spark, folder, "key string", out, state, judged, 3)
    assert asked.value == 40 + 30 + 20
    got = {int(r["key"]): (r["candidate"], r["passed"], r["attempts"]) for r in ingest.best_so_far(spark, out).collect()}
    assert got == {k: (f"{k} by {k % 4 or 3}", k % 4 > 0, k % 4 or 3) for k in range(40)}
