"""The command line, settings and small functions around models."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.functions import metrics
from corpusloom.operators import markdown
from corpusloom.plans import claims, models, translation
from corpusloom.plans.settings import Cleanup, Ledger, Translation
from corpusloom.sources import files


def test_commands(spark, tmp_path, capsys):
    d = str(tmp_path / "d")
    spark.createDataFrame([("f", "EVENT", "A claim")], "fact string, claim_type string, claim string").write.parquet(f"{d}/facts.parquet")
    spark.createDataFrame([("S1", "C1", 0.869425, "Book")], "source string, cluster string, q double, title string").write.parquet(f"{d}/sources.parquet")
    spark.createDataFrame([("f", "S1", "covered", "explicit_support", None, 1.0, ["e"], [])], "fact string, source string, coverage string, stance string, contradiction_type string, confidence double, support_ids array<string>, contradiction_ids array<string>").write.parquet(f"{d}/decisions.parquet")
    spark.createDataFrame([("e", "E1", 1.0, True)], "id string, evidence_class string, confidence double, verified boolean").write.parquet(f"{d}/evidence.parquet")
    spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert main(["score", d, f"{d}/scores.parquet"], spark) == 0
    assert spark.read.parquet(f"{d}/scores.parquet").first()["grade"] == "FACT_PROBABLE"
    assert main(["export", d, f"{d}/x"], spark) == 0
    assert "A claim" in "\n".join(r["value"] for r in spark.read.text(f"{d}/x/report").collect())
    for command in ("parse", "clean", "segment"):
        assert main([command, d, f"{d}/{command}"], spark) == 0
    assert spark.read.parquet(f"{d}/segment").count() == 2
    assert main(["status", d], spark) == 0 and main(["list"]) == 0 and main(["query", d, "none", f"{d}/n"], spark) == 1
    assert "facts: 1" in capsys.readouterr().out
    spark.createDataFrame([("S2", "C2", 0.5, "Other"), ("S1", "C1", 0.8, "Book")], "source string, cluster string, q double, title string").write.mode("overwrite").parquet(f"{d}/sources.parquet")
    assert main(["score", d, f"{d}/again"], spark) == 2


def test_settings():
    assert Translation().beams() == [None, 8, 8]
    for bad in (lambda: Ledger(chunk_overlap=4000), lambda: Ledger(same_fact=2), lambda: Cleanup(dpi=1), lambda: Translation(threshold=-1)):
        with pytest.raises(ValueError):
            bad()


def test_policies():
    for bad in ({"plausible": 0.9}, {"established_clusters": 0}, {"penalised": ("D2",)}, {"meaningful": 0}, {"stances": {"silent": 0}}, {"stances": {"explicit_support": 0.1, "implicit_support": 0.5, "explicit_contradiction": -1.0, "mixed": 0.0, "silent": 0.0}}, {"multipliers": {"E1": 1.0}}):
        with pytest.raises(ValueError):
            claims.Policy(**bad)
    for bad in (lambda: Cleanup(layout="3"), lambda: Cleanup(direction="up"), lambda: Cleanup(max_pages=0), lambda: Cleanup(confidence=2)):
        with pytest.raises(ValueError):
            bad()


def test_metrics(spark):
    assert metrics.chrf("the cat sat", "the cat sat") == metrics.bleu("the cat sat here", "the cat sat here") == 1.0
    assert metrics.chrf("", "a") == metrics.chrf("x", "y") == metrics.bleu("x", "y") == metrics.bleu("", "y") == 0.0
    # by hand: unigrams 2 of 3, bigrams 1 of 2, trigrams none of 1 (half a hit); as long as the reference
    assert metrics.bleu("a b x", "a b c") == pytest.approx((2 / 3 * 1 / 2 * 1 / 2) ** (1 / 3))
    assert metrics.bleu("a b", "a b c d") == pytest.approx(math.exp(-1))
    # characters ab/abc: orders 1 and 2 on both sides, (1, 2/3) and (1, 1/2); words: none alike; beta 2
    p, r = 2 / 3, (2 / 3 + 1 / 2) / 3
    assert metrics.chrf("ab", "abc") == pytest.approx(5 * p * r / (4 * p + r))
    assert metrics._words("(so) it, is!") == ["(so", ")", "it", ",", "is", "!"] and metrics._words("'x y") == ["'", "x", "y"]
    rows = spark.createDataFrame([("k", "s", "a b", "a b", 0.5), ("l", "s", "a b", None, 0.5)], "key string, source string, candidate string, reference string, heuristic double")
    got = {r["key"]: r for r in translation.scored(rows, lambda x: x.select("key", F.lit(2.0).alias("comet"))).collect()}
    assert got["k"]["score"] == pytest.approx((0.25 + 0.5 + 0.3 + 0.1) / 1.4, abs=1e-4) and got["l"]["score"] == 0.75 and got["l"]["chrf"] is None
    assert translation.scored(rows).where("key = 'l'").first()["score"] == 0.5


def test_readers(spark):
    made = spark.createDataFrame([("a", b"2"), ("b", b"9"), ("c", b"x"), ("d", b"0")], "name string, content binary")
    sizes = lambda c: None if c == b"x" else [(72, 72), (720, 720)] * int(c)
    rows = files.rasterised(made, sizes, lambda c, i, dpi: f"{i}@{dpi}".encode(), 100, 10, 500_000).collect()
    got = {(r["name"], r["page_number"]): (r["width"], r["image"] and bytes(r["image"]), r["error"]) for r in rows}
    assert got["a", 1] == (100, b"1@100", None) and got["a", 2] == (1000, None, "1000000 pixels, allowed are 500000")
    assert got["b", None][2] == "18 pages, allowed are 1 to 10" and got["c", None][2] == "encrypted" and got["d", None][2].startswith("0 pages")
    told = files.described(made, lambda c: {"encrypted": c == b"x", "labels": ["i", "ii"], "metadata": {"title": "T"}}).collect()
    assert {r["name"]: r["labels"] for r in told} == {"a": ["i", "ii"], "b": ["i", "ii"], "c": None, "d": ["i", "ii"]}
    sources = spark.createDataFrame([("S1", "a.pdf"), ("s1", "B.PDF"), ("S2", "x/c.pdf"), ("S3", "d.pdf")], "source string, filename string")
    assert {r["source"]: len(r["errors"]) for r in files.manifest_errors(sources).collect()} == {"S1": 1, "s1": 1, "S2": 1}


def test_embed(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "y")], "key string, text string")
    got = models.embed(rows, lambda: lambda xs: [[float(len(x)), 1.0] for x in xs]).collect()
    assert {r["key"]: r["embedding"] for r in got} == {"a": [2.0, 1.0], "b": [1.0, 1.0]}
    old = spark.createDataFrame([(1, [1.0], "m"), (2, None, "m"), (3, [1.0], "n"), (4, [1.0], None)], "id int, embedding array<double>, embedding_model string")
    assert sorted(r["id"] for r in models.stale(old, "m").collect()) == [2, 3, 4]


def test_math_shield(spark):
    text = r"a $x$ and \[y\] or \$5"
    m = markdown.shield_math_column(F.col("t"), F.lit("Q"))
    back = lambda said: markdown.unshield_math_column(said, m["formulas"])
    got = spark.createDataFrame([(text,)], "t string").select(m["text"].alias("said"), back(m["text"]).alias("back"), back(F.lit("gone")).alias("gone")).first()
    assert "$x$" not in got["said"] and got["back"] == text and got["gone"] is None


def test_pieces_between_batches(spark):
    asked = models.ask(spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("payload")), lambda: lambda xs: [str(len(xs))] * len(xs), 8)
    assert asked.count() == 100 and {r["response"] for r in asked.collect()} <= {str(i) for i in range(1, 9)}
