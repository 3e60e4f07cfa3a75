"""Runs of a project: stages resume, changes make invalid what hangs on them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import claims, lifecycle, project, storage
from corpusloom.plans.settings import Ledger
from corpusloom.sources import files

PAGES = [("S1", 1, "The bridge was built in 1901. It fell in 1950."), ("S2", 1, "The bridge was built in 1901."), ("S3", 1, "Nothing of the kind.")]


def extract(chunks):
    each = chunks.select("chunk_id", F.explode(F.split("chunk", r"(?<=\.) ")).alias("quote")).where("quote LIKE '%bridge%' OR quote LIKE '%fell%'")
    made = each.unionByName(each.withColumn("quote", F.lit("an invented quotation")))
    return made.select("chunk_id", F.col("quote").alias("claim"), F.lit("EVENT").alias("claim_type"), "quote", F.lit("E1").alias("evidence_class"), F.lit(0.9).alias("confidence"), F.lit("Bridge").alias("event"))


def embed(facts):
    return facts.select("id", F.when(F.col("text").contains("built"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))


def align(pairs):
    return pairs.select("fact", "source", F.lit("explicit_support").alias("stance"), F.lit(None).cast("string").alias("contradiction_type"), F.lit(1.0).alias("confidence"), F.concat("ids", F.array(F.lit("other"))).alias("support_ids"), F.array().cast("array<string>").alias("contradiction_ids"), F.lit("so it says").alias("rationale"))


@pytest.fixture
def plan(spark, tmp_path):
    p = project.Project(spark, str(tmp_path / "p"), project.Models(extract, embed, align))
    spark.createDataFrame([(s, f"Book {s}", f"C{s}", 0.8) for s in ("S1", "S2", "S3")], "source string, title string, cluster string, q double").write.parquet(p.path("sources"))
    spark.createDataFrame(PAGES, "source string, page_number int, text string").write.parquet(p.path("pages"))
    return p


def test_run(spark, plan):
    assert all(ok for _, ok in plan.checks())
    told = plan.run()
    assert told["parse"] == {"pages": 3, "chunks": 3, "new": 3, "gone": 0}
    assert told["extract"] == {"chunks": 3, "facts": 3, "new": 3}
    assert told["deduplicate"]["facts"] == 2 and told["align"] == {"pairs": 6} and told["score"] == {"facts": 2}
    stances = {(r["claim"], r["source"]): (r["stance"], r["coverage"]) for r in plan.table("stances").join(plan.table("canonical_facts"), "fact").collect()}
    assert stances["It fell in 1950.", "S1"] == ("explicit_support", "covered") and stances["It fell in 1950.", "S2"] == ("silent", "not_covered")
    ledger = spark.read.options(header=True, multiLine=True, escape="\"").csv(told["export"]["folder"] + "/ledger")
    parts = [p.read_bytes() for p in Path(told["export"]["folder"], "ledger").glob("part-*")]
    assert all(p.startswith(files.BOM.encode() + b"Fact ID,") for p in parts)
    assert ledger.columns == list(claims.LEDGER.values()) and {r["Event"] for r in ledger.collect()} == {"Bridge"}
    assert {r["Rationale"] for r in spark.read.options(header=True, multiLine=True, escape="\"").csv(told["export"]["folder"] + "/evidence").collect()} == {"so it says", project.UNSHOWN}
    # nothing is asked again, what is there stays
    again = plan.run()
    assert again["parse"]["new"] == again["extract"]["new"] == again["deduplicate"]["new"] == again["align"]["pairs"] == 0
    assert plan.table("runs").count() == 12
    # from a stage on, by force
    forced = plan.run("align", True)
    assert list(forced) == ["align", "score", "export"] and forced["align"] == {"pairs": 6}


def test_alignment_finds_what_is_only_similar(spark, plan):
    """A contradiction between facts that are no near-duplicates: the model is shown it because it's similar."""
    asked = []

    def embed(facts):
        asked.append(facts.count())
        built = F.when(F.col("text").contains("1901"), F.array(F.lit(1.0), F.lit(0.0))).when(F.col("text").contains("1902"), F.array(F.lit(0.7), F.lit(0.714)))
        return facts.select("id", F.coalesce(built, F.array(F.lit(-1.0), F.lit(0.0))).alias("embedding"))

    def align(pairs):
        own = pairs.join(claimed(), F.array_contains("ids", F.col("id"))).groupBy("fact", "claim", "source", "ids").agg(F.collect_list(F.when(F.col("claim") == F.col("said"), F.col("id"))).alias("up"), F.collect_list(F.when(F.col("claim") != F.col("said"), F.col("id"))).alias("down"))
        return own.select("fact", "source", F.lit("silent").alias("stance"), F.lit("D2_DATE").alias("contradiction_type"), F.lit(0.9).alias("confidence"), F.col("up").alias("support_ids"), F.col("down").alias("contradiction_ids"))

    spark.createDataFrame([("S1", 1, PAGES[0][2]), ("S2", 1, "The bridge was built in 1902."), ("S3", 1, PAGES[2][2])], "source string, page_number int, text string").write.mode("overwrite").parquet(plan.path("pages"))
    run = project.Project(spark, plan.folder, project.Models(extract, embed, align))
    claimed = lambda: run.table("raw_facts").select("id", F.col("claim").alias("said"))
    run.run()
    held = {(r["claim"], r["source"]): (r["stance"], r["coverage"], r["contradiction_type"]) for r in run.table("stances").join(run.table("canonical_facts"), "fact").collect()}
    first = "The bridge was built in 1901."
    assert held[first, "S1"] == ("explicit_support", "covered", None) and held[first, "S2"] == ("explicit_contradiction", "covered", "D2_DATE") and held[first, "S3"] == ("silent", "not_covered", None)
    assert held["The bridge was built in 1902.", "S1"][0] == "explicit_contradiction" and len(held) == 9
    assert run.shown().count() == 5 and run.settings.top_k == 16
    # vectors are kept, and only new facts are embedded and filed
    assert run.run("deduplicate", True)["deduplicate"]["facts"] == 3 and asked == [3]
    cells = {r["item_id"]: r["angle"] for r in run.table("fact_cells").collect()}
    spark.createDataFrame([("S3", 2, "It fell in 1949.")], "source string, page_number int, text string").write.mode("append").parquet(plan.path("pages"))
    run.run()
    assert asked == [3, 1] and run.table("fact_vectors").count() == 4
    assert {k: v for k, v in ((r["item_id"], r["angle"]) for r in run.table("fact_cells").collect()) if k in cells} == cells and run.table("fact_cells").count() == 4
    other = project.Project(spark, plan.folder, project.Models(extract, embed, align, "another model"))
    assert other.embed() == 4 and other.embed() == 0


def test_a_table_survives_a_crash_while_it_is_replaced(spark, plan, monkeypatch):
    rows = lambda n: spark.range(n).toDF("id")
    plan.replace("t", rows(3))
    plain = plan._rename
    for fails in (1, 2):  # the first or the second rename
        done = []

        def rename(a, b):
            done.append(a)
            if len(done) == fails:
                raise KeyboardInterrupt
            plain(a, b)

        monkeypatch.setattr(plan, "_rename", rename)
        with pytest.raises(KeyboardInterrupt):
            plan.replace("t", rows(5))
        monkeypatch.setattr(plan, "_rename", plain)
        assert plan.has("t") and plan.table("t").count() == 3
    assert plan.replace("t", rows(5)) == 5 and plan.table("t").count() == 5
    assert not plan.has("t.old")


def test_changes(spark, plan):
    plan.run()
    new = [("S1", 1, PAGES[0][2]), ("S2", 1, "The bridge was built in 1902."), ("S3", 1, PAGES[2][2])]
    spark.createDataFrame(new, "source string, page_number int, text string").write.mode("overwrite").parquet(plan.path("pages"))
    assert plan.parse() == {"pages": 3, "chunks": 3, "new": 1, "gone": 1}
    assert not plan.has("canonical_facts") and not plan.has("scores") and plan.table("raw_facts").count() == 2
    assert plan.extract() == {"chunks": 1, "facts": 3, "new": 1}
    plan.run("deduplicate")
    # another way of cutting takes the stored pages anew
    wide = project.Project(spark, plan.folder, plan.models, Ledger(chunk_size=600, chunk_overlap=10))
    assert wide.parse() == {"pages": 3, "chunks": 3, "new": 3, "gone": 3}
    assert wide.table("raw_facts").count() == 3 and not wide.has("canonical_facts")  # chunks that come out the same keep their facts
    wide.run("extract")
    # a new policy makes scores invalid only
    strict = project.Project(spark, plan.folder, plan.models, wide.settings, claims.Policy(plausible=0.5))
    old = {r["policy"] for r in wide.table("scores").collect()}
    strict.score()
    assert old.isdisjoint({r["policy"] for r in strict.table("scores").collect()}) and strict.has("stances")
    # a removed source takes conclusions along
    spark.createDataFrame([("S1", "Book S1", "C1", 0.8)], "source string, title string, cluster string, q double").write.mode("overwrite").parquet(plan.path("sources"))
    assert "canonical_facts" in strict.sync() and not strict.has("canonical_facts") and {r["source"] for r in strict.table("raw_facts").collect()} == {"S1"}
    assert not all(ok for _, ok in strict.checks())


def test_score_needs_all_decisions(spark, plan):
    for stage in ("parse", "extract", "deduplicate"):
        getattr(plan, stage)()
    few = project.Project(spark, plan.folder, project.Models(extract, embed, lambda pairs: align(pairs).where("source = 'S1'")))
    few.align()
    with pytest.raises(ValueError):
        few.score()
    # sources without anything to show are decided on without the model
    assert plan.align() == {"pairs": 1} and plan.score() == {"facts": 2}


def test_files(spark, tmp_path):
    files.write_text(spark, "one", f"{tmp_path}/t.txt")
    files.write_text(spark, "zwei ü", f"{tmp_path}/t.txt")
    assert (tmp_path / "t.txt").read_text() == "zwei ü" and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.txt"]
    rows = spark.createDataFrame([("a", "text", "{}")], "name string, text string, report string")
    files.write_pairs(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/report.json").first()["report"] == "{}"
    with pytest.raises(Exception, match="already exists"):
        files.write_pairs(rows, f"{tmp_path}/out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.pdf").symlink_to(tmp_path / "t.txt")
    assert [r["name"] for r in files.inside(files.discover(spark, f"{tmp_path}/in"), f"{tmp_path}/in").collect()] == ["a.pdf"]


def test_cache(spark):
    n = lifecycle.cache_namespace("v1", "m")
    assert len({n, lifecycle.cache_namespace("v2", "m"), lifecycle.cache_namespace("v1", "n"), lifecycle.cache_namespace("v1", "m", 1.0)}) == 4
    cache = spark.createDataFrame([(n, "k", "v"), ("other", "l", "w")], "namespace string, key string, value string")
    got = lifecycle.cached(spark.createDataFrame([("k",), ("l",)], "key string"), cache, n)
    assert {r["key"]: r["value"] for r in got.collect()} == {"k": "v", "l": None}


def test_clusters_must_name_a_shared_folder():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session)
