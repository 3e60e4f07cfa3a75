"""The claim ledger, translation checks, model tables and incremental runs on hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells, graph, similarity
from corpusloom.plans import claims, lifecycle, models, translation
from corpusloom.plans.storage import cut_lineage
from corpusloom.sources import files

SOURCES = [("S1", "C1", 0.869425), ("S2", "C2", 0.830938), ("S3", "C3", 0.750691), ("S4", "C3", 0.316524)]


def ledger(spark, decisions, evidence, claim_type="EVENT"):
    facts = spark.createDataFrame([("f", claim_type)], "fact string, claim_type string")
    d = spark.createDataFrame(decisions, "fact string, source string, coverage string, stance string, contradiction_type string, confidence double, support_ids array<string>, contradiction_ids array<string>")
    e = spark.createDataFrame(evidence, "id string, evidence_class string, confidence double, verified boolean")
    s = spark.createDataFrame(SOURCES, "source string, cluster string, q double")
    return claims.score_facts(facts, d, e, s).first()


def yes(source, ids, stance="explicit_support", confidence=1.0):
    return ("f", source, "covered", stance, None, confidence, ids, [])


def test_one_source(spark):
    r = ledger(spark, [yes("S1", ["e1"])], [("e1", "E1", 1.0, True)])
    assert r["support_mass"] == pytest.approx(0.869425)
    assert (round(r["research_index"], 4), round(r["evidence_strength"], 4), r["grade"]) == (46.5076, 58.0807, "FACT_PROBABLE")


def test_two_clusters(spark):
    r = ledger(spark, [yes("S1", ["e1"]), yes("S2", ["e2"])], [("e1", "E1", 1.0, True), ("e2", "E2", 1.0, True)])
    assert r["support_mass"] == pytest.approx(1.617269, abs=1e-6) and r["grade"] == "FACT_ESTABLISHED"
    assert (r["independent_support_count"], r["primary_document_count"], r["eyewitness_count"]) == (2, 1, 1)


def test_a_cluster_counts_once(spark):
    r = ledger(spark, [yes("S3", ["e1"]), yes("S4", ["e1"])], [("e1", "E1", 1.0, True)])
    assert r["support_mass"] == pytest.approx(0.750691) and r["dependent_support_count"] == 1 and r["primary_document_count"] == 2


@pytest.mark.parametrize("kind, against", [("D1_FACTUAL", 1.5 * 0.869425), ("D2_CHRONOLOGY", 0.0)])
def test_mixed(spark, kind, against):
    r = ledger(spark, [("f", "S1", "covered", "mixed", kind, 1.0, ["e1"], ["e2"])], [("e1", "E1", 1.0, True), ("e2", "E1", 1.0, True)])
    assert r["support_mass"] == pytest.approx(0.869425) and r["contradiction_mass"] == pytest.approx(against)
    assert r["grade"] == ("FACT_CONTESTED" if against else "FACT_PROBABLE")


def test_odd_evidence(spark):
    evidence = [("e1", "E9", 1.0, True), ("e2", "E1", 1.0, False), ("e3", "E1", 7.0, True)]
    assert ledger(spark, [yes("S1", ["e1"])], evidence)["support_mass"] == pytest.approx(0.35 * 0.869425)
    none = ledger(spark, [yes("S1", ["e2"])], evidence)
    assert none["support_mass"] == 0 and none["grade"] == "FACT_UNVERIFIED" and none["conflict_index"] == 0
    assert ledger(spark, [yes("S1", ["e3", "e3"])], evidence)["support_mass"] == pytest.approx(0.869425)
    assert ledger(spark, [yes("S1", [])], evidence)["evidence_strength"] == 0
    assert ledger(spark, [yes("S1", ["e3"])], evidence, "REPORTED_SPEECH")["grade"] == "SOURCE_REPORT"
    silent = ledger(spark, [("f", "S1", "not_covered", "silent", None, 1.0, [], [])], evidence)
    assert silent["evidence_coverage"] == 0


def test_quality_and_policy(spark):
    dims = {k: F.lit(0.5) for k in claims.Policy().weights}
    q = lambda d: spark.range(1).select(claims.source_quality(d).alias("q")).first()["q"]
    assert q(dims) == pytest.approx(0.5) and q(dims | {"expertise": F.lit(0.0)}) == 0
    with pytest.raises(ValueError):
        claims.Policy(weights={"authority": 0.5})


def test_sanitize(spark):
    row = spark.range(1).select(claims.sanitized(F.lit("silent"), F.array(F.lit("a"), F.lit("x")), F.array(F.lit("b")), F.lit("D1_FACTUAL"), F.array(F.lit("a"), F.lit("b"))).alias("s")).first()["s"]
    assert (row["stance"], row["support_ids"], row["contradiction_ids"], row["coverage"]) == ("mixed", ["a"], ["b"], "covered")
    cov = lambda s, c: spark.range(1).select(claims.consistent_coverage(F.lit(s), F.lit(c)).alias("x")).first()["x"]
    assert [cov("mixed", "not_covered"), cov("silent", "covered"), cov("silent", "not_covered")] == ["covered", "covered_but_silent", "not_covered"]


def test_report(spark):
    scored = claims.score_facts(spark.createDataFrame([("f", "EVENT")], "fact string, claim_type string"), spark.createDataFrame([yes("S1", ["e1"])], "fact string, source string, coverage string, stance string, contradiction_type string, confidence double, support_ids array<string>, contradiction_ids array<string>"), spark.createDataFrame([("e1", "E1", 1.0, True)], "id string, evidence_class string, confidence double, verified boolean"), spark.createDataFrame(SOURCES, "source string, cluster string, q double"))
    buckets = claims.source_buckets(spark.createDataFrame([("f", "S1", "covered", "explicit_support")], "fact string, source string, coverage string, stance string"), spark.createDataFrame([("S1", "Book")], "source string, title string"))
    row = claims.report(claims.ledger_rows(claims.ledger_order(scored.withColumn("claim", F.lit("A claim"))), buckets)).first()
    assert row["label"] == "F000001" and "## F000001 A claim" in row["markdown"] and "- explicit support: Book" in row["markdown"] and "46.51" in row["markdown"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r["node"]: r["label"] for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_hubs_are_split(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(spark.createDataFrame([(200_000, 200_001)], "src long, dst long"))
    both, hubs = graph._salted(star, "src", "dst")
    sizes = [r["count"] for r in both.repartition(8, "b", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert hubs.count() == 1 and max(sizes) < 2 * sum(sizes) / 8
    got = graph.connected_components(star).groupBy("label").count().collect()
    assert sorted(map(tuple, got)) == [(0, 100_001), (200_000, 2)]


def test_components_cost_few_jobs(spark):
    """Without hubs: two writes, one sum and the rounds; no table is written twice and no salts are joined."""
    edges = cut_lineage(spark.createDataFrame([(1, 2)], "src long, dst long"))
    spark.sparkContext.setJobGroup("components", "components")
    try:
        labels = graph.connected_components(edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
        assert {tuple(r) for r in labels.collect()} == {(1, 1), (2, 1)} and jobs <= 12, jobs
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_bounded_components(spark):
    angles = [0.0, 0.1, 0.2, 0.3, 0.4, 2.0, 2.01, 2.02, 2.03, 2.04, 2.05]
    v = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "id long, embedding array<double>")
    got = {r["id"]: (r["group"], r["slice"]) for r in graph.bounded_components(v, 0.99, most=4).collect()}
    assert len({got[i] for i in range(5)}) >= 2 and {got[i] for i in range(5, 9)} == {(5, 0)} and {got[9], got[10]} == {(5, 1)}


def similar(data, threshold):
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v in data}
    return {(a, b): unit[a] @ unit[b] for a in unit for b in unit if a < b and unit[a] @ unit[b] >= threshold}


def grouped(groups, each, dims, spread, seed):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, dims))
    return [(int(i), (centres[i % groups] + g.normal(size=dims) * spread).tolist()) for i in range(groups * each)]


@pytest.mark.parametrize("threshold", [0.6, -0.5])
def test_radius_pairs_in_cells(spark, monkeypatch, threshold):
    monkeypatch.setattr(cells, "CELL", 30)
    monkeypatch.setattr(cells, "BLOCK", 25)
    data = grouped(10, 12, 5, 0.3, 1) + [(1000, [0.0] * 5), (1001, [0.0] * 5), (1002, [1.0] + [0.0] * 4), (1003, [1.0] + [0.0] * 4)]
    v = spark.createDataFrame([*data, (2000, None)], "id long, embedding array<double>")
    got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in similarity.radius_pairs(v, threshold).collect()]
    assert sorted(got) == sorted((a, b, round(s, 9)) for (a, b), s in similar(data, threshold).items()) and got
    named = v.withColumn("id", F.col("id").cast("string"))
    assert similarity.radius_pairs(named, threshold).count() == len(got) == similarity.radius_pairs(named.withColumn("part", F.lit(1)), threshold, "part").count()
    # the forest of each task keeps all components
    edges = similarity.similar_trees(v, threshold).collect()
    assert all(round(similar(data, threshold)[r["a"], r["b"]] - r["similarity"], 9) == 0 for r in edges)
    for at in (threshold, threshold + 0.05):
        assert partition([i for i, _ in data], [(r["a"], r["b"]) for r in edges if r["similarity"] >= at]) == partition([i for i, _ in data], list(similar(data, at)))


def partition(nodes, edges):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        label[q] = p
    return {n: find(n) for n in nodes}


def test_radius_pairs_multiply_less_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 20)
    work = []
    for groups in (20, 200):
        v = spark.createDataFrame(grouped(groups, 10, 16, 0.05, 2), "id long, embedding array<double>")
        work.append(cells.multiplied(cells.met(similarity._scoped(v), 0.9)))
    assert work[1] < 30 * work[0] and work[0] < 200 * 199 / 2


def test_spanning_forest(spark):
    r = random.Random(4)
    edges = [(a, b, r.randrange(8) / 8) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.07 and a % 3 == b % 3]
    got = graph.spanning_forest(spark.createDataFrame(edges, "a long, b long, similarity double")).collect()
    assert {(x["a"], x["b"], x["similarity"]) for x in got} <= set(edges)
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    assert len(got) == len(nodes) - len(set(partition(nodes, [e[:2] for e in edges]).values()))
    for at in range(9):
        assert partition(nodes, [(x["a"], x["b"]) for x in got if x["similarity"] >= at / 8]) == partition(nodes, [e[:2] for e in edges if e[2] >= at / 8])
    assert graph.spanning_forest(spark.createDataFrame([], "a long, b long, similarity double")).count() == 0


@pytest.mark.parametrize("threshold, k", [(0.5, 3), (-0.2, 4)])
def test_retrieval_from_lists(spark, monkeypatch, threshold, k):
    monkeypatch.setattr(cells, "CELL", 40)
    monkeypatch.setattr(cells, "BLOCK", 15)
    data = [(i, f"s{i % 3}", v) for i, v in grouped(12, 15, 6, 0.4, 3)] + [(900, "s0", [0.0] * 6), (901, None, grouped(1, 1, 6, 0, 9)[0][1])]
    queries = [(i, v) for i, _, v in data if i % 7 == 0] + [(999, [0.0] * 6)]
    members = [(q, i) for q, _ in queries for i in range(q, q + 4)]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = similarity.retrieve(frame(queries, "query_id long, embedding array<double>"), frame(data, "item_id long, source string, embedding array<double>"), frame(members, "query_id long, item_id long"), threshold, k)
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    want = []
    for q, v in queries:
        for source in ("s0", "s1", "s2", None):
            found = [((q, i) not in members, -round(float(unit(v) @ unit(w)), 6), i) for i, s, w in data if s == source]
            found = sorted(x for x in found if not x[0] or -x[1] >= threshold)
            want += [(q, source, i, -s, not far, n) for n, (far, s, i) in enumerate(found, 1) if not far or n <= k]
    rows = [tuple(r[c] for c in ("query_id", "source", "item_id", "similarity", "direct", "rank")) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_direct_members_come_first(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    items = spark.createDataFrame([(10, "s", [0.0, 1.0]), (11, "s", [1.0, 0.0]), (12, "s", [0.9, 0.1]), (13, "s", [-1.0, 0.0])], "item_id long, source string, embedding array<double>")
    members = spark.createDataFrame([(1, 10), (1, 13)], "query_id long, item_id long")
    got = [(r["item_id"], r["direct"]) for r in similarity.retrieve(q, items, members, 0.5, 3).orderBy("rank").collect()]
    assert got == [(10, True), (13, True), (11, False)]
    assert [r["item_id"] for r in similarity.retrieve(q, items, members, 0.5, 1).orderBy("rank").collect()] == [10, 13]


def test_retries(spark):
    rows = [(1, 1, 0.9, False), (1, 2, 0.8, True), (1, 3, 1.0, True), (2, 1, 0.3, False), (2, 2, 0.3, False)]
    a = spark.createDataFrame(rows, "segment int, attempt int, score double, passed boolean")
    got = {r["segment"]: (r["attempt"], r["attempts"]) for r in translation.best_attempts(a, "segment").collect()}
    assert got == {1: (2, 2), 2: (1, 2)}


def test_scores(spark):
    s = lambda a, b, g: spark.createDataFrame([(a, b)], "a string, b string").select(translation.heuristic(F.col("a"), F.col("b"), translation.missing_terms(F.col("a"), F.col("b"), g), F.array().cast("array<string>"), translation.copy_ratio(F.col("a"), F.col("b"))).alias("h")).first()["h"]
    g = F.create_map(F.lit("peace"), F.lit("Frieden"))
    assert s("peace now please", "Krieg jetzt bitte", g)["issues"] == ["missing glossary term: Frieden"]
    assert s("a b", " ", g)["score"] == 0
    assert s("call 01712345678 now", "ruf 0171 jetzt", g)["score"] < 0.72
    assert "source-copy ratio too high" in s("one two three four", "one two three fours", g)["issues"]
    mean = spark.range(1).select(translation.combined(heuristic=F.lit(1.0), comet=F.lit(0.5), chrf=F.lit(None).cast("double")).alias("x")).first()["x"]
    assert mean == 0.75


def test_gate_and_glossary(spark):
    seg = spark.createDataFrame([(1, 0, 0.9, True, ["a"]), (1, 1, 0.7, True, ["b", "a"]), (2, 0, 1.0, False, [])], "doc int, pos int, score double, passed boolean, issues array<string>")
    docs = spark.createDataFrame([(1, 0.95, []), (2, 1.0, [])], "doc int, score double, issues array<string>")
    got = {r["doc"]: (r["score"], r["passed"], r["issues"]) for r in translation.gate(seg, docs).collect()}
    assert got == {1: (0.8, True, ["a", "b"]), 2: (1.0, False, [])}
    assert translation.review_records(translation.gate(seg, docs)).first()["status"] == "pending_human_review"
    p = spark.createDataFrame([(1, 0, "x", "X", "x", "Z"), (1, 1, "x", "X", "x", "X"), (1, 2, "x", "XY", "x", "Y")], "doc int, pos int, source_text string, draft string, term string, target string")
    assert [(r["term"], r["target"]) for r in translation.carried_glossary(p).collect()] == [("x", "X")]
    texts = spark.createDataFrame([(1, "abcdef")], "doc int, text string")
    terms = spark.createDataFrame([(1, "ab"), (1, "ef"), (1, "zz")], "doc int, term string")
    assert {(r["term"], r["window"]) for r in translation.proposals(texts, terms, 3).collect()} == {("ab", 0), ("ef", 1)}


def test_forms(spark):
    schema = "id int, approved boolean, source_sha256 string, actual_sha256 string, source_language string, target_language string, wanted_source string, wanted_target string, glossary array<struct<source:string,target:string>>"
    good = (True, "h", "h", "en", "hi", "en", "hi", [("a", "b")])
    rows = [(0, *good), (1, False, *good[1:]), (2, True, "h", "x", *good[3:]), (3, *good[:4], "bn", *good[5:]), (4, *good[:7], [("a", "b"), ("A", "c")]), (5, *good[:7], [("a", " ")])]
    got = {r["id"]: len(r["errors"]) for r in translation.form_errors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_models(spark):
    requests = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "key string, payload string")
    cache = spark.createDataFrame([("b", "known")], "key string, response string")
    found, fresh = models.answered(requests, cache, lambda: lambda xs: [x * 2 for x in xs])
    assert sorted(map(tuple, found.select("key", "response").collect())) == [("a", "xx"), ("a", "xx"), ("b", "known")]
    assert [tuple(r) for r in fresh.collect()] == [("a", "xx")]


def test_lifecycle(spark):
    assert lifecycle.cleared_from("align") == ["stances", "scores"]
    assert set(lifecycle.cleared_from("parse")) == {"pages", "chunks", "raw_facts", "canonical_facts", "fact_members", "stances", "scores"}
    assert lifecycle.invalidated("a", "b", 0, False, False) == ["scores"] and lifecycle.invalidated("a", "a", 0, False, False) == []
    assert lifecycle.invalidated("a", "a", 1, False, False)[0] == "canonical_facts" and lifecycle.invalidated(None, "a", 0, False, True)[0] == "chunks"
    assert lifecycle.fingerprint(a=1, b=2) == lifecycle.fingerprint(b=2, a=1) != lifecycle.fingerprint(a=1, b=3)


def test_files(spark, tmp_path):
    for name in ("b.pdf", "A.PDF", "a.pdf", "c.txt"):
        (tmp_path / name).write_text(name)
    found = files.discover(spark, str(tmp_path), content=True)
    assert [r["name"] for r in files.by_name(found).collect()] == ["A.PDF", "a.pdf", "b.pdf"]
    assert [r["names"] for r in files.collisions(found).collect()] == [["A.PDF", "a.pdf"]]
    pages = files.pages(found, lambda data: [data.decode(), "x" * 50], lambda data, i: "seen")
    assert sorted((r["name"], r["page_number"], r["text"][:4], r["used_ocr"]) for r in pages.collect())[:2] == [("A.PDF", 1, "seen", True), ("A.PDF", 2, "xxxx", False)]
    labels = files.expand(found, lambda data: [{"page": i, "label": f"{data.decode()}-{i}"} for i in range(2)], "page int, label string")
    assert labels.count() == 6 and {r["label"] for r in labels.where("name = 'b.pdf'").collect()} == {"b.pdf-0", "b.pdf-1"}
    assert files.read_text(spark, str(tmp_path / "c.txt")).first()["text"] == "c.txt"
    df = spark.range(3)
    files.write_stage(df, str(tmp_path / "s"), "one", "h", n=3)
    assert files.read_stage(spark, str(tmp_path / "s"), "one", "h").count() == 3
    with pytest.raises(ValueError):
        files.read_stage(spark, str(tmp_path / "s"), "one", "other")
    results = spark.createDataFrame([(1, True), (2, False)], "id int, needs_review boolean")
    files.write_routed(results, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/review")).count() == 1
    files.append_reviews(results, str(tmp_path / "q"))
    files.append_reviews(results, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 4
    files.write_ledger(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "l"), guard=True)
    assert spark.read.csv(str(tmp_path / "l"), header=True).first()["a"] == "'=1"


def test_policy_text():
    text = "intro <!--a-->\n```yaml\nx: &d {p: 1}\ny:\n  <<: *d\n  q: 2\n```\n<!--b--> end"
    assert files.marked_yaml(text, "<!--a-->", "<!--b-->") == {"x": {"p": 1}, "y": {"p": 1, "q": 2}}
    with pytest.raises(ValueError):
        files.marked_yaml("none", "<!--a-->", "<!--b-->")
    assert files.glossary('{"a": "b"}') == {"a": "b"} and files.glossary("a: b") == {"a": "b"}
    with pytest.raises(ValueError):
        files.glossary('{"a": 1}')


def test_chunk_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import chunk_stream

    schema, out = "doc_id long, text string", str(tmp_path / "out")
    run = lambda: chunk_stream(spark, str(tmp_path / "in"), schema, out, str(tmp_path / "cp"), "doc_id")
    put = lambda i: spark.createDataFrame([(i, f"text {i}")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    put(1)
    run()
    put(2)
    run()
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


@pytest.mark.parametrize("copies, pieces, turn", [(-1, 1, 2), (-1, 5, 2), (-1, 6, 1), (math.inf, 1, 1)])
def test_trees_by_cells_and_by_steps(spark, monkeypatch, copies, pieces, turn):
    for name, value in {"CELL": 30, "BLOCK": 25, "COPIES": copies, "PIECES": pieces, "TURN": turn, "ROWS": 7, "COLUMNS": 11, "EDGES": 50}.items():
        monkeypatch.setattr(cells, name, value)
    data = grouped(10, 12, 5, 0.3, 1) + [(1000, [0.0] * 5), (1002, [1.0] + [0.0] * 4), (1003, [1.0] + [0.0] * 4)]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in data]
    ids = [i for i, _ in data]
    for threshold in (0.6, -0.2) if pieces > 1 else (0.6,):
        want = similar(data, threshold)
        edges = similarity.similar_trees(spark.createDataFrame([*data, (2000, None)], "id long, embedding array<float>"), threshold).collect()
        assert all(abs(want[r["a"], r["b"]] - r["similarity"]) < 1e-9 for r in edges)
        for at in (threshold, threshold + 0.2, 0.95):
            assert partition(ids, [(r["a"], r["b"]) for r in edges if r["similarity"] >= at]) == partition(ids, list(similar(data, at)))
    assert similarity.similar_trees(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1])], "id string, embedding array<double>"), 0.5).select("a", "b").collect() == [("a", "b")]
    assert similarity.similar_trees(spark.createDataFrame([], "id long, embedding array<float>"), 0.5).count() == 0


def test_components_of_vectors_without_structure_take_little_disk(spark, monkeypatch):
    """Vectors that are near all borders aren't copied to all cells; what is written is bounded for each of them."""
    from corpusloom.plans import storage

    monkeypatch.setattr(cells, "CELL", 20)
    sizes = []
    held = storage.cut_lineage

    def counted(df):
        out = held(df)
        if {"v", "embedding"} & set(out.columns):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(cells, "cut_lineage", counted)
    g = np.random.default_rng(5)
    data = [(i, g.normal(size=64).tolist()) for i in range(600)]
    edges = similarity.similar_trees(spark.createDataFrame(data, "id long, embedding array<float>"), 0.4).collect()
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in data]
    assert partition(range(600), [(r["a"], r["b"]) for r in edges]) == partition(range(600), list(similar(data, 0.4)))
    assert sum(sizes) <= 600
