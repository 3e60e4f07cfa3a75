"""The claim ledger: decisions of sources on facts become masses, grades and report rows.

Tables: facts (fact, claim_type), decisions (fact, source, coverage, stance, contradiction_type, confidence,
support_ids, contradiction_ids), evidence (id, evidence_class, confidence, verified), sources (source, cluster, q).
Everything is one chain of joins and aggregations; per fact, a cluster counts with its strongest source only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clamp, lookup
from corpusloom.plans.storage import cut_lineage


@dataclass(frozen=True)
class Policy:
    """Weights and thresholds; the defaults are the published policy's."""

    # Dimension weights, class multipliers, stance values, thresholds.
    weights: dict = field(default_factory=lambda: {"authority": 0.20, "firsthand": 0.15, "temporal": 0.10, "documentary": 0.20, "independence": 0.15, "expertise": 0.10, "bias_safety": 0.10})
    multipliers: dict = field(default_factory=lambda: {"E1": 1.00, "E2": 0.90, "E3": 0.78, "E4": 0.82, "E5": 0.45, "E6": 0.60, "E7": 0.35})
    stances: dict = field(default_factory=lambda: {"explicit_support": 1.0, "implicit_support": 0.5, "explicit_contradiction": -1.5, "mixed": 0.0, "silent": 0.0})
    penalised: tuple = ("D1_FACTUAL",)
    meaningful: float = 0.20
    serious: float = 0.45
    established: float = 1.20
    established_clusters: int = 2
    probable: float = 0.65
    probable_clusters: int = 1
    plausible: float = 0.20

    def __post_init__(self):
        if abs(sum(self.weights.values()) - 1) > 1e-6:
            raise ValueError("dimension weights must sum to 1")
        own, s = Policy.__dataclass_fields__, self.stances
        for name in ("weights", "multipliers", "stances"):
            if set(getattr(self, name)) != set(own[name].default_factory()):
                raise ValueError(f"{name} must name each of {', '.join(own[name].default_factory())}")
        checks = {
            "class multipliers lie between 0 and 1": all(0 <= m <= 1 for m in self.multipliers.values()),
            "dimension weights lie between 0 and 1": all(0 <= w <= 1 for w in self.weights.values()),
            "silent and mixed stances have the value 0": s["silent"] == s["mixed"] == 0,
            "support is positive, implicit support no more than explicit, contradiction negative": s["explicit_support"] > 0 and 0 <= s["implicit_support"] <= s["explicit_support"] and s["explicit_contradiction"] < 0,
            "only D1_FACTUAL is penalised": set(self.penalised) <= {"D1_FACTUAL"},
            "thresholds are positive": min(self.meaningful, self.serious, self.plausible) > 0,
            "established needs at least what probable needs, and that what plausible needs": self.established >= self.probable >= self.plausible and self.established_clusters >= self.probable_clusters >= 1,
        }
        if failed := [what for what, ok in checks.items() if not ok]:
            raise ValueError("; ".join(failed))


def source_quality(dimensions: dict[str, Column], policy: Policy = Policy()) -> Column:
    """Weighted geometric mean; a dimension of weight 0 doesn't count, one of value 0 gives 0."""
    held = [(w, dimensions[k]) for k, w in policy.weights.items() if w]
    zero, total = F.lit(False), F.lit(0.0)
    for w, x in held:
        zero, total = zero | (x <= 0), total + w * F.log(F.greatest(x, F.lit(1e-300)))
    return F.when(zero, 0.0).otherwise(F.exp(total))


def _sides(support: Column, against: Column) -> Column:
    """Ids of both kinds with is_up, which tells the supporting ones."""
    return F.concat(F.transform(support, lambda i: F.struct(i.alias("id"), F.lit(True).alias("is_up"))), F.transform(against, lambda i: F.struct(i.alias("id"), F.lit(False).alias("is_up"))))


def strongest(is_up: Column, evidence_class: Column, confidence: Column, verified: Column, policy: Policy = Policy()) -> list[Column]:
    """Aggregates over the evidence of a decision: up and down, the strongest verified evidence on either side, null without
    any, and classes, a bit for each class of the supporting one in the order of the multipliers. is_up: which side; null: none."""
    kind = F.when(evidence_class.isin(*policy.multipliers), evidence_class).otherwise("E7")
    factor = lookup(kind, {k: str(v) for k, v in policy.multipliers.items()}).cast("double") * clamp(confidence)
    bit = lookup(kind, {k: str(1 << i) for i, k in enumerate(policy.multipliers)}).cast("int")
    of = lambda up, c: F.when(verified & (is_up == up), c)
    return [F.max(of(True, factor)).alias("up"), F.max(of(False, factor)).alias("down"), F.bit_or(of(True, bit)).alias("classes")]


def evidence_factors(decisions: DataFrame, evidence: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """fact, source and the columns of `strongest`, by a decision's supporting and contradicting ids: one pass over both
    kinds of ids. Evidence that carries its fact and source needs no ids: group it by these with `strongest`."""
    each = decisions.select("fact", "source", F.explode(_sides(F.array_distinct("support_ids"), F.array_distinct("contradiction_ids"))).alias("e")).select("fact", "source", "e.*")
    known = evidence.where("verified").select("id", "evidence_class", F.col("confidence").alias("_c"))
    return each.join(known, "id").groupBy("fact", "source").agg(*strongest(F.col("is_up"), F.col("evidence_class"), F.col("_c"), F.lit(True), policy))


def strengths(stance: Column, contradiction_type: Column, policy: Policy = Policy()) -> tuple[Column, Column]:
    """Support and contradiction by stance; only penalised types contradict, mixed does both."""
    v = policy.stances
    support = F.when(stance.isin("explicit_support", "mixed"), max(0.0, v["explicit_support"])).when(stance == "implicit_support", max(0.0, v["implicit_support"])).otherwise(0.0)
    against = F.when(stance.isin("explicit_contradiction", "mixed") & F.coalesce(contradiction_type.isin(*policy.penalised), F.lit(False)), abs(v["explicit_contradiction"])).otherwise(0.0)
    return support, against


def contributions(decisions: DataFrame, evidence: DataFrame | None, sources: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Every decision with cluster, q, support and against: quality x evidence x confidence x strength.

    decisions: one row for each fact and source. evidence: sought by the decisions' ids; None where the decisions have the
    columns of `strongest` already."""
    rows = decisions if evidence is None else decisions.join(evidence_factors(decisions, evidence, policy), ["fact", "source"], "left")
    s, a = strengths(F.col("stance"), F.col("contradiction_type"), policy)
    weight = F.col("q") * clamp(F.col("confidence"))
    rows = rows.join(sources.select("source", "cluster", "q"), "source")
    return rows.withColumn("support", weight * F.coalesce("up", F.lit(0.0)) * s).withColumn("against", weight * F.coalesce("down", F.lit(0.0)) * a).withColumn("classes", F.coalesce("classes", F.lit(0)))


def cluster_masses(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Per fact and cluster the strongest support and contradiction, the best quality that covers the fact, and counts.
    Every fact has one row of a source, so sources are counted by rows and all sums begin before the shuffle."""
    bit = {k: 1 << i for i, k in enumerate(policy.multipliers)}
    return rows.groupBy("fact", "cluster").agg(
        F.max("support").alias("support"),
        F.max("against").alias("against"),
        F.max(F.when(F.col("coverage") != "not_covered", F.col("q"))).alias("covered"),
        F.count_if(F.col("support") > 0).alias("supporting"),
        F.count_if(F.col("against") > 0).alias("contradicting"),
        *[F.count_if(F.col("classes").bitwiseAND(bit[c]) > 0).alias(c) for c in ("E1", "E2", "E4")],
        F.count("*").alias("decisions"),
    )


def scores(facts: DataFrame, clusters: DataFrame, total_quality: Column, policy: Policy = Policy()) -> DataFrame:
    """Masses, indexes, counts, grade and tier of every fact; facts without decisions have none."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = clusters.groupBy("fact").agg(
        F.sum("support").alias("support_mass"),
        F.sum("against").alias("contradiction_mass"),
        F.coalesce(F.sum("covered"), F.lit(0.0)).alias("covered"),
        F.count_if(F.col("support") >= policy.meaningful).alias("independent_support_count"),
        F.greatest(F.lit(0), F.sum("supporting") - F.count_if(F.col("support") > 0)).cast("long").alias("dependent_support_count"),
        count("E1").alias("primary_document_count"),
        count("E2").alias("eyewitness_count"),
        count("E4").alias("scholarly_count"),
        count("contradicting").alias("serious_contradiction_count"),
        count("decisions").alias("decisions"),
    )
    a, d = F.col("support_mass"), F.col("contradiction_mass")
    graded = facts.join(sums, "fact").select(
        "*",
        (100 * (a - d) / (1 + a + d)).alias("research_index"),
        (100 * (1 - F.exp(-(a + d)))).alias("evidence_strength"),
        F.when(a + d > 0, 2 * F.least(a, d) / (a + d)).otherwise(0.0).alias("conflict_index"),
        F.when(total_quality > 0, F.col("covered") / total_quality).otherwise(0.0).alias("evidence_coverage"),
    )
    g = grade(F.col("claim_type"), a, d, F.col("independent_support_count"), F.col("primary_document_count"), policy)
    return graded.withColumn("grade", g).withColumn("confidence_tier", lookup(F.col("grade"), TIERS))


def grade(claim_type: Column, a: Column, d: Column, clusters: Column, primary: Column, policy: Policy = Policy()) -> Column:
    """The grade's rules in order: kinds of claims first, then contested, established, probable, plausible."""
    calm = d < policy.serious
    return (
        F.when(claim_type == "INTERPRETATION", "INTERPRETATION")
        .when(claim_type.isin("CAUSAL_INTERPRETATION", "MOTIVE_CLAIM"), "CAUSAL_INTERPRETATION")
        .when(claim_type == "REPORTED_SPEECH", "SOURCE_REPORT")
        .when(~calm & (a >= policy.meaningful), "FACT_CONTESTED")
        .when(calm & (a >= policy.established) & (clusters >= policy.established_clusters) & ((primary >= 1) | (clusters >= 3)), "FACT_ESTABLISHED")
        .when(calm & (a >= policy.probable) & (clusters >= policy.probable_clusters), "FACT_PROBABLE")
        .when(calm & (a >= policy.plausible), "FACT_PLAUSIBLE")
        .otherwise("FACT_UNVERIFIED")
    )


# Tiers by grade, and the ledger's order.
TIERS = {
    "INTERPRETATION": "Interpretive claim — factual tier not applicable",
    "CAUSAL_INTERPRETATION": "Interpretive claim — heightened scrutiny",
    "SOURCE_REPORT": "Source report — occurrence not independently established",
    "FACT_CONTESTED": "Tier 4 — Contested",
    "FACT_ESTABLISHED": "Tier 1 — Established",
    "FACT_PROBABLE": "Tier 2 — Probable",
    "FACT_PLAUSIBLE": "Tier 3 — Plausible / unverified",
    "FACT_UNVERIFIED": "Tier 5 — Unsupported / speculative",
}
RANKED = ("FACT_CONTESTED", "FACT_ESTABLISHED", "FACT_PROBABLE", "FACT_PLAUSIBLE")


def total_cluster_quality(sources: DataFrame) -> DataFrame:
    """One row, total: the best quality of each cluster, summed up."""
    return sources.groupBy("cluster").agg(F.max("q").alias("q")).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("total"))


def score_facts(facts: DataFrame, decisions: DataFrame, evidence: DataFrame | None, sources: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Scores of all facts that have decisions; evidence as in `contributions`."""
    total = F.broadcast(total_cluster_quality(sources))  # one row
    return scores(facts.crossJoin(total), cluster_masses(contributions(decisions, evidence, sources, policy), policy), F.col("total"), policy).drop("total")


def incomplete(facts: DataFrame, sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """fact, have and need of facts that lack a source's decision."""
    need = sources.agg(F.count_distinct("source").alias("need"))
    have = decisions.groupBy("fact").agg(F.count_distinct("source").alias("have"))
    return facts.select("fact").join(have, "fact", "left").crossJoin(need).select("fact", F.coalesce("have", F.lit(0)).alias("have"), "need").where("have < need")


def open_pairs(facts: DataFrame, sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs of fact and source that still need a decision: each pair gets exactly one."""
    return facts.select("fact").crossJoin(sources.select("source")).join(decisions.select("fact", "source"), ["fact", "source"], "left_anti")


def held_stance(stance: Column, up: Column, down: Column) -> Column:
    """The stance that evidence bears out; up, down: whether there is any on that side."""
    return (
        F.when(up & down, "mixed")
        .when(up, F.when(stance.isin("explicit_support", "implicit_support"), stance).otherwise("explicit_support"))
        .when(down, "explicit_contradiction")
        .otherwise("silent")
    )


def sanitized(stance: Column, support: Column, against: Column, kind: Column, allowed: Column) -> Column:
    """A model's decision, held to the evidence that it was shown: ids outside of it go, stance and coverage follow."""
    up, down = (F.filter(x, lambda i: F.array_contains(allowed, i)) for x in (support, against))
    s = held_stance(stance, F.size(up) > 0, F.size(down) > 0)
    return F.struct(s.alias("stance"), F.when(s == "silent", "covered_but_silent").otherwise("covered").alias("coverage"), up.alias("support_ids"), down.alias("contradiction_ids"), F.when(F.size(down) > 0, kind).alias("contradiction_type"))


def decision_error(stance: Column, coverage: Column, support: Column, against: Column, kind: Column) -> Column:
    """Why a decision contradicts itself, or null."""
    up, down, typed = F.size(support) > 0, F.size(against) > 0, kind.isNotNull()
    return (
        F.when((stance == "silent") & (up | down | typed), "silent decisions hold no evidence and no type")
        .when(stance.isin("explicit_support", "implicit_support") & (~up | down | typed), "support holds support evidence only")
        .when((stance == "explicit_contradiction") & (~down | up | ~typed), "contradiction holds contradicting evidence and a type")
        .when((stance == "mixed") & ~(up & down & typed), "mixed holds both kinds of evidence and a type")
        .when(~coverage.isin("not_covered", "covered", "covered_but_silent"), "unknown coverage")
    )


def consistent_coverage(stance: Column, coverage: Column) -> Column:
    """Coverage as the stance has it: a silent source either covers the matter or doesn't, others cover it."""
    return F.when(stance != "silent", "covered").when(coverage == "not_covered", coverage).otherwise("covered_but_silent")


def ledger_order(rows: DataFrame, text: str = "claim") -> DataFrame:
    """Adds label, F and six digits, in the ledger's order: by grade, then strength, then text.

    Rows are sorted by ranges of all three, so equal grades and strengths are no hot spot, and written; a row's position
    is its place in its range and the rows of the ranges before, of which there is one number each."""
    rank = F.when(F.col("grade").isin(*RANKED), F.array_position(F.array(*[F.lit(x) for x in RANKED]), F.col("grade")) - 1).otherwise(4)
    ordered = cut_lineage(rows.withColumn("_rank", rank).orderBy("_rank", F.desc("evidence_strength"), text).drop("_rank").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    position = (F.col("_before") + F.col("_id") - F.shiftleft("_part", 33) + 1).cast("long")
    placed = ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("position", position)  # a row for each range
    return placed.withColumn("label", F.concat(F.lit("F"), F.format_string("%06d", "position"))).drop("_id", "_part", "_before")


BUCKETS = ("explicit_support", "implicit_support", "explicit_contradiction", "mixed", "covered_but_silent", "not_covered")


def bucket(stance: Column, coverage: Column) -> Column:
    return F.when(stance == "silent", coverage).otherwise(stance)


def source_buckets(decisions: DataFrame, titles: DataFrame) -> DataFrame:
    """Per fact a column for each bucket: titles in source order, one on each line."""
    named = decisions.join(titles, "source").withColumn("bucket", bucket(F.col("stance"), F.col("coverage")))
    rows = named.groupBy("fact").agg(F.array_sort(F.collect_list(F.struct("source", "title", "bucket"))).alias("all"))
    held = lambda b: F.array_join(F.transform(F.filter("all", lambda x: x["bucket"] == b), lambda x: x["title"]), "\n")
    return rows.select("fact", *[held(b).alias(b) for b in BUCKETS])


def grade_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("grade").agg(F.count("*").alias("n"))


# The export's columns with their names there.
LEDGER = {
    "label": "Fact ID",
    "event": "Event",
    "taxonomy": "Taxonomy",
    "claim": "Canonical atomic claim",
    "claim_type": "Claim type",
    "source_date": "Source date",
    "normalized_date": "Normalized date",
    "calendar": "Calendar",
    "location": "Location",
    "grade": "Classification",
    "confidence_tier": "Confidence tier",
    "research_index": "Evidence direction index",
    "strength_pct": "Evidence strength %",
    "coverage_pct": "Coverage %",
    "conflict_pct": "Conflict index %",
    "independent_support_count": "Independent support",
    "dependent_support_count": "Dependent support",
    "primary_document_count": "Supporting E1 documents",
    "eyewitness_count": "Supporting E2 eyewitnesses",
    "scholarly_count": "Supporting E4 scholarship",
    "serious_contradiction_count": "Serious D1 contradictions",
    "explicit_support": "Explicit support",
    "implicit_support": "Implicit support",
    "explicit_contradiction": "Contradiction/discrepancy",
    "mixed": "Mixed",
    "covered_but_silent": "Covered but silent",
    "not_covered": "Not covered",
}
EVIDENCE = {
    "label": "Fact ID",
    "fact": "Database ID",
    "claim": "Canonical claim",
    "source": "Source ID",
    "title": "Source title",
    "cluster": "Independence cluster",
    "q": "Source quality q_i",
    "coverage": "Coverage",
    "stance": "Stance",
    "contradiction_type": "Disagreement type",
    "confidence": "Alignment confidence",
    "supporting": "Supporting evidence",
    "contradicting": "Contradicting/discrepant evidence",
    "rationale": "Rationale",
    "chronology_notes": "Chronology notes",
    "scope_notes": "Scope notes",
}


def _or_empty(rows: DataFrame, *names: str) -> dict[str, Column]:
    """The text columns by name; empty where the table hasn't got them or they're null."""
    return {n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit("") for n in names}


def ledger_rows(ordered: DataFrame, buckets: DataFrame) -> DataFrame:
    """The export's rows: fact and the columns of LEDGER; shares are percentages, all rounded to four places."""
    rounded = {"research_index": F.col("research_index"), "strength_pct": F.col("evidence_strength"), "coverage_pct": F.col("evidence_coverage") * 100, "conflict_pct": F.col("conflict_index") * 100}
    made = {k: F.round(v, 4) for k, v in rounded.items()} | _or_empty(ordered, "event", "taxonomy", "source_date", "normalized_date", "calendar", "location")
    return ordered.join(buckets, "fact", "left").select("fact", *[made.get(c, F.col(c)).alias(c) for c in LEDGER])


def source_evidence(ordered: DataFrame, decisions: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each fact and source, with the columns of EVIDENCE: the decision, the quality of its source, and the
    texts of the evidence on both sides, in the order of its ids.

    ordered: fact, label, claim. sources: source, title, cluster, q. evidence: id, text."""
    keyed = decisions.select("fact", "source", F.posexplode(_sides(F.col("support_ids"), F.col("contradiction_ids"))).alias("pos", "e"))
    said = keyed.select("fact", "source", "pos", "e.*").join(evidence.select("id", "text"), "id")
    joined = lambda up: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_up") == up, F.struct("pos", "text")))), lambda x: x["text"]), "\n\n")
    texts = said.groupBy("fact", "source").agg(joined(True).alias("up"), joined(False).alias("down"))
    rows = decisions.join(ordered.select("fact", "label", "claim"), "fact").join(sources.select("source", "title", "cluster", "q"), "source").join(texts, ["fact", "source"], "left")
    rows = rows.withColumn("supporting", F.coalesce("up", F.lit(""))).withColumn("contradicting", F.coalesce("down", F.lit("")))
    made = _or_empty(rows, "contradiction_type", "rationale", "chronology_notes", "scope_notes")
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in EVIDENCE])


def report(rows: DataFrame) -> DataFrame:
    """label and markdown: a section of the report for each fact."""
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c.cast("string"))
    ratio = lambda c: F.format_string("%.2f", F.col(c))
    held = [F.when(F.length(b) > 0, F.concat(F.lit(f"- {b.replace('_', ' ')}: "), F.replace(F.col(b), F.lit("\n"), F.lit("; ")))) for b in BUCKETS]
    return rows.select("label", F.concat_ws("\n", F.concat(F.lit("## "), "label", F.lit(" "), "claim"), line("Classification", F.col("grade")), line("Tier", F.col("confidence_tier")), line("Direction", ratio("research_index")), line("Strength %", ratio("strength_pct")), line("Coverage %", ratio("coverage_pct")), line("Conflict %", ratio("conflict_pct")), *held).alias("markdown"))


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: what is done and what is open in each table.

    tables: sources, pages, chunks (extracted_at, extraction_error), raw_facts, canonical_facts, stances, scores."""
    parts = [
        tables["sources"].agg(F.count("*").alias("sources")),
        tables["pages"].agg(F.count("*").alias("pages")),
        tables["chunks"].agg(F.count("*").alias("chunks"), F.count_if(F.col("extracted_at").isNotNull()).alias("chunks_extracted"), F.count_if(F.col("extraction_error").isNotNull()).alias("chunks_failed")),
        tables["raw_facts"].agg(F.count("*").alias("raw_facts")),
        tables["canonical_facts"].agg(F.count("*").alias("canonical_facts")),
        tables["stances"].agg(F.count("*").alias("decisions")),
        tables["scores"].agg(F.count("*").alias("scores")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out.withColumn("decisions_missing", F.greatest(F.lit(0), F.col("canonical_facts") * F.col("sources") - F.col("decisions")))


def partition_error(observed: Column, expected: Column) -> Column:
    """Whether groups of ids fail to hold each expected id exactly once."""
    return ~(F.array_sort(observed) == F.array_sort(expected))


def canonical_members(groups: DataFrame) -> DataFrame:
    """canonical_id and member for groups (ids): the id is a digest of the sorted members. Groups are bounded components."""
    return groups.select(F.substring(F.sha2(F.array_join(F.array_sort("ids"), "\u0000"), 256), 1, 32).alias("canonical_id"), F.explode("ids").alias("member"))


def located_facts(facts: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts with the label of the page that their chunk is from. facts: chunk_id. chunks: id, page_id. pages: id, page_label."""
    c = chunks.select(F.col("id").alias("chunk_id"), "page_id")
    return facts.join(c, "chunk_id").join(pages.select(F.col("id").alias("page_id"), "page_label"), "page_id")


def member_similarity(members: DataFrame, canonical: DataFrame, facts: DataFrame) -> DataFrame:
    """canonical_id, raw_fact_id and similarity of every member with its canonical fact. Both tables: id, embedding."""
    from corpusloom.functions.vectors import cosine

    c = canonical.select(F.col("id").alias("canonical_id"), F.col("embedding").alias("_c"))
    f = facts.select(F.col("id").alias("raw_fact_id"), F.col("embedding").alias("_f"))
    return members.join(c, "canonical_id").join(f, "raw_fact_id").select("canonical_id", "raw_fact_id", cosine(F.col("_c"), F.col("_f")).alias("similarity"))
