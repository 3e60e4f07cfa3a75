"""Runs of the claim ledger over a folder of Parquet tables, stage by stage; each stage adds what is still missing.

Given: sources (source, title, cluster, q), pages (source, page_number, text). Made: chunks, extracted, raw_facts,
fact_vectors, fact_cells, cell_centres, canonical_facts, fact_members, stances, scores, runs. What models answer comes from
functions of DataFrames; answers count only where they fit the text or the evidence that was asked about.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import cells, chunk, graph, quotes, similarity
from corpusloom.plans import claims, lifecycle, models, storage
from corpusloom.plans.settings import Ledger

STAGES = ("parse", "extract", "deduplicate", "align", "score", "export")
#: Parts of the chunks' version besides the settings: a new way of cutting gets a new number.
CHUNKS_VERSION = 1


@dataclass
class Models:
    """extract: chunks (chunk_id, source, page_number, chunk) to claims (chunk_id, claim, claim_type, quote, evidence_class,
    confidence and perhaps event, taxonomy, source_date, normalized_date, calendar, location). embed: facts (id, text) to
    (id, embedding). align: open pairs (fact, claim, source, ids) to decisions (fact, source, stance, contradiction_type,
    confidence, support_ids, contradiction_ids and perhaps rationale, chronology_notes, scope_notes). embedding_model names
    what embed uses: vectors of another name are made anew."""

    extract: Callable[[DataFrame], DataFrame]
    embed: Callable[[DataFrame], DataFrame]
    align: Callable[[DataFrame], DataFrame]
    embedding_model: str = "default"


DETAILS = ("event", "taxonomy", "source_date", "normalized_date", "calendar", "location")
NOTES = ("rationale", "chronology_notes", "scope_notes")
#: Why a source without anything to show doesn't cover a fact.
UNSHOWN = "Nothing extracted from this source is similar enough."


@dataclass
class Project:
    spark: SparkSession
    folder: str
    models: Models | None = None
    settings: Ledger = field(default_factory=Ledger)
    policy: claims.Policy = field(default_factory=claims.Policy)

    # --- tables ---

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def _files(self, name: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        there, files = self._files(name)
        return files.exists(there)

    def _rename(self, old: str, new: str) -> None:
        (there, files), (to, _) = self._files(old), self._files(new)
        if not files.rename(there, to):
            raise OSError(f"{there} can't be renamed to {to}")

    def has(self, name: str) -> bool:
        """Whether the table is there. One whose replacement broke off is put back."""
        if self._exists(name):
            return True
        if self._exists(f"{name}.old"):
            self._rename(f"{name}.old", name)
            return True
        return False

    def table(self, name: str) -> DataFrame:
        self.has(name)
        return self.spark.read.parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> int:
        """Writes the rows beside the table and puts them in its place once they're whole; the number of rows.

        The old rows go last: a run that breaks off leaves them in place, or beside, from where `has` and `table` put them back."""
        seen, new = Observation(f"{name}-{uuid.uuid4().hex}"), f"{name}.{uuid.uuid4().hex}"
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(self.path(new))
        if self.has(name):
            self.clear([f"{name}.old"])
            self._rename(name, f"{name}.old")
        self._rename(new, name)
        self.clear([f"{name}.old"])
        return seen.get["rows"]

    def add(self, name: str, rows: DataFrame) -> int:
        """Appends the rows; their number."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(self.path(name))
        return seen.get["rows"]

    def clear(self, names) -> None:
        for name in names:
            for kept in (f"{name}.old", name):
                there, files = self._files(kept)
                files.delete(there, True)

    # --- stages: each gives its counts ---

    def version(self) -> str:
        return f"{CHUNKS_VERSION}:{self.settings.chunk_size}:{self.settings.chunk_overlap}"

    def parse(self, force: bool = False) -> dict:
        """Chunks of new and changed pages, and of all pages if chunks are cut in another way than those there are. What
        was concluded from chunks that go, goes."""
        pages = self.table("pages").select("source", "page_number", "text", F.sha2("text", 256).alias("page_sha"))
        wanted = pages.select("source", "page_number", "page_sha").withColumn("version", F.lit(self.version()))
        key = ["source", "page_number", "page_sha", "version"]
        old = self.table("chunks") if self.has("chunks") and not force else None
        todo = wanted if old is None else wanted.join(old.select(*key).distinct(), key, "left_anti")
        cut = chunk.chunk_pages(pages.join(todo, key[:3]), *key, size=self.settings.chunk_size, overlap=self.settings.chunk_overlap)
        new = chunk.identify(cut, "source", "page_number").withColumnRenamed("id", "chunk_id")
        gone = 0
        if old is not None:
            kept = old.join(wanted, key, "left_semi")
            gone = old.join(wanted, key, "left_anti").count()
            new = kept.unionByName(new)
        before = old.count() if old is not None else 0
        total = self.replace("chunks", new)
        if gone or force:
            self._forget(self.table("chunks"))
        return {"pages": pages.count(), "chunks": total, "new": total - before + gone, "gone": gone}

    def _forget(self, chunks: DataFrame) -> None:
        """Facts of chunks that are gone go, and what was concluded from facts."""
        for name in ("extracted", "raw_facts"):
            if self.has(name):
                self.replace(name, self.table(name).join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
        self.clear(lifecycle.cleared_from("deduplicate"))

    def extract(self, force: bool = False) -> dict:
        """Facts of chunks that weren't asked about yet; a claim whose quotation isn't on its page is dropped."""
        if force:
            self.clear(["extracted", *lifecycle.cleared_from("extract")])
        chunks = self.table("chunks").select("chunk_id", "source", "page_number", "chunk")
        todo = chunks.join(self.table("extracted").select("chunk_id"), "chunk_id", "left_anti") if self.has("extracted") else chunks
        told = self.models.extract(todo)
        told = told.select("chunk_id", "claim", "claim_type", "quote", "evidence_class", F.col("confidence").cast("double").alias("confidence"), *[(F.col(c) if c in told.columns else F.lit(None)).cast("string").alias(c) for c in DETAILS])
        found = told.join(todo, "chunk_id").withColumn("quote", quotes.resolve_quote(F.col("quote"), F.col("chunk"))).where("quote IS NOT NULL").drop("chunk")
        found = found.withColumn("id", quotes.fact_id(F.col("source"), F.col("page_number"), F.col("claim"), F.col("quote")))
        facts = lifecycle.insert_new(self.table("raw_facts"), found, "id", order="chunk_id") if self.has("raw_facts") else lifecycle.insert_new(found.limit(0), found, "id", order="chunk_id")
        before = self.table("raw_facts").count() if self.has("raw_facts") else 0
        total = self.replace("raw_facts", facts)
        asked = self.add("extracted", todo.select("chunk_id"))
        if total > before:
            self.clear(lifecycle.cleared_from("deduplicate"))
        return {"chunks": asked, "facts": total, "new": total - before}

    def deduplicate(self, force: bool = False) -> dict:
        """Families of alike facts, all or nothing: families that are there stay as they are, unless forced."""
        if force:
            self.clear(lifecycle.cleared_from("deduplicate"))
        if self.has("canonical_facts") and self.has("fact_members"):
            return {"facts": self.table("canonical_facts").count(), "new": 0}
        raw = self.table("raw_facts")
        self.embed()
        vectors = self.table("fact_vectors").select("id", "embedding")
        groups = graph.bounded_components(vectors, self.settings.same_fact, self.settings.component)
        families = groups.groupBy("group", "slice").agg(F.collect_list("id").alias("ids"))  # bounded by the component's size
        members = claims.canonical_members(families).select(F.col("canonical_id").alias("fact"), F.col("member").alias("id"))
        self.replace("fact_members", members)
        best = F.max(F.struct("confidence", *(F.col(c) for c in ("id", "claim", "claim_type", *DETAILS))))
        facts = self.table("fact_members").join(raw, "id").groupBy("fact").agg(best.alias("b")).select("fact", F.col("b.id").alias("head"), "b.claim", "b.claim_type", *[f"b.{c}" for c in DETAILS])
        n = self.replace("canonical_facts", facts)
        return {"facts": n, "new": n}

    def embed(self) -> int:
        """Vectors of facts that have none, or another model's; how many were made."""
        facts, name = self.table("raw_facts").select("id", F.col("claim").alias("text")), self.models.embedding_model
        if self.has("fact_vectors"):
            held = facts.join(self.table("fact_vectors"), "id", "left")
            todo = models.stale(held, name).select("id", "text")
            kept = held.join(todo.select("id"), "id", "left_anti").select("id", "embedding", "embedding_model")
        else:
            todo, kept = facts, None
        todo = storage.cut_lineage(todo)
        n = todo.count()
        if n or kept is None:
            made = self.models.embed(todo).select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(name).alias("embedding_model"))
            kept = made if kept is None else kept.unionByName(made)
        elif kept.count() == self.table("fact_vectors").count():
            return 0
        self.replace("fact_vectors", kept)
        return n

    def filed(self) -> tuple[DataFrame, np.ndarray]:
        """All facts in cells by their vectors, and the cells' centres. Only facts that are new, or whose vector changed, are
        dealt; once there are four times as many facts as the centres were fitted for, all are dealt anew."""
        vectors = self.table("fact_vectors").select("id", "embedding", F.xxhash64("embedding").alias("mark"))
        facts = self.table("raw_facts").select("id", "source").join(vectors, "id").withColumnRenamed("id", "item_id")
        n = facts.count()
        centres = self.table("cell_centres").orderBy("cell").collect() if self.has("cell_centres") else []  # at most cells.MOST_CELLS
        if not centres or not self.has("fact_cells") or n > 4 * max(1, centres[0]["facts"]):
            filed, at = cells.index(facts)
            self.replace("cell_centres", self.spark.createDataFrame([(i, n, c.tolist()) for i, c in enumerate(at)] or [(cells.NOWHERE, n, [])], "cell int, facts long, centre array<double>"))
            marked = filed.join(facts.select("item_id", "mark"), "item_id")
        else:
            at = np.array([c["centre"] for c in centres if c["cell"] != cells.NOWHERE] or np.zeros((0, 0)), float)
            old = self.table("fact_cells").join(facts.select("item_id", "source", "mark"), ["item_id", "source", "mark"], "left_semi")
            new = facts.join(old.select("item_id"), "item_id", "left_anti")
            dealt = cells.deal(cells.unit_items(new), at).join(new.select("item_id", "mark"), "item_id")
            marked = old.unionByName(dealt)
        self.replace("fact_cells", marked)
        return self.table("fact_cells").drop("mark"), at

    def shown(self) -> DataFrame:
        """fact, source and ids: the evidence that the model is shown of every source, the fact's own members first, then
        similar facts, up to the places that the settings give."""
        heads = self.table("canonical_facts").select(F.col("fact").alias("query_id"), F.col("head").alias("id")).join(self.table("fact_vectors"), "id")
        members = self.table("fact_members").select(F.col("fact").alias("query_id"), F.col("id").alias("item_id"))
        found = similarity.retrieve(heads, None, members, self.settings.retrieval, self.settings.top_k, self.filed())
        return similarity.candidates(found).withColumnRenamed("query_id", "fact")

    def align(self, force: bool = False) -> dict:
        """A decision for each fact and source that has none. The model is asked where the source has anything to show, and
        only what it was shown counts; a source with nothing to show doesn't cover the fact."""
        if force:
            self.clear(lifecycle.cleared_from("align"))
        facts, sources = self.table("canonical_facts"), self.table("sources")
        done = self.table("stances").select("fact", "source") if self.has("stances") else facts.select("fact").where("false").withColumn("source", F.lit(None).cast(sources.schema["source"].dataType))
        opened = storage.cut_lineage(claims.open_pairs(facts, sources, done))
        if opened.isEmpty():
            return {"pairs": 0}
        pairs = storage.cut_lineage(opened.join(facts.select("fact", "claim"), "fact").join(self.shown(), ["fact", "source"]).select("fact", "claim", "source", "ids"))
        told = self.models.align(pairs)
        said = told.join(pairs.select("fact", "source", "ids"), ["fact", "source"])
        held = claims.sanitized(F.col("stance"), F.col("support_ids"), F.col("contradiction_ids"), F.col("contradiction_type"), F.col("ids"))
        notes = [(F.col(c) if c in told.columns else F.lit(None)).cast("string").alias(c) for c in NOTES]
        rows = said.withColumn("s", held).select("fact", "source", "s.coverage", "s.stance", "s.contradiction_type", F.col("confidence").cast("double").alias("confidence"), "s.support_ids", "s.contradiction_ids", *notes)
        bare = similarity.unshown(opened.withColumnRenamed("fact", "query_id"), pairs.withColumnRenamed("fact", "query_id")).withColumnRenamed("query_id", "fact")
        rows = rows.unionByName(bare.select("fact", "source", "coverage", "stance", "confidence", F.lit(UNSHOWN).alias("rationale")), allowMissingColumns=True)
        rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("support_ids", "contradiction_ids")})
        n = self.add("stances", lifecycle.insert_new(rows.limit(0), rows, "fact", "source", order="stance"))
        if n:
            self.clear(["scores"])
        return {"pairs": n}

    def score(self, force: bool = False) -> dict:
        """Scores of all facts under the policy; an error if a pair lacks its decision."""
        facts, sources, stances = self.table("canonical_facts"), self.table("sources"), self.table("stances")
        if not claims.incomplete(facts, sources, stances).isEmpty():
            raise ValueError("some facts lack a source's decision")
        digest = lifecycle.fingerprint(**vars(self.policy))
        if not force and self.has("scores") and not self.table("scores").where(F.col("policy") != digest).isEmpty():
            self.clear(lifecycle.invalidated("", digest, 0, False, False))
        if force or not self.has("scores"):
            evidence = self.table("raw_facts").select("id", "evidence_class", "confidence", F.lit(True).alias("verified"))
            self.replace("scores", claims.score_facts(facts, stances, evidence, sources, self.policy).withColumn("policy", F.lit(digest)))
        return {"facts": self.table("scores").count()}

    def export(self, force: bool = False) -> dict:
        """The ledger and the evidence by source as CSV, the report as Markdown, in new folders below `exports`."""
        from corpusloom.sources import files

        ordered, stances, sources = claims.ledger_order(self.table("scores")), self.table("stances"), self.table("sources")
        rows = claims.ledger_rows(ordered, claims.source_buckets(stances, sources.select("source", "title")))
        out = f"{self.folder.rstrip('/')}/exports/{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:6]}"
        texts = self.table("raw_facts").select("id", quotes.evidence_text(F.col("evidence_class"), F.col("page_number"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("quote")).alias("text"))
        files.write_ledger(rows.select(*claims.LEDGER).withColumnsRenamed(claims.LEDGER), f"{out}/ledger")
        files.write_ledger(claims.source_evidence(ordered, stances, sources, texts).withColumnsRenamed(claims.EVIDENCE), f"{out}/evidence", guard=True)
        files.write_report(claims.report(rows), f"{out}/report")
        return {"facts": ordered.count(), "folder": out}

    # --- runs ---

    def sync(self) -> list[str]:
        """What goes because sources were removed: tables of conclusions, if pages or decisions of theirs are left."""
        sources = self.table("sources").select("source")
        lost = [t for t in ("chunks", "raw_facts", "stances") if self.has(t) and not self.table(t).join(sources, "source", "left_anti").isEmpty()]
        if not lost:
            return []
        for t in lost:
            self.replace(t, self.table(t).join(sources, "source", "left_semi"))
        gone = lifecycle.invalidated(None, "", 1, False, False)
        self.clear(gone)
        return gone

    def run(self, start: str = "parse", force: bool = False) -> dict[str, dict]:
        """All stages from `start` on; with force, that stage and what hangs on it are made anew. The counts of each stage
        are added to the table runs."""
        self.sync()
        told = {}
        for stage in STAGES[STAGES.index(start) :]:
            told[stage] = getattr(self, stage)(force and stage == start)
            row = [(stage, time.time(), str(told[stage]))]
            self.add("runs", self.spark.createDataFrame(row, "stage string, at double, counts string"))
        return told

    def checks(self) -> list[tuple[str, bool]]:
        """What a run needs, and whether it's there."""
        out = [(f"table {t}", self.has(t)) for t in ("sources", "pages")]
        if all(ok for _, ok in out):
            sources, pages = self.table("sources"), self.table("pages")
            out.append(("sources are named once", sources.groupBy("source").count().where("count > 1").isEmpty()))
            out.append(("pages are named once", pages.groupBy("source", "page_number").count().where("count > 1").isEmpty()))
            out.append(("all pages have a source", pages.join(sources, "source", "left_anti").isEmpty()))
            out.append(("all sources have pages", sources.join(pages, "source", "left_anti").isEmpty()))
        return [*out, ("models", self.models is not None)]
