"""Incremental runs: what is new, changed or gone, and what a change makes invalid."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order, with the tables that each one writes.
STAGES = {"parse": ("pages", "chunks"), "extract": ("raw_facts",), "deduplicate": ("canonical_facts", "fact_members"), "align": ("stances",), "score": ("scores",)}
#: Tables that lose their rows with another one's.
CASCADES = {"pages": ("chunks", "raw_facts"), "chunks": ("raw_facts",), "raw_facts": ("fact_members",), "canonical_facts": ("fact_members", "stances", "scores"), "sources": ("pages", "stances")}


def changed_inputs(found: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs (name, hash) that aren't known with this hash."""
    return found.join(known.select("name", "hash"), ["name", "hash"], "left_anti")


def reconcile(configured: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """key and state: missing (configured, not present) or unconfigured (the other way round)."""
    gone = configured.select(key).join(present.select(key), key, "left_anti").withColumn("state", F.lit("missing"))
    new = present.select(key).join(configured.select(key), key, "left_anti").withColumn("state", F.lit("unconfigured"))
    return gone.unionByName(new)


def fingerprint(**settings) -> str:
    """A digest of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def cleared_from(stage: str) -> list[str]:
    """Tables that are emptied when a run starts at a stage, with all that hangs on them."""
    names = list(STAGES)
    todo = [t for s in names[names.index(stage) :] for t in STAGES[s]]
    for t in todo:
        todo += [x for x in CASCADES.get(t, ()) if x not in todo]
    return todo


def invalidated(old_policy: str | None, new_policy: str, removed_sources: int, evidence_changed: bool, chunking_changed: bool) -> list[str]:
    """Tables that changes make invalid: new chunking all but pages, new evidence or a lost source what was concluded
    from facts, a new policy the scores only."""
    if chunking_changed:
        return ["chunks", *cleared_from("extract")]
    if evidence_changed or removed_sources:
        return cleared_from("deduplicate")
    return ["scores"] if old_policy is not None and old_policy != new_policy else []


def insert_new(target: DataFrame, rows: DataFrame, *key: str, order: str | None = None) -> DataFrame:
    """The target with rows whose key it lacks; of several with one key the first."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(order or key[0]))).where("_k = 1").drop("_k")
    return target.unionByName(first.join(target.select(*key), list(key), "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The target with the rows in place of those that have their key."""
    return target.join(rows.select(*key), list(key), "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def valid_cache(entries: DataFrame, wanted: DataFrame, files: DataFrame) -> DataFrame:
    """name and valid: same input and signature, and every artifact still has its hash.

    entries: name, input_hash, signature, artifacts map<path,hash>. wanted: name, input_hash, signature. files: path, hash."""
    each = entries.select("name", F.explode("artifacts").alias("path", "want")).join(files, "path", "left").groupBy("name").agg(F.every(F.coalesce(F.col("want") == F.col("hash"), F.lit(False))).alias("whole"))
    e = entries.select("name", F.col("input_hash").alias("_i"), F.col("signature").alias("_s"))
    same = F.col("input_hash").eqNullSafe(F.col("_i")) & F.col("signature").eqNullSafe(F.col("_s"))
    return wanted.join(e, "name", "left").join(each, "name", "left").select("name", (F.col("_i").isNotNull() & same & F.coalesce("whole", F.lit(True))).alias("valid"))


def cache_namespace(signature: str, model_digest: str, forced_at: float | None = None) -> str:
    """Where corrections of a model are kept: another signature, model or forced run doesn't see them."""
    return fingerprint(signature=signature, model=model_digest, forced_at=forced_at)


def cached(requests: DataFrame, cache: DataFrame, namespace: str) -> DataFrame:
    """requests (key) with the value that the namespace holds, null where there's none. cache: namespace, key, value."""
    return requests.join(cache.where(F.col("namespace") == namespace).select("key", "value"), "key", "left")
