"""A corpus from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of `documents`. Null doc_ids, empty texts and repeated rows are handled as each stage's function says; an empty
table passes through all stages. Texts may be of any length: each stage reads them whole. Columns beyond those of `documents` are dropped at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language_id, mixing, pii, signature_trees
from corpusloom.llm.common import WORD, table
from corpusloom.plans.storage import cut_lineage, drop, temporary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: word n-grams and the similarity in percent.
NGRAM, PERCENT = 5, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The pipeline's result holds digests and token files' bytes, which SQL can't derive.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that was learned; those without letters, or unlike all of these, go.

    Learned from the labelled documents outside the held-out fifth. A null lang becomes the predicted one."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language_id.fit(docs.where(fold != 0))
    kept = language_id.accepted(language_id.identify(docs, model, *COLUMNS))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, one row of it; null ids all stay.

    Where rows of one doc_id have different texts, each text counts as a document, ordered by doc_id and then the text's beginning."""
    own = docs.where("doc_id IS NOT NULL").select(*COLUMNS)
    twice = cut_lineage(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        first = signature_trees.join(own, NGRAM, PERCENT).where("doc_id = component_id").select("doc_id")
        one = own.join(first, "doc_id", "left_semi")
    else:
        rank = Window.partitionBy("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()).orderBy("text", "lang", "source", "n_chars")
        texts = own.join(twice, "doc_id", "left_semi").withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")
        # further texts of an id get ids of their own above all others
        top = own.agg(F.max("doc_id")).first()[0] + 1
        rest = texts.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) == 1).withColumn("_n", F.monotonically_increasing_id())
        rest = rest.withColumn("_id", F.when(F.col("_first"), F.col("doc_id").cast("long")).otherwise(F.col("_n") + top)).drop("_first", "_n")
        every = cut_lineage(own.join(twice, "doc_id", "left_anti").withColumn("_id", F.col("doc_id").cast("long")).select(*COLUMNS, "_id").unionByName(rest.select(*COLUMNS, "_id")))
        joined = signature_trees.join(every.select(F.col("_id").alias("doc_id"), "text"), NGRAM, PERCENT).select(F.col("doc_id").alias("_id"), "component_id")
        # the smallest of a group by doc_id, not by the ids given here
        least = every.select("_id", "doc_id", F.xxhash64("text").alias("_t"), F.substring("text", 1, 64).alias("_s")).join(joined, "_id").groupBy("component_id").agg(F.min(F.struct("doc_id", "_s", "_t", "_id")).alias("_m"))
        one = every.join(least.select(F.col("_m._id").alias("_id")), "_id", "left_semi")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind; no document goes."""
    rows = pii.annotate(docs, pii.fit(docs), "doc_id", "lang", "source", redacted=True)
    return rows.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document as often as the mix takes it, in the order of the mix' slots over all parts of the output;
    where the mix stops inside a document, its words up to there.

    Of rows that agree in doc_id, source and text, one stands for all in what the mix takes of them."""
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "source", "text"))
    sizes = cut_lineage(mixing.sized(keyed).select(F.col("_key").alias("doc_id"), F.col("_key").cast("string").alias("key"), "source", "size"))
    _, turns = mixing.plan(sizes)
    if turns is None:
        return docs.select(*COLUMNS).where("false")
    if not sizes.groupBy("doc_id").count().where("count > 1").isEmpty():
        rank = Window.partitionBy("_key").orderBy(*COLUMNS)
        keyed = keyed.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")
    times = keyed.join(turns.select(F.col("_d").alias("_key"), "words", "taken", "slot", "point", "turn"), "_key")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    text = F.when(F.col("words") == F.col("taken"), F.col("text")).otherwise(part)
    # slots are blocks of equally many words, so equal shares of them are equal parts of the mix
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = times.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return ready.repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col("point") * n)).cast("int")).sortWithinPartitions("slot", "turn", "doc_id").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text as little-endian 32-bit integers, and a digest of what they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, "doc_id", "source", decoded="decoded")
    return rows.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary() as kept:
            rows = cut_lineage(stage(spark, docs, sf_dir))
            kept.append(rows)
        drop(docs)
        docs = rows
    return STAGES[-1][1](spark, docs, sf_dir)
