"""Files that keep coming in, taken in once each; what is known of a document so far is the state of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.chunk import chunk_pages, identify
from corpusloom.plans import translation


def chunk_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, *keys: str):
    """Chunks of new Parquet files' texts, appended to `out`; the checkpoint remembers which files are done.

    Runs once over all that is there; the rows of a batch that ran before are written under the same batch number."""

    def write(batch: DataFrame, number: int) -> None:
        identify(chunk_pages(batch, *keys), keys[0], keys[-1]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(spark.readStream.schema(schema).parquet(folder), write, checkpoint)


def _run(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: What glossary_stream reads.
PROPOSALS = "doc string, pos long, source_text string, draft string, term string, target string"


def glossary_stream(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """The first definition of each term of a document, while chunks keep coming: new Parquet files of proposals in, what
    they change out, as `out/batch=N`.

    The state is one small row for each document and term, the definition of the lowest place so far, so it grows with the
    terms and not with the chunks, and no document is one row. It's in the checkpoint: after a restart the stream goes on
    from there. A chunk that comes late may define a term anew; `glossary_so_far` reads what holds."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(translation.carried_glossary(spark.readStream.schema(PROPOSALS).parquet(folder)), write, checkpoint, "update")


def glossary_so_far(spark: SparkSession, out: str) -> DataFrame:
    """doc, term, target and since: what all batches together say."""
    rows = spark.read.schema("doc string, term string, target string, since long, batch long").parquet(out)
    return rows.groupBy("doc", "term").agg(F.max_by(F.struct("target", "since"), "batch").alias("x")).select("doc", "term", "x.target", "x.since")


TRIED = "key string, candidate string, score double, passed boolean"


def attempts_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, judged: Callable[[DataFrame, int], DataFrame], most: int):
    """Segments that keep coming, each tried until an attempt passes, at most `most` times; all attempts as
    `out/batch=N/attempt=A` with columns key, candidate, score and passed.

    folder: Parquet files with a column key, one row for each segment. judged(open segments, attempt) asks the model and
    gives key, candidate, score and passed. What an attempt gave is written before the next one starts, and is read, not
    asked for again, if the program is started anew after an interruption; a key that came in an earlier batch isn't asked
    about either. Within a batch, segments of equal key are one; those without a key are left out."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("key IS NOT NULL").dropDuplicates(["key"])
        if number:  # batches are done one after another, so earlier ones are whole
            known = spark.read.schema(f"{TRIED}, batch long, attempt int").parquet(out).where((F.col("batch") < number) & (F.col("attempt") == 1))
            rows = rows.join(known.select("key"), "key", "left_anti")
        for attempt in range(1, most + 1):
            path = f"{out}/batch={number}/attempt={attempt}"
            if not _there(spark, f"{path}/_SUCCESS"):
                judged(rows, attempt).select(F.col("key").cast("string"), F.col("candidate").cast("string"), F.col("score").cast("double"), F.col("passed").cast("boolean")).write.mode("overwrite").parquet(path)
            rows = rows.join(spark.read.schema(TRIED).parquet(path).where("passed").select("key"), "key", "left_anti")
            if rows.isEmpty():
                return

    return _run(spark.readStream.schema(schema).parquet(folder), write, checkpoint)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def best_so_far(spark: SparkSession, out: str) -> DataFrame:
    """key, candidate, score, passed, attempt and attempts: what counts of all that was tried, as of one batch."""
    rows = spark.read.schema(f"{TRIED}, batch long, attempt int").parquet(out)
    return translation.best_attempts(rows.drop("batch"), "key")
