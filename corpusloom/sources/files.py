"""Files as tables: discovery, text, policy and glossary documents, stage outputs, ledgers, review queues."""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def discover(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]", content: bool = False) -> DataFrame:
    """path, name, length, sha256 of the folder's files, and on demand their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))


def collisions(files: DataFrame) -> DataFrame:
    """stem and names of files whose names differ in case or composition of characters only."""
    from corpusloom.operators.rows import arrow

    stem = arrow(lambda x: unicodedata.normalize("NFC", x.rpartition(".")[0] or x).casefold(), "string")(F.col("name"))
    return files.withColumn("stem", stem).groupBy("stem").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") > 1)


def inside(files: DataFrame, folder: str) -> DataFrame:
    """Files of a local folder whose path, links resolved, stays in the folder."""
    from corpusloom.operators.rows import arrow

    root = os.path.realpath(folder.removeprefix("file:"))
    stays = arrow(lambda p: os.path.commonpath([root, os.path.realpath(re.sub(r"^file:/*", "/", p))]) == root, "boolean")
    return files.where(stays(F.col("path")))


def by_name(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower("name"), "name")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Characters of a page below which its text counts as missing and is recognised from the image.
LEAST_TEXT = 40


def needs_recognition(text):
    return F.length(strip(F.coalesce(text, F.lit("")))) < LEAST_TEXT


#: Rows and bytes of strings and images that a batch holds at most before it's given on; one row may be larger.
BATCH_ROWS, BATCH_BYTES = 256, 16_000_000
#: Pages of a file that one task reads.
RANGE = 64


def _batches(rows, schema):
    """Arrow batches of a stream of dicts; only one batch is held at a time."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, (str, bytes)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _spread(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Small rows that stand for much work over a fixed number of tasks: without one, Spark would put them together by
    their own size."""
    return rows.repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _arrow_schema(kind: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def pages(files: DataFrame, extract, recognize=None) -> DataFrame:
    """name, page_number, text, used_ocr, text_sha256 for files with content.

    extract(bytes) gives the pages' texts; recognize(bytes, page) reads a page whose text is too short. A file's pages
    are one task's; files of many pages are better read by `spread_pages`."""

    def read(content):
        for i, text in enumerate(extract(content), 1):
            short = len((text or "").strip()) < LEAST_TEXT and recognize is not None
            yield {"page_number": i, "text": recognize(content, i) if short else text or "", "used_ocr": short}

    return expand(files, read, "page_number int, text string, used_ocr boolean").withColumn("text_sha256", F.sha2("text", 256))


def expand(files: DataFrame, read, kind: str) -> DataFrame:
    """name and the fields of `kind` for each row that read(bytes) gives: page labels, metadata, rendered or rectified
    pages, or whatever a reader of the format finds. kind: a SQL field list. Rows are passed on as they come."""
    schema = _arrow_schema(f"name string, {kind}")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(({"name": name, **row} for row in read(content)), schema)

    return files.select("name", "content").mapInArrow(run, f"name string, {kind}")


def _opened(path: str):
    """A file that can be read from any place on, wherever it lies: a path, or an address of HDFS or an object store."""
    import pyarrow.fs

    system, place = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return system.open_input_file(place)


def page_ranges(files: DataFrame, count, per: int = RANGE) -> DataFrame:
    """path, name, first and last: ranges of at most `per` pages, spread over tasks whatever file they are of.

    files: path, name; contents aren't needed. count(file) gives a file's number of pages; one without pages has no range."""
    schema = _arrow_schema("path string, name string, pages int")

    def run(batches):
        for batch in batches:
            yield from _batches(_counted(batch), schema)

    def _counted(batch):
        for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with _opened(path) as file:
                yield {"path": path, "name": name, "pages": count(file)}

    counted = _spread(files.select("path", "name"), "path").mapInArrow(run, "path string, name string, pages int").where("pages > 0")
    firsts = F.sequence(F.lit(1), F.col("pages"), F.lit(per))
    return counted.select("path", "name", "pages", F.explode(firsts).alias("first")).select("path", "name", "first", F.least(F.col("first") + per - 1, "pages").alias("last"))


def spread_pages(files: DataFrame, count, readers: dict, columns: list[str] | None = None, per: int = RANGE, tasks: int | None = None) -> DataFrame:
    """name, page_number and the wanted columns of every page. A large file is read by as many tasks as it has ranges,
    each opening it by its path; no task holds more than a batch of pages, and lost tasks read their ranges again.

    readers: by column its SQL type and a function (file, page) to its value; those of columns that aren't wanted are
    never called, so no page is rendered for its text only. tasks: over how many tasks ranges are dealt, as many as
    shuffles have partitions if not given."""
    wanted = {c: readers[c] for c in (readers if columns is None else columns)}
    kind = ", ".join(["name string", "page_number int", *(f"`{c}` {t}" for c, (t, _) in wanted.items())])
    schema = _arrow_schema(kind)

    def rows(batch):
        for path, name, first, last in zip(*(batch.column(i).to_pylist() for i in range(4))):
            with _opened(path) as file:
                for i in range(first, last + 1):
                    yield {"name": name, "page_number": i, **{c: f(file, i) for c, (_, f) in wanted.items()}}

    def run(batches):
        for batch in batches:
            yield from _batches(rows(batch), schema)

    return _spread(page_ranges(files, count, per), "path", "first", tasks=tasks).mapInArrow(run, kind)


def described(files: DataFrame, read) -> DataFrame:
    """name, encrypted, labels (of pages, in order) and metadata of every file; read(bytes) gives these three as a dict.

    Of encrypted files only that is known."""
    rows = expand(files, lambda content: [read(content)], "encrypted boolean, labels array<string>, metadata map<string,string>")
    open_ = ~F.coalesce("encrypted", F.lit(False))
    return rows.select("name", (~open_).alias("encrypted"), F.when(open_, F.col("labels")).alias("labels"), F.when(open_, F.col("metadata")).alias("metadata"))


def rasterised(files: DataFrame, sizes, render, dpi: int, max_pages: int, max_pixels: int) -> DataFrame:
    """name, page_number, width, height, image and error: pages rendered at so many dots per inch.

    sizes(bytes) gives the pages' widths and heights in points, or None for an encrypted file; render(bytes, page, dpi)
    an image. A file with too many pages, or none, is one row with its error, a page with too many pixels as well."""

    def read(content):
        pages = sizes(content)
        if pages is None or not 0 < len(pages) <= max_pages:
            yield {"page_number": None, "width": None, "height": None, "image": None, "error": "encrypted" if pages is None else f"{len(pages)} pages, allowed are 1 to {max_pages}"}
            return
        for i, (w, h) in enumerate(pages, 1):
            wide, high = math.ceil(w * dpi / 72), math.ceil(h * dpi / 72)
            fits = wide * high <= max_pixels
            yield {"page_number": i, "width": wide, "height": high, "image": render(content, i, dpi) if fits else None, "error": None if fits else f"{wide * high} pixels, allowed are {max_pixels}"}

    return expand(files, read, "page_number int, width int, height int, image binary, error string")


def manifest_errors(sources: DataFrame) -> DataFrame:
    """source and errors of entries whose id or file name is used twice, whatever its case, or whose file is no PDF's plain name."""
    twice = lambda c: F.count("*").over(Window.partitionBy(F.lower(c))) > 1
    checks = ((twice("source"), "source ids must be unique"), (twice("filename"), "file names must be unique"), (~F.col("filename").rlike(r"(?i)^[^/\\]+\.pdf$"), "file names are names of PDFs, without folders"))
    return sources.select("source", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks])).alias("errors")).where(F.size("errors") > 0)


def marked_yaml(text: str, begin: str, end: str) -> dict:
    """The YAML document between two markers of a text; keys may be merged from anchors."""
    import yaml

    start, stop = text.find(begin), text.find(end)
    if start < 0 or stop < start:
        raise ValueError("policy markers are missing")
    body = re.sub(r"\A\s*```\w*\n|\n```\s*\Z", "", text[start + len(begin) : stop])
    found = yaml.safe_load(body)
    if not isinstance(found, dict):
        raise ValueError("the policy is no mapping")
    return found


def glossary(text: str) -> dict[str, str]:
    """A glossary of strings in YAML or JSON, checked."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict) or not all(isinstance(k, str) and isinstance(v, str) and k.strip() and v.strip() for k, v in found.items()):
        raise ValueError("a glossary maps strings to strings")
    return found


def _hashed(files: DataFrame) -> DataFrame:
    """file, length and sha256 of files (path, length), each read as a stream."""
    import hashlib

    kind = "file string, length long, sha256 string"
    schema = _arrow_schema(kind)

    def rows(batch):
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with _opened(path) as file:
                yield {"file": path.rpartition("/")[2], "length": length, "sha256": hashlib.file_digest(file, "sha256").hexdigest()}

    def run(batches):
        for batch in batches:
            yield from _batches(rows(batch), schema)

    return _spread(files.select("path", "length"), "path").mapInArrow(run, kind)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return None
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"])


def write_stage(df: DataFrame, path: str, stage: str, source_hash: str, **stats) -> None:
    """A new version of the stage beside the old one, then its files' hashes, then the manifest that names it.

    The manifest is replaced in one step, so a reader finds the old version whole or the new one, and a write that fails
    or is killed leaves the old one as it was. The version before stays for readers that have begun; older ones, and what
    failed writes left, go. Only one program may write a stage at a time."""
    spark, before = df.sparkSession, _manifest(spark=df.sparkSession, path=path)
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/data-{version}")
    _hashed(_parts(spark, f"{path}/data-{version}")).write.parquet(f"{path}/files-{version}")
    write_text(spark, json.dumps({"stage": stage, "source_hash": source_hash, "version": version, "stats": stats}, sort_keys=True), f"{path}/manifest.json")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {version, before and before["version"]}
    for entry in system.listStatus(folder):
        kind, _, name = entry.getPath().getName().partition("-")
        if entry.isDirectory() and kind in ("data", "files") and name not in kept:
            system.delete(entry.getPath(), True)


def read_stage(spark: SparkSession, path: str, stage: str, source_hash: str, check: bool = True) -> DataFrame:
    """The stage's data; an error if its manifest is missing or tells of another input, or if a file is missing, new or
    changed. check: whether files are hashed for that, which reads them once more."""
    told = _manifest(spark, path)
    if told is None or (told["stage"], told["source_hash"]) != (stage, source_hash):
        raise ValueError(f"stage {stage} isn't there for this input")
    data = f"{path}/data-{told['version']}"
    if check:
        want = spark.read.schema("file string, length long, sha256 string").parquet(f"{path}/files-{told['version']}")
        got = _hashed(_parts(spark, data)).withColumnsRenamed({"length": "_length", "sha256": "_sha256"})
        same = F.col("length").eqNullSafe(F.col("_length")) & F.col("sha256").eqNullSafe(F.col("_sha256"))
        if bad := want.join(got, "file", "full").where(~same).select("file").first():
            raise ValueError(f"stage {stage}: {bad['file']} isn't as it was written")
    return spark.read.parquet(data)


#: Tells spreadsheets that a file is UTF-8.
BOM = "\ufeff"


def write_ledger(rows: DataFrame, path: str, guard: bool = False) -> None:
    """CSV parts with headers that begin with a byte order mark; with guard, cells can't start formulas in spreadsheets."""
    from corpusloom.functions.text import cell_guard

    text = {c for c, kind in rows.dtypes if kind == "string"}
    named = rows.select(*[cell_guard(F.col(c)).alias(c) if guard and c in text else F.col(c) for c in rows.columns])
    named.withColumnRenamed(rows.columns[0], BOM + rows.columns[0]).write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def write_report(sections: DataFrame, path: str) -> None:
    """Markdown in the order of labels, as text parts."""
    sections.repartitionByRange("label").sortWithinPartitions("label").select(F.concat("markdown", F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)


def write_pairs(rows: DataFrame, path: str) -> None:
    """Texts and reports by name: rows (name, text, report as JSON) in two folders that must be new."""
    rows.select("name", "text").write.mode("errorifexists").json(f"{path}/text")
    rows.select("name", "report").write.mode("errorifexists").json(f"{path}/report.json")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, put in place in one step once it's whole; an old one is there until then."""
    names = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}", path)]
    files = names[0].getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(names[0], True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(names[1].toUri(), spark._jsc.hadoopConfiguration()).rename(names[0], names[1], how)


def append_reviews(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_routed(results: DataFrame, path: str) -> None:
    """Two outputs, never overwritten: pass and review."""
    for flag, name in ((False, "pass"), (True, "review")):
        results.where(F.col("needs_review") == flag).write.mode("errorifexists").json(f"{path}/{name}")


def workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """A workbook of small sheets, where the library for it is installed."""
    from openpyxl import Workbook

    from corpusloom.functions.text import cell_guard

    book = Workbook()
    book.remove(book.active)
    for name, df in sheets.items():
        sheet = book.create_sheet(name)
        sheet.append(df.columns)
        for row in df.select(*[cell_guard(F.col(c).cast("string")).alias(c) for c in df.columns]).toLocalIterator():
            sheet.append(list(row))
    book.save(path)


