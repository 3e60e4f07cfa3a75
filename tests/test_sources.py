"""Large files read by ranges of pages, and stages that appear whole."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files


def test_pages_of_large_files(spark, tmp_path):
    """Pages are lines of ten bytes, found by their place."""
    for name, n in (("big.pages", 2000), ("one.pages", 1), ("none.pages", 0), ("just.pages", 128)):
        (tmp_path / name).write_bytes(b"".join(f"{name[:3]}{i:06d}\n".encode() for i in range(1, n + 1)))
    found = files.discover(spark, str(tmp_path), "*.pages")
    count = lambda f: f.size() // 10

    def text(f, i):
        f.seek(10 * (i - 1))
        return f.read(9).decode()

    def image(f, i):
        raise AssertionError("not asked for")

    ranges = sorted((r["name"], r["first"], r["last"]) for r in files.page_ranges(found, count).collect())
    assert ranges[0] == ("big.pages", 1, 64) and ranges[31] == ("big.pages", 1985, 2000) and ("just.pages", 65, 128) in ranges and len(ranges) == 35
    got = files.spread_pages(found, count, {"text": ("string", text), "image": ("binary", image)}, ["text"]).withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert {(r["name"], r["page_number"]): r["text"] for r in rows} == {(f"{n}.pages", i): f"{n[:3]}{i:06d}" for n, m in (("big", 2000), ("one", 1), ("just", 128)) for i in range(1, m + 1)}
    assert len(rows) == 2129 and len({r["task"] for r in rows if r["name"] == "big.pages"}) > 1


def test_batches_are_bounded(spark):
    schema = files._arrow_schema("x binary")
    made = []

    def rows():
        for i in range(10):
            made.append(i)
            yield {"x": b"0" * 6_000_000}

    stream = files._batches(rows(), schema)
    assert next(stream).num_rows == 3 and len(made) == 3 and sum(b.num_rows for b in stream) == 7
    assert list(files._batches(iter(()), schema)) == []


def test_stages_appear_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    read = lambda h, **kw: sorted(r["id"] for r in files.read_stage(spark, path, "one", h, **kw).collect())
    with pytest.raises(ValueError):
        read("h")
    files.write_stage(spark.range(5), path, "one", "h", n=5)
    assert read("h") == [0, 1, 2, 3, 4]
    bad = spark.range(100).repartition(8).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        files.write_stage(bad, path, "one", "h2")
    assert read("h") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        read("h2")
    old = files.read_stage(spark, path, "one", "h")
    files.write_stage(spark.range(3), path, "one", "h3")
    assert read("h3") == [0, 1, 2] and old.count() == 5  # who has begun to read may end
    files.write_stage(spark.range(0), path, "one", "h4")
    assert read("h4") == [] and len(list(Path(path).glob("data-*"))) == 2


@pytest.mark.parametrize("harm", ["change", "remove", "add"])
def test_stages_are_checked(spark, tmp_path, harm):
    path = tmp_path / "s"
    files.write_stage(spark.range(1000).repartition(4), str(path), "one", "h")
    part = sorted(path.glob("data-*/*.parquet"))[0]
    if harm == "change":
        held = bytearray(part.read_bytes())
        held[10] ^= 1
        part.write_bytes(held)
        part.with_name(f".{part.name}.crc").unlink()
    elif harm == "remove":
        part.unlink()
    else:
        part.with_name("part-more.parquet").write_bytes(part.read_bytes())
    with pytest.raises(ValueError, match="isn't as it was written"):
        files.read_stage(spark, str(path), "one", "h")
    assert files.read_stage(spark, str(path), "one", "h", check=False) is not None


def test_text_is_replaced_in_one_step(spark, tmp_path):
    path = tmp_path / "t.txt"
    for text in ("one", "two, longer", ""):
        files.write_text(spark, text, str(path))
        assert path.read_text() == text
    assert hashlib.sha256(path.read_bytes()).hexdigest() and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.txt"]
