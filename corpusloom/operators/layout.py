"""Layout blocks and character recognition results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, byline_like, strip

PREDICTION = (
    "image_bbox array<double>, text_lines array<struct<text:string,confidence:double,bbox:array<double>,"
    "words:array<struct<text:string,bbox:array<double>,bbox_valid:boolean,confidence:double>>>>"
)
ROLES = ("body", "title", "byline", "running_header", "caption", "page_number")


def cells(pages: DataFrame) -> DataFrame:
    """page, index, text, confidence, l, t, r, b of every recognised cell, scaled to the page.

    pages: page, prediction (a struct as PREDICTION), width, height. A line gives its words if all their boxes are valid
    and they spell the line; else the line is one cell. Blank cells and broken boxes are left out."""
    compact = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), f"[{SPACE}]+", "")
    size = lambda a, b: F.col("prediction.image_bbox")[a] - F.col("prediction.image_bbox")[b]
    lines = pages.select("page", (F.col("width") / size(2, 0)).alias("sx"), (F.col("height") / size(3, 1)).alias("sy"), F.posexplode("prediction.text_lines").alias("line_no", "line"))
    words = F.coalesce(F.col("line.words"), F.filter(F.array(F.struct(F.lit("").alias("text"), F.array(F.lit(0.0)).alias("bbox"), F.lit(True).alias("bbox_valid"), F.lit(0.0).alias("confidence"))), lambda _: F.lit(False)))
    spelled = compact(F.array_join(F.transform(words, lambda w: F.coalesce(w["text"], F.lit(""))), ""))
    whole = F.array(F.struct(F.col("line.text").alias("text"), F.col("line.bbox").alias("bbox"), F.lit(True).alias("bbox_valid"), F.col("line.confidence").alias("confidence")))
    fine = (F.size(words) > 0) & F.forall(words, lambda w: F.coalesce(w["bbox_valid"], F.lit(True))) & (spelled == compact(F.col("line.text")))
    each = lines.where(F.length(compact(F.col("line.text"))) > 0).select("page", "sx", "sy", "line_no", F.posexplode(F.when(fine, words).otherwise(whole)).alias("word_no", "w"))
    good = each.where((F.length(compact(F.col("w.text"))) > 0) & (F.size("w.bbox") == 4))
    place = F.row_number().over(Window.partitionBy("page").orderBy("line_no", "word_no")) - 1
    box = [(F.col("w.bbox")[i] * F.col(s)).alias(n) for i, s, n in ((0, "sx", "l"), (1, "sy", "t"), (2, "sx", "r"), (3, "sy", "b"))]
    return good.select("page", place.alias("index"), strip(F.col("w.text")).alias("text"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), *box)


def neighbour_bodies(blocks: DataFrame) -> DataFrame:
    """Adds before and after: the nearest block labelled text on either side, as structs."""
    w = Window.partitionBy("doc").orderBy("pos")
    body = F.when(F.col("label") == "text", F.struct("pos", "text", "l", "t", "r", "b"))
    return blocks.withColumn("before", F.last(body, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(body, True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def header_candidates(blocks: DataFrame) -> DataFrame:
    """Short headers in the right column that interrupt a running text, with the title they may belong to.

    blocks: doc, pos, label, text, l, t, r, b, width, height (of the first page). The title is the earlier header with
    another text that lies highest, the first of equals."""
    near = neighbour_bodies(blocks.withColumn("text", strip(F.col("text"))))
    header = (F.col("label") == "section_header") & byline_like(F.col("text"))
    place = (F.col("l") >= 0.55 * F.col("width")) & (F.col("t") >= 0.70 * F.col("height"))
    flow = (F.coalesce("before.r", "width") <= 0.60 * F.col("width")) & (F.coalesce("after.l", F.lit(0.0)) >= 0.45 * F.col("width"))
    found = near.where(header & place & flow & (F.col("width") > 0) & (F.col("height") > 0) & F.col("before").isNotNull() & F.col("after").isNotNull())
    titles = blocks.where("label = 'section_header'").select(F.col("doc").alias("_d"), F.col("pos").alias("_p"), strip(F.col("text")).alias("_text"), F.coalesce("t", F.lit(0.0)).alias("_t"))
    pairs = found.join(titles, (F.col("doc") == F.col("_d")) & (F.col("_p") < F.col("pos")) & (F.col("_text") != F.col("text")))
    best = pairs.groupBy("doc", "pos").agg(F.max_by(F.struct("_text", "_p"), F.struct("_t", -F.col("_p"))).alias("title"), F.first("text").alias("metadata"))
    return best.select("doc", "pos", "metadata", F.col("title._text").alias("title"), F.col("title._p").alias("title_pos"))


def valid_order(order: Column, roles: Column, attach: Column, confidence: Column, ids: Column) -> Column:
    """Whether a reading-order decision is a permutation of the ids, with a known role for each and known targets."""
    known = F.map_values(roles)
    return F.coalesce(
        (F.array_sort(order) == F.array_sort(ids))
        & (F.size(F.array_distinct(order)) == F.size(order))
        & (F.array_sort(F.map_keys(roles)) == F.array_sort(ids))
        & F.forall(known, lambda r: r.isin(*ROLES))
        & F.forall(F.map_keys(attach), lambda k: F.array_contains(ids, k))
        & F.forall(F.map_values(attach), lambda v: v.isNull() | F.coalesce(F.array_contains(ids, v), F.lit(False)))
        & confidence.between(0, 1),
        F.lit(False),
    )


def may_attach(roles: Column, metadata: Column, title: Column, confidence: Column) -> Column:
    """Whether a decision is sure enough to move a byline below a title."""
    return F.coalesce((confidence >= 0.8) & (roles[metadata] == "byline") & (roles[title] == "title"), F.lit(False))


def may_publish(source_hash: Column, stage_hash: Column, open_candidates: Column, formulas: Column) -> Column:
    """Nothing changed since the last stage, and nothing is left to look at."""
    return F.coalesce((source_hash == stage_hash) & (open_candidates == 0) & (formulas == 0), F.lit(False))


def label_histogram(items: DataFrame, label: str) -> DataFrame:
    return items.groupBy(label).agg(F.count("*").alias("n"))
