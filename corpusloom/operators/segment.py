"""Sentences of a text with all that lies between them, so that the text's layout can be put back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.rows import arrow, packed

# Blanks around a line, line ends, and the places between sentences.
_LINE = re.compile(r"([ \t\f\v]*+)((?:[^\r\n]*[^ \t\f\v\r\n])?)([ \t\f\v]*)(\r\n|\r|\n|\Z)")
_ENDS = re.compile(r"(?<=[.!?。！？।])(?:\s+|(?=\S))")
#: Tokens of a piece at least, whatever limit is asked for.
LEAST = 8


def pieces_of(sentence: str, limit: int, count=lambda x: len(x.split())) -> list[str]:
    """Pieces of at most max(LEAST, limit) tokens; a single word is cut by characters."""
    if count(sentence) <= max(LEAST, limit):
        return [sentence]
    words = sentence.split()
    return packed(words, max(LEAST, limit), count, " ") if len(words) > 1 else packed(sentence, max(LEAST, limit), count)


def segments(text: str, limit: int = 256, count=lambda x: len(x.split()), sentences=_ENDS.split) -> list[tuple[str, str, str]]:
    """prefix, text and separator of each piece. Line ends and blank lines hang on the piece before them, or on the
    first one's prefix; sentences of a line are parted by one space. `count` and `sentences` may be a model's."""
    prefixes, pieces, separators = [""], [], []  # the last prefix waits for its piece
    for indent, body, rest, end in _LINE.findall(text):
        said = [p for s in map(str.strip, sentences(body)) if s for p in pieces_of(s, limit, count)]
        if said:
            prefixes[-1] += indent
            prefixes += [""] * len(said)
            pieces += said
            separators += [" "] * (len(said) - 1) + [rest + end]
        elif separators:
            separators[-1] += indent + body + rest + end
        else:
            prefixes[-1] += indent + body + rest + end
    return list(zip(prefixes, pieces, separators))


KIND = "array<struct<prefix:string,text:string,separator:string>>"


def segment(text: Column, limit: int = 256) -> Column:
    return arrow(lambda x: [dict(zip(("prefix", "text", "separator"), s)) for s in segments(x, limit)], KIND)(text)


def joined(parts: Column, translations: Column | None = None) -> Column:
    """The text again, from its pieces or their translations in the same order."""
    said = parts if translations is None else F.zip_with(parts, translations, lambda p, t: F.struct(p["prefix"].alias("prefix"), t.alias("text"), p["separator"].alias("separator")))
    return F.array_join(F.transform(said, lambda p: F.concat(p["prefix"], p["text"], p["separator"])), "")


def context(rows: DataFrame, doc: str, pos: str, text: str, width: int = 2) -> DataFrame:
    """Adds before and after, the neighbouring texts of each row in its document."""
    w = Window.partitionBy(doc).orderBy(pos)
    return rows.withColumn("before", F.collect_list(text).over(w.rowsBetween(-width, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, width)))


def neighbours(rows: DataFrame, doc: str, pos: str, text: str, ok: str) -> DataFrame:
    """Adds context: the texts directly before and after, if they're ok, joined by a blank line."""
    w = Window.partitionBy(doc).orderBy(pos)
    near = [F.when(F.col(ok), F.col(text))]
    return rows.withColumn("context", F.concat_ws("\n\n", F.lag(near[0]).over(w), F.lead(near[0]).over(w)))


def batches(rows: DataFrame, doc: str, pos: str, size: int) -> DataFrame:
    """Adds batch: consecutive rows of a document in groups of `size`."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(doc).orderBy(pos)) - 1) / max(1, size)).cast("int"))
