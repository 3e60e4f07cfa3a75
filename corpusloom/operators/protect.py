"""Values that must survive translation: addresses, numbers and glossary terms behind placeholders."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.rows import arrow
from corpusloom.plans.storage import cut_lineage

# Addresses and numbers.
ADDRESS = re.compile(r"https?://\S+|\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b")
NUMBER = re.compile(r"\+?\d+(?:[  .,:/-]\d+)*%?")
#: Digits from which on a number is copied and not rewritten.
LONG_NUMBER = 7


def to_ascii(text: str) -> str:
    return "".join(str(d) if (d := unicodedata.decimal(c, None)) is not None else c for c in text)


class Rule(NamedTuple):
    """What must survive: a pattern, what is written for a match, and whether that goes behind a placeholder."""

    pattern: re.Pattern
    written: Callable[[str], str]
    hidden: Callable[[str], bool]


def _always(_: str) -> bool:
    return True


RULES = (
    Rule(ADDRESS, str, _always),
    Rule(NUMBER, to_ascii, lambda said: sum(map(str.isdigit, said)) >= LONG_NUMBER),
)


def rules(glossary: dict[str, str]) -> list[Rule]:
    """The fixed rules and one for each term, longest terms first."""
    terms = sorted(filter(None, glossary), key=len, reverse=True)
    return [*RULES, *(Rule(re.compile(re.escape(t), re.IGNORECASE), lambda _, t=t: glossary[t], _always) for t in terms)]


def chosen(text: str, by: list[Rule]) -> Iterator[tuple[Rule, re.Match]]:
    """Matches that don't overlap: what begins first, then the longest, then that of the first rule."""
    found = [(m.start(), -m.end(), k, m) for k, rule in enumerate(by) for m in rule.pattern.finditer(text)]
    free = 0
    for start, _, k, m in sorted(found, key=lambda x: x[:3]):
        if start >= free:
            free = m.end()
            yield by[k], m


def protect(text: str, glossary: dict[str, str] | None = None) -> tuple[str, dict[str, str], dict[str, str]]:
    """The text with placeholders, what each one stands for, and the terms that change."""
    parts = [(m.span(), m[0], rule.written(m[0]), rule.hidden(m[0])) for rule, m in chosen(text, rules(dict(glossary or {})))]
    behind = [put for _, _, put, hidden in parts if hidden]
    names = iter([f"<x{i}>" for i in range(len(behind))])
    ends = [0, *(end for (_, end), *_ in parts)]
    out = [text[a:start] + (next(names) if hidden else put) for a, ((start, _), _, put, hidden) in zip(ends, parts)]
    return "".join(out) + text[ends[-1] :], {f"<x{i}>": put for i, put in enumerate(behind)}, {said: put for _, said, put, _ in parts if said != put}


def restore(text: str, held: dict[str, str]) -> tuple[str, list[str]]:
    """The text with its values back, and what is missing. A placeholder is known without brackets and with spaces,
    so x1 is also found at the start of x10."""
    missing = []
    for name, value in held.items():
        around = re.split(rf"(?i:(?:<\s*)?x\s*{name[2:-1]}(?:\s*>)?)", text)
        missing += [f"missing protected value: {value}"] * (len(around) == 1)
        text = value.join(around)
    return text, missing


KIND = "struct<text:string,replacements:map<string,string>,terms:map<string,string>>"


def protected(text: Column, glossary: Column | None = None) -> Column:
    call = arrow(lambda x, g=None: dict(zip(("text", "replacements", "terms"), protect(x, dict(g or {})))), KIND)
    return call(text) if glossary is None else call(text, glossary)


def restored(text: Column, replacements: Column) -> Column:
    return arrow(lambda x, held: dict(zip(("text", "issues"), restore(x, dict(held or {})))), "struct<text:string,issues:array<string>>")(text, replacements)


def non_overlapping(found: Column) -> Column:
    """Of spans, sorted by start and then the longer first, those that begin after the last one taken ends."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("stop"), x.alias("it"))))
    empty = F.filter(F.transform(ordered, lambda x: x["it"]), lambda x: F.lit(False))
    return F.aggregate(
        ordered,
        F.struct(empty.alias("taken"), F.lit(-1).cast("int").alias("at")),
        lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["taken"], F.array(x["it"])).alias("taken"), x["it"]["end"].cast("int").alias("at"))).otherwise(acc),
        lambda acc: acc["taken"],
    )


def greedy(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of spans that `non_overlapping` takes of each key, for keys of any size; rows whose span is empty, reversed or
    null cover nothing and stay out. Of equal spans the one whose other columns sort first counts.

    Of spans that begin together only the longest can be taken, so a key's spans are as many as their starts and can be
    dealt by ranges of these. A span that begins where all before it have ended is taken whatever came before: such spans
    are found by greatest ends, first of ranges, then within them, and what follows one up to the next is a run of its own.
    Runs are walked as sorted streams that hold one value, not as arrays; only spans that overlap in one unbroken chain
    share a task. A null key is a key."""
    rest = [c for c in spans.columns if c not in (key, start)]
    whole = F.struct(*[F.col(c) for c in rest])
    ones = spans.where(F.col(end) > F.col(start)).groupBy(key, start).agg(F.min_by(whole, F.struct(-F.col(end), F.to_json(whole))).alias("_it"))
    dealt = cut_lineage(ones.repartitionByRange(key, start).select(F.struct(key).alias("_key"), F.col(start).alias("_start"), F.col(f"_it.{end}").alias("_end"), "_it", F.spark_partition_id().alias("_range")))
    inside, before = Window.partitionBy("_key", "_range").orderBy("_start"), Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy("_key", "_range").agg(F.max("_end").alias("_top")).withColumn("_top", F.max("_top").over(before))
    reach = F.greatest(F.max("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"))  # nulls don't count
    marked = cut_lineage(dealt.join(tops, ["_key", "_range"]).withColumn("_reach", reach).withColumn("_new", F.col("_reach").isNull() | (F.col("_start") >= F.col("_reach"))).drop("_top", "_reach"))
    runs = marked.where("_new").groupBy("_key", "_range").agg(F.max("_start").alias("_run"))
    runs = marked.select("_key", "_range").distinct().join(runs, ["_key", "_range"], "left").withColumn("_run", F.max("_run").over(before))
    own = F.max(F.when(F.col("_new"), F.col("_start"))).over(inside)
    rows = marked.join(runs, ["_key", "_range"]).withColumn("_run", F.coalesce(own, "_run"))
    return rows.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_start").mapInArrow(_taken, rows.schema).select(*[F.col(f"_key.{key}") if c == key else F.col("_start").alias(c) if c == start else F.col(f"_it.{c}") for c in spans.columns])


def _taken(batches):
    import pyarrow as pa

    free = None
    for batch in batches:
        taken = []
        for start, end, new in zip(*(batch.column(c).to_pylist() for c in ("_start", "_end", "_new"))):
            taken.append(new or start >= free)
            free = end if taken[-1] else free
        yield batch.filter(pa.array(taken, pa.bool_()))


def glossary_order(terms: Column) -> Column:
    """Longest first, equally long ones by spelling."""
    return F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
