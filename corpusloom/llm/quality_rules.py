"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

Null text counts as empty. An empty text has no words, fails the rule too_short and is dropped by every policy
that holds it. Repeated rows each get their own ledger row; an empty table gives an empty ledger; other columns
of the input are carried by `keep` only, so that clashing names can't disturb. Texts may be of any length; a value that
equals a rule's limit doesn't fail it, as each rule's comparison says, and no rule depends on an order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import GAP, WORD, with_text


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL condition over the measurements."""

    name: str
    bit: int
    fails: str


#: Measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, n_bars.
RULES = (
    Rule("too_short", 0, "n_words < 50"),
    Rule("repeats_itself", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > 3 * n_words"),
    Rule("shouting", 3, "n_letters > 0 AND 10 * n_upper > 5 * n_letters"),
    Rule("bar_list", 4, "10 * n_bars > 3 * n_words"),
    Rule("repeated_lines", 5, "n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule("odd_word_length", 6, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule("few_letters", 7, "word_chars > 0 AND 2 * n_letters < word_chars"),
)

#: Versioned policies: the rules that each one enforces.
POLICIES = {
    "base-1": ("too_short", "repeats_itself"),
    "clean-1": tuple(r.name for r in RULES),
}


def mask(policy: str, rules=RULES, policies=POLICIES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policies[policy])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array. Equal windows are neighbours once sorted."""
    n = F.size(words)
    windows = F.when(
        n > 3,
        F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))),
    )
    twice = F.transform(
        F.array(windows),  # binds the sorted array once
        lambda w: F.filter(w, lambda x, k: (x["h"] == F.get(w, k - 1)["h"]) | (x["h"] == F.get(w, k + 1)["h"])),
    )[0]
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.transform(F.array(starts), lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))[0]
    return F.coalesce(covered, F.lit(0).cast("long"))


def measure(docs: DataFrame, *also: str) -> DataFrame:
    """One row of measurements for each document, by SQL functions alone."""
    text = F.col("text")
    read = with_text(docs, *also).select("doc_id", *also, "text", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    count = lambda these: (F.length(text) - F.length(F.regexp_replace(text, these, ""))).cast("long")
    return read.select(
        "doc_id",
        *also,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        count(r"\p{Lu}+").alias("n_upper"),
        count(r"\p{L}+").alias("n_letters"),
        (F.length(text) - F.length(F.translate(text, "|", ""))).cast("long").alias("n_bars"),
    )


def ledger(docs: DataFrame, *also: str, rules=RULES) -> DataFrame:
    """Measurements and one bit for every failed rule."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, *also).withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: str, rules=RULES, policies=POLICIES) -> DataFrame:
    """kept: no bit of the policy's mask is set. Texts aren't read again."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules, policies)).cast("long")) == 0).withColumn("policy", F.lit(policy))


def ablations(rows: DataFrame, policy: str, rules=RULES, policies=POLICIES) -> DataFrame:
    """For every rule of the policy: documents that fail it, and those that it alone drops.

    Rows are first summed by distinct bit pattern (at most 2 ** rules), so the shuffle stays small."""
    held = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules, policies)).cast("long")).alias("bits")).agg(F.count("*").alias("docs"))
    names = [r for r in rules if r.name in policies[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in names])).alias("r")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).cast("long")
    return held.select("bits", "docs", each).groupBy(F.col("r.rule").alias("rule")).agg(total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"), total(F.col("bits") == F.col("r.bit")).alias("failed_alone"))
