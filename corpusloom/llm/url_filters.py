"""URL rules: each URL becomes host-suffix and path-prefix expressions that are joined to the rules on short digests.

A null URL, or one without "://", has an empty host and path and no rule fits it; it takes the default verdict.
A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule wins; of equally
long ones the one with the longer host, then a block before an allow. Repeated rows get the same verdict each,
an empty table or an empty rule list gives no match, and further columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules, and bytes of their hosts and paths, up to which they're sent to every task.
BROADCAST_RULES, BROADCAST_BYTES = 200_000, 32 << 20
#: Hexadecimal digits of the digest that the join compares first.
SHORT = 8


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict. Rows with a null are ignored; of repeated rules a block stays."""
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.lower("host").alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max(F.col("verdict") == "block").alias("r_block"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", F.substring("r_digest", 1, SHORT))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The input's columns and host, path, rule, verdict.

    Distinct URLs are expanded once: host suffixes at the dots (no more labels than rules have), path prefixes at the lengths that rules have.
    The expressions meet the rules in an equi-join on the digest's first digits; the full digest then confirms."""
    ready = prepare_rules(rules)
    counted = ready.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)).alias("labels"), F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"), F.coalesce(F.sum(F.octet_length("r_host") + F.octet_length("r_path")), F.lit(0)).alias("bytes")).first()
    hint = F.broadcast if counted["n"] <= BROADCAST_RULES and counted["bytes"] <= BROADCAST_BYTES else (lambda x: x)
    lengths = F.array(*[F.lit(n) for n in counted["lengths"]]).cast("array<int>")
    urls = pages.select(F.col(url).alias("_u")).where("_u IS NOT NULL").distinct().select("_u", host_of(F.col("_u")).alias("_h"), path_of(F.col("_u")).alias("_p"))
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(counted["labels"] - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    expressions = (
        urls.withColumn("_suffix", F.explode(suffixes))
        .withColumn("_length", F.explode(F.filter(lengths, lambda n: n <= F.length("_p"))))
        .withColumn("_prefix", F.expr("substring(_p, 1, _length)"))
        .withColumn("_digest", _digest(F.col("_suffix"), F.col("_prefix")))
        .withColumn("_short", F.substring("_digest", 1, SHORT))
    )
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), F.col("r_block").alias("c"), F.concat("r_host", "r_path").alias("rule"))
    winners = expressions.join(hint(ready), F.col("_short") == F.col("r_short")).where("_digest = r_digest").groupBy("_u").agg(F.max(order).alias("_win"))
    won = winners.select("_u", F.col("_win.rule").alias("_rule"), F.when(F.col("_win.c"), "block").otherwise("allow").alias("_verdict"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]

    own = lambda c: F.col(f"p.`{c}`")  # noqa: E731  the input may have columns of any names

    def judged(rows: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        return rows.select(*[own(c).alias(c) for c in kept], host_of(own(url)).alias("host"), path_of(own(url)).alias("path"), rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))

    named, none = pages.select(*kept).alias("p"), F.lit(None).cast("string")
    met = named.where(own(url).isNotNull()).join(won.alias("w"), own(url) == F.col("w._u"), "left")
    # rows without a URL meet nothing: they don't go through the join, where they'd be one task
    return judged(met, F.col("w._rule"), F.col("w._verdict")).unionByName(judged(named.where(own(url).isNull()), none, none))
