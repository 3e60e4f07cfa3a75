"""The registered queries of this subpackage: thin, each over its whole table, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, html_extract, language_id, mixing, order_minhash, pii, pivot_search, quality_rules, signature_trees, spelling, substring_dedup, turn_repair, url_filters
from corpusloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document, and the first slot that takes some."""
    rows = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLES["op6_mixing"] = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER up AS k, ((SELECT 1.5 * sum(n) FROM s) - sum(2.0 * n) OVER up + 2.0 * n) / ((SELECT sum(w) FROM s) - sum(w) OVER up + w) AS l
  FROM s WINDOW up AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT min_by(l, k) FILTER (2.0 * n / w >= l) AS l FROM o
), t AS (
  SELECT source, n, CAST(CASE WHEN l IS NULL OR w * l >= 2.0 * n THEN 2.0 * n ELSE round(w * l, 6) END AS DOUBLE) AS target FROM s, level
), b AS (
  SELECT sum(target) AS total, CAST(greatest(1, least(1024, floor(round(sum(target), 3) / 65536))) AS BIGINT) AS block FROM t
), h AS (
  SELECT source, sum(target) OVER up / total AS high, (sum(target) OVER up - target) / total AS low, row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS final
  FROM t, b WHERE target > 0 WINDOW up AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)
), i AS (
  SELECT slot, slot * CAST('0.6180339887498949' AS DOUBLE) - floor(slot * CAST('0.6180339887498949' AS DOUBLE)) AS point
  FROM (SELECT unnest(range(CAST(floor(round(total, 3) / block + 0.5) AS BIGINT))) AS slot FROM b)
), r AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM i JOIN h ON point >= low AND (point < high OR final)
), c AS (
  SELECT source, count(*) AS ranks FROM r GROUP BY source
), p AS (
  SELECT d.doc_id, d.size, d.source, t.n, t.target, block, least(coalesce(ranks, 0) * block, 2 * t.n) AS take,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY sha256(CAST(d.doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source, b
)
SELECT doc_id, size, n AS source_size, target,
  CAST(greatest(0, least(start + size, take) - start) + greatest(0, least(start + n + size, take) - start - n) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND start < take THEN slot END AS first_slot
FROM p LEFT JOIN r ON p.source IS NOT DISTINCT FROM r.source AND r.rank = CAST(start AS BIGINT) // block
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the policy clean-1."""
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "clean-1")
    base = F.lit(quality_rules.mask("base-1")).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed_bits")


ORACLES["op7_quality_rules"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents
), g AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 3
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE c.n > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '\\p{Lu}', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) AS n_letters,
    length(text) - length(replace(text, '|', '')) AS n_bars
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_letters > 0 AND 10 * n_upper > 5 * n_letters THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_bars > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 64 ELSE 0 END
    + CASE WHEN word_chars > 0 AND 2 * n_letters < word_chars THEN 128 ELSE 0 END AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM b
"""

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by four rules."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op10_url_filters"] = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u
), r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), w AS (
  SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT p.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN w ON p.page_id = w.page_id AND k = 1
"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, "doc_id", "held_out")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, "doc_id", decoded="decoded")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"), "page_id", "url").withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the trained classifier adds."""
    docs = table(spark, sf_dir, "documents")
    rows = pii.annotate(docs, pii.fit(docs), "doc_id")
    return rows.select("doc_id", *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS[: pii.BASE]], F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows that start earlier elsewhere."""
    rows = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w
), r AS (
  SELECT DISTINCT doc_id, i + j AS p FROM f, (SELECT unnest(range(0, 20)) AS j) WHERE k > 1
), g AS (
  SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id
), o AS (
  SELECT d.doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN g ON d.doc_id = g.doc_id
), k AS (
  SELECT doc_id, len(ws) AS n_words, len(ps) AS n_removed, coalesce((SELECT string_agg(ws[p], ' ' ORDER BY p) FROM (SELECT unnest(range(1, len(ws) + 1)) AS p) WHERE NOT list_contains(ps, p)), '') AS kept FROM o
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""


@query
def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles overlap by nine tenths."""
    return signature_trees.join(table(spark, sf_dir, "documents"))


ORACLES["op8_signature_trees"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS (
  SELECT i, j FROM p UNION ALL SELECT j, i FROM p
), r(i, j) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(r.j) AS component_id FROM s JOIN r ON s.doc_id = r.i GROUP BY s.doc_id, g
"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one in 199 damaged, with their near words, forms and roots."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), every=199)).select("word", "form", "root", "n", "n_near", "form_n")


# the checksum takes each byte, then eight shifts
ORACLES["op11_spelling"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), r AS (
  SELECT run, count(*) AS n, doc_id || ':' || run AS k FROM d WHERE length(run) >= 6 GROUP BY doc_id, run
), b AS (
  SELECT run, n, flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda x: [x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) AS h FROM b
), m AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), p AS (
  SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM v)
), e AS (
  SELECT a.word, b.word AS other FROM p a JOIN p b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT p.word, v.word FROM p JOIN v ON p.cut = v.word
  UNION SELECT v.word, p.word FROM p JOIN v ON p.cut = v.word
), g AS (
  SELECT e.word, count(*) AS n_near, max(o.n) AS most FROM e JOIN v o ON e.other = o.word GROUP BY e.word
), f AS (
  SELECT g.word, min(o.word) AS form, any_value(g.most) AS form_n FROM g JOIN v ON g.word = v.word JOIN e ON e.word = g.word JOIN v o ON o.word = e.other AND o.n = g.most WHERE g.most >= 5 * v.n GROUP BY g.word
), t(word, root) AS (
  SELECT word, word FROM v UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word
)
SELECT v.word, f.form, t.root, v.n, coalesce(g.n_near, 0) AS n_near, f.form_n
FROM v LEFT JOIN g ON v.word = g.word LEFT JOIN f ON v.word = f.word JOIN t ON v.word = t.word WHERE t.root NOT IN (SELECT word FROM f)
"""


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one of five faults in a quarter of the rows, by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.withColumn("_kind", kind).where("_kind != 0")
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, of which a quarter of the rows are damaged."""
    conversations = table(spark, sf_dir, "conversations")
    report, turns = turn_repair.repair(damaged_turns(conversations))
    digests = turn_repair.digests(turns).withColumnsRenamed({"conv_id": "_d"})
    every = conversations.select(F.col("conv_id").alias("_c")).distinct()
    rows = every.join(report, F.col("_c").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("_c").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("_c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# states 0 to 3: nothing, system, user, assistant; w: a turn's edit and the insertions after it, best first
ORACLES["op12_turn_repair"] = """
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d
), t AS (
  SELECT *, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM n
), ins(a, b, cost, audit) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')
), step(a, b, c) AS (
  VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')
), move AS (
  SELECT conv_id, i, s.a, s.b, 0 AS cost, 'K' AS e FROM t JOIN step s ON s.c = t.c WHERE fault IN ('none', 'truncated')
  UNION ALL SELECT conv_id, i, s.a, s.b, 1, 'R' FROM t JOIN step s ON s.c IN ('u', 'a') WHERE fault IN ('none', 'truncated')
), edit AS (
  SELECT m.conv_id, m.i, a, b, m.cost + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, e FROM move m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id AND t.i = m.i
  UNION ALL SELECT conv_id, i, a, a, 2, 'D' FROM t, (SELECT unnest([0, 1, 2, 3]) AS a)
), w AS (
  SELECT conv_id, i, edit.a, ins.b, min({'cost': edit.cost + ins.cost, 'audit': e || ins.audit}) AS w FROM edit JOIN ins ON edit.b = ins.a GROUP BY conv_id, i, edit.a, ins.b
), r(conv_id, i, b, w) AS (
  SELECT conv_id, 0::BIGINT, b, {'cost': cost, 'audit': audit} FROM (SELECT DISTINCT conv_id FROM t), ins WHERE a = 0
  UNION ALL SELECT r.conv_id, r.i + 1, w.b, min({'cost': r.w.cost + w.w.cost, 'audit': r.w.audit || w.w.audit}) FROM r JOIN w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i + 1 AND w.a = r.b GROUP BY r.conv_id, r.i, w.b
), q AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
), z AS (
  SELECT r.conv_id, min(r.w) AS w FROM r JOIN q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND q.rows = r.i WHERE r.b IN (0, 3) GROUP BY r.conv_id
), l AS (
  SELECT conv_id, unnest(string_split(w.audit, '')) AS e, generate_subscripts(string_split(w.audit, ''), 1) AS p, length(replace(w.audit, 'D', '')) % 2 AS odd FROM z WHERE w.audit <> ''
), o AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER up, 0) AS BIGINT) AS i, CAST(coalesce(sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER up, 0) AS BIGINT) AS k FROM l WINDOW up AS (PARTITION BY conv_id ORDER BY p)
), x AS (
  SELECT o.conv_id, string_agg(CASE WHEN e = 'K' THEN t.role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p) AS content
  FROM o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.i = o.i WHERE e <> 'D' GROUP BY o.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(z.w.cost, 0) AS BIGINT) AS cost, coalesce(z.w.audit, '') AS audit, sha256(coalesce(content, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors with the largest integer inner products for every fiftieth vector."""
    return pivot_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op13_pivot_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
