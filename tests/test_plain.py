"""Operators that SQL can't state, against plain versions, tables of cases, and properties."""

import difflib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import graph, markdown, protect, segment
from corpusloom.plans import translation
from corpusloom.queries import QUERIES
from tests import plain_markdown

SF = "/root/testdata/sf0.001"

# a text, and the parts of it that are protected
MASKS = [
    ("plain text\nof two lines\n", []),
    ("a\n```\nb\n```\nc", ["```\nb\n```\n"]),
    ("a\n```py\nb\n````  \nc", ["```py\nb\n````  \n"]),
    ("a\n~~~~\nb\n~~~\nc", ["~~~~\nb\n~~~\nc"]),
    ("a\n```\nb\n~~~\nc", ["```\nb\n~~~\nc"]),
    ("a\n   ```\nb\n    ```\n```\nc", ["   ```\nb\n    ```\n```\n"]),
    ("a\n    code\n\tcode\nb", ["    code\n\tcode\n"]),
    ("a\nx | y\nb", ["x | y\n"]),
    ("a `b c` d", ["`b c`"]),
    ("a ``b ` c`` d", ["``b ` c``"]),
    ("a ``b ` c\nd", ["``b ` c\nd"]),
    ("a $x$ b", ["$x$"]),
    (r"a \$x$ b", ["$ b"]),
    ("a $x\nb", ["$x"]),
    ("a $$x\ny$$ b", ["$$x\ny$$"]),
    ("a $$x\ny", ["$$x\ny"]),
    (r"a \(x\) b \[y" + "\nz", [r"\(x\)", r"\[y" + "\nz"]),
    (r"a \(x" + "\nz", [r"\(x"]),
    ("a [b](c d) ![e](f) g", ["[b](c d)", "![e](f)"]),
    ("see http://x.y/z?a=b, there", ["http://x.y/z?a=b,"]),
    ("a <!-- b\nc --> d <e f> g < h", ["<!-- b\nc -->", "<e f>"]),
    ("a\n [b]: c d\ne", [" [b]: c d"]),
    ("    $ in code\na $b$", ["    $ in code\n", "$b$"]),
    ("```\n`\n```\na `b`", ["```\n`\n```\n", "`b`"]),
    ("", []),
]


@pytest.mark.parametrize("text, parts", MASKS)
def test_protected_parts(text, parts):
    runs = markdown.runs(text)
    assert [text[a:b] for kept, a, b in runs if kept] == parts
    assert "".join(text[a:b] for _, a, b in runs) == text


def test_masks_of_documents(spark):
    """Documents without fences, formulas, links and tags: protected are indented lines and those with bars."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in QUERIES["protection_mask"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["protected"], r["end"]))
    plain = 0
    for i, text in docs.items():
        runs = sorted(got.get(i, []))
        assert "".join(text[a:b] for a, _, b in runs) == text and all(x[1] != y[1] for x, y in zip(runs, runs[1:]))
        if not any(s in text for s in ("`", "~~~", "$", "\\", "<", "](", "]:", "http")):
            plain += 1
            lines = text.splitlines(keepends=True)
            assert "".join(text[a:b] for a, kept, b in runs if kept) == "".join(x for x in lines if "|" in x or x.startswith(("    ", "\t")))
    assert plain > 100


CLEANED = [
    ("ﬁne ﬂow oﬀ ofﬁce", "fine flow off office\n"),
    ("soft­hyphen and space", "softhyphen and space\n"),
    ("été", "été\n"),
    ("/square6 item", "▪ item\n"),
    ("a long-\nword and a long- word", "a longword and a long- word\n"),
    ("dif ficult, Ef ficiency, OF FICER", "difficult, efficiency, officeR\n"),
    ("a  b\t\tc  \nd", "a b c  \nd\n"),
    ("a\n\n\n\nb\n \n \nc\n\n\n", "a\n\nb\n\nc\n"),
    ("### a\n##### b ##\n######### c", "# a\n### b\n###### c\n"),
    ("```\n# ﬁ  x\n```\n## ﬁ  x", "```\n# ﬁ  x\n```\n# fi x\n"),
    ("", "\n"),
]


@pytest.mark.parametrize("text, want", CLEANED)
def test_cleaned(text, want):
    assert markdown.clean(text) == want


def test_cleaned_documents(spark):
    """Documents in one line without any sign that protects: each step by itself."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in QUERIES["clean_markdown"](spark, SF).collect():
        text = docs[r["doc_id"]]
        if not any(s in text for s in "`~$\\<[#|\n\t") and "http" not in text and not text.startswith("    "):
            seen += 1
            words = text.strip(" ").split(" ")
            assert r["text"].strip(" \n").split(" ") == [w for w in words if w]
    assert seen > 20


TEXTS = st.text(st.sampled_from("ab. !#-\n`~$|\\[]()<>*_1é­\t"), max_size=120)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_markdown_properties(text):
    runs = markdown.runs(text)
    assert "".join(text[a:b] for _, a, b in runs) == text
    chunks = markdown.chunks(text, 6)
    assert "".join(x for x, _ in chunks) == text and all(len(x.split()) <= 6 for x, free in chunks if free)
    parts = segment.segments(text, 8)
    assert "".join("".join("".join(p) for p in parts).split()) == "".join(text.split())


def test_shields_by_brute_force(spark):
    """Many texts at once: shields, whole and damaged ones taken back, formulas, bylines."""
    r = random.Random(5)
    bits = [*"ab. !#-\n`~$|\\[]()<>*_1é\t\r", "# ", "\n# ab\n", "\n## b\n", "1. ", "](http://a.b/c)", "https://x.y/z ", "$x$", "\\(y\\)", "\u00a0", "\u2028", "😀", "٣) ", "ZXQMARKDOWN0QXZ", "ZXQMARKDOWN01QXZ", "ZXQMARKDOWN999QXZ", "MATHqN0E"]
    texts = ["", *("".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(1500))]
    rows = [(i, x, r.choice(["ab", "b", "a.b", "\\E"]), r.choice(["ab", "b"])) for i, x in enumerate(texts)]
    df = spark.createDataFrame([*rows, (-1, None, None, None)], "i int, t string, said string, title string").repartition(8)
    hurt = lambda c, name: F.when(F.col("i") % 3 == 0, c).when(F.col("i") % 3 == 1, F.replace(c, F.lit(name(1)), F.lit(""))).otherwise(F.concat(c, F.lit(" " + name(0))))
    sign, math = "ZXQMARKDOWN{}QXZ".format, "MATHqN{}E".format
    got = df.select("*", markdown.shield_column(F.col("t")).alias("s"), markdown.shield_math_column(F.col("t"), F.lit("q")).alias("m")).select(
        "*",
        markdown.unshield_column(F.col("s.text"), F.col("s.tokens")).alias("back"),
        markdown.unshield_column(hurt(F.col("s.text"), sign), F.col("s.tokens")).alias("hurt"),
        markdown.unshield_math_column(F.col("m.text"), F.col("m.formulas")).alias("mback"),
        markdown.unshield_math_column(hurt(F.col("m.text"), math), F.col("m.formulas")).alias("mhurt"),
        markdown.attach_byline_column(F.col("t"), F.col("said"), F.col("title")).alias("a"),
        markdown.attach_byline_column(F.col("t"), F.col("said"), F.col("title"), True).alias("b"),
    )
    seen, harm = Counter(), lambda i, x, name: x if i % 3 == 0 else x.replace(name(1), "") if i % 3 == 1 else f"{x} {name(0)}"
    for x in got.collect():
        if x["i"] < 0:
            assert all(x[c] is None for c in ("s", "m", "back", "hurt", "mback", "mhurt", "a", "b"))
            continue
        (said, held), (shown, kept) = plain_markdown.shield(x["t"]), plain_markdown.shield_math(x["t"], "q")
        assert (x["s"]["text"], x["s"]["tokens"]) == (said, held)
        assert x["back"] == plain_markdown.unshield(said, held)
        assert x["hurt"] == plain_markdown.unshield(harm(x["i"], said, sign), held)
        assert (x["m"]["text"], x["m"]["formulas"]) == (shown, kept)
        if "MATHqN" not in x["t"]:  # a mark is chosen so that the text doesn't hold it
            assert x["mback"] == x["t"] and x["mhurt"] == plain_markdown.unshield_math(harm(x["i"], shown, math), kept)
        assert x["a"] == plain_markdown.attach_byline(x["t"], x["said"], x["title"])
        assert x["b"] == plain_markdown.attach_byline(x["t"], x["said"], x["title"], True)
        seen.update(back=x["back"] is None, hurt=x["hurt"] is None, whole=x["hurt"] is not None, kept=len(kept) > 1, moved=x["a"] is not None, put=x["b"] is not None)
    assert min(seen.values()) > 5 and len(seen) == 6


def test_shields_of_long_texts(spark):
    text = "*a* [b](http://c/d)\n" * 20_000
    df = spark.createDataFrame([(text,)], "t string").select("t", markdown.shield_column(F.col("t")).alias("s"))
    at = time.time()
    assert df.select((markdown.unshield_column(F.col("s.text"), F.col("s.tokens")) == F.col("t")).alias("ok")).first()["ok"] and time.time() - at < 20


def test_shields_need_no_python(spark, capsys):
    QUERIES["markdown_tokens"](spark, SF).explain()
    assert "Python" not in capsys.readouterr().out


def test_greedy_spans_of_any_size(spark):
    """Against the fold, with a key that holds most spans, in chains and apart, over many ranges; and a plain version."""
    r = random.Random(7)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.randrange(20_000), r.randrange(1, 30), f"x{i}") for i in range(6000)]
    rows += [("chain", i * 2, 3, "c") for i in range(500)] + [("same", 5, n, str(i)) for n in (1, 4, 4) for i in range(200)] + [("a", 7, 0, "empty"), ("a", 9, -3, "reversed"), ("a", None, None, "null")]
    df = spark.createDataFrame([(k, s, None if s is None else s + n, x) for k, s, n, x in rows], "user string, start int, end int, _it string").repartition(8)
    want = {}
    for k, s, n, x in sorted((x for x in rows if x[1] is not None and x[2] > 0), key=lambda x: (str(x[0]), x[1], -x[2], x[3])):
        if not want.get(k) or s >= want[k][-1][1]:
            want.setdefault(k, []).append((s, s + n, x))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {}
        for x in protect.greedy(df, "user").collect():
            got.setdefault(x["user"], []).append((x["start"], x["end"], x["_it"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {k: sorted(v) for k, v in got.items()} == want and len(got) == 6 and want["same"] == [(5, 9, "0")]
    fold = df.where("user = 'b'").groupBy("user").agg(F.collect_list(F.struct("start", "end")).alias("xs")).select(F.explode(protect.non_overlapping(F.col("xs"))).alias("x")).select("x.*")
    assert sorted(map(tuple, fold.collect())) == [(s, e) for s, e, _ in want["b"]]
    assert protect.greedy(df.limit(0), "user").columns == df.columns and protect.greedy(df.limit(0), "user").count() == 0


def test_copy_ratio_with_a_bound(spark):
    """Random pairs, some near copies: exact above the bound, 0 only where the ratio isn't above it."""
    r = random.Random(11)
    rows = []
    for i in range(600):
        a = "".join(r.choice("abcde fgHIJ é") for _ in range(r.randrange(300)))
        b = "".join(c if r.random() > r.choice([0.02, 0.3]) else r.choice(["", "x", "zz"]) for c in a) if i % 3 else "".join(r.sample(a, len(a)))
        rows.append((i, a, b))
    df = spark.createDataFrame([*rows, (-1, None, "x"), (-2, "x", None), (-3, "", "")], "i int, a string, b string")
    got = {x["i"]: (x["r"], x["s"]) for x in df.select("i", translation.copy_ratio(F.col("a"), F.col("b")).alias("r"), translation.copy_ratio(F.col("a"), F.col("b"), 0.85).alias("s")).collect()}
    want = {i: difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio() for i, a, b in rows}
    assert all(got[i][0] == x and (got[i][1] == x or x <= 0.85 and got[i][1] == 0) for i, x in want.items())
    assert sum(got[i][1] > 0.85 for i in want) > 50 and sum(got[i][1] == 0 for i in want) > 20
    assert (got[-1], got[-2], got[-3]) == ((None, None), (0.0, 0.0), (1.0, 1.0))


def test_long_texts_that_are_no_copies(spark):
    df = spark.createDataFrame([("abcdefgh " * 12_000, "ijklmnop " * 12_000)], "a string, b string")
    at = time.time()
    assert df.select(translation.copy_ratio(F.col("a"), F.col("b"), 0.85).alias("r")).first()["r"] == 0 and time.time() - at < 10


def test_chunks_of_documents(spark):
    """Documents without headings, code or front matter: paragraphs are put together as long as the limit allows."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in QUERIES["markdown_chunks"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["text"], r["translatable"]))
    many = 0
    for i, text in docs.items():
        chunks = [t for _, t, _ in sorted(x for x in got[i] if x[1] is not None)]
        assert "".join(chunks) == text and all(len(c.split()) <= 220 for c in chunks)
        sentences = re.split(r"(?<=[.!?।॥])\s+", text)
        if "#" not in text and "\n\n" not in text and all(len(s.split()) <= 220 for s in sentences):
            many += len(chunks) > 1
            for a, b in zip(chunks, chunks[1:]):  # a chunk ends only where the next sentence doesn't fit
                assert len(a.split()) + len(re.split(r"(?<=[.!?।॥])\s+", b.lstrip())[0].split()) > 220
    assert many > 5


def test_copy_ratio(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for a, b in zip(rows, rows[1:]):
        if a["conv_id"] == b["conv_id"] and (a["role"], b["role"]) == ("user", "assistant"):
            want[a["conv_id"], a["turn"]] = round(difflib.SequenceMatcher(None, a["text"].casefold(), b["text"].casefold()).ratio(), 6)
    assert {(r["conv_id"], r["turn"]): r["ratio"] for r in QUERIES["copy_ratio"](spark, SF).collect()} == want and want


@pytest.mark.parametrize("whole", [1 << 18, 12])
def test_bounded_components(spark, monkeypatch, whole):
    """Components at a threshold, those that are too large again at higher ones, and at last in slices."""
    rows = sorted(((r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()), key=lambda x: x[0])
    ids = [i for i, _ in rows]
    unit = np.stack([v / np.linalg.norm(v) for _, v in rows])
    similar = unit @ unit.T

    def parts(members, threshold):
        left, out = set(members), []
        while left:
            todo, own = [min(left)], set()
            while todo:
                i = todo.pop()
                if i in left:
                    left.discard(i)
                    own.add(i)
                    todo += [j for j in left if similar[i, j] >= threshold]
            out.append(sorted(own))
        return out

    def bounded(members, threshold, most):
        for own in parts(members, threshold):
            if len(own) <= most:
                yield own
            elif threshold >= 0.97:
                yield from (own[k : k + most] for k in range(0, len(own), most))
            else:
                yield from bounded(own, threshold + 0.03, most)

    monkeypatch.setattr(graph, "WHOLE", whole)  # components that are cut by joins as well
    for threshold, most in ((0.40, 4), (-1.0, 7)) if whole > 12 else ((0.3, 4),):
        want = sorted(bounded(range(len(ids)), threshold, most))
        got: dict = {}
        for r in graph.bounded_components(spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"), threshold, most).collect():
            got.setdefault((r["group"], r["slice"]), []).append(ids.index(r["id"]))
        assert sorted(sorted(v) for v in got.values()) == want


def test_loose_quotations(spark):
    """Every quotation against every page, by the definition; long and short ones, broken in many ways."""
    import random

    from corpusloom.operators import quotes

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    texts = [[word() for _ in range(r.randint(1, 120))] for _ in range(40)]

    def broken(words):
        out = []
        for w in words:
            k = r.randint(1, max(1, len(w) - 1))
            out.append(r.choice([w, w, w[:k] + "­" + w[k:], w[:k] + "-\n  " + w[k:] if len(w) > 1 else w]))
        return "".join(w + r.choice([" ", " ", "\n", " \t", " "]) for w in out)

    pages = [(i, broken(t)) for i, t in enumerate(texts)] + [(100, ""), (101, None), (102, "a-\n1 b-"), (103, " ­ ")]
    picks = [(t, r.randrange(len(t))) for t in texts for _ in range(3)]
    asked = [(i, broken(t[a : a + r.choice([1, 2, 5, 30])])) for i, (t, a) in enumerate(picks)] + [(900, ""), (901, None), (902, "not there at all, not anywhere"), (903, "b-"), (904, pages[3][1])]
    want = {(q, p, *found) for q, a in asked for p, b in pages if a and a.strip() and b and (found := quotes.span(a, b))}
    found = lambda: {tuple(x) for x in quotes.sought(spark.createDataFrame(asked, "quote_id long, quote string"), spark.createDataFrame(pages, "page_id long, page string")).select("quote_id", "page_id", "start", "end").collect()}
    assert found() == want and len(want) > 100
    some = quotes.LOOKED_UP
    try:
        quotes.LOOKED_UP = 3  # more grams than a task looks up: the same by a join
        assert found() == want
    finally:
        quotes.LOOKED_UP = some
