"""Text operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors
from corpusloom.operators import chunk, layout, markdown, protect, quotes, segment


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, usable, language",
    [("বাংলা ভাষার একটি বাক্য। " * 10, True, "bn"), ("This is an English sentence. " * 10, True, "en"), ("¨ˆ¸˝ ¬°£¢ " * 20, False, None), ("short", False, None), ("", False, None)],
)
def test_text_quality(spark, text, usable, language):
    q = one(spark, T.text_quality(F.col("t")), t=text)
    assert (q["usable"], q["language"]) == (usable, language)


def test_languages(spark):
    norm = lambda v: one(spark, T.normalize_language(F.col("v")), v=v)
    assert [norm(v) for v in ("ben", "auto", "", None, "zh_CN", "EN-us", "xx")] == ["bn", None, None, None, "zh", "en", "xx"]
    code = lambda v: one(spark, T.language_code(F.col("v")), v=v)
    assert [code(v) for v in (" Bengali ", "zh-TW", "zho_Hans", "")] == ["ben_Beng", "zho_Hant", "zho_Hans", None]
    route = lambda a, b: one(spark, T.language_route(F.col("a"), F.col("b")), a=a, b=b)
    assert [route(*p) for p in (("en", "hi"), ("bn", "en"), ("kn", "bn"), ("en", "fr"), ("bad", "hi"), ("hi", "hi"))] == ["en_indic", "indic_en", "indic_indic", None, None, None]


def test_numbers(spark):
    assert one(spark, T.ascii_digits(F.col("t")), t="২০২১, ৫০%, ৭:০০") == "2021, 50%, 7:00"
    assert one(spark, T.number_tokens(F.col("t")), t="২০২১-এ ১২২৭টি পদ") == ["2021", "1227"]
    assert one(spark, T.number_tokens(F.col("t")), t="98-3 5% and +1 555.") == ["98-3 5%", "+1 555"]
    kept = lambda a, b: one(spark, T.numbers_kept(T.number_tokens(F.col("a")), T.number_tokens(F.col("b"))), a=a, b=b)
    assert kept("7 and 7", "7 x 7") and not kept("7 and 7", "7") and kept("none", "5")


def test_sentences_and_ratios(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!Three?  3.14 ...") == ["One.", "Two!", "Three?", "3.", "14 .", ".", "."]
    assert one(spark, T.repetition_ratio(F.col("t")), t="a b c a b c a b") == pytest.approx(0.5)
    assert one(spark, T.repetition_ratio(F.col("t")), t="a b c") == 0
    assert one(spark, T.length_ratio(F.col("a"), F.col("b")), a="one two", b="abc") == 1.5
    assert one(spark, T.split_long(F.col("t"), 3), t=" ".join(map(str, range(10)))) == ["0 1 2 3 4 5 6 7", "8 9"]
    assert one(spark, T.too_long(F.col("t"), 3), t=" ".join(map(str, range(10)))) == "sentence has 10 tokens, limit 8"


def test_guards(spark):
    guard = lambda v: one(spark, T.cell_guard(F.col("v")), v=v)
    assert guard(" =1+1") == "' =1+1" and guard("plain") == "plain"
    assert len(guard("x" * 40_000)) == 32748 + len("… [truncated]")
    assert one(spark, T.byline_like(F.col("v")), v="A Person") and not one(spark, T.byline_like(F.col("v")), v="A sentence.")
    names = [r["n"] for r in spark.createDataFrame([("p10",), ("p9",), ("P1",), ("p010",)], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()]
    assert names == ["P1", "p9", "p010", "p10"]
    assert one(spark, T.label(F.col("v")), v="a b/c") == "a_b_c" and one(spark, T.dashed_label(F.col("v")), v="!A b") == "a-b"


@pytest.mark.parametrize("value, body", [(r"$$\frac{x}{y}$$", r"\frac{x}{y}"), ("", None), ("{x", None), ("x}", None), ("}{", None), ("```x", None), ("$x$$", None), (r"\(a\{b\)", r"a\{b"), ("$", None)])
def test_latex_body(spark, value, body):
    assert one(spark, T.latex_body(F.col("v")), v=value) == body


def test_context_and_math(spark):
    assert one(spark, T.sentence_context(F.col("t"), F.lit(7), F.lit(10), 50), t="First. The word here. Last") == "The word here."
    assert one(spark, T.sentence_context(F.col("t"), F.lit(7), F.lit(10), 5), t="First. The word here. Last") is None
    assert one(spark, T.math_spans(F.col("t")), t=r"a $x$ b \(y\) \$5 and $$z$$") == ["$x$", r"\(y\)", "$$z$$"]


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.normalized(v)) == [0.6, 0.8] and one(spark, vectors.normalized(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vectors.cosine(v, F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)


def test_chunks():
    text = "word " * 100 + "\n\n" + "more. " * 200
    got = chunk.cuts(text, 300, 50)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(text[a:b] == c for a, b, c in got)
    assert all(b > a2 >= a for (a, b, _), (a2, _, _) in zip(got, got[1:]))
    assert chunk.cuts("ab\n\ncd" + "x" * 20, 4, 0)[0] == (0, 4, "ab\n\n")
    assert chunk.cuts("123456789\n\nabc", 10, 2)[0][1] == 11  # a line feed at the end, before another, goes one beyond
    assert chunk.cuts("", 10, 2) == [] and chunk.cuts(" \n " * 3, 4, 1) == []


def test_quotes(spark):
    page = "It was a well-\nknown  fact,\nso­ft and true."
    assert quotes.resolve("a wellknown fact", page) == "a well-\nknown  fact"
    assert quotes.resolve("fact, soft", page) == "fact,\nso­ft"
    assert quotes.resolve(" true. ", page) == "true." and quotes.resolve("absent", page) is None and quotes.resolve("", page) == ""
    assert one(spark, quotes.resolve_quote(F.col("q"), F.col("p")), q="fact, soft", p=page) == "fact,\nso­ft"
    assert one(spark, quotes.fact_id(F.lit("s"), F.lit(1), F.col("a"), F.lit("q"))  == quotes.fact_id(F.lit("s"), F.lit(1), F.col("b"), F.lit(" q ")), a="A  Claim", b="a claim ")
    assert one(spark, quotes.evidence_text(F.lit("E1"), F.lit(3), F.lit(""), F.lit("ch. 2"), F.lit("q"))) == "E1 — PDF p. 3 (printed 3, ch. 2): “q”"


def test_segments(spark):
    got = segment.segments("One. Two.\n\nThree!")
    assert [s[1] for s in got] == ["One.", "Two.", "Three!"] and [s[2] for s in got] == [" ", "\n\n", ""]
    text = "\n  First line.\r\nSecond line.\n\nFourth line.  \n"
    assert "".join(p + t + s for p, t, s in segment.segments(text)) == text
    assert "".join(p + "T:" + t + s for p, t, s in segment.segments(text)) == "\n  T:First line.\r\nT:Second line.\n\nT:Fourth line.  \n"
    pieces = segment.pieces_of(" ".join(map(str, range(10))), 8)
    assert len(pieces) == 2 and all(len(p.split()) <= 8 for p in pieces)
    assert segment.pieces_of("x" * 20, 8, len) == ["x" * 8, "x" * 8, "x" * 4]
    rows = spark.createDataFrame([(text,)], "t string").select(segment.joined(segment.segment(F.col("t"))).alias("x"))
    assert rows.first()["x"] == text


def test_protect(spark):
    text, held, _ = protect.protect("OpenAI docs are at https://example.com/a.", {"OpenAI": "OpenAI"})
    assert text == "<x0> docs are at <x1>" and list(held.values()) == ["OpenAI", "https://example.com/a."]
    assert protect.restore("< x 1 > and X0", held) == ("https://example.com/a. and OpenAI", [])
    assert protect.restore("<x0>", held)[1] == ["missing protected value: https://example.com/a."]
    assert protect.protect("call 0171 2345678 at ৭:০০", {})[0] == "call <x0> at 7:00"
    many = {f"<x{i}>": f"V{i}" for i in range(11)}
    assert "V10>" not in protect.restore("<x1>", {"<x1>": "V1"})[0] and protect.restore("<x10>", many)[0].startswith("V1")
    assert protect.protect("New York and York", {"York": "Y", "New York": "NY"})[1] == {"<x0>": "NY", "<x1>": "Y"}
    order = one(spark, protect.glossary_order(F.array(F.lit("a"), F.lit("ccc"), F.lit("bb"))))
    assert order == ["ccc", "bb", "a"]


PROTECTED = ["```\ncode ofﬁce\n```", "~~~~\na\n~~~~", "`in ofﬁce`", "$$\na ofﬁce\n$$", r"\(ofﬁce\)", "$ofﬁce$", "| a  | ofﬁce |", "![ofﬁce](x)", "[a](ofﬁce)", "    ofﬁce  indented"]


@pytest.mark.parametrize("span", PROTECTED)
def test_clean_keeps_protected(span):
    assert markdown.clean(span) == span + "\n"


def test_clean():
    got = markdown.clean("### Title\n\n\n##### Detail\nan of fice is ofﬁcial and inter-\nnational")
    assert got == "# Title\n\n### Detail\nan office is official and international\n"
    assert markdown.clean("af finity f i f l\n") == "affinity f i f l\n"
    assert markdown.clean("a\n```\nopen  ofﬁce") == "a\n```\nopen  ofﬁce\n"
    assert markdown.clean("$$ open  ofﬁce\nmore") == "$$ open  ofﬁce\nmore\n"
    assert markdown.clean("# a ##\n\n\n\nx y  z") == "# a\n\nx y z\n"


def test_markdown_chunks():
    text = "---\ntitle: x\n---\n\n# Head\n\nOne two three. Four five six.\n\n```\ncode block\n```\n\nLast words here."
    got = markdown.chunks(text, 5)
    assert "".join(t for t, _ in got) == text
    assert [t for t, free in got if not free] and all("code" not in t and "title" not in t for t, free in got if free)
    assert all(len(t.split()) <= 5 for t, free in got if free)
    with pytest.raises(ValueError):
        markdown.chunks("abc", 2, len)


def test_shield(spark):
    text = "# A *b* [c](http://x.y/z) `d`\n- e <f>\n| g |\n---\n"
    s = markdown.shield_column(F.col("t"))
    assert one(spark, markdown.unshield_column(s["text"], s["tokens"]), t=text) == text
    assert one(spark, markdown.unshield_column(F.replace(s["text"], F.lit("ZXQMARKDOWN0QXZ"), F.lit("")), s["tokens"]), t=text) is None


def test_interrupted(spark):
    text = "# Story\n\nIt was pro-\n\n# A Person\n\nlonged by rain."
    joined, changes = markdown.join_interrupted(text, lambda w: 5.0 if w == "prolonged" else 0.0)
    assert joined == "# Story\n\n*A Person*\n\nIt was prolonged by rain." and len(changes) == 1
    assert markdown.join_interrupted(text, lambda w: 0.0) == (text, [])
    assert markdown.join_interrupted("pro-\n\n# A Person\n\nlonged")[1] == []
    moved = lambda text, *ok: one(spark, markdown.attach_byline_column(F.col("t"), F.lit("P"), F.lit("T"), *ok), t=text)
    assert moved("# T\n\n## P\nbody") == "# T\n\n*P*\n\nbody"
    assert moved("# T") is None
    assert moved("# T", True) == "# T\n\n*P*"


def test_refine_math():
    assert markdown.refine_math(r"keep \(x_1\) here", None, None, lambda b: b) == ("keep $x_1$ here", 0, 1)
    chars = [{"text": c, "bbox_valid": True, "bbox": (i, 0, i + 1, 2)} for i, c in enumerate("a $x$")]
    assert markdown.refine_math("a $x$", chars, lambda box: f"r{box}", None) == ("a $r(3, 0, 4, 2)$", 1, 0)


def test_words_and_confusions(spark):
    assert markdown.words("Añ-b 1") == [(0, 2, "Añ"), (3, 4, "b"), (5, 6, "1")]
    assert markdown.valid_confusions([["rn", "m"]]) == [("rn", "m")]
    for bad in ("x", [["a"]], [["", "b"]], [["a-", "b"]], [["a", "b"]] * 101):
        with pytest.raises(ValueError):
            markdown.valid_confusions(bad)
    assert one(spark, markdown.accepted(F.lit("modern"), F.array(F.lit("modern")), F.lit("rnodern")))
    assert not one(spark, markdown.accepted(F.lit("free text"), F.array(F.lit("modern")), F.lit("rnodern")))


def test_misread_words_by_brute_force(spark):
    """All exchanges of one shape, tried one by one."""
    import random

    r = random.Random(3)
    for pairs in (markdown.CONFUSIONS, [("rn", "m"), ("a", "o"), ("o", "u"), ("m", "nn"), ("ab", "ou")]):
        freq = {"".join(r.choice(["rn", "m", "cl", "d", "vv", "v", "w", "1", "l", "I", "0", "O", "a", "o", "u", "n", "ab"]) for _ in range(r.randint(1, 5))): r.randrange(60) / 10 for _ in range(3000)}
        want = {}
        for w, z in freq.items():
            if 3 <= len(w) <= 64 and not w.isdigit() and z < 3.5:
                others = {w[:i] + b + w[i + len(a) :] for a, b in pairs for i in range(len(w)) if w[i : i + len(a)] == a}
                good = sorted(x for x in others - {w} if freq.get(x, 0) >= 2.5 and freq[x] >= z + 0.8)
                if good:
                    want[w] = good
        df = spark.createDataFrame(list(freq.items()), "word string, zipf double")
        assert {x["word"]: x["choices"] for x in markdown.pick_corrections(df, df, pairs).collect()} == want and len(want) > 20
    assert markdown.shapes([("ab", "cd")]) == ({}, [("ab", "cd")])


def test_numbers_kept_in_time(spark):
    import time

    kept = lambda a, b: one(spark, T.numbers_kept(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert kept(["1", "2", "1"], ["1", "1", "3", "2"]) and not kept(["1", "1"], ["1", "2"]) and not kept(["1"], ["2"])
    assert kept(["x"], ["x"]) and one(spark, T.numbers_kept(F.array().cast("array<string>"), F.array().cast("array<string>")))
    at = time.time()
    many = F.transform(F.sequence(F.lit(1), F.lit(32_000)), lambda i: (i % 9000).cast("string"))
    assert one(spark, T.numbers_kept(many, F.reverse(many))) and time.time() - at < 8


def test_reading_order(spark):
    ids = F.array(F.lit("b1"), F.lit("b2"))
    roles = F.create_map(F.lit("b1"), F.lit("title"), F.lit("b2"), F.lit("byline"))
    attach = F.create_map(F.lit("b2"), F.lit("b1"))
    ok = lambda order, r=roles, c=0.9: one(spark, layout.valid_order(F.array(*map(F.lit, order)), r, attach, F.lit(c), ids))
    assert ok(["b2", "b1"]) and not ok(["b1", "b1"]) and not ok(["b1"]) and not ok(["b1", "b2"], c=1.5)
    assert not ok(["b1", "b2"], F.create_map(F.lit("b1"), F.lit("title"), F.lit("b2"), F.lit("other")))
    assert one(spark, layout.may_attach(roles, F.lit("b2"), F.lit("b1"), F.lit(0.8))) and not one(spark, layout.may_attach(roles, F.lit("b2"), F.lit("b1"), F.lit(0.7)))
    assert one(spark, layout.may_publish(F.lit("a"), F.lit("a"), F.lit(0), F.lit(0))) and not one(spark, layout.may_publish(F.lit("a"), F.lit("b"), F.lit(0), F.lit(0)))


def test_header_candidates(spark):
    blocks = [("d", 0, "section_header", "Big title", 100.0, 2500.0, 900.0, 2400.0), ("d", 1, "text", "left column", 100.0, 2000.0, 1000.0, 500.0), ("d", 2, "section_header", "Writer", 1300.0, 2000.0, 1500.0, 1950.0), ("d", 3, "text", "right column", 1100.0, 1900.0, 1900.0, 500.0)]
    df = spark.createDataFrame([(*b, 2000.0, 2600.0) for b in blocks], "doc string, pos int, label string, text string, l double, t double, r double, b double, width double, height double")
    assert [(r["metadata"], r["title"]) for r in layout.header_candidates(df).collect()] == [("Writer", "Big title")]


def test_gaps_are_white_space(spark):
    texts = spark.createDataFrame([(f"a{chr(i)}b",) for i in range(1, 0x3100)], "t string")
    assert texts.where((F.size(T.visible_words(F.col("t"))) == 2) != F.col("t").rlike(f"[{T.SPACE}]")).count() == 0
