"""Each operator against a plain version, on documents with nulls, ties, repeated rows, long texts and clashing columns."""

import base64
import collections
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import bpe, html_extract, language_id, mixing, order_minhash, pii, quality_rules, signature_trees, substring_dedup, url_filters
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.documents(spark, [])


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_minhash(docs, empty):
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in order_minhash.fingerprints(docs).collect()}
    rows = cases.ordered(cases.rows())
    assert len(got) <= len(rows) == order_minhash.fingerprints(docs).count()
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        row = got[r[0], len(text), cases.sha(other)]
        mark, changed, near = (order_minhash.fingerprint(order_minhash.points(x)) for x in (text, other, following))
        assert row["fingerprint"] == order_minhash.spelled(mark) and row["edited_fingerprint"] == order_minhash.spelled(changed)
        assert row["near_next"] == order_minhash.likeness(mark, near) and row["near_edited"] == order_minhash.likeness(mark, changed)
    assert order_minhash.fingerprints(empty).count() == 0


def test_order_minhash_follows_edits_and_order():
    text = cases.sentence(300, 1)
    few, many = text.replace("w1 ", "q ", 3), cases.sentence(300, 2)
    swapped = text[len(text) // 2 :] + text[: len(text) // 2]
    f = lambda x: order_minhash.fingerprint(order_minhash.points(x))
    near = [order_minhash.likeness(f(text), f(x)) for x in (text, few, many)]
    assert near[0] == 1 and near[0] >= near[1] > near[2]
    assert order_minhash.likeness(f(text), f(swapped)) < 1
    long = cases.sentence(3_000, 1)
    assert order_minhash.likeness(f(long), f(long + cases.sentence(500, 2))) > 0.5 < order_minhash.likeness(f(long[:20_000]), f(long[:16_000]))


def test_order_minhash_picks_the_smallest():
    code = order_minhash.points("abcabcabcabd" * 30)
    value, at = order_minhash._numbered(order_minhash._kmers(code))
    assert len(set(value.tolist())) == len(value) == len(code) - order_minhash.K + 1
    want = []
    with np.errstate(over="ignore"):
        for j in range(order_minhash.SKETCHES):
            scrambled = [int(v) * int(order_minhash._FACTORS[j]) % (1 << 64) for v in value]
            pick = sorted(range(len(value)), key=lambda i: scrambled[i])[: order_minhash.TUPLE]
            held = np.array([j], np.uint64) * order_minhash._STEP
            for c, i in enumerate(sorted(pick, key=lambda i: at[i])):
                held = order_minhash.mix(held ^ value[i], c + 1)
            want.append(int(held[0]) >> 32)
    assert order_minhash.fingerprint(code).tolist() == want


def test_order_minhash_numbers_occurrences():
    """k-mers by code points, numbered from 0 in the order of the text; by brute force."""
    text = "aabaabaab-é日" * 9
    code = order_minhash.points(text)
    value, at = order_minhash._numbered(order_minhash._kmers(code))
    place = {int(p): int(v) for v, p in zip(value, at)}
    seen, number = {}, collections.Counter()
    for i in range(len(text) - order_minhash.K + 1):
        k = text[i : i + order_minhash.K]
        seen.setdefault((k, number[k]), set()).add(place[i])
        number[k] += 1
    assert sorted(place) == list(range(len(text) - order_minhash.K + 1))
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)


def test_order_minhash_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_BYTES", 100)
    monkeypatch.setattr(order_minhash, "QUANTILES", 4)
    data = [(i * i * i - 5000, f"text {i} " * (i % 7)) for i in range(60)] + [(2**63 - 1, "last"), (-(2**63), "first"), (None, "no id")]
    rows = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in order_minhash.fingerprints(rows).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None and r[0] > -(2**63), r[0] if r[0] is not None else -(2**63), r[1]))
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        assert got[i] == cases.sha(text[: len(text) - half] + following[:half])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>,<br>line.<p>Second; with, marks &eacute;. <img src=x>
<form><input><button>Send</button></form><div class="ad">Buy now</div><ul><li>Item one.</li><li>Item two.</li></ul></article>
<aside>Related</aside><section id="comments"><p>Nice post, thanks!</p></section><footer>&copy; me</footer></body></html>"""


def test_html_extract(spark):
    plain = "<html><body><div><div class='menu'><a>A</a> <a>B</a></div><div class='text'><p>" + "Some words, and more. " * 20 + "</p><p>Short.</p></div><div class='footer'>End</div></div></body></html>"
    pages = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, plain, "x"), (5, "<p>Just &lt;text", "x"), (6, "no tags & more", "x"), (1, PAGE, "x"), (7, "<nav>only</nav>", "x"), (8, "<p>" + "word, " * 200_000, "x")]
    df = spark.createDataFrame(pages, "page_id int, html string, text string")
    got = collections.defaultdict(list)
    for r in html_extract.extract(df, "page_id").collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == ["Title & more\nFirst bold, line.\nSecond; with, marks é.\nItem one.\nItem two."] * 2
    assert got[2] == got[3] == got[7] == [""]
    assert got[4] == [" ".join(["Some words, and more."] * 20) + "\nShort."]
    assert got[5] == ["Just <text"] and got[6] == ["no tags & more"]
    assert got[8][0] == " ".join(["word,"] * 200_000)
    assert html_extract.extract(df.limit(0), "page_id").count() == 0


def test_html_extract_keeps_siblings():
    some, more = "<p>" + "Some words, and more. " * 8 + "</p>", "<p>" + "Other words, which go on. " * 30 + "</p>"
    page = lambda x: html_extract.main_text(f"<html><body><div class=logo>Site</div><div class=links><a>A</a> <a>B</a></div>{x}<div class=bottom><a>Imprint</a></div></body></html>")
    said = lambda *xs: "\n".join(re.sub("<[^>]*>", "", x).strip() for x in xs)
    assert page(f"<div class=content><h1>T</h1><div class=intro>{some}</div><h2>U</h2><div class=body>{more}</div></div>") == said("T", some, "U", more)
    assert page(f"<h1>T</h1><div id=a>{some}</div><div id=b><h2>U</h2>{more}</div>") == said("T", some, "U", more)
    items = ["<li>" + f"Item {i}, which is long and goes on. " * 3 + "</li>" for i in range(20)]
    assert page(f"<div class=content>{some}<ul>{''.join(items)}</ul>{some}</div>") == said(some, *items, some)
    assert page(f"<div class=content>{some}<blockquote>{more * 4}</blockquote>{some}</div>") == said(some, *[more] * 4, some)
    assert page(f"<article id=a>{some}</article><article id=b>{more}</article>") == said(some, more)
    assert page(f"<article>{some}<article class=quoted>{more}</article>{some}</article>") == said(some, more, some)


def test_html_extract_reads_marked_wrappers():
    text = "<p>" + "Some words, and more. " * 20 + "</p>"
    want = re.sub("<[^>]*>", "", text).strip()
    page = lambda x: html_extract.main_text(f"<html><body>{x}</body></html>")
    for start, end in [("<div id=page class='site has-sidebar'>", "</div>"), ("<div class='with-sidebar no-comments'>", "</div>"), ("<div class=search-result>", "</div>"), ("<form id=aspnet>", "</form>"), ("<form><div class='wrap widget'>", "</div></form>")]:
        for inner in (f"<article>{text}</article>", f"<main><div>{text}</div></main>", f"<div class=body>{text}</div>"):
            assert page(f"{start}<nav>Menu</nav>{inner}<div class=sidebar>Other. Things. Here. Too.</div><div class=comments>{text}</div>{end}") == want, (start, inner)
    for part in (f"<div class=comments>{text * 20}</div>", f"<div class=related><article>{text * 3}</article><article>{text}</article></div>", "<form class=login>Name <button>Send</button></form>"):
        assert page(f"<div class=body>{text}</div>{part}") == want
        assert page(f"<article>{text}</article>{part}") == want
    assert page("<form class=login>Name and password <button>Send</button></form>") == page("<div class=cookie-notice>We use cookies.</div>") == ""


def random_page(r):
    """A tree of (tag, class, children or text), with marked parts, and with articles in half of all pages."""

    def words(n):
        return " ".join(r.choice(["alpha", "beta,", "gamma.", "delta", "eps;"]) for _ in range(n))

    def grow(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["p", "p", "p", "h2", "ul", "div", "div", "section", *articles])
            if kind == "article" and depth == 0:
                out.append((kind, "", grow(depth + 1)))
            elif kind in ("div", "section") and depth < 4:
                out.append((kind, r.choice(["", "", "body", "intro", "links", "ad", "site-nav", "comments", "has-sidebar"]), grow(depth + 1)))
            elif kind == "ul":
                out.append((kind, "", [("li", "", words(r.choice([1, 3, 20]))) for _ in range(r.randrange(1, 5))]))
            elif kind in ("p", "h2"):
                out.append((kind, r.choice(["", "", "", "", "", "ad", "adBox"]) if kind == "p" and articles else "", words(r.choice([1, 4, 30, 80]) if kind == "p" else 3)))
        return out

    articles = r.choice([[], ["article", "article"]])
    return ("body", "", [*grow(0), ("p", "", "One. Two. Three. Four.")])  # sentences outside of marks: no marked part holds the text


def brute_text(tree):
    """The definition over whole paths and all pairs of blocks."""
    found = []  # path of (number, tag, class), text

    def walk(node, above, number=[0]):
        number[0] += 1
        path = (*above, (number[0], node[0], node[1]))
        for child in [] if isinstance(node[2], str) else node[2]:
            walk(child, path)
        if isinstance(node[2], str) and node[2]:
            found.append((path, node[2]))

    walk(tree, ())
    inside = lambda p: next((x[0] for x in p if x[1] == "article"), 0)
    marked = ("ad", "adBox", "site-nav", "comments")
    quiet = lambda p: inside(p) and p[-1][1] == "p" and p[-1][2] in marked
    found = [(p, t) for p, t in found if not any(c in marked for _, _, c in (p[:-1] if quiet(p) else p))]
    if sum(len(t) for p, t in found if quiet(p)) <= sum(len(t) for p, t in found if inside(p) and not quiet(p)):
        found = [(p, t) for p, t in found if not quiet(p)]
    if not found:
        return ""
    names = [tuple(x[1:] for x in p) for p, _ in found]
    marks = [len(re.findall("[.,;:!?]", t)) for _, t in found]
    mean = lambda xs, name: sum(x for x, n in zip(xs, names) if n == name) / names.count(name)
    ratios = [(mean([len(t) for _, t in found], n), mean(marks, n)) for n in names]

    def smooth(k, i):
        near = [(np.exp(-0.5 * (j - i) ** 2), ratios[j][k]) for j in range(max(0, i - 2), min(len(names), i + 3))]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = [(smooth(0, i) * (1 + smooth(1, i)) * t * (1 + m)) ** 0.25 for i, (t, m) in enumerate(ratios)]
    score = [mean(fused, n) for n in names]
    least = html_extract.THRESHOLD * sum(s * len(t) for s, (_, t) in zip(score, found)) / sum(len(t) for _, t in found)
    chosen = [s >= least or (n[-1][0] == "p" and m >= 1 and t >= html_extract.SENTENCE) for s, n, (t, m) in zip(score, names, ratios)]
    weight = [s * len(t) * c for s, (_, t), c in zip(score, found, chosen)]
    within = [inside(p) for p, _ in found]
    if sum(w for w, a in zip(weight, within) if a) >= sum(w for w, a in zip(weight, within) if not a):
        part = {a for a, c in zip(within, chosen) if a and c}
    else:
        part = {0} if len(set(within) - {0}) > 1 else set(within)
    found, chosen = [x for x, a in zip(found, within) if a in part], [c for c, a in zip(chosen, within) if a in part]
    box = [[x for x in p if x[1] not in html_extract.PROSE][-1] for p, _ in found]
    own = lambda b, only: sum(len(t) for (_, t), c, x in zip(found, chosen, box) if x == b and (c or not only))
    direct = [2 * own(b, True) > own(b, False) for b in box]
    kept = [d or c for d, c in zip(direct, chosen)]
    for i in range(len(found)):
        for j in range(i):
            kept[i] |= any(direct[j] and box[j] == box[k] and box[j][1] != "body" for k in range(i + 1, len(found)))
    for i in range(len(found) - 2, -1, -1):
        kept[i] |= kept[i + 1] and found[i][0][-1][1] == "h2"
    return "\n".join(t for (_, t), k in zip(found, kept) if k)


def test_html_extract_by_brute_force():
    import random

    def written(node):
        inside = node[2] if isinstance(node[2], str) else "".join(map(written, node[2]))
        return f"<{node[0]} class='{node[1]}'>{inside}</{node[0]}>"

    r = random.Random(8)
    checked = 0
    for _ in range(400):
        tree = random_page(r)
        text = brute_text(tree)
        assert html_extract.main_text(f"<html>{written(tree)}</html>") == text
        checked += len(text) > 200
    assert checked > 200


def test_html_extract_goes_by_its_ratios(spark, monkeypatch):
    """Pages with an article lose text if other paths than those of high ratios are chosen."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    right = [html_extract.main_text(x) for x in pages]
    plain = html_extract.chosen_paths

    def turned(paths, texts, prose):
        _, score = plain(paths, texts, prose)
        worst = min(set(paths), key=lambda p: score[paths.index(p)])
        return np.array([p == worst for p in paths]), score

    monkeypatch.setattr(html_extract, "chosen_paths", turned)
    changed = [html_extract.main_text(x) != y for x, y in zip(pages, right) if y.count("\n")]
    assert sum(changed) > 0.9 * len(changed) > 0


def test_html_extract_leaves_adverts_and_comments_in_articles():
    text = "The river rose in spring, and the town was flooded for weeks."
    page = lambda x: html_extract.main_text(f"<nav>x</nav><article><h1>T</h1><p>{text}</p>{x}<p>{text}</p><p>End.</p></article>")
    want = f"T\n{text}\n{text}\nEnd."
    for x in ("<p class='ad'>BUY NOW</p>", "<span class='ad'>BUY NOW</span>", "<a class='adBox' href=x>BUY <b>NOW</b></a>", "<p class='comment'>reader says</p>", "<div class='adBox'>BUY NOW</div>", "<div id=sponsoredPost><p>BUY, now. And now.</p></div>"):
        assert page(x) == want, x
    assert page("<p id='search-for-truth'>Short.</p>") == want.replace(f"{text}\n{text}", f"{text}\nShort.\n{text}")
    assert page("<p>So <span class='ad-hoc'>it</span> <i class=promo>(buy)</i> goes.</p>") == f"T\n{text}\nSo it goes.\n{text}\nEnd."
    # marked paragraphs that hold the text are it
    assert html_extract.main_text("<article><h1>T</h1>" + f"<p class=notice>{text}</p>" * 3 + "</article>") == "\n".join(["T", text, text, text])


def test_html_extract_loses_no_text():
    text = "Some words, and more. " * 10
    inside = [f"<p id='search-for-truth'>{text}</p>", f"<h2 id='comments-on-method'>{text}</h2>", f"<p data-id='ad-3'>{text}</p>", f"<p title=don't>It's lost. {text}</p>", f"<p>{text}</p>"]
    plain = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in inside]
    assert html_extract.main_text(f"<nav>x</nav><article>{''.join(inside)}</article>") == "\n".join(plain)
    assert html_extract.main_text(f"<nav>x</nav><div>{''.join(inside)}</div>") == "\n".join(plain)
    assert html_extract.main_text("<article><p>a <b and it's fine then.</p><p>More.</p></article>") == "a <b and it's fine then.\nMore."
    assert html_extract.main_text("<div><p>Only one paragraph, in here.</p></div><div><p>And another one, in there.</p></div>") == "Only one paragraph, in here.\nAnd another one, in there."
    assert html_extract.main_text("<p>one <script>x</script> two <button>b</button> three</p>") == "one two three"
    assert html_extract.main_text("<pre>a <span class='token comment'># b</span></pre>") == "a # b"


def test_html_extract_tells_articles_from_teasers():
    text = "The river rose in spring, and the town was flooded for weeks."
    body = f"<h1>T</h1><div class=meta>2020, Jo</div><p>{text}</p><p>{text}</p><ul><li>One</li></ul><p>{text}</p>"
    want = "\n".join(["T", "2020, Jo", text, text, "One", text])
    cards = "".join(f"<article><h3>Other {i}</h3><p>Teaser, short.</p></article>" for i in range(3))
    assert html_extract.main_text(f"<body><div class=content>{body}</div><div class=more>{cards}</div></body>") == want
    assert html_extract.main_text(f"<body><article>{body}</article><ol class=commentlist><li><article class=comment><p>{text * 9}</p></article></ol></body>") == want
    assert html_extract.main_text(f"<body><table><tr><td class=nav><a>1</a><td>{body}<td class=ad>Buy, now.</table></body>") == want


def test_html_extract_takes_linear_time():
    import time

    n = 20_000
    pages = ["<div>word, and. " * n, "".join(f"<p id=p{i}>word, and so on. </p>" for i in range(n)), "".join(f"<p class=p{i}>word, and so on. </p>" for i in range(n)), "<span>" * n + "<p>x</p>" * n, "<i><p>" + "<b>" * n + "</i>" * n, '<a b="<a "' * n, "<h1>" * n + "x", "<button>x" * n, "<div class=ad>x." * n, "<form>x, y. " * n, "<a =" * n]
    for page in pages:
        at = time.time()
        html_extract.main_text(page)
        assert time.time() - at < 6, page[:40]
    assert html_extract.main_text(pages[0]).count("\n") == n - 1 == html_extract.main_text(pages[2]).count("\n")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty, reference):
    packed = lambda t: b"".join(struct.pack("<I", i) for i in reference.encode_ordinary(t or ""))
    want = sorted(((r[0], packed(r[1]), (r[1] or "").encode()) for r in cases.rows()), key=repr)
    rows = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, "doc_id", most=50), PATH)
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows.collect()), key=repr)
    assert got == want
    fused = bpe.encode(docs, PATH, public_tokenizers.PATTERN, "doc_id", most=50, decoded="d").collect()
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["d"])) for r in fused), key=repr) == want
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN, "doc_id").count() == 0


def test_bpe_native(docs, reference):
    short = docs.where("text IS NULL OR length(text) < 6000")
    rows = bpe.encode_native(short, PATH, public_tokenizers.PATTERN, "doc_id", most=20)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in rows.collect()), key=repr)
    assert got == sorted(((r[0], reference.encode_ordinary(r[1] or "")) for r in cases.rows() if r[1] is None or len(r[1]) < 6000), key=repr)
    back = rows.select("doc_id", bpe.decode_native(F.col("ids"), PATH).alias("b"), bpe.packed_native(F.col("ids"), PATH).alias("p")).collect()
    assert all(len(r["p"]) % 4 == 0 for r in back) and {bytes(r["b"]) for r in back} == {(r[1] or "").encode() for r in cases.rows() if r[1] is None or len(r[1]) < 6000}


def test_bpe_long_word(reference):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    r = np.random.default_rng(1)
    for word in ("a" * 10_001, "".join(r.choice(list("etaoin"), 3000)), "".join(r.choice(list("xyzé"), 47))):
        assert bpe.fold(word.encode(), ranks) == reference.encode_ordinary(word)


def test_substring_dedup(docs, empty):
    marks = {r["t"]: r["m"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t", F.lit(1)).alias("m")).collect()}
    want = sorted(cases.dedup(cases.rows(), marks=marks), key=repr)
    assert tuples(substring_dedup.dedup(docs)) == want
    assert tuples(substring_dedup.dedup(docs.repartition(7))) == want
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "RANGE_CELLS", 500)
    shared = cases.sentence(70, 99, "s")
    data = [(i, f"{cases.sentence(20 + i % 50, i)} {shared if i % 3 == 0 else ''} {cases.sentence(30, i % 7, 'r')}", None, None, None, *("" for _ in cases.CLASHING)) for i in range(120)]
    assert tuples(substring_dedup.dedup(cases.documents(spark, data))) == sorted(cases.dedup(data), key=repr)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(x)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(x) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(x) if 10 <= len(digits(m)) <= 15])


def test_frequent_words_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(f"{'a ' * 9}{'b ' * 9}{'c ' * 3}d e f g",)], "text string")
    for most, want in ((2, {" a", " b"}), (3, {" a", " b", " c"}), (4, {" a", " b", " c"}), (100, {"a", " a", " b", " c", " d", " e", " f", " g"})):
        assert set(bpe.frequent_words(rows, PATH, public_tokenizers.PATTERN, most).column("w").to_pylist()) == want
    many = spark.createDataFrame([(" ".join(f"w{i}" for i in range(6000)),)], "text string")
    monkeypatch.setattr(bpe, "FILL", 500)
    assert 800 < bpe.frequent_words(many, PATH, public_tokenizers.PATTERN, 1000).num_rows <= 1000


def test_pii(docs, empty):
    rows = pii.annotate(docs, pii.fit(docs), "doc_id", redacted=True).collect()
    assert len(rows) == len(cases.rows())
    by_text = {(r[0], pii.redact(r[1] or "", plain_spans(r[1] or ""))): r[1] for r in cases.rows()}
    for r in rows:
        assert [x for x in r["spans"] if x in r["base"]] == r["base"]
        if r["redacted"] is not None and "token" not in r["redacted"] and "TOKEN" not in r["redacted"]:
            text = by_text[r["doc_id"], r["redacted"]] or ""
            assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["base"]] == plain_spans(text)
    mail = next(r for r in rows if r["redacted"] and r["redacted"].startswith("mail"))
    assert mail["redacted"] == "mail <EMAIL> from <IP>, card <CARD>, call <PHONE> now."
    assert pii.annotate(empty, pii.fit(empty), "doc_id").count() == 0


def test_pii_base_is_leftmost():
    import random

    r = random.Random(3)
    for _ in range(20_000):
        x = "".join(r.choice("a1.9@ -+()2x%_\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(x) == plain_spans(x), x
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


def test_pii_takes_whole_secrets():
    secret = pii.KINDS.index("secret")
    held = lambda x: [x[s:e] for s, k, e in pii.candidates(x, pii.base_spans(x)) if k == secret]
    long = "aB3_" * 100
    for x in (long, "gh" + "p_" + "a1B2" * 40, "sk" + "-" + "a1B2" * 40):
        assert held(f"the token: {x} ends") == [x]
    for x in ("gh" + "p_" + "a1B2" * 40, "sk" + "-" + "a1B2" * 40, "sk" + "-" + "a1B2_-" * 40):
        assert held(f"so {x.strip('-_')} ends")[0] == x.strip("-_")
    x = f"token={long}.john@mail.example.com"  # a base span takes the end of the run, or all of it
    assert "".join(x[s:e] for s, _, e in pii.candidates(x, pii.base_spans(x))) == x[6:]
    x = f"token={long}/4111111111111111/{long} ends"
    assert held(x) == [long + "/", "/" + long]
    assert held("token=" * 50_000) and not held("sk-" * 5)
    # nothing of a secret stays, however long it is and wherever base spans lie in it
    redacted = lambda x: pii.redact(x, pii.spans(x, lambda _: True)[1])
    assert redacted("token=4111111111111111-secretpart99 .") == "token=<CARD><SECRET> ."
    assert redacted("api_key=abcdef1.2.3.4ghijkl .") == redacted(f"api_key={'abc' * 80}def1.2.3.4ghijkl .") == "api_key=<SECRET><IP><SECRET> ."
    assert redacted("token=x1.2.3.4y5.6.7.8z99 .") == "token=<SECRET><IP><SECRET><IP><SECRET> ."
    asked = []
    pii.spans("the isbn token=x1.2.3.4y5.6.7.8z99 .", lambda v: asked.append(v) or True)
    assert len(asked) == 3 and len(set(asked)) == 1


def test_pii_takes_runs_of_any_length_and_number():
    import time

    at = time.time()
    secret = "aB3_" * 1250
    held = f"my token: {secret} ends"
    assert pii.redact(held, pii.candidates(held, pii.base_spans(held))) == "my token: <SECRET> ends"
    mail = f"{'a' * 500} [at] {'b' * 300} [dot] {'c' * 100} [dot] de"
    written = f"write {mail} now"
    assert [written[s:e] for s, _, e in pii.candidates(written, [])] == [mail]
    many = "mail a.b@c.example.com or 10.0.0.1, ssn 123-45-6789; " * 17_000
    assert len(pii.candidates(many, pii.base_spans(many))) == 51_000
    assert pii.candidates("a" * 300_000, []) == [] == pii.candidates("a" * 300_000 + " [at] ", [])
    assert time.time() - at < 20


def test_pii_by_brute_force(spark):
    """Spans that no other one touches, votes, expectation-maximisation and classifier in plain loops."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    counts: collections.Counter = collections.Counter()
    found = {}
    for t in filter(None, texts):
        base, wide = plain_spans(t), []
        for kind, pattern, _ in pii.WIDER:
            for m in pattern.finditer(t):
                wide.append((*(m.span("it") if "it" in pattern.groupindex else m.span()), pii.KINDS.index(kind)))
        covered = {i for a, _, b in base for i in range(a, b)}
        parts = []
        for s, e, k in wide:
            if pii.KINDS[k] != "secret":
                parts += [(s, k, e, (s, k, e))] if covered.isdisjoint(range(s, e)) else []
                continue
            free = [i for i in range(s, e) if i not in covered]
            for i in free:
                if i - 1 not in free:
                    parts.append((i, k, next(j for j in range(i, e + 1) if j not in free), (s, k, e)))
        out = [(x, x) for x in base]
        for s, k, e, whole in sorted(parts, key=lambda x: (x[0], -x[2], x[1], x[3])):
            if not any(a < e and s < b for (a, _, b), _ in out):
                out.append(((s, k, e), whole))
        found[t] = sorted(out)
        counts.update(pii.votes(t, whole, x in base) for x, whole in out)
    got = {tuple(r["votes"]): r["n"] for r in pii.vote_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == dict(counts)
    rows = sorted(counts.items())
    belief = [1 / (1 + np.exp(-1.4 * (sum(v == 2 for v in p[1:7]) - 2 * sum(v == 1 for v in p[1:7]) - 0.5))) for p, _ in rows]
    held = max(1.0, 0.02 * sum(counts.values()))
    for _ in range(50):
        prior = [(1 + sum(b * n for b, (p, n) in zip(belief, rows) if p[0] == k)) / (2 + sum(n for p, n in rows if p[0] == k)) for k in range(len(pii.KINDS))]
        chance = {}
        for j in range(6):
            for truth in (0, 1):
                seen = [held * x + sum((b if truth else 1 - b) * n for b, (p, n) in zip(belief, rows) if p[1 + j] == v) for v, x in ((1, 8.0 - 6 * truth), (2, 2.0 + 6 * truth))]
                chance |= {(j, truth, v): x / sum(seen) for v, x in zip((1, 2), seen)}
        odds = [np.log(prior[p[0]] / (1 - prior[p[0]])) + sum(np.log(chance[j, 1, p[1 + j]] / chance[j, 0, p[1 + j]]) for j in range(6) if p[1 + j]) for p, _ in rows]
        belief = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]
    assert np.allclose(belief, pii.reliabilities(np.array([p for p, _ in rows]), np.array([float(n) for _, n in rows]))[0])
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = pii.fit(docs)
    # the classifier's gradient vanishes at its weights
    x, share = pii._features(np.array([p for p, _ in rows])), np.array([n for _, n in rows]) / sum(counts.values())
    assert np.abs(x.T @ (share * (1 / (1 + np.exp(-x @ model.weights)) - belief)) + 1e-4 * model.weights).max() < 1e-6
    for r in pii.annotate(docs, model, "text").collect():
        said = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]]
        base = plain_spans(r["text"] or "")
        assert said == [x for x, whole in found.get(r["text"], []) if x in base or model.accepts(pii.votes(r["text"], whole, False))]


def test_pii_finds_the_reliable_labelers():
    patterns = np.array([[0, 2, 0, 2, 0, 0, 0, 3], [0, 0, 0, 1, 0, 1, 1, 3], [0, 0, 0, 2, 2, 0, 0, 3], [0, 0, 0, 1, 0, 0, 0, 3]])
    belief, prior, table = pii.reliabilities(patterns, np.array([100.0, 80, 40, 60]))
    assert belief[0] > 0.9 and belief[2] > 0.9 and belief[1] < 0.1 and belief[3] < 0.5
    assert table[2, 1, 2] > table[2, 0, 2] and 0 < prior[0] < 1


def test_mixing(docs, empty):
    rows = mixing.mix(mixing.sized(docs), block=64).collect()
    assert len(rows) == len(cases.rows())
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    sizes = [(s, sum(r["size"] for r in v)) for s, v in by_source.items()]
    goal = mixing.targets(sizes)
    for s, v in by_source.items():
        assert {r["source_size"] for r in v} == {sum(r["size"] for r in v)} and {r["target"] for r in v} == {goal[s]}
        assert abs(sum(r["taken"] for r in v) - goal[s]) <= 3 * 64
        assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in v)
    assert abs(sum(goal.values()) - 1.5 * sum(n for _, n in sizes)) < 1e-3
    assert sorted(map(tuple, rows), key=repr) == tuples(mixing.mix(mixing.sized(docs.repartition(5)), block=64))
    assert mixing.mix(mixing.sized(empty)).count() == 0


def test_targets_stop_at_the_cap():
    assert mixing.targets([("a", 10), ("b", 1000), (None, 1000)]) == {"a": 20.0, "b": pytest.approx(998.333333), None: pytest.approx(1996.666667)}


def test_mixing_follows_its_schedule(spark, docs, monkeypatch):
    """Words, slots and their order by a plain loop over the golden-ratio points; another constant gives another mix."""
    data = [(i, cases.sentence(5 + i * 7 % 40, i), "abc"[i * i % 3]) for i in range(90)]
    rows = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(mixing.sized(rows), block=16).collect()}
    sizes = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in "abc"}
    goal = mixing.targets(list(sizes.items()))
    total, streams, want = sum(goal.values()), {}, {i: [0, None] for i, _, _ in data}
    for s in "abc":
        mine = sorted((d for d in data if d[2] == s), key=lambda d: cases.sha(str(d[0])))
        streams[s] = [d[0] for d in mine for _ in d[1].split()] * 2
    for slot in range(round(total / 16)):
        point, s = slot * mixing.GOLDEN % 1.0, "a"
        for s in "abc":
            if point < sum(goal[x] for x in "abc" if x <= s) / total:
                break
        block, streams[s] = streams[s][:16], streams[s][16:]
        for i in block:
            want[i] = [want[i][0] + 1, slot if want[i][1] is None else want[i][1]]
    assert got == {i: tuple(x) for i, x in want.items()}
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(mixing.sized(rows), block=16).collect()} != got


def test_schedule_spreads_sources(spark):
    goal = [("a", 600.0), ("b", 300.0), ("none", 0.0), (None, 100.0)]
    rows = mixing.schedule(spark, goal, 1000, run=64).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1000))
    for s, k in goal:
        ranks = [r["rank"] for r in rows if r["source"] == s]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - k) <= 3
        assert abs(sum(r["source"] == s for r in rows[:100]) - k / 10) <= 4
    assert mixing.block_words(1e12) == mixing.BLOCK and mixing.block_words(100.0) == 1


def test_quality_rules(docs, empty):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs), "clean-1")
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows.collect()), key=repr)
    assert got == sorted(((r[0], *cases.measures(r[1])) for r in cases.rows()), key=repr)
    for r in rows.collect():
        assert r["kept"] == (r["failed_bits"] == 0)
        assert bool(r["failed_bits"] & 1) == (r["n_words"] < 50) and bool(r["failed_bits"] & 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    cut = {r["rule"]: (r["failed"], r["failed_alone"]) for r in quality_rules.ablations(quality_rules.ledger(docs), "clean-1").collect()}
    bits = [r["failed_bits"] for r in rows.collect()]
    assert cut == {r.name: (sum(bool(b >> r.bit & 1) for b in bits), sum(b == 1 << r.bit for b in bits)) for r in quality_rules.RULES}
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.ablations(quality_rules.ledger(empty), "base-1").count() == 0


def test_signature_trees(docs, empty):
    got = tuples(signature_trees.join(docs))
    want = sorted(cases.linked(cases.rows()), key=repr)
    assert got == want
    assert signature_trees.join(empty).count() == 0


@pytest.mark.parametrize("n, percent, tree", [(3, 90, 6000), (5, 80, 20)])
def test_signature_trees_lose_no_link(spark, monkeypatch, n, percent, tree):
    import random

    monkeypatch.setattr(signature_trees, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(signature_trees, "RANGE_KEYS", 300)
    r, data = random.Random(5), []
    for g in range(12):
        words = cases.sentence(r.choice([4, 12, 30, 90, 200]), g).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"e{r.randrange(50)}"
            if r.random() < 0.3:
                w += ["more"] * r.randrange(3)
            data.append((len(data), " ".join(w), None, None, None, *("" for _ in cases.CLASHING)))
    got = tuples(signature_trees.join(cases.documents(spark, data), n, percent, tree))
    assert got == sorted(cases.linked(data, n, percent), key=repr)


def test_signature_trees_bound_every_task(spark, monkeypatch):
    """Two families in one group, each held together by passages that don't suffice for a link, but for a few members."""
    most = []

    def watch(run):
        def watched(rows, tasks, *more):
            most.append(tasks.distinct().groupBy("group", "piece").count().agg(F.max("count")).first()[0] or 0)
            return run(rows, tasks, *more)

        return watched

    monkeypatch.setattr(signature_trees, "_sent", watch(signature_trees._sent))
    monkeypatch.setattr(signature_trees, "_sent_again", watch(signature_trees._sent_again))
    base, data = [f"w{i}" for i in range(400)], []
    for i in range(240):
        words = list(base)
        for j in range(12 if i % 8 else 4):
            words[(i * 37 + j * 31) % 400] = f"own{i if i % 8 else 0}x{j}"
        data.append((i, " ".join(words), None, None, None, *("" for _ in cases.CLASHING)))
    got = tuples(signature_trees.join(cases.documents(spark, data), 5, 80, 40))
    assert got == sorted(cases.linked(data, 5, 80), key=repr)
    assert len(most) == 2 and 0 < most[1] <= 2 * 40


def test_signature_trees_copy_texts_row_by_row(spark):
    """A document that all pieces of its group share leaves its block once, and Spark copies it."""
    import pyarrow as pa

    docs = pa.table({"doc_id": [1, 2], "text": ["x" * 100_000, "y"], "block": [0, 0]})
    own = pa.table({"d": [1, 2], "group": [9, 9], "piece": pa.array([3, 5], pa.int32()), "again": [True, True], "pieces": pa.array([4000, None], pa.int32())})
    assert signature_trees._send(None, docs, own).nbytes < 101_000
    tasks = spark.createDataFrame([(1, 9, 3, True, 4000), (2, 9, 5, True, None)], "doc_id long, group long, piece int, again boolean, pieces int")
    sent = signature_trees._sent(spark.createDataFrame([(1, "x" * 100), (2, "y")], "doc_id long, text string"), tasks, 2)
    got = sent.groupBy("doc_id").agg(F.count_distinct("group").alias("groups"), F.count_if("again").alias("again"), F.min(F.length("text")).alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 4000, 1, 100), (2, 1, 1, 1)]


def test_signature_trees_spread_large_groups(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30_000, 1).otherwise(F.col("id")).alias("group"))
    few = rows.groupBy("group").agg(F.count("*").alias("_rows"), F.max("doc_id").alias("best"))
    got = signature_trees._known(rows, few, "group", "doc_id", 1000)
    assert got.count() == 40_000 and got.where("best IS NULL").isEmpty() and got.columns == ["group", "doc_id", "best"]


def test_tables_go_when_a_query_ends(spark):
    from pathlib import Path

    from corpusloom.plans import storage

    storage.shared_folder(spark)
    folder = Path((spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).removeprefix("file:"))
    before = set(folder.glob("corpusloom-*"))
    with storage.temporary():
        assert signature_trees.join(cases.documents(spark)).count() == len(cases.rows())
        assert set(folder.glob("corpusloom-*")) > before
    assert set(folder.glob("corpusloom-*")) == before


def test_tree_is_exact():
    r = np.random.default_rng(2)
    sets = []
    for g in range(30):
        base = r.integers(0, 1 << 60, int(r.integers(5, 80)), dtype=np.uint64)
        for _ in range(int(r.integers(1, 30))):
            sets.append(np.unique(np.where(r.random(len(base)) < 0.04, r.integers(0, 1 << 60, len(base), dtype=np.uint64), base)))
    sets = [np.stack([s, s * np.uint64(3)]) for s in sets]
    label = signature_trees.Tree(sets).labels(80)
    plain = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x[0], sets[j][0]))
            if 100 * both >= 80 * (x.shape[1] + sets[j].shape[1] - both):
                p, q = sorted((plain[i], plain[j]))
                plain = [p if y == q else y for y in plain]
    assert label.tolist() == plain


def test_language_id(spark, docs, empty):
    said = {"en": "the cat and the dog with other things that they have", "fr": "le chat et les chiens avec une autre chose que nous avons", "de": "der hund und die katze mit einer anderen sache die wir haben"}
    train = [(i, f"{t} {i}", k) for i, (k, t) in enumerate(list(said.items()) * 30)]
    model = language_id.fit(spark.createDataFrame([*train, (999, None, "en"), (998, "", "fr"), (997, "text", None)], "doc_id int, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    asked = spark.createDataFrame([("the dog and other cats", "en"), ("les autres chats avec nous", "fr"), ("die anderen katzen haben", "de"), (None, "und"), ("", "und"), ("123 !?", "und")], "text string, want string")
    for r in language_id.identify(asked, model, "want").collect():
        assert r["lang_pred"] == r["want"] and 0 <= r["score"] <= 1
    got = language_id.identify(docs, model, "doc_id").collect()
    assert len(got) == len(cases.rows())
    assert language_id.accepted(language_id.identify(asked, model, "want")).count() == 3
    assert language_id.identify(empty, model, "doc_id").count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing, "doc_id").collect()} == {"und"}


def test_language_id_costs_few_jobs(spark):
    """However many partitions a shuffle has, the filter's few parts come to the driver in few jobs."""
    rows = spark.createDataFrame([(1, "some english words " * 9, "en"), (2, "quelques mots " * 9, "fr")], "doc_id long, text string, lang string")
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert language_id.fit(rows).langs == ["en", "fr"]
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) < 32
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_language_id_by_brute_force(spark, monkeypatch):
    """Sets of trigrams in place of the filter: the same languages, and scores up to chance hits of the filter."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    counts: dict = collections.defaultdict(collections.Counter)
    grams = lambda t: [x if x.isalpha() else None for x in (t or "").lower()]
    every = lambda t: [tuple(g[i - 1 : i + 2]) for g in [[None, *grams(t), None]] for i in range(1, len(g) - 1) if g[i]]
    for _, text, lang in docs:
        if lang is not None:
            counts[lang].update(every(text))
    share = {k: {g: n / sum(c.values()) for g, n in c.items() if n >= language_id.LEAST} for k, c in counts.items()}
    held = {k: {g for g, x in c.items() if x >= language_id.STRAY * max(s.get(g, 0) for s in share.values())} for k, c in share.items()}
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for room in (language_id.MOST_BYTES, 16_384):  # as many slots as wanted, and fewer: no trigram goes
        model = language_id.fit(rows, room=room)
        assert model.slots.nbytes <= room and model.langs == sorted(held)
        for r in language_id.identify(rows, model, "doc_id", "text").collect():
            own = every(r["text"])
            hits = {k: sum(g in held[k] for g in own) / len(own) for k in held} if own else {}
            if not own:
                assert (r["lang_pred"], r["score"]) == ("und", 0)
            elif room > 16_384:
                assert abs(r["score"] - max(hits.values())) < 0.1 and hits[r["lang_pred"]] >= max(hits.values()) - 0.1
    assert language_id.slots_for(1 << 40, 65) * 16 <= language_id.MOST_BYTES < language_id.slots_for(1 << 40, 64) * 16
    nobody = language_id.identify(spark.createDataFrame([(None, "some text", "en")], "doc_id long, text string, lang string"), model, "doc_id")
    assert nobody.count() == 1


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*((?:/[^?#]*)?)", rest)[1]
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


def test_url_filters(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.example.org", "", "block")]
    urls = [None, "", "nothing", "http://EXAMPLE.net/en/x?y#z", "https://x.example.net/EN/", "http://example.com/de/1", "http://example.com.org/fr/", "http://net", "http://net/", "http://.net/", "http://a.b.example.org", "http://" + "s." * 500 + "example.com/de/" + "p" * 3000, "x://h?q/", "http://example.net/en/x?y#z"]
    pages = spark.createDataFrame([(i, u, "c", "c", "c", "c") for i, u in enumerate(urls)], "page_id int, url string, host string, _u string, _rule string, r_host string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("example.com", "/de/", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, table).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filters.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, table.limit(0), default="block").collect()} == {"block"}


