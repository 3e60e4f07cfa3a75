"""Main text of HTML pages by tag-path ratios.

A page is read into elements and blocks of text. Every block has the path of tags and classes from the root to it; for
each path, text length and punctuation are summed and divided by the path's blocks. The ratios are smoothed over the
blocks in page order and fused, and paths above a share of the mean are chosen. Elements whose own text is for the greater
part on chosen paths are content nodes. The text is all blocks of chosen paths, those that content nodes directly hold or
that lie between two of these, and headings before them; where most chosen text is in articles, of the articles alone.
Parts that by tag, class, id or role are menus, adverts, forms, notices, comments and the like are never text, but for a
marked element that holds the article, and for marked paragraphs where these hold most of the articles' text.

An empty table gives an empty result. Null or empty HTML, and pages without any text but such parts, give an empty text. Tags left open and a cut-off end are
read as far as they go; a `<` that begins no tag is text. Paths with equal ratios are chosen alike. Pages of any length
and depth take time in proportion to their length. Repeated rows are extracted alike; other columns are carried by `keep`.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import passes, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Tags that are passed over up to their end, within a block as well; and those where only if there is an end.
RAW = frozenset("script style textarea title noscript template iframe svg".split())
PASSED = RAW | frozenset("button select canvas".split())
IN_HEAD = RAW | frozenset("base link meta".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that hold text but aren't the container of an article.
PROSE = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr th td center".split())
LISTS = frozenset("ul ol dl table figure".split())
#: Open elements that a start tag ends, and those that such an end may reach over.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {h: {"p"} | HEADINGS for h in HEADINGS}
BESIDE_P = INLINE | frozenset("td th li dt dd tr option".split())
LOOSE = HEADINGS | frozenset("p li dt dd tr option".split())
CELLS = frozenset(("td", "th"))

#: Tags whose content is never article text. A form may hold the whole page.
OUTSIDE = frozenset("head script style noscript template nav footer aside button select option input textarea iframe svg dialog menu object canvas".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that mark such parts, those that mark what readers wrote, and words that may stand with them.
PARTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu footer toolbar pagination pager search skip copyright".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion".split())
REPLIES = frozenset("comment comments commentlist respond disqus replies reply".split())
HEADERS = frozenset("header masthead topbar banner".split())
PLAIN = frozenset("area bar block bottom box button buttons container content first form group holder inner item items last left link links list main mobile page panel post posts primary right row secondary section side site slot small text thread title top unit wrap wrapper".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?:[!?]|/[^A-Za-z])[^>]*+(?:>|\Z)"  # a declaration or a malformed end
    # a tag: its name, then attributes, where quotes count only behind an equals sign; and how it ends
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:_-]*+)(?P<attributes>(?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)*+)(?P<stop>>|\Z|(?=<))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']\S*)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？،।]")
#: Blocks on either side over which ratios are smoothed, and the share of the mean score that a chosen path needs.
SMOOTH, THRESHOLD = 2, 0.4
#: Paths of paragraphs with one mark a block and so many characters are chosen as well: sentences, as in an introduction.
SENTENCE = 40
#: Marks of sentences that make a text an article.
SENTENCES = 3

HARD, SOFT, QUIET = 2, 1, 3


@dataclass
class Page:
    """Elements, numbered as they begin (0 is the page), and blocks of text in page order."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    #: The outermost article around the element, or else the innermost main.
    articles: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names(value: str, words: frozenset) -> bool:
    """Whether some name consists of words that mark a part, and of such as may stand with them."""
    for name in value.split():
        said = [x.lower() for x in WORDS.findall(name)]
        if any(x in words for x in said) and all(x in words or x in PLAIN or x in PARTS for x in said):
            return True
    return False


def _mark(tag: str, attributes: dict[str, str], article: int) -> int:
    if tag in OUTSIDE or "hidden" in attributes or not ROLES.isdisjoint(attributes.get("role", "").lower().split()):
        return HARD
    if tag == "header" and not article:
        return HARD
    if tag == "form":
        return SOFT
    if tag in ("html", "body", "main"):
        return 0
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if article and tag in PROSE and tag not in LISTS:
        return QUIET if _names(named, PARTS | REPLIES) else 0
    if _names(named, REPLIES):
        return HARD
    if tag == "article":
        return 0
    return SOFT if _names(named, PARTS) or (not article and _names(named, HEADERS)) else 0


def read(source: str) -> Page:
    page, known = Page(), {}
    stack: list[tuple[str, int]] = []  # open tags, each with its element, or that around it for inline tags
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    blocks: list[int] = []  # where in the stack tags are open that aren't inline
    text: list[str] = []
    endless: set[str] = set()  # tags that have no end from here on
    muted: list[int] = []  # where in the stack inline adverts are open

    def say(said: str):
        if not muted:
            text.append(said)

    def flush():
        said = " ".join("".join(text).split())
        if said:
            page.blocks.append((stack[blocks[-1]][1] if blocks else 0, said))
        text.clear()

    def close(to: int):
        while len(stack) > to:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
            if muted and muted[-1] == len(stack):
                muted.pop()

    def start(tag: str, raw: str):
        over = stack[-1][1] if stack else 0
        if tag not in INLINE:
            named = _attributes(raw)
            article = page.articles[over]
            page.marks.append(_mark(tag, named, article))
            if tag in ("article", "main") and page.tags[article] != "article":
                article = len(page.tags)
            key = (page.paths[over], tag, " ".join(sorted(named.get("class", "").lower().split())))
            page.paths.append(known.setdefault(key, len(known) + 1))
            page.parents.append(over)
            page.articles.append(article)
            page.tags.append(tag)
            over = len(page.tags) - 1
            blocks.append(len(stack))
        elif "class" in raw or "id" in raw or not raw.islower():
            named = _attributes(raw)
            if _names(f"{named.get('class', '')} {named.get('id', '')}", ADVERTS):
                muted.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, over))

    def imply(tag: str):
        """Ends what the start tag ends by itself."""
        ends = CLOSES.get(tag) or ({"p"} if tag not in BESIDE_P else set())
        for at in reversed(blocks):
            if stack[at][0] in ends:
                close(at)
                return
            if stack[at][0] not in LOOSE and not (tag == "tr" and stack[at][0] in CELLS):
                return

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            say(_html.unescape(source[at:]))
            break
        tag, raw = (m["tag"] or "").lower(), m["attributes"] or ""
        if tag and not m["stop"] and (m.end() < size or ("=" not in raw and raw.strip(" /"))):
            say(_html.unescape(source[at : m.end()]))  # no tag, but text
            at = m.end()
            continue
        if m.start() > at:
            say(_html.unescape(source[at : m.start()]))
        at = m.end()
        if not tag:
            continue
        flows = tag in INLINE or tag in PASSED or (tag in VOID and tag != "hr")
        if tag == "br":
            say(" ")
        elif m["end"]:
            if not flows:
                flush()
            where = places.get(tag)
            if where and not (tag in INLINE and blocks and where[-1] < blocks[-1]):
                close(where[-1])
        elif tag in PASSED and not raw.endswith("/") and (tag in RAW or tag not in endless):
            stop = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if stop is None:
                endless.add(tag)
            at = stop.end() if stop else size if tag in RAW else at
        elif not (tag in ("html", "body") and places.get(tag)):
            if not flows:
                flush()
                imply(tag)
                if places.get("head") and tag not in IN_HEAD:
                    close(places["head"][-1])
            if tag not in VOID and not raw.endswith("/"):
                start(tag, raw)
    flush()
    return page


def outside(page: Page) -> list[bool]:
    """By element: whether it lies in a part that isn't the article's.

    Hard marks hold for all below. A soft mark doesn't if its element holds more text than is unmarked and the page's only
    article or main; or, on pages without these, nearly all text, in sentences, where there are none outside of marks."""
    n = len(page.tags)
    hard, over = [False] * n, [n] * n  # over: the nearest softly marked element, n for none
    for i in range(1, n):
        p = page.parents[i]
        hard[i] = hard[p] or page.marks[i] == HARD
        over[i] = i if page.marks[i] == SOFT and not hard[i] else over[p]
    size, said, articles = [0] * (n + 1), [0] * (n + 1), set()  # what each one holds, beside those within it
    for i, t in page.blocks:
        if not hard[i]:
            size[over[i]] += len(t)
            said[over[i]] += len(PUNCTUATION.findall(t))
            articles |= {page.articles[i]} - {0}
    below: dict[int, list[int]] = {}
    whole, marks = list(size), list(said)
    for i in range(n - 1, 0, -1):
        if over[i] == i:
            up = over[page.parents[i]]
            below.setdefault(up, []).append(i)
            if up < n:
                whole[up] += whole[i]
                marks[up] += marks[i]
    around: set[int] = set()  # the only article
    if len(articles) == 1:
        i = over[next(iter(articles))]
        while i < n:
            around.add(i)
            i = over[page.parents[i]]
    taken: set[int] = set()
    total, plain, sentences = sum(len(t) for _, t in page.blocks), size[n], said[n]
    at = n
    while nearest := below.get(at):
        best = max(nearest, key=lambda i: (i in around, whole[i], -i))
        holds = best in around and whole[best] > plain
        alone = not articles and 2 * whole[best] > total and marks[best] >= SENTENCES and 10 * plain < whole[best] and sentences < SENTENCES
        if not (holds or alone):
            break
        taken.add(best)
        plain, sentences, at = plain + size[best], sentences + said[best], best
    out, quiet = [False] * n, [False] * n
    for i in range(1, n):
        p = page.parents[i]
        out[i] = out[p] or page.marks[i] == HARD or (page.marks[i] == SOFT and i not in taken)
        quiet[i] = quiet[p] or page.marks[i] == QUIET
    inside = [(len(t), quiet[i]) for i, t in page.blocks if page.articles[i] and not out[i]]
    # marked paragraphs that hold most of the articles' text are the text
    if sum(k for k, q in inside if q) <= sum(k for k, q in inside if not q):
        out = [o or q for o, q in zip(out, quiet)]
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    weights = np.exp(-0.5 * np.arange(-SMOOTH, SMOOTH + 1) ** 2)
    return np.convolve(x, weights)[SMOOTH : SMOOTH + len(x)] / np.convolve(np.ones(len(x)), weights)[SMOOTH : SMOOTH + len(x)]


def chosen_paths(paths: list[int], texts: list[str], prose: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks: whether each one's path is chosen, and its path's score.

    A path's ratios are characters and punctuation marks by block. They are smoothed in page order, fused by their
    geometric mean, and averaged over the path's blocks; the threshold is a share of the mean score of all characters."""
    at = np.unique(np.array(paths), return_inverse=True)[1]
    length, marks = np.array([len(t) for t in texts], float), np.array([len(PUNCTUATION.findall(t)) for t in texts], float)
    n = np.bincount(at)
    text_ratio, mark_ratio = np.bincount(at, length) / n, np.bincount(at, marks) / n
    fused = np.sqrt(_smooth(text_ratio[at]) * (1 + _smooth(mark_ratio[at])) * text_ratio[at] * (1 + mark_ratio[at])) ** 0.5
    score = np.bincount(at, fused) / n
    least = THRESHOLD * (score[at] * length).sum() / length.sum()
    sentences = (mark_ratio >= 1) & (text_ratio >= SENTENCE)
    return (score[at] >= least) | (sentences[at] & np.array(prose)), score[at]


def main_text(source: str | None) -> str:
    """The page's text, blocks joined by line feeds."""
    page = read(source or "")
    away = outside(page)
    held = [(i, t) for i, t in page.blocks if not away[i]]
    if not held:
        return ""
    own = [page.tags[i] in ("p", "blockquote") for i, _ in held]
    chosen, score = chosen_paths([page.paths[i] for i, _ in held], [t for _, t in held], own)
    weight = score * np.array([len(t) for _, t in held]) * chosen
    article = np.array([page.articles[i] for i, _ in held])
    if weight[article > 0].sum() >= weight[article == 0].sum():
        part = np.isin(article, article[chosen & (article > 0)])
    else:  # beside the text, several articles are teasers of others
        part = article == 0 if len(set(article.tolist()) - {0}) > 1 else np.ones(len(held), bool)
    held, chosen = [x for x, k in zip(held, part) if k], chosen[part]
    # content nodes: more than half of what they directly hold is chosen. All blocks between two that a node directly
    # holds lie below it
    box = [0] * len(page.tags)  # the nearest element that isn't a paragraph, list, quotation, part of a table or article's header
    for i in range(1, len(box)):
        box[i] = box[page.parents[i]] if page.tags[i] in PROSE or (page.tags[i] == "header" and page.articles[i]) else i
    at = np.array([box[i] for i, _ in held])
    size = np.array([len(t) for _, t in held])
    holder = np.unique(at, return_inverse=True)[1]
    share = np.bincount(holder, size * chosen) > 0.5 * np.bincount(holder, size)
    direct = share[holder]
    nodes = np.flatnonzero(direct)
    first, last = dict(zip(at[nodes[::-1]].tolist(), nodes[::-1].tolist())), dict(zip(at[nodes].tolist(), nodes.tolist()))
    cover = np.zeros(len(held) + 1, int)
    for b in first:
        if page.tags[b] not in ("html", "body"):
            cover[first[b]] += 1
            cover[last[b]] -= 1
    kept = chosen | direct | (np.cumsum(cover[:-1]) > 0)
    for k in range(len(held) - 2, -1, -1):
        kept[k] |= kept[k + 1] and page.tags[held[k][0]] in HEADINGS
    return "\n".join(t for (_, t), k in zip(held, kept) if k)


def extract(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """The columns named by keep and text for every page."""
    rows = pages.select(*keep, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for part in passes(batch, "_html"):
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "text"])

    return rows.mapInArrow(tidied(run), f"{kinds + ', ' if kinds else ''}text string")
