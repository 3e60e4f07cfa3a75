"""Awkward documents for all operators of the subpackage, and plain versions of what the operators compute."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names operators use inside.
CLASHING = "block key group label size words taken score ids rank host rule verdict component piece task one two rep".split()


def sentence(n, seed, stem="w"):
    r = random.Random(seed)
    return " ".join(f"{stem}{r.randrange(400)}" for _ in range(n))


def thue_morse(n, letters="ab"):
    """Words that sums of powers modulo 2**64 can't tell from their complement."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def texts():
    base = sentence(120, 1)
    near = base.split()
    near[60] = "changed"
    passage = sentence(60, 2, "p")
    long_ = sentence(20_000, 3, "l")
    return [
        None,
        "",
        " \t\n ",
        "one",
        "Two words",
        base,
        base,
        " ".join(near),
        base.upper().replace("W", "w"),
        f"{sentence(30, 4)}\n{passage} {sentence(30, 5)}",
        f"{sentence(10, 6)} {passage}\n{sentence(50, 7)}",
        passage,
        "x" * 5000,
        long_,
        long_ + " tail",
        "same line\nsame line\nother line\nsame line " * 30,
        "### $$$ %%% &&& *** " * 40,
        "mail a.b@c.example.com from 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 010-9999 now.",
        'the token = "c1e4c9030b2f4a" and 300.1.1.1 and a@b',
        "Ünïcödé straße ١٢٣ 日本語 テスト 👍🏽  nbsp",
        "\x00\x01 control \x7f",
        f"{thue_morse(1024)} {sentence(19, 10, 't')}",
        f"{thue_morse(1024, 'ba')} {sentence(19, 10, 't')}",
        thue_morse(4096),
        thue_morse(4096, "ba"),
    ]


def rows():
    """doc_id, text, lang, source, n_chars and clashing columns: ties, repeated rows and nulls in every column."""
    out = []
    for i, t in enumerate(texts()):
        out.append((i * 3, t, ("en", "fr", None)[i % 3], ("b", "a", None, "c")[i % 4], None if t is None else len(t)))
    out.append(out[5])
    out.append((None, texts()[5], None, None, None))
    out.append((7, "tie " + sentence(40, 9), "en", "a", None))
    out.append((7, "tie " + sentence(40, 8), "en", "a", None))
    return [(*r, *("clash" for _ in CLASHING)) for r in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ordered(docs):
    return sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def dedup(docs, size=20, marks=None):
    """doc_id, words, removed, kept text by the definition; marks: the digests that order texts of one doc_id."""
    seen, out = set(), []
    for d in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (marks or {}).get(r[1] or "", 0))):
        w = WORD.findall(d[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            win = tuple(w[i : i + size])
            if win in seen:
                gone[i : i + size] = [True] * size
            seen.add(win)
        out.append((d[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(docs, n=3, percent=90):
    """doc_id, size of the set, component by the definition; rows with one doc_id count as one document."""
    sets = [(d[0], shingles(d[1], n)) for d in docs]
    label = {d[0]: d[0] for d in docs if d[0] is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    label[q] = p
    return [(a, len(x), None if a is None else find(a)) for a, x in sets]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
