"""Spelling variants, repaired conversations and exact search, each against a plain version."""

import collections
import functools
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pivot_search, spelling, turn_repair
from corpusloom.llm.queries import damaged_turns
from tests.llm import cases


def counted(docs, every=None):
    out = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 5 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n), key=repr)


def variants(spark, docs, every=None):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(spelling.word_counts(rows, every)).collect()), key=repr)


def test_spelling_variants(spark):
    r = random.Random(7)
    stems = ["general", "aaaaaaa", "élèvesé", "straßen", "mississippi", "x×y÷zabc"]
    words = []
    for s in stems:
        for k in range(12):
            w = list(s)
            for _ in range(k % 3):
                i = r.randrange(len(w))
                [w.__setitem__, w.insert][k % 2](i, r.choice("abé"))
            if k % 4 == 3:
                del w[r.randrange(len(w))]
            words += ["".join(w)] * r.choice([1, 3, 5, 6, 26, 30, 131])
    # a chain of forms: 5, 25, 125, 625 occurrences
    for i, w in enumerate(["chainaaa", "chainaab", "chainabb", "chainbbb"]):
        words += [w] * 5 ** (i + 1)
    r.shuffle(words)
    docs = [(i if i % 9 else None, " ".join(words[i::40]) + (". UPPER'Case\tGENERAL" if i % 3 else "")) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "12 _ ,"), (102, "general " * 3)]
    for every in (None, 7):
        want = plain_variants(counted(docs, every))
        assert variants(spark, docs, every) == want and any(x[3] for x in want)
    assert ("chainaaa", 5, 1, "chainaab", 25, "chainbbb") in variants(spark, docs)
    assert variants(spark, [(1, None)]) == []


def test_spelling_of_long_texts_and_words(spark, monkeypatch):
    long_ = "q" * 3000 + "Wort" + "r" * 3000
    docs = [(i, f"{long_} {long_[:-1]}x {'tail ' * 10}letters") for i in range(5)]
    assert variants(spark, docs) == plain_variants(counted(docs))
    monkeypatch.setattr(spelling, "SLICE", 10)
    text = "one secondword " * 30 + "é" * 55
    assert "".join(spelling._slices(text)) == text
    assert all(not (re.match("[a-zé]", b) and re.search("[a-zé]$", a)) for a, b in itertools.pairwise(spelling._slices(text)))


def test_spelling_groups_hold_no_pairs(spark):
    """Rows of groups: one for each place, deletion and word."""
    words = spark.createDataFrame([("banana", 0), ("letters", 1)], "word string, word_id long")
    assert words.mapInArrow(spelling._keys(5), spelling.KEYS).count() == 6 + 6 + 1 + 7 + 6 + 1


def test_spelling_takes_awkward_documents(spark):
    docs = cases.documents(spark)
    got = {r["word"]: r["n"] for r in spelling.variants(spelling.word_counts(docs)).collect()}
    assert got == counted([(r[0], r[1]) for r in cases.rows()])


def plain_repair(sorts):
    """Least cost and audit of a run of sorts, by going through all edits from the end."""
    step = turn_repair.NEXT

    @functools.cache
    def rest(i, state, inserts):
        ways = []
        if i == len(sorts) and state in (0, 3):
            ways.append((0, ""))
        if inserts < 3:
            for c in "ua":
                if state in step[c]:
                    ways.append((5, "I", rest(i, step[c][state], inserts + 1)))
        if i < len(sorts):
            ways.append((2, "D", rest(i + 1, state, 0)))
            if sorts[i] != "D":
                more = 5 * sorts[i].isupper()
                for c, cost, e in [("u", 1, "R"), ("a", 1, "R"), (sorts[i].lower(), 0, "K")]:
                    if state in step.get(c, {}):
                        ways.append((cost + more, e, rest(i + 1, step[c][state], 0)))
        found = [w if len(w) == 2 else (w[0] + w[2][0], w[1] + w[2][1]) for w in ways if len(w) == 2 or w[2]]
        return min(found, default=None)

    return rest(0, 0, 0)


def test_turn_matrices():
    r = random.Random(3)
    for n in [0, 1, 2, 3, *range(4, 40)]:
        for letters in ("suaxDSUAX", "ua", "uuaAU"):
            sorts = "".join(r.choice(letters) for _ in range(n))
            whole = turn_repair.turns(sorts)
            assert turn_repair.cheapest(whole) == plain_repair(sorts), sorts
            k = r.randint(0, n)
            assert turn_repair.product(turn_repair.turns(sorts[:k]), turn_repair.turns(sorts[k:])) == whole
    for sorts in itertools.product("suaxDU", repeat=4):
        assert turn_repair.cheapest(turn_repair.turns("".join(sorts))) == plain_repair("".join(sorts))


def plain_conversations(rows):
    """Everything that op12 returns, by conv_id, for rows whose order by turn has no ties but copies."""
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, sorts, faults = set(), "", collections.Counter()
        for _, role, text in turns:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            sorts += "D" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit = plain_repair(sorts)
        given, left = [], iter(turns)
        total = len(audit.replace("D", ""))
        for e in audit:
            row = next(left) if e != "I" else None
            if e != "D":
                expected = ("user", "assistant")[(len(given) - total) % 2]
                given.append(f"{row[1] if e == 'K' else expected}:{row[2] if row else ''}")
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, cases.sha("\n".join(given)))
    return out


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, seg string, edit string, fault string")
    report, turns = turn_repair.repair(damaged_turns(df))
    digest = {r["conv_id"]: r["sha256"] for r in turn_repair.digests(turns).collect()}
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) + (digest.get(r["conv_id"], cases.sha("")),) for r in report.collect()}
    return got, turns


def conversations(n, most, seed):
    r, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(1, most)):
            text = r.choice(["Yes.", "No!", "cut off", "", " \t", None, "Yes.", f"number {turn}.", f"line\n{turn}?\n ", "x" * 3000])
            rows.append((conv, turn if turn or conv else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return [(*x, "clash", "clash", "clash", "clash") for x in rows]


@pytest.mark.parametrize("small", [False, True])
def test_turn_repair(spark, monkeypatch, small):
    if small:  # conversations of many segments, over several levels
        monkeypatch.setattr(turn_repair, "SEGMENT", 3)
        monkeypatch.setattr(turn_repair, "SPAN", 2)
    rows = conversations(12, 70, 5)
    got, turns = repaired(spark, rows)
    want = plain_conversations([x[:4] for x in rows])
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(v == (0, 0, 0, 0, 0, 0, "", cases.sha("")) for k, v in want.items() if k not in got)
    roles = collections.defaultdict(str)
    for r in turns.orderBy("conv_id", "position").collect():
        assert r["position"] == len(roles[r["conv_id"]])
        roles[r["conv_id"]] += r["role"][0]
    assert all(re.fullmatch("s?(ua)+", x) for x in roles.values())


def test_turn_repair_of_repeated_rows_and_none(spark):
    """Turns with equal numbers have an order of their own, so only what doesn't depend on it is held here."""
    rows = [(5, 1, "user", "Same.", "", "", "", "")] * 40 + [(5, 1, "assistant", "Fine.", "", "", "", "")] * 40
    got, _ = repaired(spark, rows)
    kind = zlib.crc32(b"5:1") % 20
    assert kind > 4 and got[5][:2] == (0, 0) and got[5][2] == 78 and got[5][5] in (156, 158, 160) and len(got[5][6]) == 80
    assert repaired(spark, [])[0] == {}


def plain_search(rows, top=5):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            if sum(x * x for x in w) < 2**62:
                whole.append((i, w))
    out = []
    for k, (q, v) in enumerate(whole):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for j, (i, w) in enumerate(whole) if j != k)
            out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, rows, **named):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, block string, query string")
    return sorted(map(tuple, pivot_search.search(df, F.col("vec_id") % 50 == 0, **named).collect()), key=repr)


def test_pivot_search_with_ties_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "SMALLEST", 8)
    r = random.Random(1)
    rows = [(i, [r.randrange(-3, 4) / 256 for _ in range(4)]) for i in range(0, 400, 2)]
    rows += [(50 * i, [0.25, 0.5, -0.5, 1.0]) for i in range(30)] + [(7, [0.25, 0.5, -0.5, 1.0])] * 4 + [(None, [0.25, 0.5, -0.5, 1.0]), (100, [0.25, 0.5, -0.5, 1.0]), (100, [0.25, 0.5, -0.5, 1.0])]
    rows += [(1, None), (150, None), (200, [1.0, None]), (250, [math.nan, 1.0]), (300, [1.0, math.inf]), (350, []), (400, [1.0]), (450, [1.0, 0.0]), (500, [1e300, 1.0]), (-50, [3e6, -2e6, 1e6, 0.0]), (3, [3e6, -2e6, 1.1e6, 0.0]), (550, [1.0, 2.0, 3.0, 4.0, 5.0])]
    assert searched(spark, rows, n_pivots=5) == plain_search(rows)
    assert searched(spark, [], n_pivots=5) == [] and searched(spark, [(0, [1.0])]) == []
    assert searched(spark, [(0, [1.0]), (1, [-2.0])]) == [(0, 1, 1, -131072)]


def test_pivot_search_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "SMALLEST", 16)
    g = np.random.default_rng(5)
    centres = g.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + g.normal(size=8) / 20).tolist()) for i in range(600)]
    assert searched(spark, rows) == plain_search(rows)


def test_pivot_search_passes_candidates_over(monkeypatch):
    g = np.random.default_rng(2)
    centres = g.normal(size=(6, 8)) * 500
    vectors = np.concatenate([c + g.normal(size=(100, 8)) * 10 for c in centres]).astype(np.int64)
    at = np.concatenate([vectors[:1], vectors[100:101], vectors[200:201], vectors[300:301]])
    far = pivot_search.distances(vectors, at)
    square = (vectors * vectors).sum(axis=1)
    row = {"vectors": [v.tobytes() for v in vectors], "ids": [[i] for i in range(600)], "far": far.T.tobytes(), "low": far.min(axis=0), "high": far.max(axis=0), "least": float(square.min())}
    block, seen = pivot_search.Searched(row), []
    plain = pivot_search.inner
    monkeypatch.setattr(pivot_search, "inner", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    for i in range(0, 600, 40):
        scores = vectors @ vectors[i]
        least = int(np.sort(scores)[-6])
        (found, score), = block.search(vectors[i : i + 1], far[i : i + 1], [least], 6)
        assert score.tolist() == sorted(scores.tolist())[::-1][:6] and (scores[found] == score).all()
    assert sum(seen) < 0.7 * 600 * 15
