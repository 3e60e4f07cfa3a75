"""Personal data by weak supervision.

Fixed patterns find the base spans: emails, IP addresses, card numbers, phone numbers. Wider patterns propose further
spans. Regex, gazetteer and context labelers vote on every candidate; the votes are counted by pattern over all
documents, expectation-maximisation estimates each labeler's reliability from the counts, and a logistic classifier is
trained on the resulting beliefs. Candidates that it accepts are added; base spans always stay. What base spans leave of a
secret, be it ever so short, is judged as the whole secret is.

A null text counts as empty and has no spans. Repeated rows get equal spans; an empty table trains a classifier that
adds nothing. Offsets count code points. Added spans never overlap base spans or each other. Texts may be of any length
and hold any number of spans: patterns read runs of any length once, and overlaps are found by bisection. Other columns
don't disturb, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import passes, tidied

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = 4

# The base patterns. A start inside a run is tried only right after a match, as any other start in the
# run would meet the same end; so a long run is read once.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = _LOCAL + r"++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EMAIL_HERE, EMAIL_NEXT = re.compile(_EMAIL), re.compile(rf"(?<!{_LOCAL})" + _EMAIL)
IP_HERE, IP_NEXT = re.compile(_IP), re.compile(r"(?<![0-9])" + _IP)
CARD, PHONE = re.compile(_CARD), re.compile(_PHONE)

#: Candidates beyond the base: numbers in groups, secrets after a cue, bank accounts, social security numbers, spelled-out emails.
WIDER = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+.,:/-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])"), "0123456789"),
    ("phone", re.compile(r"(?<![0-9A-Za-z])00[1-9][0-9]?[ ()./-]{1,2}[0-9][0-9 ()./-]{5,16}[0-9](?![0-9A-Za-z])"), "0123456789"),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), "-"),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), "0123456789"),
    ("secret", re.compile(r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passw(?:or)?d|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<it>[A-Za-z0-9_+/=.-]{8,}+)"), "=:"),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<it>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk[-_][A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])"), "AKIAgh_sk"),
    ("email", re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]{2,}+)++"), "])"),
)
#: Gazetteers: endings of mail hosts, digits that cards begin with, countries of bank accounts, words near such data.
TLDS = frozenset("com net org edu gov io de fr es it uk us eu info biz ch at nl be pl se jp cn in br ru ca au".split())
ISSUERS = frozenset("3456")
COUNTRIES = frozenset("AT BE CH CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV NL NO PL PT RO SE SI SK TR".split())
CUES = {
    "email": "mail email e-mail contact write correo courriel kontakt",
    "ip": "ip host server address client addr login from",
    "card": "card visa mastercard amex credit debit payment pay tarjeta carte karte konto",
    "phone": "phone tel telephone call mobile cell fax contact whatsapp sms telefon telefono téléphone teléfono anruf",
    "secret": "key secret token password passwd auth credential api login",
    "iban": "iban account bank konto compte cuenta transfer",
    "ssn": "ssn social security number",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("isbn issn doi version page pages vol figure table chapter order invoice sku part id no price article section".split())
_WORD = re.compile(r"[^\W_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _runs(text: str, here: re.Pattern, following: re.Pattern):
    at = 0
    while True:
        m = (here.match(text, at) if at else None) or following.search(text, at)
        if m is None:
            return
        yield m
        at = m.end()


_DIGITS = re.compile(r"[^0-9]+")
_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end; by start, then kind."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _runs(text, EMAIL_HERE, EMAIL_NEXT)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _runs(text, IP_HERE, IP_NEXT) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    found.sort()
    return found


class Taken:
    """Base spans as stretches that don't overlap, in order."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in base:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int):
        """What the stretches leave of a run."""
        for i in range(bisect_right(self.ends, start), len(self.starts)):
            if self.starts[i] >= end:
                break
            if start < self.starts[i]:
                yield start, self.starts[i]
            start = self.ends[i]
        if start < end:
            yield start, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and wider ones that overlap none of them, nor each other; the earlier and then the longer stays. Of a
    secret, what base spans leave of it."""
    return [span for span, _ in proposed(text, base)]


def proposed(text: str, base: list[tuple[int, int, int]]) -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """Candidates, each with the span that is voted on: for parts of a secret the whole secret."""
    wider, taken = [], Taken(base)
    for kind, pattern, hint in WIDER:
        if any(c in text for c in hint):
            for m in pattern.finditer(text):
                start, end = m.span("it") if "it" in pattern.groupindex else m.span()
                parts, whole = list(taken.free(start, end)), (start, KINDS.index(kind), end)
                if kind == "secret" or parts == [(start, end)]:
                    wider += [((a, whole[1], b), whole) for a, b in parts]
    out, last = [(span, span) for span in base], 0
    for span, whole in sorted(wider, key=lambda x: (x[0][0], -x[0][2], x[0][1], x[1])):
        if span[0] >= last:
            out.append((span, whole))
            last = span[2]
    return sorted(out)


def votes(text: str, span: tuple[int, int, int], is_base: bool) -> tuple[int, ...]:
    """What the labelers say (1 no, 2 yes, 0 nothing) and the shape features, as small numbers.

    Labelers: format, check digits, gazetteer, context before, context against, boundaries."""
    start, k, end = span
    kind, said = KINDS[k], text[start:end]
    digits = _DIGITS.sub("", said)
    form = 2 if is_base else 0
    check = 0
    if kind == "card":
        check = 2 if luhn(digits) else 1
    elif kind == "iban":
        flat = said.replace(" ", "")
        check = 2 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else 1
    elif kind == "ssn":
        check = 1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2
    elif kind == "phone":
        check = 1 if len(set(digits)) <= 2 else 2 if 10 <= len(digits) <= 15 else 1
    elif kind == "secret":
        check = 2 if digits and any(c.isalpha() for c in said) else 1
    elif kind == "ip":
        check = 1 if said.startswith("0.") or any(len(p) > 1 and p[0] == "0" for p in said.split(".")) else 2
    gazetteer = 0
    if kind == "email":
        gazetteer = 2 if re.split(r"[^a-z0-9]+", said.lower())[-1] in TLDS else 1
    elif kind == "card":
        gazetteer = 2 if digits[0] in ISSUERS else 1
    elif kind == "iban":
        gazetteer = 2 if said[:2] in COUNTRIES else 1
    before = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])}
    context = 2 if before & CUES[kind] else 0
    against = 1 if before & AGAINST else 0
    edge = 1 if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else 0
    length = min(5, (end - start) // 6)
    return (k, form, check, gazetteer, context, against, edge, length)


def vote_counts(docs: DataFrame) -> DataFrame:
    """Candidates by vote pattern over all documents: each task sums its own, and patterns are boundedly many."""

    def count(batches):
        held: dict[tuple, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    known = set(base)
                    for span, whole in proposed(text, base):
                        key = votes(text, whole, span in known)
                        held[key] = held.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in held], pa.list_(pa.int32())), pa.array(list(held.values()), pa.int64())], ["votes", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidied(count), "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: belief of each pattern, prior of each kind, and each labeler's
    chance of each vote given truth (labeler, truth, vote). Starts from labelers that are right four times of five."""
    kinds, said = patterns[:, 0], patterns[:, 1:7]
    yes = (said == 2).sum(1) + 0.0
    no = (said == 1).sum(1) + 0.0
    belief = 1 / (1 + np.exp(-1.4 * (yes - 2 * no - 0.5)))
    prior, table = np.zeros(len(KINDS)), np.zeros((6, 2, 3))
    held = max(1.0, 0.02 * counts.sum())
    for _ in range(rounds):
        for k in range(len(KINDS)):
            mine = kinds == k
            prior[k] = (1 + (belief * counts)[mine].sum()) / (2 + counts[mine].sum())
        for j in range(6):
            for truth, share in ((0, 1 - belief), (1, belief)):
                # pseudo-counts of the start keep a labeler from turning into its opposite; silence tells nothing
                seen = np.bincount(said[:, j], share * counts, 3)[1:] + held * np.array([8.0, 2.0] if truth == 0 else [2.0, 8.0])
                table[j, truth, 1:] = seen / seen.sum()
        odds = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for j in range(6):
            told = said[:, j] > 0
            odds[told] += np.log(table[j, 1, said[told, j]]) - np.log(table[j, 0, said[told, j]])
        belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return belief, prior, table


def _features(patterns: np.ndarray) -> np.ndarray:
    parts = [np.ones((len(patterns), 1)), np.eye(len(KINDS))[patterns[:, 0]]]
    parts += [np.eye(3)[patterns[:, j]][:, 1:] for j in range(1, 7)]
    parts.append(np.eye(6)[patterns[:, 7]])
    return np.concatenate(parts, 1)


@dataclass
class Model:
    weights: np.ndarray
    threshold: float = 0.9

    def accepts(self, pattern: tuple[int, ...]) -> bool:
        return bool(1 / (1 + np.exp(-float((_features(np.array([pattern]))[0] @ self.weights)))) >= self.threshold)


def fit(docs: DataFrame, threshold: float = 0.9) -> Model:
    """The final classifier. The driver gets one row per vote pattern, at most kinds x 3^6 x 6."""
    rows = sorted((tuple(r["votes"]), r["n"]) for r in vote_counts(docs).collect())
    width = 1 + len(KINDS) + 12 + 6
    if not rows:
        return Model(np.concatenate([[-30.0], np.zeros(width - 1)]), threshold)
    patterns, counts = np.array([p for p, _ in rows]), np.array([n for _, n in rows], float)
    belief, _, _ = reliabilities(patterns, counts)
    x, w = _features(patterns), np.zeros(width)
    share = counts / counts.sum()
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (p - belief)) + 1e-4 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(w, threshold)


def spans(text: str | None, accepts) -> tuple[list, list]:
    """Base spans, and all spans with the accepted ones among the further candidates."""
    if not text:
        return [], []
    base = base_spans(text)
    held = set(base)
    return base, [s for s, whole in proposed(text, base) if s in held or accepts(votes(text, whole, False))]


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, k, end in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[k].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:int,end:int>>"


def annotate(docs: DataFrame, model: Model, *keep: str, redacted: bool = False) -> DataFrame:
    """The columns named by keep, base and spans for every row; on demand the redacted text."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        known: dict[tuple, bool] = {}

        def accepts(pattern):
            if pattern not in known:
                known[pattern] = model.accepts(pattern)
            return known[pattern]

        named = lambda found: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]
        for batch in batches:
            for part in passes(batch, "_text"):
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [spans(x, accepts) for x in texts]
                columns = [*part.columns[:-1], pa.array([named(b) for b, _ in found], kind), pa.array([named(a) for _, a in found], kind)]
                names = [*part.schema.names[:-1], "base", "spans"]
                if redacted:
                    columns.append(pa.array([x if x is None else redact(x, a) for x, (_, a) in zip(texts, found)], pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(tidied(run), f"{kinds + ', ' if kinds else ''}base {SPAN}, spans {SPAN}" + ", redacted string" * redacted)


def spelled(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
