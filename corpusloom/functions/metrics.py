"""Scores of a candidate against a reference by n-grams, after the published definitions of chrF++ and BLEU."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column

from corpusloom.operators.rows import arrow

#: Orders of character and word n-grams in chrF++, the weight of recall, orders in BLEU.
CHARACTERS, WORDS, BETA, ORDERS = 6, 2, 2.0, 4
_MARKED = re.compile(r"(.+)([!-/:-@[-`{-~])|([!-/:-@[-`{-~])(.+)")


def _grams(units, n: int) -> Counter:
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def _words(text: str) -> list[str]:
    """Words, with a punctuation mark at their end, or else at their start, as a word of its own."""
    out: list[str] = []
    for word in text.split():
        m = _MARKED.fullmatch(word)
        out += filter(None, m.groups()) if m else [word]
    return out


def chrf(candidate: str, reference: str) -> float:
    """chrF++, from 0 to 1: the mean F-score of character n-grams up to 6 and word n-grams up to 2 that occur on both sides."""
    told, wanted = ("".join(x.split()) for x in (candidate, reference))
    orders = [(_grams(told, n), _grams(wanted, n)) for n in range(1, CHARACTERS + 1)]
    orders += [(_grams(_words(candidate), n), _grams(_words(reference), n)) for n in range(1, WORDS + 1)]
    precision, recall, held = 0.0, 0.0, 0
    for mine, theirs in orders:
        if mine and theirs:
            both = (mine & theirs).total()
            precision, recall, held = precision + both / mine.total(), recall + both / theirs.total(), held + 1
    if not held or precision + recall == 0:
        return 0.0
    p, r = precision / held, recall / held
    return (1 + BETA**2) * p * r / (BETA**2 * p + r)


def bleu(candidate: str, reference: str) -> float:
    """Sentence BLEU, from 0 to 1: the geometric mean of n-gram precisions up to 4, orders without a hit counting half as
    much each time, times the penalty for short candidates. Words and punctuation marks are tokens."""
    told, wanted = (re.findall(r"\w+|[^\w\s]", x) for x in (candidate, reference))
    if not told or not wanted:
        return 0.0
    logs, halves, held = 0.0, 1.0, 0
    for n in range(1, ORDERS + 1):
        mine = _grams(told, n)
        if not mine:
            break
        hits = (mine & _grams(wanted, n)).total()
        if n == 1 and not hits:
            return 0.0
        if not hits:
            halves *= 2
        logs, held = logs + math.log((hits or 1 / halves) / mine.total()), held + 1
    return math.exp(logs / held) * min(1.0, math.exp(1 - len(wanted) / len(told)))


def chrf_column(candidate: Column, reference: Column) -> Column:
    return arrow(lambda c, r: None if r is None else chrf(c, r), "double")(candidate, reference)


def bleu_column(candidate: Column, reference: Column) -> Column:
    return arrow(lambda c, r: None if r is None else bleu(c, r), "double")(candidate, reference)
