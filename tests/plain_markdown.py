"""Plain forms of shields, for tests: one text at a time, in Python."""

import re
from collections import Counter
from functools import reduce

SIGN = re.compile(
    r"(\r\n|\r|\n|`+[^`\n]*`+|https?://[^\s)>]+|(?<=\]\()[^)\s]+|<[^>\n]+>"
    r"|(?m:^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-+*][ \t]+|\d+[.)][ \t]+))|(?m:^[ \t]*\|)|(?m:^[ \t]*(?:[-*_][ \t]*){3,}$)"
    r"|\|{1,2}|[*_~]{1,3}|!\[|\]\(|\)|\[|\])"
)
FORMULA = re.compile(r"(?s)(\$\$.+?\$\$|(?<![\\$])\$(?!\$).+?(?<!\\)\$(?!\$)|\\\(.+?\\\)|\\\[.+?\\\])")


def named(pattern, text, name):
    parts = pattern.split(text)
    held = {name.format(i): x for i, x in enumerate(parts[1::2])}
    parts[1::2] = held
    return "".join(parts), held


def shield(text):
    return named(SIGN, text, "ZXQMARKDOWN{}QXZ")


def unshield(text, held):
    name = re.compile(r"ZXQMARKDOWN[0-9]+QXZ")
    times = Counter(name.findall(text))
    return None if any(times[x] != 1 for x in held) else name.sub(lambda m: held.get(m[0], m[0]), text)


def shield_math(text, mark):
    return named(FORMULA, text, f"MATH{mark}N{{}}E")


def unshield_math(text, held):
    return reduce(lambda t, x: t.replace(*x), held.items(), text) if all(name in text for name in held) else None


def attach_byline(text, said, title, missing_ok=False):
    found = list(re.finditer(rf"(?m)^#{{1,6}}[ \t]+{re.escape(said)}[ \t]*\n?", text))
    if not (0 if missing_ok else 1) <= len(found) <= 1:
        return None
    for m in found:
        text = text[: m.start()] + text[m.end() :]
    heads = list(re.finditer(rf"(?m)^#{{1,6}}[ \t]+{re.escape(title)}[ \t]*$", text))
    if len(heads) != 1:
        return None
    at = heads[0].end()
    return f"{text[:at]}\n\n*{said}*{text[at:]}"
