"""Column functions over text: character classes, language codes, numbers, sentences, ratios, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python's str.isspace have it; Java and RE2 read this class alike.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Script ranges by language, and the codes of ISO 639-2 that are shortened.
SCRIPTS = {
    "bn": r"\x{0980}-\x{09FF}",
    "hi": r"\x{0900}-\x{097F}",
    "gu": r"\x{0A80}-\x{0AFF}",
    "pa": r"\x{0A00}-\x{0A7F}",
    "ta": r"\x{0B80}-\x{0BFF}",
    "te": r"\x{0C00}-\x{0C7F}",
    "kn": r"\x{0C80}-\x{0CFF}",
    "ml": r"\x{0D00}-\x{0D7F}",
    "or": r"\x{0B00}-\x{0B7F}",
    "ar": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "zh": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}",
}
LONG_CODES = {"ben": "bn", "eng": "en", "hin": "hi", "pan": "pa", "tam": "ta", "tel": "te", "kan": "kn", "mal": "ml", "ori": "or", "guj": "gu", "ara": "ar", "zho": "zh"}
# language_Script codes by the names and short codes that users give.
CODE_OF = {
    "ar": "arb_Arab",
    "arabic": "arb_Arab",
    "bn": "ben_Beng",
    "bengali": "ben_Beng",
    "de": "deu_Latn",
    "german": "deu_Latn",
    "en": "eng_Latn",
    "english": "eng_Latn",
    "es": "spa_Latn",
    "spanish": "spa_Latn",
    "fr": "fra_Latn",
    "french": "fra_Latn",
    "gu": "guj_Gujr",
    "gujarati": "guj_Gujr",
    "hi": "hin_Deva",
    "hindi": "hin_Deva",
    "id": "ind_Latn",
    "indonesian": "ind_Latn",
    "it": "ita_Latn",
    "italian": "ita_Latn",
    "ja": "jpn_Jpan",
    "japanese": "jpn_Jpan",
    "ko": "kor_Hang",
    "korean": "kor_Hang",
    "ml": "mal_Mlym",
    "malayalam": "mal_Mlym",
    "mr": "mar_Deva",
    "marathi": "mar_Deva",
    "ne": "npi_Deva",
    "nepali": "npi_Deva",
    "nl": "nld_Latn",
    "dutch": "nld_Latn",
    "or": "ory_Orya",
    "odia": "ory_Orya",
    "pa": "pan_Guru",
    "punjabi": "pan_Guru",
    "pl": "pol_Latn",
    "polish": "pol_Latn",
    "pt": "por_Latn",
    "portuguese": "por_Latn",
    "ru": "rus_Cyrl",
    "russian": "rus_Cyrl",
    "ta": "tam_Taml",
    "tamil": "tam_Taml",
    "te": "tel_Telu",
    "telugu": "tel_Telu",
    "th": "tha_Thai",
    "thai": "tha_Thai",
    "tr": "tur_Latn",
    "turkish": "tur_Latn",
    "uk": "ukr_Cyrl",
    "ukrainian": "ukr_Cyrl",
    "ur": "urd_Arab",
    "urdu": "urd_Arab",
    "vi": "vie_Latn",
    "vietnamese": "vie_Latn",
    "zh": "zho_Hans",
    "zh-cn": "zho_Hans",
    "chinese": "zho_Hans",
    "zh-tw": "zho_Hant",
}
# The languages of the Indic models, and their own short codes.
INDIC = "asm_Beng ben_Beng brx_Deva doi_Deva gom_Deva guj_Gujr hin_Deva kan_Knda kas_Arab kas_Deva mai_Deva mal_Mlym mar_Deva mni_Beng mni_Mtei npi_Deva ory_Orya pan_Guru san_Deva sat_Olck snd_Arab snd_Deva tam_Taml tel_Telu urd_Arab".split()
INDIC_SHORT = {"as": "asm_Beng", "brx": "brx_Deva", "doi": "doi_Deva", "kok": "gom_Deva", "kn": "kan_Knda", "ks": "kas_Arab", "mai": "mai_Deva", "mni": "mni_Mtei", "sa": "san_Deva", "sat": "sat_Olck", "sd": "snd_Arab"}
#: Zeros of the scripts whose decimal digits are turned into ASCII.
ZEROS = (0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0DE6, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0, 0x1810, 0xFF10)
#: Fixed value: marks that end a sentence.
SENTENCE_ENDS = ".!?。！？।"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def count_of(text: Column, characters: str) -> Column:
    """How many code points the class holds."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("long")


def strip(text: Column) -> Column:
    """Without white space at either end, all kinds of it."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def short_hash(*parts: Column) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The key's entry or null. Small tables only: they become part of the expression."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def normalize_language(value: Column) -> Column:
    """The primary subtag in its short form; null for null, empty or auto."""
    first = F.split(F.replace(F.lower(value), F.lit("_"), F.lit("-")), "-")[0]
    return F.when(value.isNull() | F.lower(value).isin("", "auto"), F.lit(None)).otherwise(F.coalesce(lookup(first, LONG_CODES), first))


def language_code(value: Column) -> Column:
    """language_Script code of a name or short code; unknown ones pass, null for empty."""
    trimmed = strip(value)
    return F.when(F.length(trimmed) > 0, F.coalesce(lookup(F.lower(trimmed), CODE_OF), trimmed))


def language_route(source: Column, target: Column) -> Column:
    """en_indic, indic_en or indic_indic; null if a language isn't supported or both are the same."""
    a, b = (F.coalesce(lookup(F.lower(x), INDIC_SHORT), language_code(x)) for x in (source, target))
    known = a.isin(*INDIC, "eng_Latn") & b.isin(*INDIC, "eng_Latn") & (a != b)
    return F.when(known, F.when(a == "eng_Latn", "en_indic").when(b == "eng_Latn", "indic_en").otherwise("indic_indic"))


def detected(text: Column, code: Column, probability: Column) -> Column:
    """A detector's answer as a language_Script code, or null: it needs 20 characters, a probability of 0.6 and a
    language that translation supports."""
    full = F.coalesce(lookup(F.lower(code), INDIC_SHORT), language_code(code))
    return F.when((F.length(strip(text)) >= 20) & (probability >= 0.60) & full.isin(*INDIC, "eng_Latn"), full)


def text_quality(text: Column) -> Column:
    """usable, language, reason, characters, letters, symbol_ratio, latin_ratio, script: how well text was extracted."""
    scripts = F.array(*[F.struct(count_of(text, c).alias("n"), (-F.length(F.regexp_extract(text, f"^[^{c}]*", 0))).alias("first"), F.lit(k).alias("k")) for k, c in SCRIPTS.items()])

    def counted(rest):
        """rest: the text without ASCII letters, in which all else is counted, as it's short for most texts."""
        ascii_ = (F.length(text) - F.length(rest)).cast("long")
        return F.struct(
            (ascii_ + count_of(rest, r"\p{L}")).alias("letters"),
            ascii_.alias("ascii"),
            count_of(rest, r"\p{Sk}\p{Sm}\p{So}").alias("symbols"),
            (ascii_ + count_of(rest, f"^{SPACE}")).alias("visible"),
            F.length(strip(text)).alias("stripped"),
            F.length(text).cast("long").alias("characters"),
            # one look tells the many texts that have none of the scripts
            F.when(rest.rlike(f"[{''.join(SCRIPTS.values())}]"), F.array_max(scripts)).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("first"), F.lit("").alias("k"))).alias("top"),
        )

    counts = let(F.regexp_replace(text, "[A-Za-z]+", ""), counted)
    ratios = lambda c: F.struct(
        c.alias("c"),
        (c["symbols"] / F.greatest(F.lit(1), c["visible"])).alias("symbol"),
        (c["ascii"] / F.greatest(F.lit(1), c["letters"])).alias("latin"),
        (c["top"]["n"] / F.greatest(F.lit(1), c["letters"])).alias("script"),
    )
    return let(let(counts, ratios), lambda r: let(_quality_case(r), lambda case: _quality(r, case)))


def _quality_case(r: Column) -> Column:
    """The first rule that fits."""
    return (
        F.when(r["c"]["stripped"] < 100, "short")
        .when((r["symbol"] > 0.05) & (r["script"] < 0.20), "font")
        .when((r["c"]["top"]["n"] > 0) & (r["script"] >= 0.20), "script")
        .when((r["latin"] >= 0.70) & (r["symbol"] < 0.02), "latin")
        .otherwise("none")
    )


def _quality(r: Column, case: Column) -> Column:
    c, top = r["c"], r["c"]["top"]
    said = {"short": "too little extracted text", "font": "symbol-heavy legacy/custom font encoding", "latin": "predominantly Latin Unicode text", "none": "no reliable Unicode script detected"}
    return F.struct(
        case.isin("script", "latin").alias("usable"),
        F.when(case == "script", top["k"]).when(case == "latin", F.lit("en")).alias("language"),
        F.when(case == "script", F.concat(F.lit("dominant Unicode script: "), top["k"])).otherwise(lookup(case, said)).alias("reason"),
        c["characters"].alias("characters"),
        c["letters"].alias("letters"),
        F.round(r["symbol"], 4).alias("symbol_ratio"),
        F.round(r["latin"], 4).alias("latin_ratio"),
        F.when(top["n"] > 0, top["k"]).alias("script"),
        top["n"].alias("script_count"),
    )


def ascii_digits(text: Column) -> Column:
    every = "".join(chr(z + i) for z in ZEROS for i in range(10))
    return F.translate(text, every, "0123456789" * len(ZEROS))


#: Fixed value: numbers with their joined parts.
NUMBER = r"\+?\p{Nd}+(?:[ \x{A0}.,:/-]\p{Nd}+)*%?"


def number_tokens(text: Column) -> Column:
    """Numbers as written, in ASCII digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(ascii_digits(x), F.lit(" "), F.lit(" ")))


def numbers_kept(source: Column, candidate: Column) -> Column:
    """Whether each number of the source occurs at least as often in the candidate: equal ones are told apart by their
    place in their run, so that one difference of sets answers it."""
    numbered = lambda tokens: F.flatten(F.transform(run_counts(tokens), lambda r: F.transform(F.sequence(F.lit(1).cast("long"), r["n"]), lambda k: F.concat_ws("\u0000", r["token"], k.cast("string")))))
    return F.when(source.isNotNull() & candidate.isNotNull(), F.size(F.array_except(numbered(source), numbered(candidate))) == 0)


WORD = r"[\p{L}\p{N}_]+"


def content_size(text: Column) -> Column:
    """Words, if there's more than one, or else visible characters."""
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(words > 1, words).otherwise(count_of(text, f"^{SPACE}")).cast("long")


def length_ratio(source: Column, candidate: Column) -> Column:
    return content_size(candidate) / F.greatest(F.lit(1), content_size(source))


def repetition_ratio(text: Column) -> Column:
    """Share of word trigrams that occurred before; 0 below six words."""

    def ratio(words):
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.when(F.size(words) < 6, F.lit(0.0)).otherwise(let(grams, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)))

    return let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), ratio)


def sentences(text: Column) -> Column:
    """Pieces that end in a sentence mark, trimmed; blank ones are left out."""
    pieces = F.split(text, rf"(?<=[{SENTENCE_ENDS}])(?:[{SPACE}]+|(?=[^{SPACE}]))")
    return F.filter(F.transform(pieces, strip), lambda x: F.length(x) > 0)


def word_list(text: Column) -> Column:
    """Runs of letters, marks and numbers."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


#: White space as in SPACE, written for Java alone: the signs up to U+00FF are one look into a table, and one range sends
#: nearly all others away.
GAP = r"[\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]+"


def visible_words(text: Column) -> Column:
    """Runs of anything but white space. Splitting at the gaps takes a quarter of the time that matching each run does."""
    return F.array_remove(F.split(text, GAP), "")


def split_long(sentence: Column, limit: int) -> Column:
    """Pieces of at most max(8, limit) words; a single long word stays one piece."""
    return let(visible_words(sentence), lambda words: split_words(sentence, words, limit))


def split_words(sentence: Column, words: Column, limit: int) -> Column:
    """The same from the sentence's words."""
    n = max(8, limit)
    piece = lambda i: F.array_join(F.slice(words, i * n + 1, F.lit(n)), " ")
    return F.when(F.size(words) <= n, F.array(sentence)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / n).cast("int") - 1), piece))


def too_long(sentence: Column, limit: int) -> Column:
    """An error text for a sentence that may not be split, or null."""
    return let(F.size(visible_words(sentence)), lambda n: too_many(n, limit))


def too_many(n: Column, limit: int) -> Column:
    """The same from the number of words."""
    return F.when(n > max(8, limit), F.format_string("sentence has %d tokens, limit %d", n, F.lit(max(8, limit))))


def byline_like(text: Column) -> Column:
    """One to eight words, at most 80 characters, without a sentence mark at the end."""
    words = F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)))
    return words.between(1, 8) & (F.length(text) <= 80) & ~F.regexp_replace(text, f"[{SPACE}]+$", "").rlike(r"[.?!:;]$")


def natural_key(name: Column) -> Column:
    """A key that sorts embedded numbers by value: runs of digits, without leading zeros, follow their length."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))).otherwise(p)), "")


#: Characters of an error that are kept: of an extraction, of a decision.
ERROR_CHARS, DECISION_ERROR_CHARS = 4000, 1500


def error_message(error: Column, most: int = ERROR_CHARS) -> Column:
    return F.substring(error, 1, most)


def run_counts(tokens: Column, name: str = "token") -> Column:
    """Distinct tokens in order, each with its count n: equal ones are neighbours once sorted, so rows stay where they are."""

    def counted(held):
        s, starts = held["s"], held["starts"]
        return F.transform(starts, lambda at, k: F.struct(F.get(s, at).alias(name), (F.coalesce(F.get(starts, k + 1), F.size(s)) - at).cast("long").alias("n")))

    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    none = F.filter(F.transform(tokens, lambda t: F.struct(t.alias(name), F.lit(0).cast("long").alias("n"))), lambda _: F.lit(False))
    return F.when(F.size(tokens) > 0, let(let(F.array_sort(tokens), lambda s: F.struct(s.alias("s"), first(s).alias("starts"))), counted)).otherwise(none)


def cell_guard(value: Column) -> Column:
    """A spreadsheet cell that can't start a formula and fits its limit."""
    safe = F.when(F.regexp_replace(value, f"^[{SPACE}]+", "").rlike(r"^[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(F.length(safe) > 32767, F.concat(F.substring(safe, 1, 32748), F.lit("… [truncated]"))).otherwise(safe)


def label(value: Column) -> Column:
    """A file name's part: other characters than letters, digits, - and _ become one _."""
    return F.regexp_replace(value, "[^A-Za-z0-9_-]+", "_")


def dashed_label(value: Column) -> Column:
    """Lower case with a dash for every other character than letters, digits, - and _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")


def crop_box(box: Column, width: Column, height: Column, padding: int = 2) -> Column:
    """Whole pixels around a box, padded and clamped to the image; null if nothing is left."""
    l, t = (F.greatest(F.lit(0), F.floor(box[k]) - padding).cast("long") for k in ("l", "t"))  # noqa: E741
    r, b = F.least(width.cast("long"), F.ceil(box["r"]) + padding), F.least(height.cast("long"), F.ceil(box["b"]) + padding)
    return F.when((r > l) & (b > t), F.struct(l.alias("l"), t.alias("t"), r.cast("long").alias("r"), b.cast("long").alias("b")))


def box_around(box: Column) -> list[Column]:
    """The smallest box around a group's boxes, as aggregates l, t, r and b."""
    return [f(box[k]).alias(k) for f, k in ((F.min, "l"), (F.min, "t"), (F.max, "r"), (F.max, "b"))]


def union_box(boxes: Column) -> Column:
    """The smallest box around all boxes."""
    side = lambda f, k: f(F.transform(boxes, lambda b: b[k])).alias(k)
    return F.struct(side(F.array_min, "l"), side(F.array_min, "t"), side(F.array_max, "r"), side(F.array_max, "b"))


#: Fixed value: formulas in their delimiters.
MATH = r"(?s)\$\$(.+?)\$\$|(?<![\\$])\$(?!\$)(.+?)(?<!\\)\$(?!\$)|\\\((.+?)\\\)|\\\[(.+?)\\\]|<math[^>]*>(.+?)</math>"


def math_spans(text: Column) -> Column:
    """Formulas with their delimiters."""
    return F.regexp_extract_all(text, F.lit(MATH), F.lit(0))


def latex_body(value: Column) -> Column:
    """A formula without one pair of delimiters; null if it's empty, too long, or its braces don't balance."""
    v = strip(value)
    pairs = (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$"))
    chain = None
    for a, b in pairs:
        inner = F.substring(v, F.lit(len(a) + 1), F.greatest(F.lit(0), F.length(v) - len(a) - len(b)))
        hit = v.startswith(a) & v.endswith(b)
        chain = F.when(hit, inner) if chain is None else chain.when(hit, inner)
    body = strip(chain.otherwise(v))
    plain = F.regexp_replace(body, r"\\.", "")
    depth = F.aggregate(
        F.regexp_extract_all(plain, F.lit(r"[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad")),
        lambda acc, c: F.struct((acc["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"), (acc["bad"] | ((acc["d"] == 0) & (c == "}"))).alias("bad")),
    )
    good = (F.length(body) > 0) & (F.length(body) <= 16384) & ~body.rlike(r"(?<!\\)\$") & ~body.contains("```") & (depth["d"] == 0) & ~depth["bad"]
    return F.when(good, body)


def detection_text(markdown: Column) -> Column:
    """Markdown without front matter, code, addresses, tags and list marks, for language detection."""
    for pattern in (
        r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n[ \t]*\n*|\z)",
        r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?^\1[ \t]*$",
        r"`+[^`\n]*`+",
        r"https?://[^\s)>]+",
        r"<[^>\n]+>",
        r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-+*]\s+|\p{Nd}+[.)]\s+)",
    ):
        markdown = F.regexp_replace(markdown, pattern, " ")
    return markdown


def sentence_context(text: Column, start: Column, end: Column, limit: int) -> Column:
    """The sentence around a span, or null if it's longer than the limit."""
    marks = r".!?।॥\n"
    # all up to the last mark goes, which is sought from the end: a pattern for the rest would be tried at every character
    left = F.regexp_replace(F.substring(text, F.lit(1), start), rf"(?s)\A.*[{marks}]", "")
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), f"^[^{marks}]*[{marks}]?", 0)
    return let(strip(F.concat(left, F.substring(text, start + 1, end - start), right)), lambda found: F.when(F.length(found) <= limit, found))


def windows(text: Column, size: int) -> Column:
    """Consecutive slices of the text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON object."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256)
