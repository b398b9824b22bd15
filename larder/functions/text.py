"""Text functions over Columns: cleaning of recognised text, segments of ingredient lists, claims.

All are native expressions. Java's and Python's \\b and \\s differ beyond ASCII, so patterns state
their classes. Null stays null unless a function says otherwise.
"""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of noise, digits that stand for letters, punctuation, markers and claims.
NOISE = r"[|`~^¬{}\[\]<>©®™§¶]+"
DIGIT_LETTERS = {"0": "o", "1": "l", "5": "s", "8": "b"}
TRACE_MARKERS = ["pode conter", "podem conter", "tracos", "vestigios", "may contain", "traces of", "peut contenir", "traces de"]
CONTAINS_MARKERS = ["contem", "contains", "contient"]
CLAIM = r"sem\s+gluten|gluten\s*free|isento\s+de\s+gluten|0\s*%?\s*gluten"
HEADER = r"ingredientes?\s*:?|ingredients?\s*:?|composi[cç][aã]o\s*:?"
# Written so that no run of digits or blanks is read more than a few times: a number or a blank starts where its run does, and
# what is taken isn't given back. PERCENT accepts what \(?\s*\d+[.,]?\d*\s*%\s*\)? does.
PERCENT = r"(?:\(\s*+|(?<!\s)\s++)?+(?<!\d)\d++(?:[.,]\d*+)?+\s*+%\s*+\)?+"
# Lists are cut at [,;\n/]+, \.\s, \)\s*,? and \s+(?:e|y|and)\s+. The last becomes a comma first, with the blanks around it, unless
# a bracket takes them all or a full stop takes the only one.
JOINED = r"(\.\s|(?<![\s.)]))(\n*+)\s++(?:e|y|and)\s++"
SEPARATORS = r"[,;\n/]++|\.\s|\)\s*+,?"
TRIMMED = r"(?U)^\s++|(?<!\s)\s++$"
EDGES = " .;:-*•[]"
SECTION_START = r"(?imu)^[ \t]*(ingredientes?|ingredients?|composici[oó]n|composi[çc][aã]o)\s*[:.]?\s*"
SECTION_END = r"(?imu)^[ \t]*(informa[çc][aã]o\s+nutricional|valores?\s+nutricionais|conserva[çc][aã]o|consumir\s+preferencialmente|val(?:idade)?\.?|lote|produzido\s+por|origem|peso\s+l[ií]quido)"

#: Blanks as str.split() knows them; \\s of Java lacks some.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))


def _points() -> list[str]:
    """Every code point that a text can hold and that isn't ASCII."""
    return [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]


#: First and last Hangul syllable; how they are made of initial, medial and final sounds.
_HANGUL, _SOUNDS = (0xAC00, 0xD7A3), ((0x1100, 19), (0x1161, 21), (0x11A7, 28))


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What code points of all planes fold to, by the Unicode tables: (to one character or none, to several); Hangul is left to arithmetic."""
    found = {c: x for c in _points() if not _HANGUL[0] <= ord(c) <= _HANGUL[1] for x in [_plain(c)] if x != c}
    return {c: x for c, x in found.items() if len(x) < 2}, {c: x for c, x in found.items() if len(x) > 1}


@functools.cache
def _unsettled() -> str:
    """A pattern of the code points that may not stand, or not so, in composed form: marks, what decomposes for good, what joins the letter before it."""
    joins = set("".join(map(chr, range(0x1161, 0x1176))) + "".join(map(chr, range(0x11A8, 0x11C3))))
    for c in _points():
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joins.add(chr(int(parts[1], 16)))
    return _one_of([c for c in _points() if unicodedata.combining(c) or c in joins or unicodedata.normalize("NFC", c) != c])


def _re(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def once(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.transform(F.array(c), lambda x: f(x))[0]  # by a lambda, as a function of two parameters would be given the place too


def _class(codes: list[int]) -> str:
    cuts = [0, *(i for i in range(1, len(codes)) if codes[i] - codes[i - 1] > 1), len(codes)]
    return "[" + "".join(f"\\x{{{codes[a]:x}}}-\\x{{{codes[b - 1]:x}}}" for a, b in zip(cuts, cuts[1:], strict=False)) + "]"


def _one_of(chars) -> str:
    """A pattern of exactly these characters. A class tries its ranges one by one, so there is one for each block of 4096
    code points, behind a look at the block, and Latin letters pass by two looks."""
    codes = sorted(map(ord, chars))
    low, high = [x for x in codes if x < 0x300], [x for x in codes if x >= 0x300]
    blocks = [[x for x in high if x >> 12 == b] for b in sorted({x >> 12 for x in high})]
    far = "|".join(f"(?=[\\x{{{own[0]:x}}}-\\x{{{own[-1]:x}}}]){_class(own)}" for own in blocks)
    return "(?:" + "|".join(([_class(low)] if low else []) + [f"(?=[^\\x00-\\x{{2ff}}])(?:{far})"]) + ")"


def _listed(values) -> Column:
    """An array of texts as one literal that the optimiser takes apart."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _expanded(c: Column) -> Column:
    """Characters that fold to several ones, in a text that has some."""
    several = _folds()[1]
    codes, forms = _listed(str(ord(x)) for x in several).cast("array<int>"), _listed(several.values())

    def sounds(code: Column) -> Column:
        at = code - _HANGUL[0]
        each = [_listed("" if n == 28 and i == 0 else chr(first + i) for i in range(n)) for first, n in _SOUNDS]
        places = F.floor(at / 588), F.floor(at % 588 / 28), at % 28
        return F.concat(*(F.element_at(s, (p + 1).cast("int")) for s, p in zip(each, places, strict=True)))

    def part(x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code < 0x80, x).when(code.between(*_HANGUL), sounds(code)).otherwise(F.coalesce(F.try_element_at(forms, F.nullif(F.array_position(codes, code), F.lit(0)).cast("int")), x))

    # One evaluation of what was translated, however often it is named.
    special = _one_of([*several, *map(chr, range(_HANGUL[0], _HANGUL[1] + 1))])
    pieces = lambda x: F.regexp_extract_all(x, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0))
    return once(c, lambda x: F.when(x.rlike(special), F.array_join(F.transform(pieces(x), part), "")).otherwise(x))


def fold(c: Column) -> Column:
    """Lower case without accents and compatibility forms, blanks collapsed; of all planes, with Hangul by its sounds.

    Accents go one character at a time, so their order doesn't matter. ASCII texts skip the tables.
    """
    one = _folds()[0]
    # Characters without a counterpart go.
    kept, gone = [x for x in one if one[x]], [x for x in one if not one[x]]
    wide = _expanded(F.translate(F.lower(c), "".join(kept + gone), "".join(one[x] for x in kept)))
    return F.trim(_re(F.when(_ascii(c), F.lower(c)).otherwise(wide), f"{BLANK}+", " "))


def _bare(c: str) -> str:
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.category(x).startswith("M")))


@functools.cache
def _unaccented() -> tuple[str, str]:
    """What code points lose their accents to: those with a counterpart first, then those that go."""
    found = {c: x for c in _points() if not _HANGUL[0] <= ord(c) <= _HANGUL[1] for x in [_bare(c)] if x != c and len(x) < 2}
    kept = [c for c in found if found[c]]
    return "".join(kept + [c for c in found if not found[c]]), "".join(found[c] for c in kept)


def strip_accents(c: Column) -> Column:
    """Lower case without marks, as SQL's strip_accents(lower()): unlike fold(), compatibility forms and blanks stay."""
    return F.when(_ascii(c), F.lower(c)).otherwise(F.translate(F.lower(c), *_unaccented()))


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def compose(c: Column) -> Column:
    """Canonical composition (NFC). Marks may come in any number and order, for which there is no built-in expression;
    only texts that hold marks or other unsettled characters are sent to a worker."""
    unsettled = ~_ascii(c) & c.rlike(r"[^\x00-\x{2ff}]") & c.rlike(_unsettled())  # the first is quick, and true of all that the second finds
    return F.when(unsettled, _composed(F.when(unsettled, c))).otherwise(c)


def normalize_unicode(c: Column) -> Column:
    """Composed letters, without controls."""
    return drop_controls(compose(c))


def drop_controls(c: Column) -> Column:
    """Control, format, unassigned and private characters go, but for line feeds."""
    return _re(c, r"[\p{C}&&[^\n]]")


def strip_noise(c: Column) -> Column:
    return _re(c, NOISE, " ")


def join_hyphens(c: Column) -> Column:
    """A hyphen at a line's end joins the next line."""
    return _re(c, r"-\s*\n\s*")


def normalize_blanks(c: Column) -> Column:
    """Blanks collapse, three line feeds or more become two, punctuation sticks to the word before it."""
    c = _re(_re(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    c = _re(_re(c, r"(?U)(?<!\s)\s++([,.;:!?])", "$1"), r"(?U)([,.;:])(?=\S)", "$1 ")
    return _re(c, TRIMMED)


def digits_to_letters(c: Column) -> Column:
    """In words of three ASCII letters and digits or more, 0 1 5 8 between letters become o l s b; neighbours are judged as given."""
    # Neighbours must be letters, so no two replaced digits touch, and the order of replacements doesn't matter.
    # A match starts at a word's start or, by \G, where the one before it in the same word ended.
    edge, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    out = c
    for digit, letter in DIGIT_LETTERS.items():
        out = _re(out, rf"(?:{edge}(?=[a-zA-Z0-9]{{3,}}{end})|\G(?<=[a-zA-Z0-9]))([a-zA-Z0-9]*?[a-zA-Z]){digit}(?=[a-zA-Z])", f"$1{letter}")
    # Few texts have a digit between letters.
    return F.when(c.rlike("[a-zA-Z][0158][a-zA-Z]"), out).otherwise(c)


def letters(c: Column) -> Column:
    """Number of letters."""
    return F.length(_re(c, r"\P{L}+"))


def drop_short_lines(c: Column, least: int = 3) -> Column:
    """Lines with fewer letters go, blank ones stay."""
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    # A line feed at the end opens no further line.
    lines = F.when(lines[F.size(lines) - 1] == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.array_join(F.filter(lines, lambda x: (letters(x) >= least) | (_re(x, r"(?U)\s+") == "")), "\n")


def clean_ocr_text(c: Column) -> Column:
    """All steps for recognised text."""
    c = normalize_unicode(c)  # a worker's function can't stand in a lambda
    for step in (join_hyphens, strip_noise, digits_to_letters, normalize_blanks, drop_short_lines):
        c = once(c, step)
    return c


def ingredients_section(c: Column) -> Column:
    """What stands between the section's heading and the next known heading; all if there is no heading."""
    return once(c, _section)


def _section(c: Column) -> Column:
    head = F.regexp_instr(c, F.lit(SECTION_START))
    tail = F.substring(c, F.lit(1), F.lit(2**31 - 1))
    tail = F.substr(c, head + F.length(F.regexp_substr(c, F.lit(SECTION_START))))
    end = F.regexp_instr(tail, F.lit(SECTION_END))
    cut = F.when(end > 0, F.substr(tail, F.lit(1), end - 1)).otherwise(tail)
    return F.when(head > 0, _re(cut, TRIMMED)).otherwise(c)


def drop_header(c: Column) -> Column:
    """Everything up to the first word that heads a list."""
    return _re(c, rf"(?isu)^.*?(?:{HEADER})")


def segments(c: Column) -> Column:
    """Array of the list's items in order; an opening parenthesis stays in its item, as closing ones separate."""
    plain = lambda t: F.when(t.contains("%"), _re(t, PERCENT, " ")).otherwise(t)
    text = _re(once(drop_header(normalize_unicode(c)), plain), JOINED, "$1$2,")
    parts = F.transform(F.split(text, SEPARATORS), lambda x: F.btrim(x, F.lit(EDGES)))
    return F.filter(parts, lambda x: x != "")


def match_string(c: Column) -> Column:
    """Words of a to z of the folded text."""
    return match_words(fold(c))


def match_words(folded: Column) -> Column:
    """Percentages hold no letters, so they go with the rest."""
    return F.trim(_re(folded, r"[^a-z]+", " "))


def tag_list(c: Column) -> Column:
    """Lower-cased, trimmed, non-empty tags; an empty array for null."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: _re(x, TRIMMED))
    return F.filter(parts, lambda x: x != "")


def claims_gluten_free(c: Column) -> Column:
    return F.coalesce(fold(c).rlike(CLAIM), F.lit(False))


def has_trace_marker(folded: Column) -> Column:
    return folded.rlike("|".join(TRACE_MARKERS))


def has_contains_marker(folded: Column) -> Column:
    return folded.rlike("|".join(CONTAINS_MARKERS))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def human_size(c: Column) -> Column:
    """Bytes with one decimal and a unit up to TiB."""
    out = F.format_string("%.1f TiB", c / F.lit(1024.0**4))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(c < F.lit(1024.0 ** (power + 1)), F.format_string(f"%.1f {unit}", c / F.lit(1024.0**power))).otherwise(out)
    return out


def full_size_url(c: Column) -> Column:
    """The address of the full image: its size number becomes 'full'."""
    return _re(c, r"\.(\d+)\.jpg(\?.*)?$", ".full.jpg$2")


def coalesce_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))
