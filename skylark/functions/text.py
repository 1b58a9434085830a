"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import itertools
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decompose to another one and marks, by Unicode's own rule, and the marks.
_MARKED = [c for c in map(chr, itertools.chain(range(0xC0, 0xD800), range(0xE000, 0x30000), range(0xE0100, 0xE01F0))) if unicodedata.decomposition(c) or unicodedata.category(c)[0] == "M"]
_BARE = {c: unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")) for c in _MARKED}
_PAIRS = sorted(((c, b) for c, b in _BARE.items() if c != b), key=lambda p: p[1] == "")
#: The marks come last and stand for nothing.
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chain(value: Column, *steps: tuple[str, str]) -> Column:
    """regexp_replace for each (pattern, replacement), in order."""
    return reduce(lambda v, s: F.regexp_replace(v, s[0], s[1]), steps, value)


def trim_all(c: Column | str) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    return col(c).isNull() | (trim_all(c) == "")


def fold_accents(c: Column | str) -> Column:
    """Letters without their accents and other marks, of any script."""
    return F.translate(col(c), ACCENTED, PLAIN)


def normalize_brand_name(c: Column | str) -> Column:
    """Brand names in one spelling: lower case words without accents, apostrophes, periods, hyphens; & is and."""
    v = chain(col(c), ("'", ""), (r"\.", ""), ("&", " and "), ("([a-z])([A-Z])", "$1 $2"))
    v = chain(trim_all(F.lower(v)), ("-", " "), ("([a-z])and([a-z])", "$1 and $2"), ("([0-9])([a-z])", "$1 $2"), ("([a-z])([0-9])", "$1 $2"))
    return F.regexp_replace(fold_accents(v), r"(?U)\s+", " ")


def brand_match_key(c: Column | str) -> Column:
    """The normalized name without anything but a-z and 0-9."""
    return F.regexp_replace(normalize_brand_name(c), "[^a-z0-9]", "")


def normalize_text_for_matching(c: Column | str) -> Column:
    """Text with camel case, digits, glued "and", & and accents opened up as in normalize_brand_name; case stays."""
    steps = [("'", ""), (r"\.", ""), ("([a-z])([A-Z])", "$1 $2"), ("-", " "), ("([0-9])([a-zA-Z])", "$1 $2"), ("([a-zA-Z])([0-9])", "$1 $2")]
    v = chain(col(c), *steps, ("(?i)([a-z])and([a-z])", "$1 and $2"), ("&", " and "))
    return F.regexp_replace(fold_accents(v), r"(?U)\s+", " ")


def open_words(c: Column | str) -> Column:
    """Text for matching as in normalize_text_for_matching, but accents go first and only ASCII white space counts, as in the SQL of brands_in_texts."""
    letter = "([a-zA-Z\u017f\u212a])"
    steps = [("'", ""), (r"\.", ""), ("([a-z])([A-Z])", "$1 $2"), ("-", " "), ("([0-9])([a-zA-Z])", "$1 $2"), ("([a-zA-Z])([0-9])", "$1 $2")]
    return chain(fold_accents(c), *steps, (f"{letter}(?i:and){letter}", "$1 and $2"), ("&", " and "), (r"[\t\n\f\r ]+", " "))


def normalize_words(c: Column | str) -> Column:
    """Lower case words of ASCII letters, digits, _ and the Spanish accented letters, single spaces between."""
    return trim_all(chain(F.lower(col(c)), (r"[^a-z0-9_áéíóúñü]+", " ")))


def compact(c: Column | str) -> Column:
    """Lower case a-z and 0-9 only, accents folded."""
    return F.regexp_replace(fold_accents(F.lower(col(c))), "[^a-z0-9]", "")


def long_words(c: Column | str, least: int = 3) -> Column:
    """The distinct normalized words of at least so many characters."""
    return F.array_distinct(F.filter(F.split(normalize_words(c), " "), lambda w: F.length(w) >= least))


def word_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the words longer than 2; 0 if either has none."""
    x, y = long_words(a), long_words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / F.size(F.array_union(x, y)))


# Words that say little about a company.
STOP_WORDS = ["academia", "centro", "escuela", "english", "language", "school", "centre", "center", "de", "en", "para", "the", "and", "y", "la", "el", "los", "las"]


def company_variations(c: Column | str) -> Column:
    """The compact name, then its telling words, each of 3 characters or more, distinct and in order."""
    words = F.filter(F.split(F.lower(col(c)), r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~compact(w).isin(STOP_WORDS))
    return F.filter(F.array_distinct(F.concat(F.array(compact(c)), F.transform(words, compact))), lambda v: F.length(v) >= 3)


def inline_citations(c: Column | str) -> Column:
    """The numbers of [n] or \\[n\\] marks, distinct and ascending."""
    found = F.regexp_extract_all(col(c), F.lit(r"\\?\[(\d+)\\?\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def clean_column_name(c: Column | str) -> Column:
    """A lower-case identifier: runs of other characters become _, none at the ends."""
    return chain(F.lower(trim_all(c)), (r"[^a-z0-9_]+", "_"), ("_+", "_"), ("^_|_$", ""))


def questions(c: Column | str) -> Column:
    """Distinct question sentences, URLs taken out first."""
    bare = F.regexp_replace(col(c), r"https?://\S+", "")
    sentences = F.regexp_extract_all(bare, F.lit(r"[^.!?\n]++[.!?\n]?"), F.lit(0))
    found = F.filter(sentences, lambda s: s.endswith("?"))
    return F.filter(F.array_distinct(F.transform(found, trim_all)), lambda q: F.length(q) > 1)


def count_name(text: Column | str, name: str) -> Column:
    """How often a name stands in the text as whole ASCII words, without regard to case."""
    return F.regexp_count(col(text), F.lit(rf"(?iu)(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"))


def collapse_blank_lines(c: Column | str) -> Column:
    """Lines trimmed, at most one blank line in a row, none at the ends."""
    blank = r"[\s\x{FEFF}&&[^\n]]"
    return trim_all(chain(col(c), (rf"(?U)(?<!{blank}){blank}*+\n{blank}*+", "\n"), ("\n{3,}", "\n\n")))


#: A rule's selector begins with one of these, so words before braces stay.
_SELECTOR = r"[.#:@*][\w\-.#:,>\[\]=*~+ ]*+"


def without_css(c: Column | str) -> Column:
    """Without style rules (`.selector { property: value; }`) and blocks of them under an at-rule that leak into scraped text.

    A selector begins with . # : * or @, so that prose and JSON-like braces stay, as do braces without a property.
    No pattern repeats a group: innermost rules go first, then the at-rules that this empties.
    """
    rule = rf"(?:^|(?<=[\s{{}}])){_SELECTOR}\{{(?=\s*+[\w-]++\s*+:)[^{{}}]*+\}}(?:\.(?=\s|$))?"
    empty = rf"(?:^|(?<=[\s}}]))@[\w-]++[^{{}}]*+\{{\s*+\}}(?:\.(?=\s|$))?"
    return chain(col(c), (rule, ""), (empty, ""))


def without_adjacent_repeats(parts: Column | str) -> Column:
    """An array without elements that equal the one before."""
    parts = col(parts)
    return F.filter(parts, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(parts, i - 1)))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def dedent(c: Column | str) -> Column:
    """Without the indentation that all lines share; the lines of a paragraph become one, but for list items.

    Blank lines don't count for the indentation. A paragraph that begins with a list mark (-, *, +, 1. or a.) keeps its lines. Null stays null.
    """
    filled = lambda line: trim_all(line) != ""
    lines = F.split(col(c), "\n")
    width = F.array_min(F.transform(F.filter(lines, filled), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))))
    cut = lambda s: F.transform(s["lines"], lambda x: F.when(filled(x), F.substr(x, s["width"] + 1)).otherwise(x))
    known = F.array(F.struct(lines.alias("lines"), F.coalesce(width, F.lit(0)).alias("width")))
    paragraphs = F.split(F.array_join(F.get(F.transform(known, cut), F.lit(0)), "\n"), "\n\n")
    one = lambda p: F.when(trim_all(p).rlike(r"^([-*+]|\d+\.|[a-zA-Z]\.) "), p).otherwise(F.replace(p, F.lit("\n"), F.lit(" ")))
    return trim_all(F.array_join(F.transform(paragraphs, one), "\n\n"))
