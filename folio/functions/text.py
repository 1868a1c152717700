"""Text functions as Column expressions. Patterns are Java's; those with classes name Unicode ones."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and spaces with their plain forms, and dashes with theirs.
PLAIN = {
    "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
    "′": "'", "‘": "'", "’": "'", "‚": "'", "‵": "'", "‹": "'", "›": "'",
    "\u00a0": " ", "\u200b": "", "\ufeff": "",
}
DASHES = {"–": "--", "—": "---"}

# Spellings of editions.
EDITIONS = {
    "10": "Tenth", "2": "Second", "2nd": "Second", "2nd Editio": "Second", "3": "Third", "3rd": "Third", "5": "Fifth", "Second Edi": "Second", "fourth": "Fourth",
}


def plain_characters(c: Column) -> Column:
    """Typographic quotes and spaces made plain, dashes as hyphens."""
    kept = [k for k, v in PLAIN.items() if v]
    dropped = [k for k, v in PLAIN.items() if not v]
    out = F.translate(c, "".join(kept + dropped), "".join(PLAIN[k] for k in kept))
    for dash, hyphens in DASHES.items():
        out = F.replace(out, F.lit(dash), F.lit(hyphens))
    return out


def mapped(c: Column, values: dict[str, str]) -> Column:
    """The value that stands for c, or c itself."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def edition(c: Column) -> Column:
    return mapped(c, EDITIONS)


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters whose decomposition without marks is one other character, and those characters; then the marks, which go."""
    found = {}
    for i in range(0xC0, sys.maxunicode + 1):
        char = chr(i)
        if unicodedata.decomposition(char)[:1] not in ("", "<"):
            bare = "".join(x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn")
            if len(bare) == 1 and bare != char:
                found[char] = bare
    marks = (chr(i) for i in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Mn")
    return "".join([*found, *(m for m in marks if m not in found)]), "".join(found.values())


def remove_accents(c: Column) -> Column:
    """Letters without their accents; letters that are no composites (ø, ß) stay."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, *_accents())).otherwise(c)


def spaced_initials(c: Column) -> Column:
    """`Doe, JKL` to `Doe, J K L`: two or three capitals after the comma."""
    three = F.regexp_replace(c, r"(?<=, )([A-Z])([A-Z])([A-Z])\b", "$1 $2 $3")
    return F.regexp_replace(three, r"(?<=, )([A-Z])([A-Z])\b", "$1 $2")


def initial_periods(c: Column) -> Column:
    """`Doe, J K` to `Doe, J. K.`."""
    return F.regexp_replace(c, r"\b([A-Z])( |$)", "$1.$2")


def without_dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(""))


def citations(c: Column) -> Column:
    """Citations named in a text: a number, thousands as K, or a range's mean; 0 without one."""
    unit = r"([0-9][0-9,]*[Kk]?)\+?(?: ?- ?([0-9][0-9,]*[Kk]?)\+?)? +(?:(?:Google|GS) +)?[Cc]itations?"

    def number(group: int) -> Column:
        raw = F.lower(F.replace(F.regexp_extract(c, unit, group), F.lit(","), F.lit("")))
        digits = F.regexp_replace(raw, "k$", "")
        return F.when(digits == "", None).otherwise(digits.cast("double") * F.when(raw.endswith("k"), 1000).otherwise(1))

    first, second = number(1), number(2)
    return F.coalesce(F.floor((first + F.coalesce(second, first)) / 2), F.lit(0)).cast("long")


def integer_text(c: Column) -> Column:
    """The whole number that a text holds, as text, or the text."""
    return F.coalesce(c.cast("string").try_cast("bigint").cast("string"), c.cast("string"))


def file_size(c: Column) -> Column:
    """A size for people. Units change at 2^10, 2^18, 2^28, 2^38 and 2^48, so 256 KiB are `0MB`."""
    n, out = c.cast("long"), None
    for most, shift, unit in ((10, 0, "B"), (18, 10, "KB"), (28, 20, "MB"), (38, 30, "GB"), (48, 40, "TB")):
        text = F.concat(F.format_number(F.shiftright(n, shift), 0), F.lit(unit))
        out = F.when(n < 1 << most, text) if out is None else out.when(n < 1 << most, text)
    return out.otherwise(F.concat(F.format_number(F.shiftright(n, 50), 0), F.lit("PB")))


def joined_hyphens(c: Column) -> Column:
    """Words that a line's end has split, joined again."""
    # a word is entered at its start only and never given back in part
    return F.when(F.contains(c, F.lit("-\n")), F.regexp_replace(c, r"(?U)(?<!\w)(\w++)-\n(\w++)", "$1$2")).otherwise(c)


def unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r"), F.lit(""))


def looks_like_title(c: Column) -> Column:
    """At least five characters and two words, and not only digits and separators."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.coalesce((F.char_length(text) >= 5) & (words >= 2) & ~text.rlike(r"(?U)^[\d\s\-_.]+$"), F.lit(False))


def first_year(c: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone; null without one."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit(""))


def de_slugged(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("_"), F.lit(" ")))


def clean_title(c: Column) -> Column:
    """A title without what office programs put there."""
    return F.regexp_replace(F.trim(c), r"(?i)Microsoft (?:PowerPoint|Word)(?: - )?|Presentation title", "")


def last_name_first(c: Column) -> Column:
    """`First Last` to `Last, First`; names with a comma stay."""
    parts = F.split(F.trim(c), " ")
    turned = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))
    return F.when((F.trim(c) == "") | F.contains(c, F.lit(",")), F.trim(c)).otherwise(turned)


def without_braces(c: Column) -> Column:
    """Pairs of braces removed around what has none inside."""
    return F.regexp_replace(c, r"\{([^{}]+)\}", "$1")


def best_title(meta: Column, cover: Column, name: Column, similarity: Column) -> Column:
    """The likeliest title of a document from its metadata, its first page and its file name."""
    m, v = F.coalesce(meta, F.lit("")), F.coalesce(cover, F.lit(""))
    long_m, long_v = F.char_length(m), F.char_length(v)
    fallback = F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))
    return (
        F.when(similarity > 90, m).when((long_m > long_v) & (long_m > 10), m).when((long_v > long_m) & (long_v > 10), v)
        .when(F.size(F.split(fallback, " ")) > 3, fallback).otherwise("")
    )


def lookup_query(title: Column, subject: Column, stem: Column) -> Column:
    """What to search a document by: the first of title, subject and file name that looks like a title, and a year."""
    slug = de_slugged(stem)
    base = F.when(looks_like_title(title), title).when(looks_like_title(subject), subject).when(looks_like_title(slug), slug)
    year = F.coalesce(first_year(subject), first_year(title), first_year(stem))
    return F.when(base.isNotNull(), F.concat_ws(" ", base, year)).otherwise("")


# Paths


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def relative_parent(path: Column, root: str) -> Column:
    """The folder of a path, without the root it starts with."""
    rest = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.char_length(path))).otherwise(path)
    return F.regexp_replace(F.regexp_replace(rest, r"[^/\\]*$", ""), r"^[/\\]+|[/\\]+$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def text_path(path: Column, text_dir: str, extractor: str) -> Column:
    """Where the extracted text of a document is."""
    return F.concat(F.lit(text_dir.rstrip("/") + "/"), F.regexp_replace(path, r"^[/\\]+", ""), F.lit(f".{extractor}.md"))


def moment(nanoseconds: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp of microseconds."""
    ns = nanoseconds.cast("long")
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def starts_with_match(c: Column, pattern: str) -> Column:
    """Whether a pattern matches from the start of a text."""
    return c.rlike(f"^(?:{pattern})")


def latin1(c: Column) -> Column:
    """A text's bytes in Latin-1; characters it lacks are question marks."""
    return F.encode(c, "ISO-8859-1")


def from_utf8(c: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(c.cast("string"))


def wide_characters(c: Column) -> Column:
    """The distinct characters of a text that need more than one byte."""
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: F.octet_length(x) > 1)
