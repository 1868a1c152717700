"""What Spark has no function for, as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# TeX accent commands with their combining marks, and commands for single letters.
MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dj": "đ", "DJ": "Đ", "ng": "ŋ", "NG": "Ŋ"}
SIGNS = {r"\&": "&", r"\%": "%", r"\$": "$", r"\#": "#", r"\_": "_", r"\{": "{", r"\}": "}", "---": "—", "--": "–", "``": "“", "''": "”"}

_ACCENT = re.compile(r"""\\([`'^~="."]|[uvHcdbkr](?![A-Za-z]))\s*(?:\{\s*(\\[ij]|\w)?\s*\}|(\\[ij](?![A-Za-z])|\w))""")
_LETTER = re.compile(r"\\(" + "|".join(sorted(LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|\s+|)")
_SINGLE = re.compile(r"\{(.)\}")
_LEFT = re.compile(r"\\[A-Za-z`'^~=.\"]")


def tex_decoded(text: str | None) -> tuple[str | None, bool]:
    """TeX accents and letters as Unicode, braces round single characters gone, capital names in title case; and whether commands were left."""
    if text is None:
        return None, False

    def accent(m: re.Match) -> str:
        base = (m[2] or m[3] or "").replace("\\i", "i").replace("\\j", "j")
        return unicodedata.normalize("NFC", base + MARKS[m[1]]) if base else m[0]

    out = _LETTER.sub(lambda m: LETTERS[m[1]], _ACCENT.sub(accent, text))
    for sign, char in SIGNS.items():
        out = out.replace(sign, char)
    while (once := _SINGLE.sub(r"\1", out)) != out:
        out = once
    if out.find(",") > 0 and out == out.upper():
        out = out.title()
    return out, bool(_LEFT.search(out))


def tex_to_unicode(text: Column, by_hand: dict[str, str] | None = None) -> Column:
    """A struct of the decoded text and `undecoded`: whether commands are left. by_hand: texts with what stands for them."""
    told = by_hand or {}

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("undecoded", T.BooleanType())]))
    def decode(texts: pd.Series) -> pd.DataFrame:
        pairs = [(told[t], False) if t in told else tex_decoded(t) for t in texts]
        return pd.DataFrame({"text": [p[0] for p in pairs], "undecoded": [p[1] for p in pairs]})

    return decode(text)


@F.pandas_udf(T.StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Each run of letters capitalised, after hyphens and apostrophes too."""
    return texts.map(lambda t: None if t is None else t.title())


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def indel_ratio(a: str, b: str) -> float:
    """200 x the longest common subsequence over both lengths; 100 for two empty strings."""
    if not a and not b:
        return 100.0
    if len(a) < len(b):
        a, b = b, a
    # each bit is a character of b; a zero marks a matched place
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    state = full
    for c in a:
        x = state & at.get(c, 0)
        state = (state + x | state - x) & full
    return 200.0 * (len(b) - state.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
