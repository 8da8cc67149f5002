"""Text expressions: white space, token keys, distances, escapes.

White space follows the Unicode notion everywhere (``\\s`` of the JVM leaves
no-break spaces), and lengths are in code points.
"""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Unicode white space as a character class without brackets, for JVM and RE2 alike.
SPACE = r"\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Distinct words of a pair that ``words_as_chars`` can number.
MOST_WORDS = 0x10FFFF - 0x10000


def strip(text: Column) -> Column:
    """``text`` without leading and trailing white space."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, ends stripped (null stays null)."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def bit_distance(a: str, b: str) -> int:
    """Edit distance in code points by bit vectors: a column of the table is two
    integers of ``len(a)`` bits, so a step costs a few machine words."""
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where the column rises, and where it falls
    for c in b:
        equal = at.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(rises & last) - bool(falls & last)
        rises, falls = rises << 1 | 1, falls << 1
        up, down = (falls | ~(equal | down | rises)) & full, rises & (equal | down) & full
    return score


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance of whole texts (null if either is): bit vectors in Arrow
    batches, some sixty times fewer steps than the built-in's table."""

    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else bit_distance(p, q) for p, q in zip(x, y)], dtype="Int64")

    return F.pandas_udf(distances, LongType())(a, b)


def tokens(text: Column) -> Column:
    """White-space separated tokens; the empty array for blank text."""
    return F.filter(F.split(squeeze(text), " "), lambda x: x != "")


def strip_edges(token: Column) -> Column:
    """``token`` without punctuation and symbols at its ends."""
    return F.regexp_replace(token, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def token_key(token: Column) -> Column:
    """Key under which tokens count as the same word."""
    return F.lower(strip_edges(strip(token)))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over reference length; may exceed 1.  An empty reference
    gives 0 against an empty hypothesis, else 1; null operands give null."""
    n = F.length(reference)
    rate = F.levenshtein(reference, hypothesis) / F.nullif(n, F.lit(0))
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(rate)


def words_as_chars(own: Column, words: Column) -> Column:
    """Each word as the character numbered by its place in ``words``, in the
    planes above the surrogates; more than ``MOST_WORDS`` words raise."""
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 0xFFFF), 8, "0")), "UTF-32")
    out = F.array_join(F.transform(own, code), "")
    return F.when(F.size(words) > MOST_WORDS, F.raise_error(F.lit("too many distinct words in a pair")).cast("string")).otherwise(out)


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words: every distinct word of the pair becomes one
    character, so the built-in distance applies."""
    a, b = tokens(reference), tokens(hypothesis)
    words = F.array_distinct(F.concat(a, b))
    return F.levenshtein(words_as_chars(a, words), words_as_chars(b, words))


def xml_escape(text: Column) -> Column:
    """Text for XML content and attributes."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def nfc(text: Column) -> Column:
    """Composed form; there is no built-in for it, so Arrow batches carry it."""

    def compose(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    return F.pandas_udf(compose, StringType())(text)


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def code_points(text: Column) -> Column:
    """The characters of ``text`` in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def round_half_up(x: Column) -> Column:
    """Rounding towards positive infinity at halves."""
    return F.floor(x + 0.5)
