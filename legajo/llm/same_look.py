"""One consistent form for text that looks the same but differs in characters.

Each character has a quick-check property (stable or not, learned once per
process from the Unicode database).  Values of stable characters pass through
untouched.  In the others only the maximal runs of unstable characters, with
the starter before them as context, are normalised, and the results spliced
into the unchanged rest.  Look-alike letters of other scripts need the word as
context: they are replaced in words that hold Latin letters.  Words made of
look-alikes only follow the nearest word whose script is certain: beside
``был`` the word ``у`` is Cyrillic, beside ``casa`` it is meant as ``y``; where
no word is certain the corpus's main script holds.  Words with any other letter of their script stay
(``привет``, ``λόγος``), and single letters like ``Ω`` are symbols that say
nothing about their neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.tables import table

#: Letters of Greek and Cyrillic that look like a Latin letter.
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
#: Look-alikes that only stand for a letter beside Latin ones.
_ONLY_MIXED = {"α": "a", "γ": "y", "η": "n", "τ": "t", "σ": "o", "ω": "w", "к": "k", "κ": "k", "м": "m", "т": "t", "ԁ": "d", "ո": "n"}
#: What look-alikes are where no word of the text is certain: the script of the corpus.
MAIN_SCRIPT = "latin"
#: Look-alikes of digits, in numbers only.
_DIGITS = {"З": "3"}
_FOREIGN = "Ͱ-ϿЀ-ԯԱ-և"
#: JVM-side quick check: values without any of these need no Python at all.
SUSPECT = "[^\\x00-\\x7F¡¿°ºª«»·€½¼¾áéíóúüñÁÉÍÓÚÜÑãõçâêôàÃÕÇÂÊÔÀ—–“”‘’…•©§¦¤¬±¶³®£]"

_IGNORABLE = {0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, *range(0xFE00, 0xFE10)}
_STABLE, _UNSTABLE = set(), set()


def _fold(c: str) -> str:
    """The ordinary text that a character stands for."""
    if ord(c) in _IGNORABLE:
        return ""
    category, parts = unicodedata.category(c), unicodedata.decomposition(c)
    if category == "Zs":
        return " "
    if parts.startswith(("<wide>", "<narrow>")) or parts.startswith(("<font>", "<compat>")) and category in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd"):
        return unicodedata.normalize("NFKC", c)
    return c


@cache
def _maybe() -> frozenset[str]:
    """Characters whose quick check is "maybe": they compose with what may stand
    before them (second parts of compositions, vowels and finals of Hangul)."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for code in range(0xC0, 0x20000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and "<" not in parts[0] and unicodedata.is_normalized("NFC", chr(code)):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _joins(c: str) -> bool:
    return unicodedata.combining(c) > 0 or c in _maybe()


def _unstable(c: str) -> bool:
    """Quick check of one character: it folds, may join the one before, or isn't
    composed."""
    return _fold(c) != c or _joins(c) or not unicodedata.is_normalized("NFC", c)


def unstable_of(text: str) -> set[str]:
    """The unstable characters of ``text``."""
    new = set(text) - _STABLE - _UNSTABLE
    for c in new:
        (_UNSTABLE if _unstable(c) else _STABLE).add(c)
    return set(text) & _UNSTABLE


_PART = "(?:[^\\W_]|[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufeff])"
_word = re.compile(f"{_PART}+")
_foreign = re.compile(f"[{_FOREIGN}]")


def _script(word: str) -> str:
    """``latin``, ``other``, ``open`` (look-alikes only) or '' (says nothing)."""
    letters = [c for c in word if c.isalpha()]
    if any(not _foreign.match(c) for c in letters):
        return "latin"
    if letters and all(c in LOOK_ALIKE or c in _DIGITS for c in letters):
        return "open"
    return "other" if len(letters) > 1 else ""


def _latin(word: str) -> str:
    if not any(c.isalpha() and c not in _DIGITS for c in word):
        return "".join(_DIGITS.get(c, c) for c in word)
    return "".join(LOOK_ALIKE.get(c) or _ONLY_MIXED.get(c, c) for c in word)


def _plain_words(text: str) -> str:
    """``text`` with look-alikes replaced where their words are Latin ones."""
    words = list(_word.finditer(text))
    scripts = [_script(m.group()) for m in words]
    n = len(words)
    left, right = [(n + 1, "")] * n, [(n + 1, "")] * n  # distance and script of the nearest certain word
    for order, near in ((range(n), left), (range(n - 1, -1, -1), right)):
        last, script = None, ""
        for i in order:
            near[i] = (abs(i - last), script) if last is not None else (n + 1, "")
            if scripts[i] in ("latin", "other"):
                last, script = i, scripts[i]
    out, at = [], 0
    for i, m in enumerate(words):
        if not _foreign.search(m.group()):
            continue
        certain = scripts[i]
        if certain == "open":
            (a, x), (b, y) = left[i], right[i]
            certain = (x if a < b else y if b < a else x if x == y else "other") or MAIN_SCRIPT
        if certain == "latin":
            out += [text[at : m.start()], _latin(m.group())]
            at = m.end()
    return "".join([*out, text[at:]])


def canonical(text: str | None) -> str | None:
    """The consistent form of ``text``; null and empty stay as they are.

    Line and page breaks, tabs, typographic signs, ordinals, fractions and
    mojibake are left alone.  ``canonical(canonical(t)) == canonical(t)``.
    """
    if not text or text.isascii():
        return text
    if _foreign.search(text):
        text = _plain_words(text)
    found = unstable_of(text)
    if found:
        pieces, at = [], 0
        for m in re.finditer("[" + "".join(map(re.escape, sorted(found))) + "]+", text):
            start = m.start()
            if start > at and _joins(next((x for x in m.group() if _fold(x)), "a")[0]):
                start -= 1  # the starter that the marks combine with
            pieces.append(text[at:start])
            pieces.append(unicodedata.normalize("NFC", "".join(map(_fold, text[start : m.end()]))))
            at = m.end()
        return "".join([*pieces, text[at:]])
    return text


def canonicalise(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the consistent form of column ``text`` as column ``into``.

    All other columns and rows are kept (a column already named ``into`` is
    replaced); rows keep their partition.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    base = df.drop(into) if into != text else df.withColumnRenamed(text, "__before")
    text = "__before" if into == text else text
    schema = StructType([*base.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(b.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(canonical, values), type=pa.string())], names=[*b.schema.names, into])

    out = base.mapInArrow(run, schema)
    return out.drop("__before") if text == "__before" else out


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, rec_id, line_no, text of the three kinds of value."""
    case = table(spark, sf_dir, "case_results")

    def whole(c: str) -> DataFrame:
        return case.select(F.lit(c).alias("field"), F.col("result_id").alias("rec_id"), F.lit(0).alias("line_no"), F.col(c).alias("text"))

    lines = table(spark, sf_dir, "recognitions").select("recognition_id", F.explode("lines").alias("l"))
    line = lines.select(F.lit("prediction").alias("field"), F.col("recognition_id").alias("rec_id"), F.col("l.line_number").cast("int").alias("line_no"), F.col("l.prediction").alias("text"))
    return whole("expected").unionByName(whole("obtained")).unionByName(line)


def suspect(text: Column) -> Column:
    return text.rlike(SUSPECT)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a character that stands for another one or for nothing."""
    out = canonicalise(fields(spark, sf_dir).where(suspect(F.col("text"))), "text", "canonical")
    return out.where("canonical != text").select("field", "rec_id", "line_no")


def p4_equal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category the cases whose expected and obtained text are equal as
    written, and those equal once both have the consistent form."""
    pairs = table(spark, sf_dir, "case_results").select("category", "expected", "obtained")
    both = canonicalise(canonicalise(pairs, "expected", "e"), "obtained", "o")
    return both.groupBy("category").agg(F.count_if(F.col("expected") == F.col("obtained")).alias("equal_as_written"), F.count_if(F.col("e") == F.col("o")).alias("equal_canonical"), F.count("*").alias("n"))
