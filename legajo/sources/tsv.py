"""Recogniser TSV: one row per page in, one row per word out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in a header, and what the columns are called here.
NAMES = {"level": "level", "page_num": "page", "block_num": "block", "par_num": "paragraph", "line_num": "line", "word_num": "word_no", "left": "left", "top": "top", "width": "width", "height": "height", "conf": "confidence", "text": "text"}
COLUMNS = tuple(NAMES.values())


def _held(df: DataFrame, keep: list[str], prefix: str = "__", **columns: Column) -> DataFrame:
    """``keep`` and the named columns, computed once: they come out of a generator,
    so no later filter, cell or row takes their expressions in and repeats them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(prefix + n) for n, c in columns.items()]))))


def parse_words(df: DataFrame, tsv: str, strict: bool = True) -> DataFrame:
    """Words (level 5, text not blank) of each row's TSV with the row's other
    columns.

    A header line names the columns, in any order; without one they stand in
    the order of ``NAMES``.  Where the text is the last column, tabs within it
    stay.  Strict: a header that lacks a column, a short row, a number that is
    none, a negative origin or an empty box raises; otherwise such rows are
    dropped.  Null and empty texts have no words.
    """
    keep = [c for c in df.columns if c != tsv]
    page = _held(df, keep, lines=F.split(tsv, "\r?\n"))
    head = F.get(F.filter("__lines", lambda x: x.startswith("level\t")), F.lit(0))
    page = _held(page, [*keep, "__lines"], h=F.coalesce(F.split(head, "\t"), F.array(*[F.lit(n) for n in NAMES])))
    places = F.struct(*[F.nullif(F.array_position("__h", n).cast("int"), F.lit(0)).alias(n) for n in NAMES])
    page = _held(page, [*keep, "__lines"], at=places, n=F.size("__h"), m=F.array_except(F.array(*[F.lit(n) for n in NAMES]), "__h"))
    line = page.select(*keep, "__at", "__n", "__m", F.explode("__lines").alias("__l")).where("trim(__l) != '' and not __l like 'level\t%'")
    part = _held(line, [*keep, "__at", "__n", "__m"], p=F.split("__l", "\t", -1))
    at = lambda n: F.col(f"__at.{n}")
    cell = lambda n: F.try_element_at("__p", at(n))
    rest = F.array_join(F.slice("__p", F.col("__n"), F.size("__p") - F.col("__n") + 1), "\t")
    text = F.when((at("text") == F.col("__n")) & (F.size("__p") > F.col("__n")), rest).otherwise(cell("text"))
    typed = _held(part, [*keep, "__m"], "", **{c: cell(n).try_cast("double") for n, c in NAMES.items() if n != "text"}, text=text)
    good: Column = F.size("__m") == 0
    for c in COLUMNS[:11]:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = good & (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("width") > 0) & (F.col("height") > 0) & F.col("text").isNotNull()
    word = typed.where("level = 5 or level is null or size(__m) > 0")
    checked = word.withColumn("__ok", good)
    if strict:
        wrong = F.when(F.size("__m") > 0, F.concat(F.lit("malformed TSV header, without "), F.array_join("__m", ", "))).otherwise("malformed TSV row")
        checked = checked.withColumn("__ok", F.when(F.col("__ok"), True).otherwise(F.raise_error(wrong).cast("boolean")))
    return checked.where("__ok and trim(text) != ''").select(*keep, *[F.col(c).cast("int").alias(c) for c in COLUMNS[1:6]], *COLUMNS[6:])
