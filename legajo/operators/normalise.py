"""Strict normalisation of identifiers, correlatives, dates and amounts.

Staged projections: each step is a column of its own, so no expression is
evaluated twice and the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.fields import digits
from legajo.functions.text import SPACE, strip


def normalise(df: DataFrame, kind: Column, raw: Column) -> DataFrame:
    """``df`` with ``input``, ``value``, ``status`` and ``reason`` of ``raw`` by
    the rule of ``kind`` (NIT, TV_CORRELATIVO, DATE, AMOUNT).

    UNCHANGED or NORMALIZED come with a value; INVALID and AMBIGUOUS (a
    two-digit year, never expanded) with null.  A null text counts as empty.
    An unknown kind gives nulls.  Columns of ``df`` with these names are
    replaced.
    """
    k, text, part, read = F.col("__kind"), F.col("__text"), F.col("__part"), F.col("__read")
    value, reason = F.col("value"), F.col("reason")
    plain = F.coalesce(strip(F.col("__raw")), F.lit(""))
    staged = df.drop(*[c for c in ("input", "value", "status", "reason") if c in df.columns]).withColumns({"__kind": kind, "__raw": raw})
    staged = staged.withColumn("__text", F.when(k == "TV_CORRELATIVO", F.upper(plain)).otherwise(plain))
    staged = staged.withColumn(
        "__part",
        F.when(k == "TV_CORRELATIVO", F.regexp_replace(F.col("__text"), f"[{SPACE}]*-[{SPACE}]*", "-"))
        .when(k == "DATE", F.regexp_replace("__text", f"[{SPACE}]+", ""))
        .when(k == "AMOUNT", F.regexp_replace(F.regexp_extract("__text", rf"^[Bb][Ss]\.?[{SPACE}]+(.+)$", 1), f"[{SPACE}]+", ""))
        .otherwise(text),
    )
    staged = staged.withColumn("__read", F.when(k == "TV_CORRELATIVO", F.concat(F.substring(part, 1, 3), digits(F.substring(part, 4, 1000)))).otherwise(digits(part)))
    day = F.when(read.rlike("^[0-9]{2}/[0-9]{2}/(?:[0-9]{2}|[0-9]{4})$"), F.concat(F.substring(read, 1, 6), F.when(F.length(read) == 8, "2000").otherwise(F.substring(read, 7, 4))))
    staged = staged.withColumn("__day", F.when(k == "DATE", F.try_to_date(day, "dd/MM/yyyy")))
    staged = staged.withColumn("__short", (k == "DATE") & F.col("__day").isNotNull() & (F.length(read) == 8))
    staged = staged.withColumn(
        "value",
        F.when((k == "NIT") & read.rlike("^[0-9]{1,20}$"), read)
        .when((k == "TV_CORRELATIVO") & part.rlike("^TV-[A-Z0-9]+-[A-Z0-9]{4}$") & read.rlike("^TV-[0-9]{3,}-[0-9]{4}$"), read)
        .when((k == "DATE") & F.col("__day").isNotNull() & (F.length(read) == 10) & (F.substring(read, 7, 4) >= "0100"), read)
        .when((k == "AMOUNT") & read.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]{2}$"), F.concat(F.lit("Bs "), read)),
    )
    staged = staged.withColumn(
        "reason",
        F.when(k.isNull(), None).when(F.col("__short"), "SHORT_YEAR").when(value.isNull(), F.when(k == "DATE", "INVALID_DATE").otherwise("INVALID_FORMAT"))
        .when(value == text, "NO_CHANGE").when(read != part, "NUMERIC_CONTEXT").otherwise("FORMAT_NORMALIZATION"),
    )
    status = F.when(reason == "SHORT_YEAR", "AMBIGUOUS").when(reason.startswith("INVALID"), "INVALID").when(reason == "NO_CHANGE", "UNCHANGED").when(reason.isNotNull(), "NORMALIZED")
    out = staged.withColumns({"status": status, "input": text})
    return out.select(*[c for c in df.columns if c not in ("input", "value", "status", "reason")], "input", "value", "status", "reason")
