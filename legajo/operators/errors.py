"""Error rates: micro averages, rankings, deltas and pairwise comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(part, F.nullif(whole, F.lit(0))), F.lit(0.0))


def micro_rates(df: DataFrame, keys: Sequence[str], duration: str | None = None) -> DataFrame:
    """Summed distances over summed references per group (never a mean of
    ratios), and total and mean of the finite, non-negative durations (0 where
    there are none)."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("character_distance", "word_distance", "reference_characters", "reference_words")}
    out = [F.count("*").alias("samples"), *[v.alias(c) for c, v in sums.items()]]
    out += [F.round(ratio(sums["character_distance"], sums["reference_characters"]), 6).alias("cer"), F.round(ratio(sums["word_distance"], sums["reference_words"]), 6).alias("wer")]
    if duration:
        d = F.when((F.col(duration) >= 0) & ~F.isnan(duration), F.col(duration))
        out += [F.round(F.coalesce(F.sum(d), F.lit(0.0)), 3).alias("total_duration_ms"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 3).alias("mean_duration_ms")]
    return df.groupBy(*keys).agg(*out)


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with its place by ``order`` in each partition, ties broken by the
    order given, so it must end in a unique column."""
    window = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(window))


def inner_strict(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, left rows without partner): the caller decides whether a
    missing partner is an error, nothing is dropped silently."""
    return left.join(right, list(keys)), left.join(right, list(keys), "left_anti")


def joined_strict(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inner join; a left row without partner raises when the result is read."""
    marked = left.join(right.withColumn("__there", F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.concat(F.lit("no partner for "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])).cast("boolean")
    return marked.where(F.when(F.col("__there").isNull(), missing).otherwise(True)).drop("__there")
