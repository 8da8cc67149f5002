"""Problem 1 over its tables: durations per run, day and strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm.rank_summary import merge_summaries, quantile_bounds, ratio_exceeds, summarise
from legajo.tables import table

#: Permitted rank error as a share of the group.
EPS = 0.005


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, run_id, day, value of every row of the three tables; negative
    durations, which are none, come as null."""
    parts = [("case_results", "duration_ms", "generated_at"), ("matrix_rows", "ocr_duration_ms", "measured_at"), ("pipeline_summaries", "p95_ms", "generated_at")]
    frames = [table(spark, sf_dir, t).select(F.lit(c).alias("field"), "run_id", F.to_date(at).alias("day"), F.when(F.col(c) >= 0, F.col(c)).alias("value")) for t, c, at in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose 95th percentile is more than four times their median."""
    return ratio_exceeds(durations(spark, sf_dir), ["field", "run_id"], "value", 0.95, 0.5, 4.0, EPS)


def p1_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain bounds of median and p95 per field and day, and of the whole
    (null day), the latter combined from the daily pieces and that of the rows
    without a day, which has no row of its own."""
    keys = ["field", "day"]
    probs = {"p50": 0.5, "p95": 0.95}
    days = merge_summaries(summarise(durations(spark, sf_dir), keys, "value", EPS / 4), keys, EPS / 4)
    whole = quantile_bounds(days, ["field"], probs, EPS / 4).withColumn("day", F.lit(None).cast("date"))
    daily = quantile_bounds(days.where("day is not null"), keys, probs, EPS / 4)
    return daily.unionByName(whole).select("field", "day", "n", "p50_lo", "p50_hi", "p95_lo", "p95_hi")


def p1_run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain bounds of median and 95th percentile of every run, with the
    number of its values."""
    keys = ["field", "run_id"]
    out = quantile_bounds(summarise(durations(spark, sf_dir), keys, "value", EPS / 4), keys, {"p50": 0.5, "p95": 0.95}, EPS / 4)
    return out.select(*keys, "n", "p50_lo", "p50_hi", "p95_lo", "p95_hi")
