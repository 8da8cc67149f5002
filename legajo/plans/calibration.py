"""Confidence calibration, distributions and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.plans.quality import ALIGNED, aligned
from legajo.plans.registry import query
from legajo.tables import table

#: Edges of the confidence bins, and the thresholds looked at.
EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0000001)
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99)

#: Characters that were recognised, with whether they are right.
_CHARS = f"SELECT *, kind = 'match' AS match FROM ({ALIGNED}) WHERE prediction <> ''"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned characters that were recognised (deletions have no confidence)."""
    return aligned(spark, sf_dir).where("prediction != '' and confidence is not null").withColumn("match", F.col("kind") == "match")


_BIN_VALUES = ", ".join(f"({i + 1}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))


@query(f"""
SELECT b.bin, count(c.confidence) AS n, CAST(count_if(NOT c.match) AS BIGINT) AS errors, round(count_if(NOT c.match) / nullif(count(c.confidence), 0), 6) AS error_rate
FROM (VALUES {_BIN_VALUES}) b(bin, lo, hi) LEFT JOIN ({_CHARS}) c ON c.confidence >= b.lo AND c.confidence < b.hi GROUP BY b.bin
""")
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per confidence bin; empty bins appear with a null rate.  The bin
    is computed, so the characters need no range join."""
    c = F.col("confidence")
    number = F.lit(None).cast("int")
    for i in reversed(range(len(EDGES) - 1)):
        number = F.when((c >= EDGES[i]) & (c < EDGES[i + 1]), i + 1).otherwise(number)
    have = scored(spark, sf_dir).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.count_if(~F.col("match")).alias("errors"))
    return spark.range(1, len(EDGES)).select(F.col("id").cast("int").alias("bin")).join(have, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"), F.round(F.try_divide("errors", "n"), 6).alias("error_rate"))


_T_VALUES = ", ".join(f"(CAST({t} AS DOUBLE))" for t in THRESHOLDS)


@query(f"""
SELECT t AS threshold, CAST(count_if(flag AND error) AS BIGINT) AS tp, CAST(count_if(flag AND NOT error) AS BIGINT) AS fp, CAST(count_if(NOT flag AND error) AS BIGINT) AS fn, CAST(count_if(NOT flag AND NOT error) AS BIGINT) AS tn,
  round(count_if(flag AND error) / nullif(count_if(flag), 0), 6) AS precision_, round(count_if(flag AND error) / nullif(count_if(error), 0), 6) AS recall,
  round(coalesce(count_if(NOT flag) / nullif(count(*), 0), 0), 6) AS coverage, round(coalesce(count_if(NOT flag AND error) / nullif(count_if(NOT flag), 0), 0), 6) AS false_trusted
FROM (SELECT t, confidence < t AS flag, NOT match AS error FROM ({_CHARS}), (VALUES {_T_VALUES}) v(t)) GROUP BY t
""")
def threshold_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each threshold would flag.  One pass: conditional counts per
    threshold side by side, then unpivoted; rows aren't multiplied."""
    c, error = F.col("confidence"), ~F.col("match")
    counts = scored(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(error).alias("e"),
        *[F.count_if(c < t).alias(f"f{i}") for i, t in enumerate(THRESHOLDS)], *[F.count_if((c < t) & error).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)],
    )
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"f{i}").alias("flagged"), F.col(f"t{i}").alias("tp")) for i, t in enumerate(THRESHOLDS)]))
    r = counts.select("n", "e", each.alias("x")).select("n", "e", "x.*").selectExpr("threshold", "tp", "flagged - tp AS fp", "e - tp AS fn", "n - e - flagged + tp AS tn", "flagged", "n", "e")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return r.select(
        "threshold", "tp", "fp", "fn", "tn", F.round(F.try_divide("tp", "flagged"), 6).alias("precision_"), F.round(F.try_divide("tp", "e"), 6).alias("recall"),
        F.round(zero(F.try_divide(F.col("n") - F.col("flagged"), F.col("n"))), 6).alias("coverage"), F.round(zero(F.try_divide(F.col("fn"), F.col("n") - F.col("flagged"))), 6).alias("false_trusted"),
    )


@query(f"SELECT category, round(avg(pow(confidence - CASE WHEN match THEN 1 ELSE 0 END, 2)), 6) AS brier FROM ({_CHARS}) GROUP BY category")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("category").agg(F.round(F.avg(F.pow(F.col("confidence") - F.col("match").cast("int"), 2)), 6).alias("brier"))


@query(f"""
SELECT recognition_id, CAST(grouping(recognition_id) AS INTEGER) AS grouping_id, CAST(count_if(prediction <> '') AS BIGINT) AS scored, CAST(count_if(kind = 'match') AS BIGINT) AS correct, CAST(count_if(kind IN ('substitution', 'insertion')) AS BIGINT) AS errors, CAST(count_if(kind = 'deletion') AS BIGINT) AS deletions,
  round(count_if(kind = 'match') / nullif(count_if(prediction <> ''), 0), 6) AS accuracy FROM ({ALIGNED}) GROUP BY ROLLUP (recognition_id)
""")
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised, right, wrong and missing characters per document and, where
    ``grouping_id`` is 1, overall."""
    kind, recognised = F.col("kind"), F.count_if(F.col("prediction") != "")
    counts = aligned(spark, sf_dir).rollup("recognition_id").agg(F.grouping("recognition_id").cast("int").alias("grouping_id"), recognised.alias("scored"), F.count_if(kind == "match").alias("correct"), F.count_if(kind.isin("substitution", "insertion")).alias("errors"), F.count_if(kind == "deletion").alias("deletions"))
    return counts.withColumn("accuracy", F.round(F.try_divide("correct", F.nullif("scored", F.lit(0))), 6))


@query(f"""
SELECT CAST(count_if(confidence < 0.7) AS BIGINT) AS flagged, round(count_if(confidence < 0.7 AND NOT match) / count_if(confidence < 0.7), 6) AS precision_, round(count_if(confidence < 0.7 AND NOT match) / nullif(count_if(NOT match), 0), 6) AS error_recall,
  round(count_if(confidence >= 0.7 AND NOT match) / count_if(confidence >= 0.7), 6) AS review_error_rate FROM ({_CHARS})
""")
def policy_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, error = F.col("confidence") < 0.7, ~F.col("match")
    return scored(spark, sf_dir).agg(
        F.count_if(low).alias("flagged"), F.round(F.try_divide(F.count_if(low & error), F.count_if(low)), 6).alias("precision_"),
        F.round(F.try_divide(F.count_if(low & error), F.count_if(error)), 6).alias("error_recall"), F.round(F.try_divide(F.count_if(~low & error), F.count_if(~low)), 6).alias("review_error_rate"),
    )


_GOOD = "ocr_duration_ms >= 0 AND NOT isnan(ocr_duration_ms)"


@query("""
SELECT strategy, count(confidence) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS least, round(quantile_cont(confidence, 0.1), 6) AS p10, round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.5), 6) AS median,
  round(quantile_cont(confidence, 0.75), 6) AS p75, round(quantile_cont(confidence, 0.9), 6) AS p90, max(confidence) AS most FROM matrix_rows WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY strategy
""")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearly interpolated quantiles; confidences have few distinct values, so
    the exact percentile aggregates counts, not rows."""
    p = F.percentile("confidence", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    own = table(spark, sf_dir, "matrix_rows").where("confidence is not null and not isnan(confidence)").groupBy("strategy").agg(F.count("confidence").alias("n"), F.avg("confidence").alias("m"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), p.alias("p"))
    return own.select("strategy", "n", F.round("m", 6).alias("mean"), "least", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p10", "p25", "median", "p75", "p90"))], "most")


def _ranked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy, x, c, band: how often each duration occurs, and its band."""
    good = table(spark, sf_dir, "matrix_rows").where(_GOOD).select("strategy", F.col("ocr_duration_ms").alias("x"))
    return good.groupBy("strategy", "x").agg(F.count("*").alias("c")).withColumn("band", F.floor(F.log2(F.col("x") + 1) * 16).cast("int"))


@query(f"""
SELECT strategy, list_sort(list(ocr_duration_ms))[least(count(*), CAST(floor(0.5 * count(*)) AS BIGINT) + 1)] AS p50, list_sort(list(ocr_duration_ms))[least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)] AS p95
FROM matrix_rows WHERE {_GOOD} GROUP BY strategy
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sorted[min(n - 1, floor(p * n))]``, another definition than the
    interpolated one.  Logarithmic bands locate the rank; only the band that
    holds it is ranked, so no task sees a whole group."""
    counts = _ranked_values(spark, sf_dir)
    bands = counts.groupBy("strategy", "band").agg(F.sum("c").alias("in_band"))
    by = Window.partitionBy("strategy").orderBy("band")
    whole = Window.partitionBy("strategy")
    placed = bands.select("strategy", "band", (F.sum("in_band").over(by) - F.col("in_band")).alias("before"), "in_band", F.sum("in_band").over(whole).alias("n"))
    wanted = placed.select("*", F.explode(F.array(F.struct(F.lit("p50").alias("p"), F.lit(0.5).alias("q")), F.struct(F.lit("p95").alias("p"), F.lit(0.95).alias("q")))).alias("w"))
    wanted = wanted.withColumn("rank", F.least(F.col("n"), F.floor(F.col("w.q") * F.col("n")) + 1)).where("rank > before and rank <= before + in_band")
    near = counts.join(wanted.select("strategy", "band", "before", "rank", F.col("w.p").alias("p")), ["strategy", "band"])  # two rows per strategy
    run = F.sum("c").over(Window.partitionBy("strategy", "band", "p").orderBy("x")) + F.col("before")
    hit = near.withColumn("upto", run).where("upto >= rank").groupBy("strategy", "p").agg(F.min("x").alias("x"))
    return hit.groupBy("strategy").agg(F.max(F.when(F.col("p") == "p50", F.col("x"))).alias("p50"), F.max(F.when(F.col("p") == "p95", F.col("x"))).alias("p95"))


@query("SELECT document_key, list_sort(list(confidence))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM quality_inputs WHERE confidence IS NOT NULL GROUP BY document_key")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sorted[floor(n / 2)]``: the third definition; confidences have two
    decimals, so a group's counts are bounded."""
    counts = table(spark, sf_dir, "quality_inputs").where("confidence is not null").groupBy("document_key", "confidence").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("document_key").orderBy("confidence"))
    n = F.sum("c").over(Window.partitionBy("document_key"))
    return counts.select("document_key", "confidence", upto.alias("upto"), n.alias("n")).where("upto >= floor(n / 2) + 1").groupBy("document_key").agg(F.min("confidence").alias("upper_median"))


@query("SELECT category, round(median(line_count), 6) AS median_lines FROM recognitions GROUP BY category")
def median_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "recognitions").groupBy("category").agg(F.round(F.median("line_count"), 6).alias("median_lines"))


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY generated_at, summary_id) AS cycle FROM pipeline_summaries WHERE total_duration_ms IS NOT NULL AND NOT isnan(total_duration_ms) AND total_duration_ms >= 0)
SELECT run_id, count(*) AS cycles, round(max(total_duration_ms) FILTER (WHERE cycle = 1), 6) AS cold, round(avg(total_duration_ms) FILTER (WHERE cycle > 1), 4) AS warm_mean, max(total_duration_ms) AS longest,
  round((max(total_duration_ms) FILTER (WHERE cycle = 1) - avg(total_duration_ms) FILTER (WHERE cycle > 1)) / nullif(max(total_duration_ms) FILTER (WHERE cycle = 1), 0), 4) AS improvement FROM c GROUP BY run_id
""")
def warm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration of a run without its first cycle, beside that cycle's.  The
    first is a minimum of structs and leaves the sum, so no rows are ordered."""
    good = table(spark, sf_dir, "pipeline_summaries").where("total_duration_ms >= 0 and not isnan(total_duration_ms)")
    own = good.groupBy("run_id").agg(F.count("*").alias("cycles"), F.sum("total_duration_ms").alias("s"), F.max("total_duration_ms").alias("longest"), F.min(F.struct("generated_at", "summary_id", "total_duration_ms"))["total_duration_ms"].alias("cold"))
    warm = F.try_divide(F.col("s") - F.col("cold"), F.nullif(F.col("cycles") - 1, F.lit(0)))
    return own.select("run_id", "cycles", F.round("cold", 6).alias("cold"), F.round(warm, 4).alias("warm_mean"), "longest", F.round(F.try_divide(F.col("cold") - warm, F.nullif(F.col("cold"), F.lit(0.0))), 4).alias("improvement"))


@query("""
SELECT run_id, round(sum(recognition_duration_ms), 3) AS recognition_ms, max(model_load_duration_ms) AS load_ms, CAST(sum(character_count) AS BIGINT) AS characters, round(1000 * sum(character_count) / nullif(sum(recognition_duration_ms), 0), 2) AS per_second
FROM (SELECT category AS run_id, * FROM recognitions WHERE strategy = 'runtime' AND recognition_duration_ms >= 0 AND NOT isnan(recognition_duration_ms)) GROUP BY run_id
""")
def telemetry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of most measures, the maximum of the load time, and the rate."""
    rows = table(spark, sf_dir, "recognitions").where("strategy = 'runtime' and recognition_duration_ms >= 0 and not isnan(recognition_duration_ms)")
    ms = F.sum("recognition_duration_ms")
    return rows.groupBy(F.col("category").alias("run_id")).agg(F.round(ms, 3).alias("recognition_ms"), F.max("model_load_duration_ms").alias("load_ms"), F.sum("character_count").alias("characters"), F.round(1000 * F.sum("character_count") / F.nullif(ms, F.lit(0.0)), 2).alias("per_second"))


@query("""
WITH m AS (SELECT run_id, avg(mean_duration_ms) FILTER (WHERE mode = 'A') AS a, avg(mean_duration_ms) FILTER (WHERE mode = 'B') AS b, bool_and(text_integrity_percent >= 90) AS intact FROM pipeline_summaries WHERE mean_duration_ms > 0 AND NOT isnan(mean_duration_ms) GROUP BY run_id)
SELECT run_id, round(a / b, 6) AS speed_up, round((a - b) / a, 6) AS improvement, intact FROM m WHERE a IS NOT NULL AND b IS NOT NULL
""")
def speed_up_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed-up of one mode over another per run, and whether every row passes."""
    good = table(spark, sf_dir, "pipeline_summaries").where("mean_duration_ms > 0 and not isnan(mean_duration_ms)")
    mean = lambda m: F.avg(F.when(F.col("mode") == m, F.col("mean_duration_ms")))
    own = good.groupBy("run_id").agg(mean("A").alias("a"), mean("B").alias("b"), F.bool_and(F.col("text_integrity_percent") >= 90).alias("intact"))
    return own.where("a is not null and b is not null").select("run_id", F.round(F.col("a") / F.col("b"), 6).alias("speed_up"), F.round((F.col("a") - F.col("b")) / F.col("a"), 6).alias("improvement"), "intact")


@query("SELECT category, CAST(count_if(metrics.character_distance = 0) AS BIGINT) AS exact, CAST(count_if(metrics.character_distance > 0 AND metrics.cer < 0.05) AS BIGINT) AS close, CAST(count_if(metrics.cer >= 0.05) AS BIGINT) AS far FROM case_results GROUP BY category")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metrics")
    return table(spark, sf_dir, "case_results").groupBy("category").agg(F.count_if(m["character_distance"] == 0).alias("exact"), F.count_if((m["character_distance"] > 0) & (m["cer"] < 0.05)).alias("close"), F.count_if(m["cer"] >= 0.05).alias("far"))


@query("SELECT strategy, count(DISTINCT category) AS categories, count(DISTINCT writer_id) AS writers FROM matrix_rows GROUP BY strategy")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matrix_rows").groupBy("strategy").agg(F.count_distinct("category").alias("categories"), F.count_distinct("writer_id").alias("writers"))
