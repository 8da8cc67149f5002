"""Queries of the training-data operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from legajo.llm import copies, durations, mixture, page_repair, personal, same_look, subjects, text_kind, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": durations.p1_found,
    "p1_daily_percentiles": durations.p1_daily_percentiles,
    "p1_run_bounds": durations.p1_run_bounds,
    "p2_found": page_repair.p2_found,
    "p2_paragraphs": page_repair.p2_paragraphs,
    "p3_found": copies.p3_found,
    "p3_collapsed": copies.p3_collapsed,
    "p4_found": same_look.p4_found,
    "p4_equal_pairs": same_look.p4_equal_pairs,
    "p5_found": text_kind.p5_found,
    "p5_statistics": text_kind.p5_statistics,
    "p6_found": personal.p6_found,
    "p6_redacted": personal.p6_redacted,
    "p6_confirmed": personal.p6_confirmed,
    "p7_ids": tokens.p7_ids,
    "p8_mix": mixture.p8_mix,
    "p8_shares": mixture.p8_shares,
    "p9_found": subjects.p9_found,
    "p9_composition": subjects.p9_composition,
}

_RUNS_OVER = """
SELECT '{field}' AS field, run_id FROM {table}
WHERE {field} >= 0 AND NOT isnan({field}) AND run_id IS NOT NULL
GROUP BY run_id HAVING quantile_cont({field}, 0.95) > 4 * quantile_cont({field}, 0.5)
"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": copies.FOUND_SQL,
    "p3_collapsed": copies.COLLAPSED_SQL,
    "p5_statistics": text_kind.STATISTICS_SQL,
    "p1_found": " UNION ALL ".join(
        _RUNS_OVER.format(table=t, field=f)
        for t, f in (("case_results", "duration_ms"), ("matrix_rows", "ocr_duration_ms"), ("pipeline_summaries", "p95_ms"))
    ),
}
