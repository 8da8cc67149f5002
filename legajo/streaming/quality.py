"""Streaming versions: verdicts per window, deduplication, running documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions.quality import page_quality, rank


def verdict_counts(pages: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Verdicts per window of ``recognized_at``; rows later than ``late`` behind
    the newest are dropped by the watermark, which bounds the state."""
    judged = pages.withWatermark("recognized_at", late).withColumn("status", page_quality(F.col("text"), F.col("confidence"))["status"])
    return judged.groupBy(F.window("recognized_at", window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


def once(rows: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Re-delivered rows only once, as far back as the watermark reaches."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def worst_so_far(pages: DataFrame) -> DataFrame:
    """(document_key, pages, worst) of each document after every batch: state is
    two numbers per document."""
    judged = pages.where("document_key is not null").select("document_key", rank(page_quality(F.col("text"), F.col("confidence"))["status"]).alias("r"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, worst = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            worst = max(worst, int(b.r.max()))
        state.update((n, worst))
        yield pd.DataFrame({"document_key": [key[0]], "pages": [n], "worst": [worst]})

    return judged.groupBy("document_key").applyInPandasWithState(step, "document_key string, pages long, worst int", "n long, worst int", "update", "NoTimeout")
