"""Whole processes over frames of documents: what a service would answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions.quality import page_quality
from legajo.functions.text import SPACE
from legajo.operators import anomalies, restoration
from legajo.operators.normalise import normalise


def _lines(pages: DataFrame) -> DataFrame:
    return pages.where("text is not null").select("doc", F.posexplode(F.split("text", "\r?\n")).alias("p", "line")).select("doc", (F.col("p") + 1).alias("line_no"), "line")


def process_documents(pages: DataFrame, mode: str = "conventional") -> dict[str, DataFrame]:
    """Pages (doc, text, confidence) judged, restored and read for fields.

    ``mode``: ``conventional`` or ``none`` stop there; anything else also lists
    the candidates that a model would be asked about.  Lazy frames: quality,
    restored (one text per document), changes, fields, candidates."""
    from legajo.plans.fields import extracted

    lines = _lines(pages)
    quality = pages.select("doc", page_quality(F.col("text"), F.col("confidence")).alias("q")).select("doc", "q.*")
    kept = restoration.collapse_blanks(restoration.restored_lines(lines).where("not noise").select("doc", "line_no", F.col("s8").alias("line")), "line")
    text = kept.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("restored"))
    found = extracted(lines).drop("line")
    out = {"quality": quality, "restored": text, "changes": restoration.changes(lines), "fields": normalise(found, F.col("field_type"), F.col("raw"))}
    if mode not in ("conventional", "none"):
        first = anomalies.first_occurrences(anomalies.scored_tokens(lines)).where("score >= 45")
        out["candidates"] = anomalies.diversified_top(first, 4)
    return out


def analyze_semantics(pages: DataFrame, suggest: Callable[[str], tuple[str, str]]) -> DataFrame:
    """Candidates of each document with the suggestion a model makes for them,
    validated.  ``suggest`` maps a token to (decision, suggestion); each distinct
    token is asked once."""
    candidates = process_documents(pages, "assisted")["candidates"].select("doc", "token", "line_key")
    asked = candidates.select("token").distinct()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            answers = [suggest(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d for d, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.string())], names=["token", "decision", "suggested"])

    answered = candidates.join(asked.mapInArrow(run, "token string, decision string, suggested string"), "token").join(pages.select("doc", F.col("text").alias("document")), "doc")
    rows = answered.withColumnRenamed("token", "original").withColumn("context", F.regexp_replace("line_key", f"[{SPACE}]+", " ")).withColumn("candidate", F.col("original"))
    return anomalies.validate(rows).select("doc", "original", "suggested", "decision", "char_distance", "status", "rejection")


def review_regions(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes (left, top, width, height) padded and clamped for a second reading;
    those that can't be read again are left out."""
    from legajo.functions.text import round_half_up

    good = boxes.where("left >= 0 and top >= 0 and width >= 1 and height >= 1")
    px, py = F.greatest(F.lit(16), round_half_up(2 * F.col("height"))), F.greatest(F.lit(12), round_half_up(1.5 * F.col("height")))
    out = good.withColumns({"x0": F.greatest(F.lit(0), F.floor(F.col("left") - px)), "y0": F.greatest(F.lit(0), F.floor(F.col("top") - py)), "x1": F.least(F.lit(width), F.ceil(F.col("left") + F.col("width") + px)), "y1": F.least(F.lit(height), F.ceil(F.col("top") + F.col("height") + py))})
    return out.where("(x1 - x0) * (y1 - y0) <= 2000000")
