"""Admission of files and corpora; the bytes are made from document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.operators import imaging
from legajo.plans.quality import _PAGE
from legajo.plans.registry import query
from legajo.sources import files as src
from legajo.tables import table

_HEAD = "CASE doc_id % 5 WHEN 0 THEN '255044462D312E34' WHEN 1 THEN 'FFD8FFE000104A46' WHEN 2 THEN '89504E470D0A1A0A' WHEN 3 THEN '474946383961' ELSE '' END"
_FILES = f"""
SELECT doc_id, head, CASE WHEN head LIKE '255044462D%' THEN 'application/pdf' WHEN head LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN head LIKE '89504E470D0A1A0A%' THEN 'image/png' END AS sniffed,
  CASE kind WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'text/plain' END AS mime, CASE WHEN source = 'camara' THEN 'camera' ELSE 'file' END AS origin
FROM (SELECT *, {_HEAD} AS head FROM documents)
"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content, mime, origin: leading bytes by arithmetic."""
    k = F.col("doc_id") % 5
    head = F.when(k == 0, "255044462D312E34").when(k == 1, "FFD8FFE000104A46").when(k == 2, "89504E470D0A1A0A").when(k == 3, "474946383961").otherwise("")
    mime = F.when(F.col("kind") == "pdf", "application/pdf").when(F.col("kind") == "png", "image/png").when(F.col("kind") == "jpeg", "image/jpeg").otherwise("text/plain")
    origin = src.source_of(F.when(F.col("source") == "camara", "camera"))
    return table(spark, sf_dir, "documents").select("doc_id", F.unhex(head).alias("content"), mime.alias("mime"), origin.alias("origin"))


@query(f"SELECT doc_id, sniffed AS mime, CASE sniffed WHEN 'application/pdf' THEN 'pdf' WHEN 'image/jpeg' THEN 'image' WHEN 'image/png' THEN 'image' END AS kind FROM ({_FILES})")
def file_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = src.sniff(F.col("content"))
    return uploads(spark, sf_dir).select("doc_id", found.alias("mime")).withColumn("kind", src.kind_of(F.col("mime")))


_REASON = "CASE WHEN head = '' THEN 'EMPTY_FILE' WHEN sniffed IS NULL THEN 'UNKNOWN_SIGNATURE' WHEN mime NOT IN ('application/pdf', 'image/jpeg', 'image/png') THEN 'MIME_NOT_ALLOWED' WHEN mime <> sniffed THEN 'MIME_MISMATCH' WHEN origin = 'camera' AND sniffed = 'application/pdf' THEN 'CAMERA_PDF' END"


@query(f"SELECT doc_id, origin, reason, CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS code FROM (SELECT *, {_REASON} AS reason FROM ({_FILES}))")
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = src.rejection(F.col("content"), F.col("mime"), F.col("origin"))
    return uploads(spark, sf_dir).select("doc_id", "origin", reason.alias("reason")).withColumn("code", src.error_code(F.col("reason")))


@query("SELECT doc_id, CASE WHEN source = 'camara' THEN 'camera' ELSE 'file' END AS origin, CASE WHEN lang = 'en' THEN 'handwritten' ELSE 'printed' END AS mode FROM documents")
def resolved_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("lang") == "en", "handwritten").when(F.col("lang") == "pt", "").when(F.col("lang") == "es", "printed")
    return table(spark, sf_dir, "documents").select("doc_id", src.source_of(F.when(F.col("source") == "camara", "camera")).alias("origin"), src.mode_of(asked).alias("mode"))


@query("""
SELECT id, CASE WHEN bool_or(coalesce(trim(expected), '') = '') THEN 'pending' WHEN bool_or(recognised IS NULL) THEN 'invalid' ELSE 'complete' END AS status FROM (
  SELECT c.id, c.expected, r.id AS recognised FROM case_results c LEFT JOIN (SELECT DISTINCT id FROM recognitions) r ON r.id = c.id WHERE c.id IS NOT NULL) GROUP BY id
""")
def corpus_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each case has a text to compare with and a recognition: cases
    are aggregated by id before the join."""
    case = table(spark, sf_dir, "case_results").where("id is not null").groupBy("id").agg(F.bool_or(F.coalesce(F.trim("expected"), F.lit("")) == "").alias("blank"))
    have = table(spark, sf_dir, "recognitions").select("id").where("id is not null").distinct().withColumn("there", F.lit(True))
    return case.join(have, "id", "left").select("id", F.when(F.col("blank"), "pending").when(F.col("there").isNull(), "invalid").otherwise("complete").alias("status"))


@query("""
SELECT doc_id, translate(text, '01oOlIsS', 'oO01I1S5') AS degraded FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
""")
def degraded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic degradation of texts for tests of recognition."""
    return table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", F.translate("text", "01oOlIsS", "oO01I1S5").alias("degraded"))


def _declared_pages(text: str | None) -> str:
    if text is None:
        raise ValueError("no text")
    if not text.strip():
        raise LookupError("blank")
    return str(text.count("\f") + 1)


@query("""
SELECT source, count(*) AS documents, CAST(count_if(text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) = '') AS BIGINT) AS failed FROM documents GROUP BY source
""")
def fault_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python step that fails on some rows: they are counted, the rest go on."""
    out = src.isolated(table(spark, sf_dir, "documents").select("source", "text"), "text", _declared_pages, into="pages")
    return out.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("status") != "OK").alias("failed"))


@query("""
SELECT recognition_id, json_extract_string(j, '$.field') AS field, json_extract_string(j, '$.value') AS value FROM (
  SELECT recognition_id, to_json(struct_pack(field := field_name, value := value)) AS j FROM semantic_fields)
""")
def json_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and parsed again under a schema."""
    text = table(spark, sf_dir, "semantic_fields").select("recognition_id", F.to_json(F.struct(F.col("field_name").alias("field"), "value")).alias("j"))
    return text.select("recognition_id", F.from_json("j", "field string, value string").alias("x")).select("recognition_id", "x.field", "x.value")


@query("SELECT doc, angle, variance FROM (SELECT doc, angle, variance, row_number() OVER (PARTITION BY doc ORDER BY variance DESC, angle) AS n FROM (SELECT doc, angle, round(var_pop(ink), 6) AS variance FROM (SELECT page_id AS doc, CAST(a.a AS INTEGER) AS angle, r.r AS row_no, (page_id * 7 + r.r * (11 + abs(a.a - page_id % 9)) ) % 97 AS ink FROM quality_inputs, generate_series(-10, 10) a(a), generate_series(1, 12) r(r)) GROUP BY ALL)) WHERE n = 1")
def deskew_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle of each page whose row ink varies most (synthetic ink)."""
    page = table(spark, sf_dir, "quality_inputs").select(F.col("page_id").alias("doc"))
    grid = page.select("doc", F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("angle")).select("doc", "angle", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("row_no"))
    ink = grid.withColumn("ink", (F.col("doc") * 7 + F.col("row_no") * (11 + F.abs(F.col("angle") - F.col("doc") % 9))) % 97)
    return imaging.best_angle(ink)


@query(f"SELECT strftime(recognized_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, status, count(*) AS n FROM ({_PAGE}) JOIN (SELECT page_id, recognized_at FROM quality_inputs) USING (page_id) WHERE recognized_at IS NOT NULL GROUP BY ALL")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts per day, counted by a stream that reads the table to its end."""
    import uuid

    from legajo.streaming.quality import verdict_counts
    from legajo.tables import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "quality_inputs").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/quality_inputs.parquet*")
    counts = verdict_counts(source)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n")


_STATUS = """
SELECT id, CASE WHEN bool_or(coalesce(trim(expected), '') = '') THEN 'pending' WHEN bool_or(recognised IS NULL) THEN 'invalid' ELSE 'complete' END AS status FROM (
  SELECT c.id, c.expected, r.id AS recognised FROM case_results c LEFT JOIN (SELECT DISTINCT id FROM recognitions) r ON r.id = c.id WHERE c.id IS NOT NULL) GROUP BY id
"""


@query(f"SELECT CAST(count_if(status = 'complete') AS BIGINT) AS complete, CAST(count_if(status = 'pending') AS BIGINT) AS pending, CAST(count_if(status = 'invalid') AS BIGINT) AS invalid FROM ({_STATUS})")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete, pending and invalid cases of the corpus."""
    return corpus_validation(spark, sf_dir).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "pending", "invalid")])


@query("SELECT CAST(doc_id AS VARCHAR) AS id, page_count > 3 AS more, CAST(n.n AS INTEGER) AS page_number FROM documents, generate_series(1, 3) n(n) WHERE page_count > 0 AND n.n <= page_count")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each file that are read: the first three at most."""
    rows = src.pages_of(table(spark, sf_dir, "documents").select("doc_id", "page_count"), "page_count")
    return rows.select(F.col("doc_id").cast("string").alias("id"), (F.col("page_count") > 3).alias("more"), "page_number")


@query("SELECT CAST(recognition_id AS VARCHAR) AS id, line_count IS NOT NULL AS ok, line_count AS lines FROM recognitions WHERE strategy = 'runtime'")
def worker_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a line-by-line worker written as JSON and read again."""
    rows = table(spark, sf_dir, "recognitions").where("strategy = 'runtime'")
    line = F.to_json(F.struct(F.lit("result").alias("type"), F.col("recognition_id").cast("string").alias("id"), F.col("line_count").isNotNull().alias("ok"), F.struct(F.col("line_count").alias("lines")).alias("result")))
    out = src.responses(rows.select(line.alias("value")), "lines int")
    return out.select("id", "ok", F.col("result.lines").alias("lines"))
