"""Page, document and character verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.quality import RANKS, character_action, low_confidence, needs_verification, page_quality, rank
from legajo.functions.text import SPACE, code_points, strip
from legajo.operators.restoration import scored_alignment
from legajo.plans.registry import query
from legajo.tables import spread, table

_BLANK = f"coalesce(trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g')), '') = ''"
_PAGE = f"""
SELECT page_id, document_key, page_number, confidence, text,
  CASE WHEN {_BLANK} THEN 'INSUFFICIENT' WHEN confidence IS NULL THEN 'REVIEW' WHEN confidence < 70 THEN 'INSUFFICIENT' WHEN confidence < 90 THEN 'REVIEW' ELSE 'ACCEPTABLE' END AS status,
  CASE WHEN {_BLANK} THEN 'EMPTY_TEXT' WHEN confidence IS NULL THEN 'CONFIDENCE_UNAVAILABLE' WHEN confidence < 70 THEN 'LOW_CONFIDENCE' WHEN confidence < 90 THEN 'MODERATE_CONFIDENCE' END AS reason
FROM quality_inputs
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "quality_inputs").withColumn("q", page_quality(F.col("text"), F.col("confidence"))).select("*", "q.*").drop("q")


@query(f"SELECT page_id, status, reason, status <> 'ACCEPTABLE' AS requires_review FROM ({_PAGE})")
def page_quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "status", "reason", (F.col("status") != "ACCEPTABLE").alias("requires_review"))


@query(f"""
WITH p AS (SELECT * FROM ({_PAGE}) WHERE document_key IS NOT NULL),
r AS (SELECT document_key, reason, min(struct_pack(n := page_number, i := page_id)) AS first FROM p WHERE reason IS NOT NULL GROUP BY ALL),
s AS (SELECT document_key, string_agg(reason, ',' ORDER BY first) AS reasons FROM r GROUP BY document_key)
SELECT p.document_key, CASE max(CASE status WHEN 'INSUFFICIENT' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) WHEN 2 THEN 'INSUFFICIENT' WHEN 1 THEN 'REVIEW' ELSE 'ACCEPTABLE' END AS status,
  count(*) AS pages, coalesce(any_value(s.reasons), '') AS reasons
FROM p LEFT JOIN s USING (document_key) GROUP BY p.document_key
""")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst page verdict of each document and its distinct reasons in the
    order they first appear.  Two partial aggregations: a hot document never
    gathers its pages in one place."""
    page = pages(spark, sf_dir).where("document_key is not null")
    reason = page.groupBy("document_key", "reason").agg(F.max(rank(F.col("status"))).alias("worst"), F.count("*").alias("n"), F.min(F.struct("page_number", "page_id")).alias("first"))
    whole = reason.groupBy("document_key").agg(F.max("worst").alias("worst"), F.sum("n").alias("pages"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("first", "reason")))).alias("r"))
    status = F.element_at(F.array(*[F.lit(s) for s in RANKS]), F.col("worst") + 1)
    return whole.select("document_key", status.alias("status"), "pages", F.array_join(F.transform("r", lambda x: x["reason"]), ",").alias("reasons"))


@query(f"SELECT strftime(recognized_at AT TIME ZONE 'UTC', '%Y-%m') AS month, CAST(count_if(status = 'ACCEPTABLE') AS BIGINT) AS acceptable, CAST(count_if(status = 'REVIEW') AS BIGINT) AS review, CAST(count_if(status = 'INSUFFICIENT') AS BIGINT) AS insufficient FROM (SELECT * FROM ({_PAGE}) JOIN (SELECT page_id, recognized_at FROM quality_inputs) USING (page_id)) GROUP BY ALL")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts per month, pivoted."""
    month = F.date_format("recognized_at", "yyyy-MM").alias("month")
    return pages(spark, sf_dir).groupBy(month).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in RANKS])


@query("SELECT document_key, round(avg(confidence), 6) AS mean_confidence, count(confidence) AS pages_with_confidence FROM quality_inputs GROUP BY document_key")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over pages that have a confidence; null where none has."""
    return table(spark, sf_dir, "quality_inputs").groupBy("document_key").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count("confidence").alias("pages_with_confidence"))


@query("""
SELECT document_key, block, string_agg(text, chr(10) || chr(10) ORDER BY page_number, page_id) AS text, count(*) AS pages FROM (
  SELECT *, CAST(floor((page_number - 1) / 50) AS BIGINT) AS block FROM quality_inputs WHERE text IS NOT NULL AND document_key IS NOT NULL) GROUP BY document_key, block
""")
def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a document in page order, in blocks of fifty page numbers, so the
    size of a row doesn't grow with that of a document."""
    page = table(spark, sf_dir, "quality_inputs").where("text is not null and document_key is not null")
    block = F.floor((F.col("page_number") - 1) / 50).cast("long").alias("block")
    own = page.groupBy("document_key", block).agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "text"))).alias("p"))
    return own.select("document_key", "block", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.size("p").cast("long").alias("pages"))


_CONFIDENCE = "((recognition_id * 31 + line_no * 17 + {i} * 7) % 101) / 100.0"
_CHARS = f"""
SELECT recognition_id, category, line_no, i AS char_index, {_CONFIDENCE.format(i='i')} AS confidence
FROM (SELECT recognition_id, category, line_no, unnest(generate_series(0, length(p) - 1)) AS i FROM (
  SELECT recognition_id, category, l.line_number AS line_no, l.prediction AS p FROM (SELECT recognition_id, category, unnest(lines) AS l FROM recognitions WHERE strategy = 'runtime'))
  WHERE length(p) > 0)
"""


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognition_id, category, line_no, t (true text), p (prediction), c (the
    prediction's characters with confidences, which are synthetic arithmetic)."""
    lines = spread(table(spark, sf_dir, "recognitions").where("strategy = 'runtime'").select("recognition_id", "category", "lines")).select("recognition_id", "category", F.explode("lines").alias("l"))
    pair = lines.select("recognition_id", "category", F.col("l.line_number").alias("line_no"), F.col("l.text").alias("t"), F.col("l.prediction").alias("p"))
    confidence = lambda i: ((F.col("recognition_id") * 31 + F.col("line_no") * 17 + i * 7) % 101) / 100.0
    return pair.withColumn("c", F.transform(code_points(F.coalesce("p", F.lit(""))), lambda x, i: F.struct(x.alias("ch"), confidence(i).alias("confidence"))))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per predicted character with its confidence."""
    char = _recognised(spark, sf_dir).select("recognition_id", "category", "line_no", F.posexplode("c").alias("char_index", "x"))
    return char.select("recognition_id", "category", "line_no", "char_index", F.col("x.ch").alias("ch"), F.col("x.confidence").alias("confidence"))


_SQUEEZED = f"trim(regexp_replace(nfc_normalize(coalesce(l.text, '')), '[{SPACE}]+', ' ', 'g'))"
#: The alignment in SQL: tokens of each line; for lines that differ the table of
#: distances, row by row, and the way back through it.
ALIGNED = f"""
WITH RECURSIVE l AS (SELECT recognition_id, category, l.line_number AS line_no, {_SQUEEZED} AS t, coalesce(l.prediction, '') AS p FROM (SELECT recognition_id, category, unnest(lines) AS l FROM recognitions WHERE strategy = 'runtime')),
g AS (SELECT recognition_id, line_no, generate_subscripts(c, 1) AS k, unnest(c) AS cluster FROM (SELECT *, regexp_extract_all(p, '[^\\p{{M}}]\\p{{M}}*|\\p{{M}}+') AS c FROM l)),
o AS (SELECT *, CAST(sum(length(cluster)) OVER (PARTITION BY recognition_id, line_no ORDER BY k) - length(cluster) AS BIGINT) AS begins FROM g),
n AS (SELECT recognition_id, line_no, k, generate_subscripts(c, 1) AS k2, unnest(c) AS ch, conf FROM (SELECT *, string_split(nfc_normalize(cluster), '') AS c, list_min(list_transform(range(begins, begins + length(cluster)), lambda i: {_CONFIDENCE.format(i='i')})) AS conf FROM o)),
w AS (SELECT *, regexp_matches(ch, '^[{SPACE}]$') AS ws FROM n),
s AS (SELECT *, sum(CASE WHEN ws AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY recognition_id, line_no ORDER BY k, k2) AS grp FROM (SELECT *, lag(ws) OVER (PARTITION BY recognition_id, line_no ORDER BY k, k2) AS prev FROM w)),
z AS (SELECT recognition_id, line_no, grp, bool_or(ws) AS ws, CASE WHEN bool_or(ws) THEN ' ' ELSE any_value(ch) END AS ch, min(conf) AS conf FROM s GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY recognition_id, line_no ORDER BY grp) AS a, row_number() OVER (PARTITION BY recognition_id, line_no ORDER BY grp DESC) AS b FROM z),
b AS (SELECT recognition_id, line_no, list(ch ORDER BY grp) AS bc, list(conf ORDER BY grp) AS cc, string_agg(ch, '' ORDER BY grp) AS q FROM x WHERE NOT (ws AND (a = 1 OR b = 1)) GROUP BY ALL),
pair AS (SELECT l.recognition_id, l.category, l.line_no, t, coalesce(q, '') AS q, CASE WHEN t = '' THEN [] ELSE string_split(t, '') END AS ac, coalesce(bc, []) AS bc, coalesce(cc, []) AS cc FROM l LEFT JOIN b USING (recognition_id, line_no)),
dp AS (SELECT recognition_id, line_no, ac, bc, 0 AS i, [range(0, len(bc) + 1)] AS m FROM pair WHERE t <> q
  UNION ALL SELECT recognition_id, line_no, ac, bc, i + 1, list_append(m, list_transform(range(1, len(s) + 1), lambda k: list_min(s[1:k]) + k)) FROM (
    SELECT *, list_prepend(m[i + 1][1], list_transform(range(1, len(bc) + 1), lambda j: least(m[i + 1][j + 1] + 1, m[i + 1][j] + CASE WHEN ac[i + 1] = bc[j] THEN 0 ELSE 1 END) - (j + 1))) AS s FROM dp WHERE i < len(ac))),
fin AS (SELECT recognition_id, line_no, ac, bc, m FROM dp WHERE i = len(ac)),
bt AS (SELECT recognition_id, line_no, CAST(len(ac) AS BIGINT) AS i, CAST(len(bc) AS BIGINT) AS j, CAST(NULL AS VARCHAR) AS kind, CAST(0 AS BIGINT) AS ri, CAST(0 AS BIGINT) AS pj FROM fin
  UNION ALL SELECT recognition_id, line_no, i - CASE WHEN k = 'insertion' THEN 0 ELSE 1 END, j - CASE WHEN k = 'deletion' THEN 0 ELSE 1 END, k, CASE WHEN k = 'insertion' THEN 0 ELSE i END, CASE WHEN k = 'deletion' THEN 0 ELSE j END FROM (
    SELECT bt.recognition_id, bt.line_no, i, j, CASE WHEN i > 0 AND j > 0 AND ac[i] = bc[j] AND m[i + 1][j + 1] = m[i][j] THEN 'match' WHEN i > 0 AND j > 0 AND m[i + 1][j + 1] = m[i][j] + 1 THEN 'substitution' WHEN j > 0 AND m[i + 1][j + 1] = m[i + 1][j] + 1 THEN 'insertion' ELSE 'deletion' END AS k
    FROM bt JOIN fin USING (recognition_id, line_no) WHERE i + j > 0))
SELECT recognition_id, category, line_no, 'match' AS kind, unnest(bc) AS reference, unnest(bc) AS prediction, unnest(cc) AS confidence FROM pair WHERE t = q
UNION ALL SELECT recognition_id, category, line_no, kind, CASE WHEN ri > 0 THEN ac[ri] ELSE '' END, CASE WHEN pj > 0 THEN bc[pj] ELSE '' END, CASE WHEN pj > 0 THEN cc[pj] END FROM bt JOIN pair USING (recognition_id, line_no) WHERE kind IS NOT NULL
"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step of the alignment of each recognised line with its text."""
    pair = _recognised(spark, sf_dir).select("recognition_id", "category", "line_no", "t", F.array("c").alias("c"))
    return scored_alignment(pair, ["recognition_id", "category", "line_no"], "t", "c")


@query(f"SELECT recognition_id, category, line_no, kind, reference, prediction, round(confidence, 6) AS confidence FROM ({ALIGNED})")
def aligned_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised characters, composed and with the least confidence of their
    parts, aligned with the text they stand for."""
    return aligned(spark, sf_dir).select("recognition_id", "category", "line_no", "kind", "reference", "prediction", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT recognition_id, count(*) AS characters, CAST(count_if(confidence < 0.7) AS BIGINT) AS fallback, CAST(count_if(confidence >= 0.7) AS BIGINT) AS review FROM ({_CHARS}) GROUP BY recognition_id")
def char_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document by what is to be done with them."""
    action = character_action(F.col("confidence"))
    return characters(spark, sf_dir).groupBy("recognition_id").agg(F.count("*").alias("characters"), F.count_if(action == "FALLBACK").alias("fallback"), F.count_if(action == "REVIEW").alias("review"))


@query(f"SELECT DISTINCT recognition_id, CAST(line_no AS INTEGER) AS line_no FROM ({_CHARS}) WHERE confidence < 0.7")
def fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with at least one character to fall back on."""
    return characters(spark, sf_dir).where(character_action(F.col("confidence")) == "FALLBACK").select("recognition_id", "line_no").distinct()


@query("""
SELECT item_id, text, confidence, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 100 THEN 'invalid' WHEN confidence < 25 THEN 'low' ELSE 'medium' END AS level, TRUE AS requires_review
FROM word_context_items
""")
def review_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display form: a bad confidence is a level of its own, never an error."""
    c = F.col("confidence")
    level = F.when(c.isNull() | F.isnan(c) | (c < 0) | (c > 100), "invalid").when(c < 25, "low").otherwise("medium")
    return table(spark, sf_dir, "word_context_items").select("item_id", "text", "confidence", level.alias("level"), F.lit(True).alias("requires_review"))


@query("SELECT item_id, text, confidence FROM word_context_items WHERE confidence >= 0 AND confidence < 50")
def low_confidence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "word_context_items").where(low_confidence(F.col("confidence"))).select("item_id", "text", "confidence")


@query("""
WITH r AS (SELECT id, category, max(confidence) FILTER (WHERE strategy = 'none') AS original, max(confidence) FILTER (WHERE strategy = 'grayscale') AS processed, max(text) FILTER (WHERE strategy = 'none') AS text FROM matrix_rows WHERE id IS NOT NULL GROUP BY id, category)
SELECT id, category, original, processed, coalesce(trim(text), '') <> '' AND original IS NOT NULL AND (processed IS NULL OR original >= processed + 10) AS prefer_original FROM r
""")
def candidate_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the unprocessed reading wins: it has text, a finite confidence,
    and the processed one has none or is ten points behind."""
    on = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    best = table(spark, sf_dir, "matrix_rows").where("id is not null").groupBy("id", "category").agg(on("none", "confidence").alias("original"), on("grayscale", "confidence").alias("processed"), on("none", "text").alias("t"))
    wins = (F.coalesce(F.trim("t"), F.lit("")) != "") & F.col("original").isNotNull() & (F.col("processed").isNull() | (F.col("original") >= F.col("processed") + 10))
    return best.select("id", "category", "original", "processed", F.coalesce(wins, F.lit(False)).alias("prefer_original"))


@query("""
SELECT row_id, angle, abs(angle) >= 9.5 AND row_id % 7 <> 0 AS needs_verification, abs(angle) >= 0.5 AND category NOT IN ('photo-perspective') AS false_skew
FROM (SELECT row_id, category, ((row_id * 37) % 401 - 200) / 10.0 AS angle FROM matrix_rows) WHERE category IS NOT NULL
""")
def skew_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of images (pages of files are none) extreme enough to be verified,
    and skew where none is expected (angle and kind are synthetic arithmetic)."""
    rows = table(spark, sf_dir, "matrix_rows").where("category is not null").select("row_id", "category", (((F.col("row_id") * 37) % 401 - 200) / 10.0).alias("angle"))
    return rows.select("row_id", "angle", needs_verification(F.col("angle"), F.when(F.col("row_id") % 7 == 0, "pdf").otherwise("image")).alias("needs_verification"), ((F.abs("angle") >= 0.5) & (F.col("category") != "photo-perspective")).alias("false_skew"))


@query("""
WITH g AS (SELECT recognition_id, line_no, count(*) AS n, max(i) AS last, string_agg(ch, '' ORDER BY i) AS joined FROM (
  SELECT recognition_id, l.line_number AS line_no, unnest(generate_series(0, length(l.prediction) - 1)) AS i, l.prediction AS p, substr(l.prediction, CAST(unnest(generate_series(0, length(l.prediction) - 1)) + 1 AS BIGINT), 1) AS ch
  FROM (SELECT recognition_id, unnest(lines) AS l FROM recognitions WHERE strategy = 'runtime') WHERE length(l.prediction) > 0) GROUP BY ALL)
SELECT r.recognition_id, CAST(count(g.line_no) AS BIGINT) AS lines, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS characters, CAST(count_if(g.last + 1 <> g.n) AS BIGINT) AS broken, any_value(r.line_count) AS declared_lines
FROM recognitions r LEFT JOIN g USING (recognition_id) WHERE r.strategy = 'runtime' GROUP BY r.recognition_id
""")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines and characters really there, lines whose character
    numbers aren't contiguous, and the number of lines declared.  Checked within
    the row's own array, without exploding it."""
    runtime = table(spark, sf_dir, "recognitions").where("strategy = 'runtime'")
    held = F.filter(F.coalesce("lines", F.array()), lambda x: F.length(x["prediction"]) > 0)
    size = F.aggregate(held, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["prediction"]))
    broken = F.size(F.filter(held, lambda x: F.length(F.array_join(F.split(x["prediction"], ""), "")) != F.length(x["prediction"])))
    return runtime.select("recognition_id", F.size(held).cast("long").alias("lines"), size.alias("characters"), broken.cast("long").alias("broken"), F.col("line_count").alias("declared_lines"))


@query(f"""
SELECT recognition_id, line_count IS DISTINCT FROM coalesce(len(lines), 0) AS lines_differ, character_count IS DISTINCT FROM coalesce(list_sum(list_transform(lines, lambda x: coalesce(length(x.text), 0))), 0) AS characters_differ,
  text IS DISTINCT FROM regexp_replace(array_to_string(list_transform(coalesce(lines, []), lambda x: coalesce(x.text, '')), chr(10)), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text_differs
FROM recognitions WHERE strategy = 'runtime'
""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its declared number of lines, number of characters
    or text differs from what its lines hold (``contract_checks`` passes the
    declared number on and its ``broken`` is always zero)."""
    runtime = table(spark, sf_dir, "recognitions").where("strategy = 'runtime'")
    held = F.coalesce(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit(""))), F.array().cast("array<string>"))
    size = F.aggregate(held, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    differs = lambda declared, real: ~F.col(declared).eqNullSafe(real)
    return runtime.select("recognition_id", differs("line_count", F.size(held)).alias("lines_differ"), differs("character_count", size).alias("characters_differ"), differs("text", strip(F.array_join(held, "\n"))).alias("text_differs"))


@query("""
SELECT item_id, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 100 THEN 'N/D' ELSE printf('%.1f%%', round(confidence, 1)) END AS shown, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 100 THEN 'inválida' WHEN confidence < 25 THEN 'baja' ELSE 'media' END AS label,
  coalesce(nullif(trim(line_text), ''), '—') AS context FROM word_context_items
""")
def review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees of each word."""
    c = F.col("confidence")
    bad = c.isNull() | F.isnan(c) | (c < 0) | (c > 100)
    shown = F.when(bad, "N/D").otherwise(F.format_string("%.1f%%", F.round(c, 1)))
    return table(spark, sf_dir, "word_context_items").select("item_id", shown.alias("shown"), F.when(bad, "inválida").when(c < 25, "baja").otherwise("media").alias("label"), F.coalesce(F.nullif(F.trim("line_text"), F.lit("")), F.lit("—")).alias("context"))


@query("""
SELECT recognition_id, detection_duration_ms IS NOT NULL AND NOT isnan(detection_duration_ms) AND NOT isinf(detection_duration_ms) AND detection_duration_ms >= 0 AND coalesce(line_count, -1) >= 0 AS detected,
  coalesce(line_count = coalesce(len(lines), 0), false) AS as_many_recognised FROM recognitions WHERE strategy = 'runtime'
""")
def detector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a detector's answer can be used (a finite duration and a number of
    lines, neither negative), and whether as many lines were recognised."""
    d = F.col("detection_duration_ms")
    usable = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")) & (d >= 0) & (F.coalesce("line_count", F.lit(-1)) >= 0)
    return table(spark, sf_dir, "recognitions").where("strategy = 'runtime'").select("recognition_id", usable.alias("detected"), F.coalesce(F.col("line_count") == F.size(F.coalesce("lines", F.array())), F.lit(False)).alias("as_many_recognised"))
