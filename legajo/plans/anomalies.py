"""Suspicious tokens and the suggestions made for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions.quality import anomaly_score, noise_line
from legajo.functions.text import SPACE, strip, token_key
from legajo.operators import anomalies as op
from legajo.plans.layout import noise_sql
from legajo.plans.registry import query
from legajo.tables import spread, table

_LINES = """
SELECT page_id AS doc, CAST(unnest(generate_series(1, len(regexp_split_to_array(text, '\\r?\\n')))) AS INTEGER) AS line_no, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM quality_inputs WHERE text IS NOT NULL
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = spread(table(spark, sf_dir, "quality_inputs").where("text is not null").select("page_id", "text"))
    return page.select(F.col("page_id").alias("doc"), F.posexplode(F.split("text", "\r?\n")).alias("p", "line")).select("doc", (F.col("p") + 1).alias("line_no"), "line")


@query(f"SELECT doc, line_no, {noise_sql('line')} AS noise FROM ({_LINES})")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc", "line_no", noise_line(F.col("line")).alias("noise"))


_CLEAN = "regexp_replace({t}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"


def score_sql(t: str, base: str) -> str:
    """The anomaly score over the SQL expressions of token and base."""
    c = _CLEAN.format(t=t)
    return f"""CASE WHEN length({c}) < 2 THEN -100.0 WHEN regexp_full_match({c}, '[0-9]+') THEN -50.0 ELSE {base}
  + CASE WHEN regexp_matches({c}, '\\p{{L}}') AND regexp_matches({c}, '[0-9]') THEN 40 ELSE 0 END + CASE WHEN regexp_matches({t}, '[~`|\\\\_§©®¢]') THEN 30 ELSE 0 END
  + CASE WHEN regexp_matches({c}, '\\p{{Ll}}\\p{{Lu}}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches({t}, '\\p{{L}}[.,;:]\\p{{L}}') THEN 25 ELSE 0 END
  + CASE WHEN regexp_matches(lower({c}), '[bcdfghjklmnñpqrstvwxyz]{{3,}}') THEN 20 ELSE 0 END + CASE WHEN length({c}) BETWEEN 3 AND 18 THEN 10 WHEN length({c}) > 25 THEN -15 ELSE 0 END END"""


_BASE = "coalesce(greatest(0, 100 - confidence) * 0.8, 35)"


@query(f"SELECT item_id, CAST(round({score_sql('text', _BASE)}, 6) AS DOUBLE) AS score FROM word_context_items WHERE text IS NOT NULL")
def token_anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "word_context_items").where("text is not null")
    return items.select("item_id", F.round(anomaly_score(F.col("text"), F.col("confidence")), 6).alias("score"))


_STRIP = f"regexp_replace({{x}}, '^[{SPACE.replace('{', '{{').replace('}', '}}')}]+|[{SPACE.replace('{', '{{').replace('}', '}}')}]+$', '', 'g')"
_TOKENS = f"""
SELECT doc, line_no, CAST(pos AS INTEGER) AS pos, token, lower(regexp_replace(token, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g')) AS key, CAST({score_sql('token', '35')} AS DOUBLE) AS score, substr(line, 1, 40) AS line_key FROM (
  SELECT doc, line_no, line, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token FROM (
    SELECT doc, line_no, l AS line, list_filter(string_split(trim(regexp_replace(l, '[{SPACE}]+', ' ', 'g')), ' '), lambda v: v <> '') AS t FROM (
      SELECT doc, line_no, {_STRIP.format(x='line')} AS l FROM ({_LINES}) WHERE NOT {noise_sql('line')})))
WHERE length({_CLEAN.format(t='token')}) >= 2
"""
_FIRST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY line_no, pos) AS n FROM ({_TOKENS})) WHERE n = 1"


@query(f"SELECT doc, key, line_no, pos, token, score FROM ({_FIRST})")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_occurrences(op.scored_tokens(lines(spark, sf_dir))).select("doc", "key", "line_no", "pos", "token", "score")


@query(f"""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY doc) AS total, row_number() OVER (PARTITION BY doc, line_key ORDER BY score DESC, line_no, pos) AS in_line FROM ({_FIRST}) WHERE score >= 45),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, line_no, pos) AS place FROM c WHERE total <= 4 OR in_line <= 2)
SELECT doc, key, token, score, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4
""")
def anomaly_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates of each page, spread over its lines."""
    candidates = op.first_occurrences(op.scored_tokens(lines(spark, sf_dir))).where("score >= 45")
    return op.diversified_top(candidates, 4).select("doc", "key", "token", "score", "place")


@query()
def validate_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored suggestion by the first rule that applies, against the whole
    text of its recognition.  Candidates carry the pages' numbers and suggestions
    the recognitions', so they meet by id alone (as in ``omitted_candidates``);
    of the candidates of an id, one of the same word goes first.  (Distances are
    in code points, which SQL here lacks.)"""
    text = table(spark, sf_dir, "recognitions").select("recognition_id", F.col("text").alias("document"))
    items = table(spark, sf_dir, "word_context_items").select("id", F.coalesce("text", F.lit("")).alias("t"))
    same = items.groupBy("id", token_key(F.col("t")).alias("key")).agg(F.min("t").alias("same"))
    other = items.groupBy("id").agg(F.min("t").alias("other"))
    stored = table(spark, sf_dir, "semantic_anomalies").select("anomaly_id", "recognition_id", "id", F.col("original_text").alias("original"), F.col("suggested_alternative").alias("suggested"), F.col("line_context").alias("context"), "decision", token_key(F.coalesce("original_text", F.lit(""))).alias("key"))
    stored = stored.join(text, "recognition_id", "left").join(same, ["id", "key"], "left").join(other, "id", "left").withColumn("candidate", F.coalesce("same", "other"))
    return op.validate(stored).select("anomaly_id", "char_distance", "status", "rejection")


@query(f"""
SELECT field_id, CASE WHEN v <> '' AND e <> '' AND contains(e, v) AND len(list_filter(generate_series(1, len(string_split(e, v)) - 1), lambda i: NOT regexp_matches(string_split(' ' || e || ' ', v)[i], '[\\p{{L}}\\p{{N}}]$') AND NOT regexp_matches(string_split(' ' || e || ' ', v)[i + 1], '^[\\p{{L}}\\p{{N}}]'))) > 0
  THEN 'VERIFIED' ELSE 'HALLUCINATION_REJECTED' END AS status
FROM (SELECT field_id, coalesce({_STRIP.format(x='value')}, '') AS v, coalesce({_STRIP.format(x='exact_ocr_evidence')}, '') AS e FROM semantic_fields)
""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a field's value stands as whole words in its evidence."""
    own = table(spark, sf_dir, "semantic_fields").select("field_id", F.coalesce(strip(F.col("value")), F.lit("")).alias("v"), F.coalesce(strip(F.col("exact_ocr_evidence")), F.lit("")).alias("e"))
    good = F.when((F.col("v") != "") & (F.col("e") != "") & F.contains("e", "v"), op.whole_word_in(F.col("v"), F.col("e")))
    return own.select("field_id", F.when(F.coalesce(good, F.lit(False)), "VERIFIED").otherwise("HALLUCINATION_REJECTED").alias("status"))


@query("SELECT i.item_id, i.text, 'NO_CORRECTION_DETERMINABLE' AS decision FROM word_context_items i ANTI JOIN semantic_anomalies a ON a.id = i.id AND a.original_text = i.text")
def omitted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no decision was returned for."""
    items, decided = table(spark, sf_dir, "word_context_items").alias("i"), table(spark, sf_dir, "semantic_anomalies").select("id", "original_text").distinct().alias("a")
    left = items.join(decided, (F.col("i.id") == F.col("a.id")) & (F.col("i.text") == F.col("a.original_text")), "left_anti")
    return left.select("item_id", "text", F.lit("NO_CORRECTION_DETERMINABLE").alias("decision"))


@query(f"""
SELECT i.item_id, coalesce(i.line_text, (list_filter(regexp_split_to_array(q.text, '\\r?\\n'), lambda l: contains(l, i.text)))[1], i.text) AS context FROM word_context_items i LEFT JOIN quality_inputs q USING (page_id) WHERE i.text IS NOT NULL
""")
def fallback_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's own line, else the first line of its page that holds it, else
    the word.  Only words without a line meet their page."""
    items = table(spark, sf_dir, "word_context_items").where("text is not null").select("item_id", "page_id", "text", "line_text")
    page = table(spark, sf_dir, "quality_inputs").select("page_id", F.col("text").alias("page_text"))
    have = items.where("line_text is not null").select("item_id", F.col("line_text").alias("context"))
    miss = items.where("line_text is null").join(page, "page_id", "left")
    first = F.try_element_at(F.filter(F.split("page_text", "\r?\n"), lambda x: F.contains(x, F.col("text"))), F.lit(1))
    return have.unionByName(miss.select("item_id", F.coalesce(first, F.col("text")).alias("context")))


@query("""
WITH w AS (SELECT w.page_id, item_id, w.text, w.confidence, page_number, CASE WHEN w.page_id % 5 > 0 THEN ((w.page_id * 37) % 401 - 200) / 100.0 END AS angle,
  row_number() OVER (PARTITION BY w.page_id ORDER BY w.confidence, item_id) AS place, count(*) OVER (PARTITION BY w.page_id) AS n FROM word_context_items w LEFT JOIN quality_inputs q ON q.page_id = w.page_id WHERE w.confidence >= 0 AND w.confidence < 50)
SELECT page_id, item_id, text, page_number, abs(coalesce(angle, 0)) < 0.5 AS can_locate, round(100.0 * ((item_id * 13) % 1800) / 2000, 4) AS left_percent, round(100.0 * ((item_id * 29) % 2900) / 3000, 4) AS top_percent, CAST(place AS INTEGER) AS place, greatest(n - 80, 0) AS remaining FROM w WHERE place <= 80
""")
def suspicious_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighty least certain words of each page and how many more there are
    (a display limit), with their page, whether they can be shown on it (its
    image wasn't turned) and where, in percent of its size.  Words are placed
    before they meet their page; boxes and angles are synthetic arithmetic."""
    low = table(spark, sf_dir, "word_context_items").where("confidence >= 0 and confidence < 50")
    own = Window.partitionBy("page_id")
    placed = low.select("page_id", "item_id", "text", F.row_number().over(own.orderBy("confidence", "item_id")).alias("place"), F.count("*").over(own).alias("n")).where("place <= 80")
    page = table(spark, sf_dir, "quality_inputs").select("page_id", "page_number")
    angle = F.when(F.col("page_id") % 5 > 0, ((F.col("page_id") * 37) % 401 - 200) / 100.0)
    percent = lambda by, range_, size: F.round(100.0 * ((F.col("item_id") * by) % range_) / size, 4)
    return placed.join(page, "page_id", "left").select(
        "page_id", "item_id", "text", "page_number", (F.abs(F.coalesce(angle, F.lit(0.0))) < 0.5).alias("can_locate"), percent(13, 1800, 2000).alias("left_percent"), percent(29, 2900, 3000).alias("top_percent"), "place", F.greatest(F.col("n") - 80, F.lit(0)).alias("remaining"),
    )


@query("""
SELECT 'proposal' AS kind, recognition_id AS doc, anomaly_id AS ref, original_text AS original, suggested_alternative AS suggested, status FROM (SELECT *, row_number() OVER (PARTITION BY recognition_id ORDER BY anomaly_id) AS n FROM semantic_anomalies
  WHERE status = 'SUGGESTED' OR is_protected_field OR rejection_reason LIKE 'EDIT_DISTANCE%') WHERE n <= 25
UNION ALL SELECT 'review_only', page_id, item_id, text, NULL, 'REVIEW_ONLY' FROM word_context_items i WHERE confidence >= 0 AND confidence < 50 AND NOT EXISTS (SELECT 1 FROM semantic_anomalies a WHERE a.id = i.id)
""")
def proposal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions to show, the first 25 of each document (a display limit), and
    what else is only to be reviewed: words whose id is not among all the
    candidates, shown or not."""
    stored = table(spark, sf_dir, "semantic_anomalies")
    shown = stored.where("status = 'SUGGESTED' or is_protected_field or rejection_reason like 'EDIT_DISTANCE%'")
    placed = shown.withColumn("n", F.row_number().over(Window.partitionBy("recognition_id").orderBy("anomaly_id"))).where("n <= 25")
    proposals = placed.select(F.lit("proposal").alias("kind"), F.col("recognition_id").alias("doc"), F.col("anomaly_id").alias("ref"), F.col("original_text").alias("original"), F.col("suggested_alternative").alias("suggested"), "status")
    words = table(spark, sf_dir, "word_context_items").where("confidence >= 0 and confidence < 50")
    spare = words.join(stored.where("id is not null").select("id").distinct(), "id", "left_anti")
    return proposals.unionByName(spare.select(F.lit("review_only").alias("kind"), F.col("page_id").alias("doc"), F.col("item_id").alias("ref"), F.col("text").alias("original"), F.lit(None).cast("string").alias("suggested"), F.lit("REVIEW_ONLY").alias("status")))
