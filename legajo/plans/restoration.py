"""Restoration, synthesis and alignment of recognised texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.text import SPACE, code_points, html_escape, strip, xml_escape
from legajo.operators import restoration as op
from legajo.operators.normalise import normalise
from legajo.plans import fields as field_plans
from legajo.plans.layout import noise_sql
from legajo.plans.registry import query
from legajo.tables import spread, table

_LINES = """
SELECT result_id AS doc, CAST(unnest(generate_series(1, len(regexp_split_to_array(obtained, '\\r?\\n')))) AS INTEGER) AS line_no, unnest(regexp_split_to_array(obtained, '\\r?\\n')) AS line FROM case_results WHERE obtained IS NOT NULL
UNION ALL SELECT -recognition_id, CAST(unnest(generate_series(1, len(regexp_split_to_array(structured_fields.raw_text, '\\r?\\n')))) AS INTEGER), unnest(regexp_split_to_array(structured_fields.raw_text, '\\r?\\n')) FROM recognitions WHERE structured_fields.raw_text IS NOT NULL
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of obtained texts and, under negative numbers, of raw texts."""
    case = table(spark, sf_dir, "case_results").select(F.col("result_id").alias("doc"), F.col("obtained").alias("t"))
    raw = table(spark, sf_dir, "recognitions").select((-F.col("recognition_id")).alias("doc"), F.col("structured_fields.raw_text").alias("t"))
    return spread(case.unionByName(raw).where("t is not null")).select("doc", F.posexplode(F.split("t", "\r?\n")).alias("p", "line")).select("doc", (F.col("p") + 1).alias("line_no"), "line")


_B = "(^|[^A-Za-z0-9_])"
_ACCENTS = "x"
for _v, _a in zip("aeiouAEIOU", ["án", "én", "ín", "ón", "ún", "ÁN", "ÉN", "ÍN", "ÓN", "ÚN"]):
    _ACCENTS = f"regexp_replace({_ACCENTS}, '{_v}ń([.,;:!?)]*(?:\\s|$))', '{_a}\\1', 'g')"
_DATE_P = "(?is)^(.*?(?:^|[^A-Za-z0-9_])Fecha\\s*:\\s*)([0-9SOolI]{1,2}[/-][0-9SOolI]{1,2}[/-][0-9SOolI]{2,4})((?:[^A-Za-z0-9_].*)?)$"
_AMOUNT_P = "(?is)^(.*?(?:^|[^A-Za-z0-9_])Monto(?:\\s*:)?\\s*Bs\\.?\\s*)([0-9SOolI][0-9SOolI.,\\s]*[0-9SOolI])((?:[^A-Za-z0-9_].*)?)$"
_FIXED = "translate(regexp_extract({s}, '{p}', 2), 'SsOoIl', '550011')"


def _staged(i: int, expression: str, source: str) -> str:
    return f"SELECT *, {expression.replace('{s}', f's{i - 1}')} AS s{i} FROM ({source})"


_S = f"SELECT *, s0 <> '' AND {noise_sql('s0')} AS noise FROM (SELECT doc, line_no, coalesce(regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '') AS s0 FROM ({_LINES}))"
_S = _staged(1, _ACCENTS.replace("x,", "translate({s}, 'ıоОаеср', 'ioOaecp'),", 1), _S)
_S = _staged(2, "CASE WHEN regexp_matches({s}, '(?i)^\\d+\\s+(Atentamente,?\\s*)$') THEN regexp_replace({s}, '^\\d+\\s+', '') ELSE {s} END", _S)
_S = _staged(3, f"regexp_replace({{s}}, '(?i){_B}Nit:', '\\1NIT:', 'g')", _S)
_S = _staged(4, f"regexp_replace({{s}}, '(?i){_B}C[oó]di[o0]?:', '\\1Código:', 'g')", _S)
_S = _staged(5, f"CASE WHEN regexp_matches({{s}}, '(?i){_B}CI\\.\\s+N\\.e([^A-Za-z0-9_]|$)') THEN regexp_replace({{s}}, '(?i){_B}CI\\.\\s+N\\.e([^A-Za-z0-9_]|$)', '\\1C.I. N°\\2', 'g') ELSE regexp_replace({{s}}, '(?i){_B}N\\.e(\\s+\\d)', '\\1N°\\2', 'g') END", _S)
_S = _staged(6, f"CASE WHEN regexp_matches({{s}}, '{_DATE_P}') THEN regexp_extract({{s}}, '{_DATE_P}', 1) || {_FIXED.replace('{p}', _DATE_P)} || regexp_extract({{s}}, '{_DATE_P}', 3) ELSE {{s}} END", _S)
_S = _staged(7, f"CASE WHEN regexp_matches({{s}}, '{_AMOUNT_P}') THEN regexp_extract({{s}}, '{_AMOUNT_P}', 1) || regexp_replace({_FIXED.replace('{p}', _AMOUNT_P)}, '\\s+', '', 'g') || regexp_extract({{s}}, '{_AMOUNT_P}', 3) ELSE {{s}} END", _S)
_S = _staged(8, f"regexp_replace(regexp_replace(regexp_replace({{s}}, '{_B}Miercoles([^A-Za-z0-9_]|$)', '\\1Miércoles\\2', 'g'), '(?i){_B}miercoles([^A-Za-z0-9_]|$)', '\\1miércoles\\2', 'g'), '{_B}Ramirez([^A-Za-z0-9_]|$)', '\\1Ramírez\\2', 'g')", _S)


@query(f"SELECT doc, line_no, s8 AS restored, noise FROM ({_S})")
def restore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.restored_lines(lines(spark, sf_dir)).select("doc", "line_no", F.col("s8").alias("restored"), "noise")


_CHANGES = f"WITH s AS ({_S}) SELECT doc, line_no, 'noise' AS step, s0 AS before, '' AS after FROM s WHERE noise " + " ".join(
    f"UNION ALL SELECT doc, line_no, '{n}', s{i}, s{i + 1} FROM s WHERE NOT noise AND s{i} <> s{i + 1}" for i, n in enumerate(op.STEPS)
)


@query(_CHANGES)
def restoration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit: every step that changed a line."""
    return op.changes(lines(spark, sf_dir))


@query(f"SELECT step, count(*) AS changes, count(DISTINCT doc) AS documents FROM ({_CHANGES}) GROUP BY step")
def intervention_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.changes(lines(spark, sf_dir)).groupBy("step").agg(F.count("*").alias("changes"), F.count_distinct("doc").alias("documents"))


@query(f"""
WITH m AS (SELECT doc, line_no, s8, trim(s8) = '' AS blank FROM ({_S}) WHERE NOT noise),
k AS (SELECT *, coalesce(lag(blank) OVER w, true) AS after_blank, bool_or(NOT blank) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS more FROM m WINDOW w AS (PARTITION BY doc ORDER BY line_no))
SELECT doc, line_no, s8 AS line FROM k WHERE NOT blank OR (NOT after_blank AND more)
""")
def blank_line_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op.restored_lines(lines(spark, sf_dir)).where("not noise").select("doc", "line_no", F.col("s8").alias("line"))
    return op.collapse_blanks(kept, "line")


@query("SELECT item_id, replace(replace(replace(replace(replace(line_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM word_context_items")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "word_context_items").select("item_id", html_escape(F.col("line_text")).alias("html"))


def _escaped_sql(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""
SELECT anomaly_id, CASE WHEN length(trim(original_text)) >= 2 THEN regexp_replace({_escaped_sql('line_context')}, '(^|[\\s,.:;()"])' || regexp_escape({_escaped_sql('original_text')}) || '($|[\\s,.:;()"])',
  '\\1<mark title="' || replace({_escaped_sql("coalesce(suggested_alternative, '')")}, '\\', '\\\\') || '">' || replace({_escaped_sql('original_text')}, '\\', '\\\\') || '</mark>\\2', 'g') ELSE {_escaped_sql('line_context')} END AS html
FROM semantic_anomalies WHERE line_context IS NOT NULL AND original_text IS NOT NULL
""")
def annotated_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line, escaped, with its suspicious text marked."""
    rows = table(spark, sf_dir, "semantic_anomalies").where("line_context is not null and original_text is not null")
    mark = F.struct(F.col("original_text").alias("word"), F.col("suggested_alternative").alias("title"))
    return rows.select("anomaly_id", op.annotate(F.col("line_context"), F.when(F.length(F.trim("original_text")) >= 2, F.array(mark)).otherwise(F.array().cast("array<struct<word:string,title:string>>"))).alias("html"))


@query(f"SELECT item_id, replace(replace(replace(replace(replace(line_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM word_context_items")
def xml_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "word_context_items").select("item_id", xml_escape(F.col("line_text")).alias("xml"))


@query("SELECT category, printf('%.2f%%', 100.0 * sum(metrics.character_distance) / nullif(sum(metrics.reference_characters), 0)) AS cer FROM case_results GROUP BY category")
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = 100.0 * F.sum("metrics.character_distance") / F.nullif(F.sum("metrics.reference_characters"), F.lit(0))
    return table(spark, sf_dir, "case_results").groupBy("category").agg(F.format_string("%.2f%%", rate).alias("cer"))


@query("SELECT item_id, CAST(length(text) AS INTEGER) AS code_points, array_to_string(regexp_extract_all(text, '(?s).'), '|') AS spelled FROM word_context_items WHERE text IS NOT NULL")
def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken apart into code points and put together again."""
    items = table(spark, sf_dir, "word_context_items").where("text is not null")
    return items.select("item_id", F.size(code_points(F.col("text"))).alias("code_points"), F.array_join(code_points(F.col("text")), "|").alias("spelled"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query()
def lcs_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced words between obtained and expected texts."""
    return op.word_changes(spread(table(spark, sf_dir, "case_results").select("result_id", "obtained", "expected")), "result_id", "obtained", "expected")


@query()
def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character alignment of each recognised line with its text; the number of
    steps that don't match is the edit distance (a test holds it to that)."""
    pairs = spread(table(spark, sf_dir, "recognitions").where("strategy = 'runtime'").select("recognition_id", "lines")).select("recognition_id", F.explode("lines").alias("l")).select("recognition_id", F.col("l.line_number").alias("line_no"), F.col("l.text").alias("t"), F.col("l.prediction").alias("p"))
    return op.alignment(pairs, ["recognition_id", "line_no"], "t", "p")


@query()
def safe_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, as they stand, with the safe ones of their suggestions applied:
    suggested corrections of what isn't protected; any other line is unchanged."""
    rows = table(spark, sf_dir, "semantic_anomalies").where("line_context is not null and original_text is not null and suggested_alternative is not null")
    one = F.array(F.struct(strip(F.col("original_text")).alias("original"), strip(F.col("suggested_alternative")).alias("suggested")))
    open_to_it = (F.col("status") == "SUGGESTED") & (F.col("decision") == "CORRECTION") & ~F.coalesce("is_protected_field", F.lit(False))
    return rows.select("anomaly_id", F.when(open_to_it, op.apply_suggestions(F.col("line_context"), one)).otherwise(F.col("line_context")).alias("applied"))


_NORMALISED = " UNION ALL ".join(f"SELECT -recognition_id AS doc, input, value FROM ({field_plans._sql_on(k, f'SELECT recognition_id, line_no AS item_no, raw FROM ({field_plans._EXTRACT}) WHERE field_type = {chr(39)}{k}{chr(39)}')}) WHERE status = 'NORMALIZED'" for k in field_plans._SQL)


@query(f"""
WITH c AS (SELECT doc, CAST(count_if(step = 'noise') AS BIGINT) AS noise_removed, CAST(count_if(step <> 'noise') AS BIGINT) AS rule_changes FROM ({_CHANGES}) WHERE doc < 0 GROUP BY doc),
f AS (SELECT doc, count(*) AS field_changes FROM (SELECT DISTINCT doc, input, value FROM ({_NORMALISED})) GROUP BY doc)
SELECT coalesce(c.doc, f.doc) AS doc, coalesce(noise_removed, 0) AS noise_removed, coalesce(rule_changes, 0) AS rule_changes, coalesce(field_changes, 0) AS field_changes FROM c FULL JOIN f ON c.doc = f.doc
""")
def synthesis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions of each structured page by their author: noise removal,
    rules, and distinct field normalisations."""
    page = op.changes(lines(spark, sf_dir).where("doc < 0")).groupBy("doc").agg(F.count_if(F.col("step") == "noise").alias("noise_removed"), F.count_if(F.col("step") != "noise").alias("rule_changes"))
    found = normalise(field_plans.extracted(field_plans.page_lines(spark, sf_dir)), F.col("field_type"), F.col("raw"))
    # the flag is aggregated, so that no filter is pushed into the staged steps
    each = found.groupBy((-F.col("recognition_id")).alias("doc"), "input", "value").agg(F.max(F.col("status") == "NORMALIZED").alias("did"))
    field = each.groupBy("doc").agg(F.count_if("did").alias("field_changes")).where("field_changes > 0")
    both = page.join(field, "doc", "full")
    return both.select("doc", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("noise_removed", "rule_changes", "field_changes")])


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, original, replacement, did of every field read from a structured page."""
    found = normalise(field_plans.extracted(field_plans.page_lines(spark, sf_dir)), F.col("field_type"), F.col("raw"))
    # the flag is aggregated, so that no filter is pushed into the staged steps
    return found.groupBy((-F.col("recognition_id")).alias("doc"), F.col("input").alias("original"), F.col("value").alias("replacement")).agg(F.max(F.col("status") == "NORMALIZED").alias("did")).where("did")


@query(f"""
WITH t AS (SELECT doc, coalesce(regexp_replace(string_agg(s8, chr(10) ORDER BY line_no) FILTER (WHERE NOT noise AND NOT {noise_sql('s8')}), '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '') AS final_text FROM ({_S}) WHERE doc < 0 GROUP BY doc),
p AS (SELECT doc, input AS original, value AS replacement, 'field' AS kind FROM ({_NORMALISED}) UNION ALL SELECT doc, before, after, CASE WHEN step = 'noise' THEN 'noise' ELSE 'rule' END FROM ({_CHANGES}) WHERE doc < 0),
c AS (SELECT doc, count_if(kind = 'field') AS f, count_if(kind = 'rule') AS r, count_if(kind = 'noise') AS n FROM (SELECT doc, original, replacement, min(kind) AS kind FROM p GROUP BY ALL) GROUP BY doc)
SELECT t.doc, final_text, CAST(coalesce(f, 0) AS BIGINT) AS field_changes, CAST(coalesce(r, 0) AS BIGINT) AS rule_changes, CAST(coalesce(n, 0) AS BIGINT) AS noise_removed, CAST(0 AS BIGINT) AS shields, CAST(0 AS BIGINT) AS applied FROM t LEFT JOIN c USING (doc)
""")
def synthesised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final text of each structured page in conventional mode, and what was done to it."""
    return op.synthesise(lines(spark, sf_dir).where("doc < 0"), _normalised(spark, sf_dir).drop("did"))


@query()
def synthesised_assisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the stored suggestions: shields of protected data, and safe
    corrections applied in order to the text as it then is (SQL has no such fold)."""
    stored = table(spark, sf_dir, "semantic_anomalies").where("recognition_id is not null")
    suggestions = stored.select((-F.col("recognition_id")).alias("doc"), F.col("anomaly_id").alias("ref"), F.col("original_text").alias("original"), F.col("suggested_alternative").alias("suggested"), F.col("line_context").alias("context"), "status", "decision", F.col("is_protected_field").alias("protected"), F.col("rejection_reason").alias("rejection"))
    return op.synthesise(lines(spark, sf_dir).where("doc < 0"), _normalised(spark, sf_dir).drop("did"), suggestions)
