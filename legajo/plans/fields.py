"""Labelled fields: normalisation, extraction and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions import fields as fx
from legajo.functions.text import SPACE
from legajo.operators.normalise import normalise
from legajo.plans.registry import query
from legajo.tables import table

_KINDS = {"NIT": "NIT", "CODIGO": "TV_CORRELATIVO", "FECHA": "DATE", "MONTO": "AMOUNT"}

_W = SPACE
_CUT = f"regexp_replace(raw, '^[{_W}]+|[{_W}]+$', '', 'g')"
_RAW = """
SELECT recognition_id, CAST(n AS INTEGER) AS item_no, f.field_type AS kind, f.raw AS raw
FROM (SELECT recognition_id, unnest(structured_fields.fields) AS f, unnest(generate_series(1, len(structured_fields.fields))) AS n FROM recognitions WHERE structured_fields IS NOT NULL)
"""
_DIGITS = "translate({x}, 'OoIilLSsBZz', '00111155822')"
_NIT = f"""
SELECT recognition_id, item_no, input, value, CASE WHEN value IS NULL THEN 'INVALID' WHEN value = input THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS status,
  CASE WHEN value IS NULL THEN 'INVALID_FORMAT' WHEN value = input THEN 'NO_CHANGE' ELSE 'NUMERIC_CONTEXT' END AS reason
FROM (SELECT recognition_id, item_no, input, CASE WHEN regexp_full_match({_DIGITS.format(x='input')}, '[0-9]{{1,20}}') THEN {_DIGITS.format(x='input')} END AS value
  FROM (SELECT *, coalesce({_CUT}, '') AS input FROM ({_RAW})))
"""
_TV = f"""
SELECT recognition_id, item_no, input, value, CASE WHEN value IS NULL THEN 'INVALID' WHEN value = input THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS status,
  CASE WHEN value IS NULL THEN 'INVALID_FORMAT' WHEN value = input THEN 'NO_CHANGE' WHEN value <> compact THEN 'NUMERIC_CONTEXT' ELSE 'FORMAT_NORMALIZATION' END AS reason
FROM (SELECT *, CASE WHEN regexp_full_match(compact, 'TV-([A-Z0-9]+)-([A-Z0-9]{{4}})') AND regexp_full_match('TV-' || {_DIGITS.format(x='substr(compact, 4)')}, 'TV-[0-9]{{3,}}-[0-9]{{4}}')
    THEN 'TV-' || {_DIGITS.format(x='substr(compact, 4)')} END AS value
  FROM (SELECT *, regexp_replace(input, '[{_W}]*-[{_W}]*', '-', 'g') AS compact FROM (SELECT *, upper(coalesce({_CUT}, '')) AS input FROM ({_RAW}))))
"""
_DATE = f"""
SELECT recognition_id, item_no, input, value,
  CASE WHEN short THEN 'AMBIGUOUS' WHEN value IS NULL THEN 'INVALID' WHEN value = input THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS status,
  CASE WHEN short THEN 'SHORT_YEAR' WHEN value IS NULL THEN 'INVALID_DATE' WHEN value = input THEN 'NO_CHANGE' WHEN value <> compact THEN 'NUMERIC_CONTEXT' ELSE 'FORMAT_NORMALIZATION' END AS reason
FROM (SELECT *, regexp_full_match(read, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}') AND try_strptime(substr(read, 1, 6) || '2000', '%d/%m/%Y') IS NOT NULL AS short,
    CASE WHEN regexp_full_match(read, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AND substr(read, 7, 4) >= '0100' AND try_strptime(read, '%d/%m/%Y') IS NOT NULL THEN read END AS value
  FROM (SELECT *, {_DIGITS.format(x='compact')} AS read FROM (SELECT *, regexp_replace(input, '[{_W}]+', '', 'g') AS compact FROM (SELECT *, coalesce({_CUT}, '') AS input FROM ({_RAW})))))
"""
_AMOUNT = f"""
SELECT recognition_id, item_no, input, value, CASE WHEN value IS NULL THEN 'INVALID' WHEN value = input THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS status,
  CASE WHEN value IS NULL THEN 'INVALID_FORMAT' WHEN value = input THEN 'NO_CHANGE' WHEN value <> 'Bs ' || number THEN 'NUMERIC_CONTEXT' ELSE 'FORMAT_NORMALIZATION' END AS reason
FROM (SELECT *, CASE WHEN regexp_full_match({_DIGITS.format(x='number')}, '[0-9]{{1,3}}(\\.[0-9]{{3}})*,[0-9]{{2}}') THEN 'Bs ' || {_DIGITS.format(x='number')} END AS value
  FROM (SELECT *, regexp_replace(regexp_extract(input, '^[Bb][Ss]\\.?[{_W}]+(.+)$', 1), '[{_W}]+', '', 'g') AS number FROM (SELECT *, coalesce({_CUT}, '') AS input FROM ({_RAW}))))
"""
_SQL = {"NIT": _NIT, "TV_CORRELATIVO": _TV, "DATE": _DATE, "AMOUNT": _AMOUNT}


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognition_id, item_no, kind, raw of every field read from a page."""
    item = table(spark, sf_dir, "recognitions").select("recognition_id", F.posexplode("structured_fields.fields").alias("p", "f"))
    return item.select("recognition_id", (F.col("p") + 1).alias("item_no"), F.col("f.field_type").alias("kind"), F.col("f.raw").alias("raw"))


def _normalised(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return normalise(raw_values(spark, sf_dir), F.lit(kind), F.col("raw")).drop("kind", "raw")


@query(_NIT)
def normalize_nit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "NIT")


@query(_TV)
def normalize_correlative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "TV_CORRELATIVO")


@query(_DATE)
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "DATE")


@query(_AMOUNT)
def normalize_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir, "AMOUNT")


_KIND_SQL = "CASE kind WHEN 'NIT' THEN 'NIT' WHEN 'CODIGO' THEN 'TV_CORRELATIVO' WHEN 'FECHA' THEN 'DATE' WHEN 'MONTO' THEN 'AMOUNT' END"
_DISPATCH = f"WITH k AS (SELECT recognition_id, item_no, {_KIND_SQL} AS field_type FROM ({_RAW})) " + " UNION ALL ".join(
    f"SELECT k.field_type, n.* FROM k JOIN ({s}) n USING (recognition_id, item_no) WHERE k.field_type = '{k}'" for k, s in _SQL.items()
)


def kind_of(label: Column) -> Column:
    """The normaliser's name for a stored field type."""
    return F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[label]


@query(_DISPATCH)
def normalize_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raw value by the normaliser of its own type."""
    typed = raw_values(spark, sf_dir).withColumn("field_type", kind_of(F.col("kind"))).where("field_type is not null")
    return normalise(typed, F.col("field_type"), F.col("raw")).drop("kind", "raw")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognition_id, line_no, line of the raw texts of structured pages."""
    text = table(spark, sf_dir, "recognitions").select("recognition_id", F.col("structured_fields.raw_text").alias("t")).where("t is not null")
    return text.select("recognition_id", F.posexplode(F.split("t", "\r?\n")).alias("p", "line")).select("recognition_id", (F.col("p") + 1).alias("line_no"), "line")


def extracted(lines: DataFrame) -> DataFrame:
    """(.., field_type, raw) of each line and label rule: one pass over the
    lines with four expressions, no join against the rules."""
    found = F.array(*[F.struct(F.lit(k).alias("field_type"), fx.labelled_value(F.col("line"), k).alias("raw")) for k in fx.LABELS])
    return lines.withColumn("f", F.explode(F.filter(found, lambda x: x["raw"].isNotNull()))).select(*[c for c in lines.columns if c != "line"], "line", "f.*")


_LINES = f"""
SELECT recognition_id, CAST(n AS INTEGER) AS line_no, line FROM (
  SELECT recognition_id, unnest(regexp_split_to_array(structured_fields.raw_text, '\\r?\\n')) AS line, unnest(generate_series(1, len(regexp_split_to_array(structured_fields.raw_text, '\\r?\\n')))) AS n
  FROM recognitions WHERE structured_fields.raw_text IS NOT NULL)
"""
_RULES = ", ".join(f"('{k}', '(?i)^(?:{p})(?:[{_W}]*:[{_W}]*|[{_W}]+)(.+)$')" for k, p in fx.LABELS.items())
_EXTRACT = f"""
SELECT recognition_id, line_no, field_type, raw FROM (
  SELECT recognition_id, line_no, field_type, regexp_replace(regexp_extract(line, pattern, 1), '^[{_W}]+|[{_W}]+$', '', 'g') AS raw
  FROM ({_LINES}), (VALUES {_RULES}) r(field_type, pattern)) WHERE raw <> ''
"""


@query(_EXTRACT)
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(page_lines(spark, sf_dir)).select("recognition_id", "line_no", "field_type", "raw")


@query(f"""
SELECT recognition_id, line_no, field_type, raw FROM (
  SELECT recognition_id, line_no, field_type, trim(regexp_extract(trim(line), pattern, 1)) AS raw FROM ({_LINES}),
    (VALUES ('NIT', '^NIT:(.+)$'), ('TV_CORRELATIVO', '^Código:(.+)$'), ('AMOUNT', '^Monto:(.+)$'), ('DATE', '^Fecha:(.+)$')) r(field_type, pattern)) WHERE raw <> ''
""")
def strict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of correct texts: exact labels only, case-sensitive."""
    names = {"NIT": "NIT", "TV_CORRELATIVO": "Código", "AMOUNT": "Monto", "DATE": "Fecha"}
    line = F.trim("line")
    found = F.array(*[F.struct(F.lit(k).alias("field_type"), F.trim(F.regexp_extract(line, f"^{n}:(.+)$", 1)).alias("raw")) for k, n in names.items()])
    out = page_lines(spark, sf_dir).select("recognition_id", "line_no", F.explode(F.filter(found, lambda x: x["raw"] != "")).alias("f"))
    return out.select("recognition_id", "line_no", "f.*")


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First resolved value of each document and type, as stored."""
    item = table(spark, sf_dir, "recognitions").select("recognition_id", F.explode("structured_fields.fields").alias("f"))
    typed = item.select("recognition_id", kind_of(F.col("f.field_type")).alias("field_type"), F.struct("f.line_number", "f.raw", "f.resolved").alias("v"))
    first = typed.where("field_type is not null").groupBy("recognition_id", "field_type").agg(F.min("v").alias("v"))
    return first.select("recognition_id", "field_type", F.coalesce("v.resolved", "v.raw").alias("expected"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First extracted value of each document and type, normalised."""
    first = extracted(page_lines(spark, sf_dir)).groupBy("recognition_id", "field_type").agg(F.min(F.struct("line_no", "raw")).alias("v"), F.count("*").alias("candidates"))
    return normalise(first, F.col("field_type"), F.col("v.raw")).select("recognition_id", "field_type", "candidates", "value", "status")


_EXPECTED_SQL = f"""
SELECT recognition_id, field_type, coalesce(v.resolved, v.raw) AS expected FROM (
  SELECT recognition_id, field_type, min(struct_pack(line_number := f.line_number, raw := f.raw, resolved := f.resolved)) AS v
  FROM (SELECT recognition_id, f, CASE f.field_type WHEN 'NIT' THEN 'NIT' WHEN 'CODIGO' THEN 'TV_CORRELATIVO' WHEN 'FECHA' THEN 'DATE' WHEN 'MONTO' THEN 'AMOUNT' END AS field_type
    FROM (SELECT recognition_id, unnest(structured_fields.fields) AS f FROM recognitions WHERE structured_fields IS NOT NULL)) WHERE field_type IS NOT NULL GROUP BY ALL)
"""


def _sql_on(kind: str, source: str) -> str:
    """The normaliser's SQL over other rows (recognition_id, item_no, raw)."""
    return _SQL[kind].replace(_RAW, source)


_FIRST = f"SELECT recognition_id, field_type, arg_min(raw, line_no) AS raw, count(*) AS candidates FROM ({_EXTRACT}) GROUP BY ALL"
_FOUND_SQL = " UNION ALL ".join(f"SELECT n.recognition_id, '{k}' AS field_type, n.value, n.status FROM ({_sql_on(k, f'SELECT recognition_id, 1 AS item_no, raw FROM ({_FIRST}) WHERE field_type = {chr(39)}{k}{chr(39)}')}) n" for k in _SQL)
_VERDICT_SQL = f"""
SELECT e.recognition_id, e.field_type, e.expected, f.value,
  CASE WHEN f.status IS NULL THEN 'MISSING' WHEN f.status = 'AMBIGUOUS' THEN 'AMBIGUOUS' WHEN f.status = 'INVALID' THEN 'INVALID' WHEN f.value = e.expected THEN 'EXACT' ELSE 'WRONG' END AS verdict
FROM ({_EXPECTED_SQL}) e LEFT JOIN ({_FOUND_SQL}) f USING (recognition_id, field_type)
"""


@query(_VERDICT_SQL)
def field_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against extracted fields of each document and type."""
    verdict = F.when(F.col("status").isNull(), "MISSING").when(F.col("status").isin("AMBIGUOUS", "INVALID"), F.col("status")).when(F.col("value") == F.col("expected"), "EXACT").otherwise("WRONG")
    joined = _expected(spark, sf_dir).join(_found(spark, sf_dir), ["recognition_id", "field_type"], "left")
    return joined.select("recognition_id", "field_type", "expected", "value", verdict.alias("verdict"))


@query(f"SELECT f.field_type, count(*) AS false_positives FROM ({_FIRST}) f ANTI JOIN ({_EXPECTED_SQL}) e USING (recognition_id, field_type) GROUP BY ALL")
def field_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields that no expected one accounts for."""
    spare = _found(spark, sf_dir).join(_expected(spark, sf_dir), ["recognition_id", "field_type"], "left_anti")
    return spare.groupBy("field_type").agg(F.count("*").alias("false_positives"))


@query(f"""
SELECT field_type, count(*) AS expected, CAST(count_if(verdict IN ('EXACT', 'WRONG')) AS BIGINT) AS extracted, CAST(count_if(verdict = 'EXACT') AS BIGINT) AS exact,
  round(count_if(verdict IN ('EXACT', 'WRONG')) / count(*), 6) AS coverage, round(count_if(verdict = 'EXACT') / count(*), 6) AS exact_accuracy,
  round(count_if(verdict = 'EXACT') / nullif(count_if(verdict IN ('EXACT', 'WRONG')), 0), 6) AS accuracy_among_extracted,
  CAST(count_if(document_correct) AS BIGINT) AS in_correct_documents
FROM (SELECT *, bool_and(verdict = 'EXACT') OVER (PARTITION BY recognition_id) AS document_correct FROM ({_VERDICT_SQL})) GROUP BY field_type
""")
def field_eval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy per type, and how many stand in documents all of
    whose fields are right."""
    verdicts = field_verdicts(spark, sf_dir)
    whole = verdicts.groupBy("recognition_id").agg(F.bool_and(F.col("verdict") == "EXACT").alias("document_correct"))
    taken, exact = F.count_if(F.col("verdict").isin("EXACT", "WRONG")), F.count_if(F.col("verdict") == "EXACT")
    return verdicts.join(whole, "recognition_id").groupBy("field_type").agg(
        F.count("*").alias("expected"), taken.alias("extracted"), exact.alias("exact"), F.round(taken / F.count("*"), 6).alias("coverage"),
        F.round(exact / F.count("*"), 6).alias("exact_accuracy"), F.round(F.try_divide(exact, taken), 6).alias("accuracy_among_extracted"), F.count_if("document_correct").alias("in_correct_documents"),
    )


@query(f"SELECT recognition_id, field_type, count(*) AS candidates FROM ({_EXTRACT}) GROUP BY ALL HAVING count(*) > 1")
def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that offer more than one candidate for a field; ``field_verdicts``
    takes the first of them, a strict reader would refuse the document."""
    return _found(spark, sf_dir).where("candidates > 1").select("recognition_id", "field_type", "candidates")
