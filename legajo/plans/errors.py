"""Error rates of recognised text and comparisons of engines and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions.fields import CONFUSED, DIGITS
from legajo.functions.text import SPACE, nfc, squeeze, text_distance, word_distance
from legajo.operators.errors import micro_rates, ranked, ratio
from legajo.plans.registry import query
from legajo.tables import spread, table


def _norm_sql(column: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({column}), '[{SPACE}]+', ' ', 'g'))"


def _norm(column: str) -> Column:
    """Composed form with white space squeezed; accents are errors where they differ."""
    return squeeze(nfc(F.col(column)))


def with_distance_sql(source: str, a: str, b: str, name: str) -> str:
    """``source`` with the edit distance of two columns in code points: DuckDB's
    counts bytes, so each code point of a pair becomes one ASCII character."""
    code = "coalesce(array_to_string(list_transform(string_split({x}, ''), lambda c: chr(CAST(list_position(u_{n}, c) AS INTEGER))), ''), '')"
    return f"SELECT *, CAST(levenshtein({code.format(x=a, n=name)}, {code.format(x=b, n=name)}) AS INTEGER) AS {name} FROM (SELECT *, list_distinct(string_split({a} || {b}, '')) AS u_{name} FROM ({source}))"


_CASES = f"SELECT result_id, category, {_norm_sql('expected')} AS r, {_norm_sql('obtained')} AS h FROM case_results WHERE expected IS NOT NULL AND obtained IS NOT NULL"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis of every case that has both, normalised.  The
    input is spread over the cores before the costly distance."""
    case = table(spark, sf_dir, "case_results").where("expected is not null and obtained is not null")
    return spread(case.select("result_id", "category", "expected", "obtained")).select("result_id", "category", _norm("expected").alias("r"), _norm("obtained").alias("h"))


@query(f"SELECT result_id, d AS character_distance, round(CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0 ELSE 1 END ELSE d / length(r) END, 6) AS cer FROM ({with_distance_sql(_CASES, 'r', 'h', 'd')})")
def cer_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of whole texts."""
    own = cases(spark, sf_dir).withColumn("d", text_distance(F.col("r"), F.col("h")).cast("int"))
    rate = F.when(F.length("r") == 0, F.when(F.length("h") == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide("d", F.length("r")))
    return own.select("result_id", F.col("d").alias("character_distance"), F.round(rate, 6).alias("cer"))


_LINE_PAIRS = f"SELECT recognition_id, category, line_no, {_norm_sql('l.text')} AS r, {_norm_sql('l.prediction')} AS h FROM (SELECT recognition_id, category, l, l.line_number AS line_no FROM (SELECT recognition_id, category, unnest(lines) AS l FROM recognitions)) WHERE l.text IS NOT NULL AND l.prediction IS NOT NULL"
_WORDS = "list_filter(string_split({x}, ' '), lambda w: w <> '')"
_CODES = "array_to_string(list_transform({a}, lambda w: chr(CAST(32 + list_position(u, w) AS INTEGER))), '')"
_LINE_RATES = f"""
SELECT recognition_id, category, line_no, character_distance, CAST(length(r) AS INTEGER) AS reference_characters,
  CAST(levenshtein({_CODES.format(a='rw')}, {_CODES.format(a='hw')}) AS INTEGER) AS word_distance, CAST(len(rw) AS INTEGER) AS reference_words
FROM (SELECT *, list_distinct(rw || hw) AS u FROM (SELECT *, {_WORDS.format(x='r')} AS rw, {_WORDS.format(x='h')} AS hw FROM ({with_distance_sql(_LINE_PAIRS, 'r', 'h', 'character_distance')})))
"""


def line_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each recognised line to its text."""
    lines = spread(table(spark, sf_dir, "recognitions").select("recognition_id", "category", "lines")).select("recognition_id", "category", F.explode("lines").alias("l")).where("l.text is not null and l.prediction is not null")
    pairs = lines.select("recognition_id", "category", F.col("l.line_number").alias("line_no"), _norm("l.text").alias("r"), _norm("l.prediction").alias("h"))
    words = F.size(F.filter(F.split("r", " "), lambda w: w != ""))
    return pairs.select("recognition_id", "category", "line_no", F.levenshtein(F.col("r"), F.col("h")).alias("character_distance"), F.length("r").alias("reference_characters"), word_distance(F.col("r"), F.col("h")).alias("word_distance"), words.alias("reference_words"))


@query(_LINE_RATES)
def line_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_distances(spark, sf_dir)


_MICRO = """count(*) AS samples, CAST(coalesce(sum(character_distance), 0) AS BIGINT) AS character_distance, CAST(coalesce(sum(word_distance), 0) AS BIGINT) AS word_distance,
 CAST(coalesce(sum(reference_characters), 0) AS BIGINT) AS reference_characters, CAST(coalesce(sum(reference_words), 0) AS BIGINT) AS reference_words,
 round(coalesce(sum(character_distance) / nullif(sum(reference_characters), 0), 0), 6) AS cer, round(coalesce(sum(word_distance) / nullif(sum(reference_words), 0), 0), 6) AS wer"""
_DURATION = "round(coalesce(sum({d}) FILTER (WHERE {d} >= 0 AND NOT isnan({d})), 0), 3) AS total_duration_ms, round(coalesce(avg({d}) FILTER (WHERE {d} >= 0 AND NOT isnan({d})), 0), 3) AS mean_duration_ms"


@query(f"SELECT category, {_MICRO} FROM ({_LINE_RATES}) GROUP BY category")
def error_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micro_rates(line_distances(spark, sf_dir), ["category"])


@query(f"SELECT strategy, psm, {_MICRO}, {_DURATION.format(d='ocr_duration_ms')} FROM matrix_rows GROUP BY strategy, psm")
def micro_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micro_rates(table(spark, sf_dir, "matrix_rows"), ["strategy", "psm"], "ocr_duration_ms")


@query("""
SELECT strategy, psm, category, count(*) AS samples, CAST(coalesce(sum(character_distance), 0) AS BIGINT) AS character_distance,
  round(coalesce(sum(character_distance) / nullif(sum(reference_characters), 0), 0), 6) AS cer, CAST(grouping(strategy, psm, category) AS BIGINT) AS level
FROM matrix_rows GROUP BY GROUPING SETS ((strategy, psm), (category), (strategy), ())
""")
def error_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several levels of aggregation in one pass."""
    table(spark, sf_dir, "matrix_rows").createOrReplaceTempView("legajo_matrix_rows")
    return spark.sql("""
        SELECT strategy, psm, category, count(*) AS samples, coalesce(sum(character_distance), 0) AS character_distance,
          round(coalesce(sum(character_distance) / nullif(sum(reference_characters), 0), 0), 6) AS cer, grouping_id(strategy, psm, category) AS level
        FROM legajo_matrix_rows GROUP BY GROUPING SETS ((strategy, psm), (category), (strategy), ())
    """)


_RANK_SQL = f"SELECT strategy, psm, cer, wer, row_number() OVER (ORDER BY cer, wer, strategy, psm) AS place FROM (SELECT strategy, psm, {_MICRO} FROM matrix_rows GROUP BY strategy, psm)"


@query(f"SELECT strategy, psm, cer, wer, CAST(place AS INTEGER) AS place FROM ({_RANK_SQL})")
def strategy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations from best to worst (a handful of groups, so one task)."""
    rates = micro_rates(table(spark, sf_dir, "matrix_rows"), ["strategy", "psm"])
    return ranked(rates, [], [F.col(c).asc() for c in ("cer", "wer", "strategy", "psm")]).select("strategy", "psm", "cer", "wer", "place")


@query("""
SELECT id, strategy, psm, cer, wer, confidence, row_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cer NULLS FIRST, wer NULLS FIRST, coalesce(confidence, -1) DESC, row_id) AS n FROM matrix_rows WHERE id IS NOT NULL) WHERE n = 1
""")
def best_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best row of each case by rates, then confidence (missing counts as -1).

    The minimum of one struct per case is a partial aggregation, so a case
    that holds a tenth of the rows needs no sort in one task."""
    rows = table(spark, sf_dir, "matrix_rows").where("id is not null")
    key = F.struct("cer", "wer", (-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "row_id", "strategy", "psm", "confidence")
    return rows.groupBy("id").agg(F.min(key).alias("b")).select("id", "b.strategy", "b.psm", "b.cer", "b.wer", "b.confidence", "b.row_id")


@query("""
WITH s AS (SELECT DISTINCT strategy FROM matrix_rows), p AS (SELECT DISTINCT psm FROM matrix_rows), c AS (SELECT DISTINCT category FROM matrix_rows)
SELECT x.strategy, x.psm, x.category, count(m.row_id) AS runs FROM (SELECT * FROM s, p, c WHERE strategy IS NOT NULL AND psm IS NOT NULL AND category IS NOT NULL) x
LEFT JOIN matrix_rows m ON m.strategy = x.strategy AND m.psm = x.psm AND m.category = x.category GROUP BY ALL
""")
def matrix_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the experiment matrix with its number of rows, empty cells
    too; the cross product is of distinct configuration values only."""
    rows = table(spark, sf_dir, "matrix_rows")
    have = rows.where("strategy is not null and psm is not null and category is not null").groupBy("strategy", "psm", "category").agg(F.count("row_id").alias("n"))
    values = rows.agg(F.collect_set("strategy").alias("s"), F.collect_set("psm").alias("p"), F.collect_set("category").alias("c"))
    cells = values.select(F.explode("s").alias("strategy"), "p", "c").select("strategy", F.explode("p").alias("psm"), "c").select("strategy", "psm", F.explode("c").alias("category"))
    return cells.join(have, ["strategy", "psm", "category"], "left").select("strategy", "psm", "category", F.coalesce("n", F.lit(0)).alias("runs"))


@query(f"""
WITH g AS (SELECT category, strategy, {_MICRO} FROM matrix_rows GROUP BY category, strategy)
SELECT a.category, round(a.cer - b.cer, 6) AS cer_delta, round(a.wer - b.wer, 6) AS wer_delta, CASE WHEN a.cer < b.cer THEN 'better' WHEN a.cer > b.cer THEN 'worse' ELSE 'same' END AS verdict
FROM g a JOIN g b ON a.category = b.category AND a.strategy = 'grayscale' AND b.strategy = 'none'
""")
def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category rates of one strategy against another: both sides from one scan,
    pivoted by conditional sums instead of joined."""
    rows = table(spark, sf_dir, "matrix_rows")

    def rate(strategy: str, top: str, bottom: str):
        on = F.col("strategy") == strategy
        return F.round(ratio(F.sum(F.when(on, F.col(top))), F.sum(F.when(on, F.col(bottom)))), 6)

    sides = rows.where(F.col("category").isNotNull()).groupBy("category").agg(
        *[rate(s, "character_distance", "reference_characters").alias(f"c{i}") for i, s in enumerate(("grayscale", "none"))],
        *[rate(s, "word_distance", "reference_words").alias(f"w{i}") for i, s in enumerate(("grayscale", "none"))],
        *[F.count_if(F.col("strategy") == s).alias(f"n{i}") for i, s in enumerate(("grayscale", "none"))],
    )
    verdict = F.when(F.col("c0") < F.col("c1"), "better").when(F.col("c0") > F.col("c1"), "worse").otherwise("same")
    return sides.where("n0 > 0 and n1 > 0").select("category", F.round(F.col("c0") - F.col("c1"), 6).alias("cer_delta"), F.round(F.col("w0") - F.col("w1"), 6).alias("wer_delta"), verdict.alias("verdict"))


@query("""
WITH t AS (SELECT sum(character_distance) / nullif(sum(reference_characters), 0) AS cer FROM matrix_rows),
b AS (SELECT * FROM (VALUES ('first', CAST(0.3492 AS DOUBLE)), ('second', CAST(0.4648 AS DOUBLE))) x(baseline, baseline_cer))
SELECT baseline, baseline_cer, round(cer, 6) AS cer, round(cer - baseline_cer, 6) AS delta, cer < baseline_cer AS improved FROM t, b
""")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall rate against named baselines (one row beside two)."""
    total = table(spark, sf_dir, "matrix_rows").agg((F.sum("character_distance") / F.nullif(F.sum("reference_characters"), F.lit(0))).alias("cer"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(v).alias("baseline_cer")) for n, v in (("first", 0.3492), ("second", 0.4648))]))
    return total.select("cer", named.alias("b")).select("b.baseline", "b.baseline_cer", F.round("cer", 6).alias("cer"), F.round(F.col("cer") - F.col("b.baseline_cer"), 6).alias("delta"), (F.col("cer") < F.col("b.baseline_cer")).alias("improved"))


@query("""
WITH a AS (SELECT id, avg(character_count) AS runtime_chars, count(*) AS runtime_rows FROM recognitions WHERE strategy = 'runtime' GROUP BY id),
b AS (SELECT id, count(*) AS document_rows FROM recognitions WHERE strategy = 'rgb-original' GROUP BY id),
c AS (SELECT id, count(*) AS gray_rows FROM recognitions WHERE strategy = 'grayscale' GROUP BY id)
SELECT id, round(runtime_chars, 6) AS runtime_chars, runtime_rows, document_rows, gray_rows FROM a JOIN b USING (id) JOIN c USING (id)
""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids recognised by all three engines: each side aggregated before the join,
    so a hot id meets itself once."""
    rec = table(spark, sf_dir, "recognitions")
    side = lambda s, *agg: rec.where(F.col("strategy") == s).groupBy("id").agg(*agg)
    a = side("runtime", F.round(F.avg("character_count"), 6).alias("runtime_chars"), F.count("*").alias("runtime_rows"))
    return a.join(side("rgb-original", F.count("*").alias("document_rows")), "id").join(side("grayscale", F.count("*").alias("gray_rows")), "id")


@query("SELECT r.recognition_id, count(a.anomaly_id) AS anomalies, count(DISTINCT a.original_text) AS distinct_texts FROM recognitions r JOIN semantic_anomalies a USING (recognition_id) GROUP BY r.recognition_id")
def truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join of documents with their anomalies, counted per document: the
    many side is aggregated first, then met with the keys."""
    per = table(spark, sf_dir, "semantic_anomalies").where("recognition_id is not null").groupBy("recognition_id").agg(F.count("anomaly_id").alias("anomalies"), F.count_distinct("original_text").alias("distinct_texts"))
    return table(spark, sf_dir, "recognitions").select("recognition_id").join(per, "recognition_id")


_SPLIT = "regexp_split_to_array({x}, '\\r?\\n')"
_POSITION = f"""
SELECT a.result_id, a.line_no, a.line AS expected_line, b.line AS obtained_line FROM
 (SELECT result_id, unnest({_SPLIT.format(x='expected')}) AS line, CAST(unnest(generate_series(1, len({_SPLIT.format(x='expected')}))) AS INTEGER) AS line_no FROM case_results WHERE expected IS NOT NULL AND obtained IS NOT NULL) a
 JOIN (SELECT result_id, unnest({_SPLIT.format(x='obtained')}) AS line, CAST(unnest(generate_series(1, len({_SPLIT.format(x='obtained')}))) AS INTEGER) AS line_no FROM case_results WHERE obtained IS NOT NULL AND expected IS NOT NULL) b
 USING (result_id, line_no)
"""


@query(_POSITION)
def line_position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and obtained lines side by side: both texts are in the row, so
    the lines are zipped and no join is needed."""
    case = table(spark, sf_dir, "case_results").where("expected is not null and obtained is not null")
    split = case.select("result_id", F.split("expected", "\r?\n").alias("e"), F.split("obtained", "\r?\n").alias("o"))
    zipped = split.select("result_id", F.posexplode(F.slice(F.arrays_zip("e", "o"), 1, F.least(F.size("e"), F.size("o")))).alias("p", "z"))
    return zipped.select("result_id", (F.col("p") + 1).alias("line_no"), F.col("z.e").alias("expected_line"), F.col("z.o").alias("obtained_line"))


@query(f"SELECT result_id, count(*) AS lines, CAST(count_if(expected_line <> obtained_line) AS BIGINT) AS mismatched FROM ({_POSITION}) GROUP BY result_id HAVING count_if(expected_line <> obtained_line) > 0")
def line_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with lines that differ from those expected at the same place."""
    pairs = line_position_join(spark, sf_dir)
    differ = F.count_if(F.col("expected_line") != F.col("obtained_line"))
    return pairs.groupBy("result_id").agg(F.count("*").alias("lines"), differ.alias("mismatched")).where("mismatched > 0")


@query(f"""
SELECT result_id, CAST(len({_SPLIT.format(x='expected')}) AS INTEGER) AS expected_lines, CAST(len({_SPLIT.format(x='obtained')}) AS INTEGER) AS obtained_lines FROM case_results
WHERE expected IS NOT NULL AND obtained IS NOT NULL AND len({_SPLIT.format(x='expected')}) <> len({_SPLIT.format(x='obtained')})
""")
def zip_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose lines can't be zipped strictly: unequal numbers."""
    case = table(spark, sf_dir, "case_results").where("expected is not null and obtained is not null")
    sizes = case.select("result_id", F.size(F.split("expected", "\r?\n")).alias("expected_lines"), F.size(F.split("obtained", "\r?\n")).alias("obtained_lines"))
    return sizes.where("expected_lines != obtained_lines")


_READ = f"SELECT recognition_id, l.line_number AS n, {_norm_sql('l.text')} AS t, {_norm_sql('l.prediction')} AS p, translate({_norm_sql('l.prediction')}, '{CONFUSED}', '{DIGITS}') AS o FROM (SELECT recognition_id, unnest(lines) AS l FROM recognitions WHERE strategy = 'runtime') WHERE l.text IS NOT NULL AND l.prediction IS NOT NULL"
_READ = with_distance_sql(with_distance_sql(_READ, "t", "p", "own"), "t", "o", "other")


def line_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognition_id, line_no, own, other: distances of two readings of a line
    from its text; the other engine is one that reads digits where letters look
    like them."""
    lines = spread(table(spark, sf_dir, "recognitions").where("strategy = 'runtime'").select("recognition_id", "lines")).select("recognition_id", F.explode("lines").alias("l")).where("l.text is not null and l.prediction is not null")
    read = lines.select("recognition_id", F.col("l.line_number").alias("line_no"), _norm("l.text").alias("t"), _norm("l.prediction").alias("p"))
    t, p = F.col("t"), F.col("p")
    return read.select("recognition_id", "line_no", F.levenshtein(t, p).cast("long").alias("own"), F.levenshtein(t, F.translate(p, CONFUSED, DIGITS)).cast("long").alias("other"))


@query(f"""
SELECT recognition_id, n AS line_no, CAST(sum(own) OVER w AS BIGINT) AS before, CAST(sum(own) OVER w - own + other AS BIGINT) AS after, CAST(sum(least(own, other)) OVER w AS BIGINT) AS all_improving,
  CASE WHEN other < own THEN 'IMPROVES' WHEN other > own THEN 'WORSENS' ELSE 'UNCHANGED' END AS outcome FROM ({_READ}) WINDOW w AS (PARTITION BY recognition_id)
""")
def line_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacing one line by another engine's reading does to the document's
    summed line distance, and what replacing all improving lines would."""
    own = line_readings(spark, sf_dir)
    document = Window.partitionBy("recognition_id")
    whole = F.sum("own").over(document)
    outcome = F.when(F.col("other") < F.col("own"), "IMPROVES").when(F.col("other") > F.col("own"), "WORSENS").otherwise("UNCHANGED")
    return own.select("recognition_id", "line_no", whole.alias("before"), (whole - F.col("own") + F.col("other")).alias("after"), F.sum(F.least("own", "other")).over(document).alias("all_improving"), outcome.alias("outcome"))


@query(f"""
SELECT recognition_id, count(*) AS regions, CAST(count_if(own > 0) AS BIGINT) AS source_errors, CAST(count_if(own > 0 AND other = 0) AS BIGINT) AS corrected, CAST(count_if(own = 0 AND other = 0) AS BIGINT) AS preserved, CAST(count_if(own = 0 AND other > 0) AS BIGINT) AS destroyed
FROM ({_READ}) GROUP BY recognition_id
""")
def region_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second reading of every line would have corrected, preserved and
    destroyed (the second engine of ``line_replacement``)."""
    own = line_readings(spark, sf_dir)
    wrong, right, now = F.col("own") > 0, F.col("own") == 0, F.col("other") == 0
    return own.groupBy("recognition_id").agg(F.count("*").alias("regions"), F.count_if(wrong).alias("source_errors"), F.count_if(wrong & now).alias("corrected"), F.count_if(right & now).alias("preserved"), F.count_if(right & ~now).alias("destroyed"))


@query(f"SELECT result_id, trim(regexp_replace(nfc_normalize(expected), '[{SPACE}]+', ' ', 'g')) AS text FROM case_results WHERE expected IS NOT NULL")
def nfc_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in composed form with white space squeezed."""
    return table(spark, sf_dir, "case_results").where("expected is not null").select("result_id", squeeze(nfc(F.col("expected"))).alias("text"))
