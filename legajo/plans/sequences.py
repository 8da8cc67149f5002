"""Sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.plans.registry import query
from legajo.tables import table


@query("SELECT run_id, mode, mean_duration_ms, summary_id FROM pipeline_summaries WHERE mean_duration_ms IS NOT NULL AND NOT isnan(mean_duration_ms) ORDER BY mean_duration_ms, mode, summary_id LIMIT 20")
def fastest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by several keys, the last of them unique."""
    good = table(spark, sf_dir, "pipeline_summaries").where("mean_duration_ms is not null and not isnan(mean_duration_ms)")
    return good.orderBy("mean_duration_ms", "mode", "summary_id").limit(20).select("run_id", "mode", "mean_duration_ms", "summary_id")


@query("SELECT doc_id, substr(text, 1, 800) AS sample, substr(text, 1, 40) AS line_key FROM documents WHERE text IS NOT NULL")
def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display samples of fixed length."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 800).alias("sample"), F.substring("text", 1, 40).alias("line_key"))


@query("SELECT DISTINCT category, strategy FROM matrix_rows")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matrix_rows").select("category", "strategy").distinct()


@query("SELECT 'case' AS origin, result_id AS rec_id, obtained AS text FROM case_results UNION ALL SELECT 'recognition', recognition_id, text FROM recognitions")
def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = table(spark, sf_dir, "case_results").select(F.lit("case").alias("origin"), F.col("result_id").alias("rec_id"), F.col("obtained").alias("text"))
    return case.unionByName(table(spark, sf_dir, "recognitions").select(F.lit("recognition").alias("origin"), F.col("recognition_id").alias("rec_id"), "text"))


@query("SELECT id FROM case_results WHERE id IS NOT NULL EXCEPT SELECT id FROM recognitions")
def ids_without_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "case_results").where("id is not null").select("id").subtract(table(spark, sf_dir, "recognitions").select("id"))


@query("SELECT id FROM matrix_rows INTERSECT SELECT id FROM case_results")
def ids_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matrix_rows").select("id").intersect(table(spark, sf_dir, "case_results").select("id"))


@query("""
SELECT run_id, arg_max(id, struct_pack(c := confidence, r := -row_id)) AS best_id, max(confidence) AS best_confidence FROM matrix_rows WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY run_id
""")
def best_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax with the smaller row winning ties."""
    good = table(spark, sf_dir, "matrix_rows").where("confidence is not null and not isnan(confidence)")
    top = good.groupBy("run_id").agg(F.max(F.struct("confidence", (-F.col("row_id")).alias("r"), "id")).alias("m"))
    return top.select("run_id", F.col("m.id").alias("best_id"), F.col("m.confidence").alias("best_confidence"))


@query("SELECT recognition_id, string_agg(suggested_alternative, '|' ORDER BY length(suggested_alternative) DESC, suggested_alternative) AS replacements FROM (SELECT DISTINCT recognition_id, suggested_alternative FROM semantic_anomalies WHERE suggested_alternative IS NOT NULL) GROUP BY recognition_id")
def replacements_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct replacements of each document, longest first."""
    own = table(spark, sf_dir, "semantic_anomalies").where("suggested_alternative is not null").select("recognition_id", "suggested_alternative").distinct()
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.length("suggested_alternative")).alias("n"), F.col("suggested_alternative").alias("s"))))
    return own.groupBy("recognition_id").agg(F.array_join(F.transform(sorted_, lambda x: x["s"]), "|").alias("replacements"))


@query("SELECT strategy, psm, category, count(*) AS n FROM matrix_rows GROUP BY CUBE (strategy, psm, category)")
def configuration_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matrix_rows").cube("strategy", "psm", "category").agg(F.count("*").alias("n"))


@query("""
SELECT n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name
""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: the large table is aggregated by its key before it meets the
    dimensions."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL
""")
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
