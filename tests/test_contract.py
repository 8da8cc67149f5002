from legajo.plans import quality


def test_declared_figures_are_compared_with_the_lines(spark, tmp_path):
    two = [("uno",), ("dos ",)]
    rows = [(1, "runtime", "uno\ndos", 2, 7, two), (2, "runtime", "uno\ndos", 3, 7, two), (3, "runtime", "uno\ndos", 2, 6, two), (4, "runtime", "uno dos", 2, 7, two), (5, "runtime", None, None, None, None), (6, "runtime", "", 0, 0, []), (7, "runtime", "ñ", 1, 1, [("ñ",)]), (8, "grayscale", "x", 9, 9, two)]
    spark.createDataFrame(rows, "recognition_id long, strategy string, text string, line_count int, character_count int, lines array<struct<text string>>").write.parquet(f"{tmp_path}/recognitions.parquet")
    out = {r["recognition_id"]: (r["lines_differ"], r["characters_differ"], r["text_differs"]) for r in quality.contract_violations(spark, str(tmp_path)).collect()}
    none = (False, False, False)
    assert out == {1: none, 2: (True, False, False), 3: (False, True, False), 4: (False, False, True), 5: (True, True, True), 6: none, 7: none}
