from legajo.streaming import quality as s


def test_streams(spark, tmp_path):
    schema = "page_id long, document_key string, text string, confidence double, recognized_at timestamp"
    rows = [(1, "a", "x", 95.0), (2, "a", "x", 50.0), (3, "b", None, None), (1, "a", "x", 95.0), (4, None, "x", 80.0)]
    spark.createDataFrame(rows, "page_id long, document_key string, text string, confidence double").selectExpr("*", "timestamp'2026-01-01 10:00:00' as recognized_at").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {(r["status"], r["n"]) for r in run(s.verdict_counts(read()), "complete", "verdicts")} == {("ACCEPTABLE", 2), ("INSUFFICIENT", 2), ("REVIEW", 1)}
    assert len(run(s.once(read(), ["page_id"], "recognized_at"), "append", "deduplicated")) == 4
    last = {r["document_key"]: (r["pages"], r["worst"]) for r in run(s.worst_so_far(read()), "update", "documents")}
    assert last == {"a": (3, 2), "b": (1, 2)}
