from ledgerloom.streaming import intake

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_intake_appends_once(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        intake.append_once(intake.stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_windows_and_first_occurrences(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i}:00", i % 2) for i in range(6)] + [(9, "2024-01-01 02:00:00", 0)]
    spark.createDataFrame(rows, "id int, t string, k int").selectExpr("id", "cast(t as timestamp) as ts", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id int, ts timestamp, k int").parquet(str(tmp_path / "in"))
    for name, df in (("w", intake.windowed_counts(source(), "ts", "k", "3 minutes", "1 minute")), ("f", intake.first_occurrences(source(), "ts", ["k"], "1 minute"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((str(r["start"])[14:16], r["k"], r["n"]) for r in spark.table("w").collect()) == [("00", 0, 2), ("00", 1, 1), ("03", 0, 1), ("03", 1, 2)]
    assert sorted(r["k"] for r in spark.table("f").collect())[:2] == [0, 1]
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r["n"] for r in intake.sessions(batch, "ts", "k", "10 minutes").collect()) == [1, 3, 3]
