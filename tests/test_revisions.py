"""Revisions of a stream, stopped and started again between intakes, against those of a batch."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import revisions as R

SCHEMA = "content string, place long, signature string"


@pytest.fixture
def intake(spark, tmp_path):
    def run(parts, idle_ms=None):
        """Each part is an intake of its own: the stream starts, reads what is new, and ends."""
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = R.revisions_of_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), idle_ms)
            query = stream.withColumn("intake", F.lit(k)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    return run


def test_stream_equals_batch(spark, intake):
    r = random.Random(3)
    parts, place = [], 0
    for _ in range(3):
        rows = []
        for _ in range(200):
            place += 1
            rows.append((r.choice(["a", "b", "c", "d", "é", None]), place, r.choice(["s1", "s2", None])))
        rows.append((None, None, "s1"))
        parts.append(r.sample(rows, len(rows)))
    got = intake(parts)
    want = R.revisions_of_batch(spark.createDataFrame([x for p in parts for x in p], SCHEMA))
    columns = ["content", "place", "signature", "revision"]
    assert sorted(map(repr, got.filter("status = 'revision'").select(columns).collect())) == sorted(map(repr, want.select(columns).collect())) and want.count() > 100
    assert got.filter("status = 'late'").count() == 0 and got.select("intake").distinct().count() == 3


def test_repeats_and_late_rows(intake):
    got = intake([[("a", 5, "s"), ("a", 6, "s"), ("b", 1, None)], [("a", 7, "s"), ("a", 4, "t"), ("b", 1, "x"), ("b", 2, None)], [("a", 8, "t")]])
    rows = sorted((x["content"], x["intake"], x["place"], x["revision"], x["status"]) for x in got.collect())
    assert rows == [("a", 0, 5, 1, "revision"), ("a", 1, 4, 1, "late"), ("a", 2, 8, 2, "revision"), ("b", 0, 1, 1, "revision"), ("b", 1, 1, 1, "late")]
