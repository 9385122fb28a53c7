from pyspark.sql import functions as F

from pairloom.streaming import state


def test_stream_equals_batch(spark, tmp_path):
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type")).write.mode("append").parquet(str(tmp_path / "in"))
    out = state.count_events(spark, str(tmp_path / "in"), "counted", str(tmp_path / "at"))
    assert {r["event_type"]: r["n"] for r in out.collect()} == {"a": 7, "b": 13}
