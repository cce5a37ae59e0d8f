"""Lines by a rule of their own; exact percentiles of windows."""

from pyspark.sql import functions as F

from sonolake.functions import text as t
from sonolake.streaming import windows


def test_lines_lose_spaces_not_digits(spark):
    d = spark.createDataFrame([(" 0a \n1b1\n 2c\n\u00a0d ",), (None,)], "text string")
    assert [r[0] for r in d.select(t.by_line(F.col("text"))).collect()] == ["0a 1b1 2c \u00a0d", None], "a line's number is not what it is trimmed of"
    assert d.select(t.by_line(F.col("text"), F.upper)).first()[0] == " 0A  1B1  2C \u00a0D "


def test_percentiles_of_windows_are_exact(spark, tmp_path):
    days = spark.range(60_000).selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 2) as ts", "double(id * 7 % 60000) as value")
    more = spark.createDataFrame([("2024-01-03 05:00:00", None), ("2024-01-04 05:00:00", 2.0), ("2024-01-04 06:00:00", None)], "ts string, value double").selectExpr("timestamp(ts) as ts", "value")
    table = days.unionByName(more)
    even, odd = sorted(i * 7 % 60000 for i in range(0, 60000, 2)), sorted(i * 7 % 60000 for i in range(1, 60000, 2))
    expected = [(1, 30000, 29999.0, even[26999]), (2, 30000, 30000.0, odd[26999]), (3, 1, None, None), (4, 2, 2.0, 2.0)]
    rows = lambda d: sorted((r.start.day, r.n, r["mean"], r.p90) for r in d.collect())
    assert rows(windows.latency_windows(table, "1 day")) == expected
    table.write.parquet(f"{tmp_path}/events")
    stream = windows.latency_windows(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events"), "1 day")
    stream.writeStream.format("memory").queryName("windows_of_stream").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/at").start().awaitTermination()
    assert rows(spark.table("windows_of_stream")) == expected
