"""pulse_trend against its SQL where the mean of buys changes by just the threshold."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.mark.parametrize(("high", "low"), [(48.88, 3.76), (3.23, 0.38)])
def test_a_mean_at_the_threshold_is_judged_as_in_the_sql(spark, tmp_path, high, low):
    e = spark.range(45).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.when(F.col("id") < 25, high).otherwise(low).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["pulse_trend"]).fetchall()
    got = [tuple(r) for r in entry.queries()["pulse_trend"](spark, str(tmp_path)).collect()]
    assert len(got) == 31 and sorted(got) == sorted(want)
