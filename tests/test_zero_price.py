"""Events at a price of 0: exit samples and replays against the SQL, and a model of rows that hold infinite values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import stats as S
from ledgerlens.plans.base import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of which every third is worth nothing."""
    to = tmp_path_factory.mktemp("zero")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("value", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{to}/events.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["exit_dataset", "forward_hold", "simulate_exit"])
def test_like_the_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    got = [tuple(map(str, r)) for r in df.collect()]
    want = [tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()]
    assert len(want) > 100 and any("inf" in r for r in want)
    assert sorted(got) == sorted(want)


def test_models_take_what_is_not_finite_as_missing(spark):
    rows = spark.createDataFrame([(1.0, 1), (3.0, 2), (float("inf"), 3), (float("nan"), 4), (None, 5)], "x double, n int")
    got = [list(r.features) for r in S.assembled(rows, ["x", "n"]).orderBy("n").collect()]
    assert got == [[1.0, 1.0, 0.0, 0.0], [3.0, 2.0, 0.0, 0.0]] + [[2.0, float(n), 1.0, 0.0] for n in (3, 4, 5)]
