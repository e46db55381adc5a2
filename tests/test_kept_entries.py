"""Queries on exit samples: entries are written once, and the events are then read once."""

from ledgerlens.plans import exits

SF = "/root/testdata/sf0.001"


def test_entries_are_the_same_when_written(spark):
    assert sorted(exits.kept_entries(spark, SF).collect()) == sorted(exits.entries(spark, SF).collect())


def test_samples_read_the_events_once(spark):
    plan = exits.exit_dataset(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("props#") > 0 and sum("Relation [" in line and "props#" in line for line in plan.split("\n")) == 1
