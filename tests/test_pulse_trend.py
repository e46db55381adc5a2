"""Trends of mean buys that lie exactly on the threshold."""

import pytest

from ledgerlens.operators import windows as W


@pytest.mark.parametrize(("high", "low", "tie"), [(48.88, 3.76, 40), (3.23, 0.38, 41)])
def test_a_change_of_exactly_the_threshold_is_none(spark, high, low, tie):
    """20 buys in the window, one after the other of the other price: at `tie` the mean falls by 15 %, not by more; added as doubles in order it was more."""
    rows = [(i, 1, i, "buy", a, float(i), 0, 1.0) for i, a in enumerate([high] * 25 + [low] * 20)]
    e = spark.createDataFrame(rows, "event_id long, entity_id long, actor_id long, side string, amount double, ts double, creator_id long, reserve double")
    got = {r.event_id: r.size_trend for r in W.pulse(e, 90.0).collect()}
    assert [got[tie + i] for i in (-1, 0, 1)] == ["stable", "stable", "declining"]
