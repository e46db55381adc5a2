"""The replay and the vectors of entries: few sorts, and no stage that holds the windows of all parts at once."""

import re

from ledgerlens.operators import exits as E
from ledgerlens.plans import exits as X

SF = "/root/testdata/sf0.001"


def nodes(df):
    return re.findall(r"^[ :+\-*()\d]*([A-Z]\w+)", df._jdf.queryExecution().executedPlan().toString(), re.M)


def test_replay_sorts_events_twice_and_aggregates_by_hash(spark):
    trades = spark.createDataFrame([(1, i, i % 3, "buy", 1.0, float(i), 2.0, 1.0) for i in range(1, 30)], "entity_id long, event_id long, actor_id long, side string, amount double, ts double, price double, reserve double")
    entries = spark.createDataFrame([(1, 0.5, 1.0, 9)], "entity_id long, entry_ts double, entry_price double, creator_id long")
    got = nodes(E.simulated(trades.repartition("entity_id"), entries, spark.createDataFrame([X.LEDGER_CONFIG], E.PARAMS), X.WHALE, X.LEDGER_TICK).hint("broadcast"))
    assert "SortAggregate" not in got and "HashAggregate" in got
    assert got.count("Window") <= 7, got


def test_every_reason_has_a_place(spark):
    """Reasons are carried as places in REASONS; one that is missing there would be lost."""
    text = open(E.__file__).read()
    rules = re.findall(r', "([a-z_]+)"\),$', text[text.index("    rules = [") : text.index("    # the stop is tested")], re.M)
    assert len(rules) == 13 and set(rules) <= set(E.REASONS)
    assert {"no_new_blood", "timeout", "model_sell"} <= set(E.REASONS)
    assert len(set(E.REASONS)) == len(E.REASONS)


def test_dataset_joins_written_parts(spark):
    got = nodes(X.entry_dataset_early(spark, SF))
    assert "Window" not in got and "Generate" not in got
    assert sum(n.startswith("FileScan") for n in got) <= 2, got


def test_both_vectors_share_their_ledger_and_parts(spark, monkeypatch):
    """The ledger is written once, and what no span changes is made once, for both variants."""
    from ledgerlens.plans import stats

    made, asked = [], []
    monkeypatch.setattr(X, "dataset_parts", lambda spark, sf_dir: made.append(sf_dir) or "parts")
    monkeypatch.setattr(stats, "_entry_rows", lambda spark, sf_dir, early, shared: asked.append((sf_dir, early, shared)) or (None, []))
    monkeypatch.setattr(stats, "_parts", lambda *a, **k: (None, None, None))
    monkeypatch.setattr(stats.S, "train_classifier", lambda *a, **k: None)
    monkeypatch.setattr(stats, "_report", lambda *a: spark.range(1))
    assert stats.train_entry_dataset(spark, SF).count() == 4
    assert len(made) == 1 and made[0].trades and made[0].tokens
    assert asked == [(made[0], False, "parts"), (made[0], True, "parts")]
