"""The ledger written once gives the same rows; running medians of small keys, large keys and both."""

import random
from collections import defaultdict
from statistics import median

import pytest

from ledgerlens.operators import windows as W
from ledgerlens.plans.history import snapshots
from ledgerlens.sources.tables import kept, ledger_tokens, ledger_trades

SF = "/root/testdata/sf0.001"


def test_kept_ledger(spark):
    once = kept(spark, SF)
    assert once == SF and kept(spark, once) is once
    for make in (ledger_trades, ledger_tokens):
        a, b = make(spark, SF), make(spark, once)
        assert a.schema.simpleString() == b.schema.simpleString() and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    used = snapshots(spark, once)  # no join of line items and orders is left in what it returns
    assert not any("lineitem" in f or "orders" in f for f in used.inputFiles())


@pytest.mark.parametrize("small", [0, 40, 256])
def test_running_median_of_keys_of_any_size(spark, small):
    r = random.Random(4)
    rows = [(k, i, r.choice([None, float(r.randrange(30)), -r.random()])) for i in range(400) for k in [r.choice([1, 1, 1, 1, 2, 3, None])]] + [(9, 1, None), (9, 2, None)]
    out = W.running_median(spark.createDataFrame(rows, "k int, i int, v double").repartition(3), "k", ["i"], "v", "mid", small)
    seen, want = defaultdict(list), {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        want[k, i] = median(seen[k]) if seen[k] else None
        if v is not None:
            seen[k].append(v)
    got = {(x.k, x.i): x.mid for x in out.collect()}
    assert len(got) == len(rows) and all(got[k] == v or abs(got[k] - v) < 1e-9 for k, v in want.items())
