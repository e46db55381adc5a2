"""Pasts of buyers: activity is dealt by actor once, and what an actor did in the entity itself is taken off again."""

from ledgerlens.operators import actors as C


def test_one_deal_of_activity_and_no_join(spark):
    act = spark.createDataFrame(
        [(1, 10, 0.0, 5.0, True, 2.0), (1, 20, 1.0, 8.0, True, -1.0), (1, 30, 2.0, 20.0, True, 4.0), (1, 40, 0.0, 9.0, False, 7.0), (2, 10, 3.0, 4.0, True, 1.0), (None, 10, 0.0, 1.0, True, 5.0)],
        "actor_id long, entity_id long, first_ts double, last_ts double, is_closed boolean, realized double",
    )
    top = spark.createDataFrame([(10, 1, 1, 10.0), (30, 1, 1, 10.0), (10, 2, 2, 10.0), (50, 2, 1, 4.0), (50, 3, 2, 10.0), (10, None, 3, 10.0)], "entity_id long, actor_id long, rank int, cutoff double")
    d = C.prior_stats(top, act)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = {(r.entity_id, r.actor_id): (r.n_prior, r.n_closed, r.n_won, r.sum_realized) for r in d.collect()}
    assert got == {(10, 1): (2, 1, 0, -1.0), (30, 1): (3, 2, 1, 1.0), (10, 2): (0, 0, 0, 0.0), (50, 2): (0, 0, 0, 0.0), (50, 3): (0, 0, 0, 0.0), (10, None): (1, 1, 1, 5.0)}
