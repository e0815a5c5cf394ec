import random

import pytest

from scriptloom.operators import packing


def by_hand(rows, rule):
    """(group, place) -> shard, one row after the other."""
    out, state = {}, {}
    for g, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        v = v or 0
        shard, held, n = state.get(g, (0, 0, 0))
        if n and ((held + v > rule.limit if rule.inclusive else held >= rule.limit) or n >= rule.most_rows):
            shard, held, n = shard + 1, 0, 0
        state[g] = shard, held + v, n + 1
        out[g, i] = shard
    return out


def found(spark, rows, rule, tasks, group=("g",)):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        df = spark.createDataFrame(rows, "g string, i int, v int")
        got = packing.pack(df, "v", rule, list(group), ["i"], "n").collect()
        assert len(got) == len(rows)
        return {(r.g, r.i): r.n for r in got}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_fold_over_any_cuts(spark, seed):
    rng = random.Random(seed)
    groups = [*["hot"] * 300, *["b"] * 40, *"cdef", None]
    rows = [(rng.choice(groups), i, rng.choice([0, 0, 1, 3, 5, 40, None])) for i in range(260)]
    rule = [packing.Rule(30, False), packing.Rule(400, True, 12), packing.Rule(20, True, 5), packing.Rule(3, False, 2)][seed]
    assert found(spark, rows, rule, (6, 9, 13, 5)[seed]) == by_hand(rows, rule)


def test_one_chain_without_groups_and_shards_over_several_tasks(spark):
    rows = [(None, i, 1) for i in range(200)]
    for rule in (packing.Rule(70, False), packing.Rule(1000, True), packing.Rule(55, True)):
        assert found(spark, rows, rule, 9, ()) == by_hand(rows, rule)


def test_refuses_what_it_cannot_pack(spark):
    df = spark.createDataFrame([(1, 0.5)], "i int, v double")
    with pytest.raises(ValueError, match="integers"):
        packing.shard_pack(df, "v", 3, [], ["i"])
    with pytest.raises(ValueError, match="positive"):
        packing.Rule(0, False)
    with pytest.raises(Exception, match="negative"):
        packing.shard_pack(spark.createDataFrame([(1, -1)], "i int, v int"), "v", 3, [], ["i"]).collect()
