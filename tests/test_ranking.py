"""Row numbers, running sums and packing of groups, in one task and spread, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators.curate import pack_in_order
from tarnwork.operators.ranking import number_rows


def test_number_rows(spark):
    dice = random.Random(1)
    rows = [(dice.choice(["a", "a", "a", "b", None]), k, dice.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(7)
    got = {r["k"]: (r["place"], r["run"]) for r in number_rows(df, group=["g"], order=[F.desc("k")], sums={"run": "n"}).collect()}
    count, total, want = {}, {}, {}
    for g, k, n in sorted(rows, key=lambda r: -r[1]):
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + n
        want[k] = (count[g], total[g])
    assert got == want
    assert number_rows(df.limit(0), group=["g"], order=["k"]).count() == 0


@pytest.mark.parametrize("scope", [1000, 0])
def test_pack_in_order(spark, scope):
    dice = random.Random(2)
    rows = [("g" if k % 4 else "h", k, dice.choice([5, 30, 60, 200, None])) for k in range(150)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    got = {r["k"]: r["batch_no"] for r in pack_in_order(df, group="g", order=["k"], size="n", most=4, limit=100, scope=scope).collect()}
    want, state = {}, {}
    for g, k, n in rows:
        n = n or 0
        batch, count, used = state.get(g, (1, 0, 0))
        if count and (count >= 4 or used + n > 100):
            batch, count, used = batch + 1, 0, 0
        state[g] = (batch, count + 1, used + n)
        want[k] = batch
    assert got == want
