"""Exact order statistics whatever the skew."""

import numpy as np
import pytest

from fathomry.operators import feature_metrics as M
from fathomry.operators import ranks


def skewed(name):
    r = np.random.default_rng(5)
    n = 30_000
    return {
        "normal": r.standard_normal(n),
        "one value": np.full(n, 3.25),
        "nearly one value": np.where(r.random(n) < 0.97, 7.0, r.standard_normal(n)),
        "powers": 2.0 ** r.uniform(-1000, 1000, n) * r.choice([-1, 1], n),
        "integers": r.integers(0, 50, n).astype(float),
        "infinite": np.r_[r.standard_normal(n - 200), np.full(100, np.inf), np.full(100, -np.inf)],
    }[name]


@pytest.mark.parametrize("name", ["normal", "one value", "nearly one value", "powers", "integers", "infinite"])
def test_values_at_ranks(spark, monkeypatch, name):
    v = skewed(name)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    monkeypatch.setattr(ranks, "FEW", 50)
    wanted = [0, 17, 15_000, 29_700, 29_999]
    assert ranks.values_at_ranks(df, "v", wanted) == [float(x) for x in np.sort(v)[wanted]]


def test_values_that_have_no_rank(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (1.0,)], "v double")
    assert ranks.values_at_ranks(df, "v", [0, 1]) == [1.0, 2.0]
    assert M.trimmed_mean(df, "v", "v").first()[0] == 1.5 and M.trimmed_mean(df.limit(0), "v", "v").first()[0] is None


def test_no_value_is_shuffled(spark):
    df = spark.range(20_000).selectExpr("id", "double(id) AS d")
    plan = M.trimmed_mean(df, "d", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("rows", [3, 100, 1 << 18])
def test_order_rank_by_buckets_of_any_size(spark, rows):
    v = np.random.default_rng(3).permutation(2000) ** 2
    df = spark.createDataFrame([(int(x),) for x in v], "v long").repartition(5)
    assert [r["rank"] for r in ranks.order_rank(df, "v", rows=rows).orderBy("v").collect()] == list(range(2000))
    assert ranks.order_rank(df.selectExpr("double(v) AS v"), "v", rows=rows).where("rank = 7").first().v == sorted(v)[7]
