import numpy as np

from riskframe.operators import explore


def test_gram_correlations_match_pairwise_numpy(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(700, 6)) + [5e6, 0, 1, 2, 3, 4]
    x[:, 1] = x[:, 0] * 3 + g.normal(size=700)
    x[:, 4] = 7.25
    x[g.random(x.shape) < 0.2] = np.nan
    x[:, 5] = np.nan
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(6)]).repartition(5)
    got = {(r.feature_a, r.feature_b): r.r for r in explore.correlations(df, df.columns).collect()}
    assert len(got) == 15
    for i in range(6):
        for j in range(i + 1, 6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[f"c{i}", f"c{j}"]
            if i == 4 or j >= 4:
                assert r is None
            else:
                assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9


def test_plan_does_not_grow_with_pairs(spark):
    df = spark.createDataFrame([tuple(float(i * j % 7) for j in range(40)) for i in range(50)], [f"c{j}" for j in range(40)])
    out = explore.correlations(df, df.columns)
    assert out.count() == 780
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 40_000


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert explore.correlations(df, ["a", "b"]).count() == 0
