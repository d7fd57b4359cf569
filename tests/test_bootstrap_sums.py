"""The bootstrap adds weights up where rows are, the same ones as before."""

import numpy as np

from chronoweave.operators import ranking


def test_bootstrap_adds_weights_up_where_rows_are(spark):
    rng = np.random.default_rng(5)
    p, d = ranking.PRIME, rng.normal(size=3000)
    a, c = (np.r_[rng.integers(0, p, 50), 0, p - 1].astype(np.uint64) for _ in "ac")
    steps = np.arange(1, 301, dtype=np.uint64) * np.uint64(ranking.ROUND_STEP) % np.uint64(p)
    x = (a[:, None] * steps + c[:, None]) % np.uint64(p)
    s = x * x % np.uint64(p)
    u = (s * s % np.uint64(p)) * x % np.uint64(p)
    assert (ranking.poisson_weights(a, c, steps) == sum((u >= t).astype(int) for t in ranking.POISSON)).all()
    rows = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(d)] + [("n", 0, None), (None, 1, 1.0)], "k string, i int, d double")
    df = ranking.bootstrap_ci(rows, "k", "i", rounds=50)
    assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: r for r in df.collect()}
    assert set(got) == {"m", "n"} and got["n"]["low"] is None and got["m"]["low"] < got["m"]["mean"] < got["m"]["high"]
