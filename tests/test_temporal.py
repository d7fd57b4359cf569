"""Golden values of grounding, Gaussians, ranking and scoring."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import gaussian, temporal, text
from chronoweave.operators import datagen, ranking, scoring

def anchor():
    return F.lit("2021-11-09").cast("date")



def bounds(spark, e):
    b = temporal.ground(F.lit(e), anchor())
    r = spark.range(1).select(b["start"].cast("string"), b["end"].cast("string")).first()
    return tuple(r)


@pytest.mark.parametrize(
    ("e", "start", "end"),
    [
        ("THIS P1W", "2021-11-08", "2021-11-15"), ("THIS P2W", "2021-11-01", "2021-11-15"), ("NEXT_IMMEDIATE P1W", "2021-11-15", "2021-11-22"),
        ("PREV_IMMEDIATE P2W", "2021-10-25", "2021-11-08"), ("OFFSET P-3D", "2021-11-06", "2021-11-06"), ("OFFSET P2W", "2021-11-23", "2021-11-23"),
        ("OFFSET P-1M", "2021-10-10", "2021-10-10"), ("OFFSET P1Y", "2022-11-09", "2022-11-09"), ("THIS P2Y OFFSET P2Y", "2021-11-09", "2023-10-22"),
        ("THIS P3M", "2021-09-01", "2021-11-30"), ("NEXT_IMMEDIATE P1M", "2021-12-01", "2021-12-31"), ("PREV_IMMEDIATE P2M", "2021-09-01", "2021-10-31"),
        ("NEXT_IMMEDIATE P1D", "2021-11-10", "2021-11-10"), ("PREV_IMMEDIATE P1D", "2021-11-08", "2021-11-09"), ("PRESENT_REF", "2021-11-09", "2021-11-09"),
        ("1990s-mid", "1994-01-01", "1996-12-31"), ("1990s", "1990-01-01", "1999-12-31"), ("1999-02", "1999-02-01", "1999-02-28"), ("1990,1995-06", "1990-01-01", "1995-06-30"),
        ("OFFSET P30D", None, None), ("1999-13", None, None), ("2031", None, None), ("0999-12-31", None, None), ("XXXX-WXX", None, None), ("P3Y", None, None), ("", None, None),
    ],
)
def test_ground(spark, e, start, end):
    assert bounds(spark, e) == (start, end)


def test_day_index(spark):
    r = spark.range(1).select(*[temporal.day_index(F.lit(d).cast("date")) for d in ("2000-01-01", "2021-11-09", "2030-12-31")]).first()
    assert tuple(r) == (365242, 373225, 376564)


@pytest.mark.parametrize(("a", "b", "s"), [("2000", "2000", 1.0), ("2000-06", "2000", 0.331536), ("2000", "2000-06", 0.013491), ("2000-06-15", "2000-06", 0.256186), ("2000", "2001", 0.142522)])
def test_similarity(spark, a, b, s):
    got = spark.range(1).select(gaussian.expression_similarity(F.lit(a), anchor(), F.lit(b), anchor())).first()[0]
    assert got == pytest.approx(s, abs=1e-6)


def test_similarity_of_unresolvable(spark):
    r = spark.range(1).select(gaussian.expression_similarity(F.lit("P3Y"), anchor(), F.lit("2000"), anchor()), gaussian.expression_similarity(F.lit("P3Y"), anchor(), F.lit("2000"), anchor(), lenient=True)).first()
    assert tuple(r) == (None, 0.0)


def test_date_encoding(spark):
    got = spark.range(1).select(gaussian.date_encoding(anchor())).first()[0]
    assert got[:4] == pytest.approx([-0.606110, -0.795381, 0.513548, -0.858061], abs=1e-5) and len(got) == 32


def test_mixture(spark):
    rows = spark.createDataFrame([("t", "2000", dt.date(2021, 1, 1)), ("t", "2010", dt.date(2021, 1, 1)), ("t", "P3Y", dt.date(2021, 1, 1))], "text string, expr string, anchor date")
    r = scoring.text_gaussians(rows, "text").first()
    assert r["mu"] == pytest.approx(367251.25) and r["var"] == pytest.approx(3346321.6042, rel=1e-6)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (1, 4, True)], "q int, rn int, is_gold boolean")
    r = ranking.item_metrics(ranked, ["q"], 3).first()
    assert (r["mrr"], r["top"], r["recall"]) == (0.5, 1.0, 0.5)
    assert r["ndcg"] == pytest.approx(0.386853, abs=1e-6) and r["precision"] == pytest.approx(1 / 3) and r["f1"] == pytest.approx(0.4)


def test_metrics_without_gold(spark):
    r = ranking.item_metrics(spark.createDataFrame([(1, 1, False)], "q int, rn int, is_gold boolean"), ["q"], 5).first()
    assert tuple(r)[1:] == (0.0,) * 6


@pytest.mark.parametrize(("n", "g", "o", "e"), [(3, 1, 0, 0.611111), (4, 2, 0, 0.722222), (5, 1, 3, 0.176905), (5, 0, 0, 0.0)])
def test_expected_reciprocal_rank(spark, n, g, o, e):
    assert spark.range(1).select(ranking.expected_reciprocal_rank(F.lit(n), F.lit(g), F.lit(o))).first()[0] == pytest.approx(e, abs=1e-6)


def test_cosent(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.2), (1, 0.3, 0.9), (1, 0.3, 0.5)], "b int, label double, s double")
    assert datagen.cosent(rows, "b", "label", "s").first()["loss"] == pytest.approx(0.805316, abs=1e-6)


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "d e f g")], "id int, text string")
    got = {r["id"]: r["score"] for r in scoring.bm25(spark.createDataFrame([(1, "a b")], "qid int, text string"), docs, "qid", "text", "id", "text").collect()}
    assert got == {1: pytest.approx(0.820970, abs=1e-6), 2: pytest.approx(0.107316, abs=1e-6)}


def test_p_values():
    assert ranking.t_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert ranking.wilcoxon_p(5, 10, 0) == pytest.approx(20 / 1024)  # 10 of 1,024 sign patterns give 5 or less
    assert ranking.wilcoxon_p(0, 0, 0) == 1.0


def test_head_forward():
    import numpy as np

    head = scoring.TemporalHead.random(4, 2, 6, 3)
    x, mask, e = np.random.default_rng(1).normal(size=(2, 5, 4)), np.array([[1, 1, 1, 0, 0], [1, 1, 1, 1, 1]]), np.ones((2, 2))
    mu, std = head.forward(x, mask, e)
    y = x.copy()
    y[0, 3:] = 99  # masked states change nothing
    assert np.allclose(mu, head.forward(y, mask, e)[0]) and (std > 0).all() and mu.shape == (2, 3)
    w = head.w
    for r, n in ((0, 3), (1, 5)):  # directly, a row and a state at a time
        weight = [math.exp(sum(math.tanh(x[r, i] @ w["attend"][:, c] + w["attend_bias"][c]) * w["context"][c] for c in range(4))) for i in range(n)]
        pooled = [sum(weight[i] * x[r, i, c] for i in range(n)) / sum(weight) for c in range(4)]
        h = [sum(v * w["dense"][k, c] for k, v in enumerate([*pooled, *e[r]])) + w["dense_bias"][c] for c in range(6)]
        mean = sum(h) / 6
        spread = math.sqrt(sum((v - mean) ** 2 for v in h) / 6 + 1e-5)
        h = [max(0.0, (v - mean) / spread * w["scale"][c] + w["shift"][c]) for c, v in enumerate(h)]
        assert np.allclose(mu[r], [math.tanh(sum(h[c] * w["mean"][c, o] for c in range(6)) + w["mean_bias"][o]) for o in range(3)])
        assert np.allclose(std[r], [math.exp(0.5 * (sum(h[c] * w["log_var"][c, o] for c in range(6)) + w["log_var_bias"][o])) for o in range(3)])


def test_intervals_ground_in_order(spark):
    rows = spark.range(500).select(datagen.random_interval(7, F.col("id")).alias("e"))
    i = temporal.interval_bounds(F.col("e"))
    assert rows.where(i.isNull() | (i["start"] > i["end"])).count() == 0


def test_answer_normalisation(spark):
    t = F.lit("  Answer: \"The Éclair, an  a-b [3] the\nmore\" ")
    assert spark.range(1).select(text.normalize_answer(text.strip_prediction(t))).first()[0] == "éclair ab"


def test_similarity_formula():
    a, b, c, d = 10, 20, 15, 40
    mu1, v1, mu2, v2 = (a + b + 1) / 2, (b - a + 1) ** 2 / 12, (c + d + 1) / 2, (d - c + 1) ** 2 / 12
    assert 0.5 * math.log(v2 / v1) + (v1 + (mu1 - mu2) ** 2) / (2 * v2) - 0.5 > 0
