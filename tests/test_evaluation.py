"""Item order of scans, question buckets, incremental caches, exact ranks, resampling, complete negatives, cleaned predictions."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.operators import building, datagen, evaluation, qa, ranking, scoring
from chronoweave.sources import files, reports


@pytest.mark.parametrize("lines", [False, True])
def test_items_keep_their_order_and_repeats(spark, tmp_path, lines):
    items = [{"question": f"q{i % 7}", "paragraphs": ["a", "b"], "answer": [i % 2], "split": None} for i in range(300)]
    items[5] = items[4] = items[3] = {"question": "same", "paragraphs": ["a", "a"], "answer": [1], "split": None}
    folder = tmp_path / "b"
    folder.mkdir()
    for k, part in enumerate((items[:200], items[200:])):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)) if lines else json.dumps(part, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.read_benchmark(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    seen = {(r["item_id"], r["idx"]): (r["question"], r["paragraph"], r["is_gold"]) for r in got}
    assert len(got) == 600 and seen == {(i, j): (x["question"], p, j in x["answer"]) for i, x in enumerate(items) for j, p in enumerate(x["paragraphs"])}


def candidates(spark, items):
    rows = [(i, q, j, p, j in gold, "test") for i, (q, ps, gold) in enumerate(items) for j, p in enumerate(ps)]
    return spark.createDataFrame(rows, "item_id bigint, question string, idx int, paragraph string, is_gold boolean, split string")


RUNS = [("t", "temporal", "T", None, None), ("h", "hybrid", "T", "S", 0.5)]


def test_scores_are_scaled_over_the_question(spark):
    """Three items of one question; by hand the fused scores of a, b, c, d over the bucket are 0.5, 0.35, 0.65, 0.5."""
    items = [("q", ["a", "b"], {0}), ("q", ["c", "d"], {1}), ("q", ["a", "c"], {1})]
    t, s = {"a": 0.0, "b": 5.0, "c": 6.0, "d": 10.0}, {"a": 1.0, "b": 0.2, "c": 0.7, "d": 0.0}
    caches = {m: spark.createDataFrame([("q", p, v) for p, v in x.items()], files.SCORES) for m, x in (("T", t), ("S", s))}
    got = {(r["item_id"], r["idx"]): r["score"] for r in evaluation.fused_runs(candidates(spark, items), caches, RUNS, "test").where("run_id = 'h'").collect()}
    want = {p: round(0.5 * t[p] / 10 + 0.5 * s[p], 9) for p in t}
    assert got == {(i, j): want[p] for i, (_, ps, _) in enumerate(items) for j, p in enumerate(ps)}
    ranked = evaluation.fused_runs(candidates(spark, items), caches, RUNS, "test").withColumn("rn", ranking.rank_desc(["run_id", "item_id"]))
    means = {r["run_id"]: (r["n_items"], round(r["mrr"], 4)) for r in ranking.mean_metrics(ranking.item_metrics(ranked, ["run_id", "item_id"], 5), ["run_id"]).collect()}
    assert means["h"] == (3, 0.8333)


def test_lacking_scores_are_an_error_or_zero(spark):
    items = [("q", ["a", "b"], {0}), ("r", ["a"], {0})]
    whole = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0), ("r", "a", 1.0)], files.SCORES)
    short = whole.where("question = 'q' AND paragraph = 'a'")
    rows = evaluation.fused_runs(candidates(spark, items), {"T": whole, "S": short}, RUNS, "test").where("run_id = 'h'").collect()
    assert {(r["item_id"], r["idx"]): r["score"] for r in rows} == {(0, 0): 0.5, (0, 1): 0.0, (1, 0): 0.0}
    with pytest.raises(ValueError, match="T lacks 2"):
        evaluation.fused_runs(candidates(spark, items), {"T": short, "S": whole}, RUNS, "test")
    with pytest.raises(ValueError, match="S lacks 2"):
        evaluation.fused_runs(candidates(spark, items), {"T": whole, "S": short}, [*RUNS, ("s", "semantic", None, "S", None)], "test")


def test_caches_grow_by_what_they_lack(spark, tmp_path):
    path, parent, asked = str(tmp_path / "own"), str(tmp_path / "parent"), []

    def compute(pairs):
        asked.append(sorted((r["question"], r["paragraph"]) for r in pairs.collect()))
        return pairs.withColumn("score", F.length("paragraph").cast("double"))

    def pairs(*paragraphs):
        return spark.createDataFrame([("q", p) for p in paragraphs], "question string, paragraph string")

    def got(*paragraphs, parent=None):
        return {r["paragraph"]: r["score"] for r in files.cached_scores(spark, path, pairs(*paragraphs), compute, parent).collect()}

    assert got("a", "bb", "bb") == {"a": 1.0, "bb": 2.0} and got("a") == {"a": 1.0}
    files.write_cache(pairs("dddd").withColumn("score", F.lit(9)), parent)
    assert got("a", "ccc", "dddd", parent=parent) == {"a": 1.0, "ccc": 3.0, "dddd": 9.0}
    assert asked == [[("q", "a"), ("q", "bb")], [("q", "ccc")]]
    files.write_cache(pairs("a").withColumn("score", F.lit(0.5)), path, "append")
    assert got("a", "bb") == {"a": 1.0, "bb": 2.0} and got() == {} and len(asked) == 2


def test_ranks_of_many_values(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.zeros(3000), rng.integers(0, 400, 3000), rng.normal(size=1000)])
    g = np.concatenate([np.full(5000, 1), np.full(1999, 2), [3]])
    counts = spark.createDataFrame([(int(k), float(x), n) for (k, x), n in Counter(zip(g.tolist(), v.tolist())).items()], "g int, v double, n bigint")
    got = {(r["g"], r["v"]): r["rank"] for r in ranking.value_ranks(counts, ["g"], "v").collect()}
    for k in (1, 2, 3):
        own = v[g == k]
        assert all(got[k, x] == (own < x).sum() + ((own == x).sum() + 1) / 2 for x in np.unique(own))
    x, y = rng.integers(-9, 9, 500), rng.normal(size=500)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x int, y double")

    def ranks(a):
        return np.array([(a < z).sum() + ((a == z).sum() + 1) / 2 for z in a])

    assert abs(datagen.spearman(rows, "x", "y").first()[0] - 100 * np.corrcoef(ranks(np.abs(x)), ranks(y))[0, 1]) < 1e-9
    plan = ranking.signed_rank(rows.withColumn("g", F.col("x").cast("string")), ["g"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_resampling(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.1, 1, 400)
    rows = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(d)] + [("z", 0, 0.0), ("z", 1, 0.0)], "k string, i int, d double")
    got = {r["k"]: r for r in ranking.bootstrap_ci(rows, "k", "i", rounds=4000).collect()}
    means = d[rng.integers(0, 400, (4000, 400))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert abs(got["m"]["low"] - low) < 0.02 and abs(got["m"]["high"] - high) < 0.02 and abs(got["m"]["mean"] - d.mean()) < 1e-12
    assert (got["z"]["low"], got["z"]["high"]) == (0.0, 0.0)
    again = ranking.bootstrap_ci(rows.repartition(7), "k", "i", rounds=4000).where("k = 'm'").first()
    assert abs(again["low"] - got["m"]["low"]) < 1e-12


def test_negatives_are_complete(spark):
    """n others for every item, by BM25 and then, among texts that score 0, in the corpus's order; against all pairs."""
    rng = np.random.default_rng(4)
    words = ["red", "blue", "car", "tree", "sky", "night", "leaf", "x1", "x2", "x3"]
    texts = sorted({" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(40)})
    rows = [(i, q, t, (i + j) % 11 == 0) for i, q in enumerate(["red car", "nothing here", "x1", "tree tree sky"]) for j, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "item_id int, question string, paragraph string, is_gold boolean")
    asked = items.select("item_id", "question").distinct()
    scores = {(r["query_id"], r["id"]): r["score"] for r in scoring.bm25(asked, items.select("paragraph").distinct(), "item_id", "question", "paragraph", "paragraph").collect()}
    for n in (3, 25, 100):
        got = building.with_negatives(items, n).collect()
        for i in range(4):
            own = {t for k, _, t, g in rows if k == i and g}
            best = sorted((t for t in texts if t not in own), key=lambda t: (-scores.get((i, t), 0.0), t))[:n]
            assert sorted(r["paragraph"] for r in got if r["item_id"] == i and not r["is_gold"]) == sorted(best)


def test_predictions_and_axis(spark):
    shown = {"\nParis": "Paris", "\n\nAnswer: x\ny": "x", ' "a b" \n': "a b", " answer - [1] z [2]\n": "z", "'q'": "q", "": "", " \t\n ": ""}
    rows = spark.createDataFrame(list(shown.items()), "t string, want string")
    assert [tuple(r) for r in rows.where(text.strip_prediction(F.col("t")) != F.col("want")).collect()] == []
    assert rows.select(text.one_line(F.lit("\n a\nb \n"))).first()[0] == "a b"
    assert [round(x, 6) for x in reports.axis([0.5, 0.5])] == [0.45, 0.55] and reports.axis([0.0, 0.0]) == (0.0, 0.05)


def test_multiset_overlap(spark):
    rng = np.random.default_rng(6)
    rows = [([str(x) for x in rng.integers(0, 5, rng.integers(0, 9))], [str(x) for x in rng.integers(0, 5, rng.integers(0, 9))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", qa._overlap(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == sum((Counter(r["a"]) & Counter(r["b"])).values()) for r in got)


def test_random_negatives_are_complete(spark):
    from chronoweave.operators import benchmarks

    texts = spark.createDataFrame([(f"t{i}",) for i in range(12)] + [("t1",), (None,)], "text string")
    own = {q: {f"t{(q + k) % 14}" for k in range(q % 9)} for q in range(40)}
    rows = spark.createDataFrame([(q, t) for q, ts in own.items() for t in ts or [None]], "qid int, text string")
    got = benchmarks.uniform_others(rows, texts, 5).collect()
    for q, ts in own.items():
        mine = [r["text"] for r in got if r["qid"] == q]
        assert len(mine) == len(set(mine)) == min(5, 12 - len({t for t in ts if int(t[1:]) < 12})) and not ts & set(mine)
    assert sorted(map(tuple, benchmarks.uniform_others(rows.repartition(3), texts, 5).collect())) == sorted(map(tuple, got))
    drawn = Counter(r["text"] for r in benchmarks.uniform_others(spark.range(1200).select(F.col("id").alias("qid"), F.lit("t0").alias("text")), texts, 3).collect())
    assert "t0" not in drawn and len(drawn) == 11 and max(drawn.values()) < 1.3 * min(drawn.values())


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    assert len(entry._llm()[0]) == 14 or importlib.util.find_spec("chronoweave.llm") is None
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("chronoweave.llm", "corpus_pipeline")) else found(name, *a))
    assert entry._llm() == ({}, {}) and "ground_any" in entry.queries()


def test_temporal_engine_encodes_each_text_once(spark, tmp_path):
    """One question with two dates takes its first item's; a missing date and paragraphs take the default; every distinct text is encoded once."""
    from pathlib import Path

    from chronoweave.operators import scoring

    items = spark.createDataFrame(
        [(1, "who", "b", "2001-01-01"), (0, "who", "a", "1999-05-05"), (0, "who", "b", "1999-05-05"), (2, "when", "a", None), (3, "a", "a", "no date"), (4, None, "c", None), (5, "void", None, None)],
        "item_id long, question string, paragraph string, reference_date string",
    )
    questions, paragraphs = scoring.anchored_texts(items)
    assert {(r["text"], str(r["anchor"])) for r in questions.collect()} == {("who", "1999-05-05"), ("when", "2021-11-09"), ("a", "2021-11-09"), ("void", "2021-11-09")}
    assert {(r["text"], str(r["anchor"])) for r in paragraphs.collect()} == {(t, "2021-11-09") for t in "abc"}
    log = str(tmp_path)

    def model(texts, days):
        import numpy as np
        import uuid

        Path(log, uuid.uuid4().hex).write_text("\n".join(f"{t}@{d}" for t, d in zip(texts, days)))
        year = np.array([[float(d[:4]) / 1000] for d in days])
        return np.hstack([year, year * 0 + 1]), np.full((len(days), 2), 0.5)

    got = {(r["question"], r["paragraph"]): r["score"] for r in scoring.temporal_similarity(items, scoring.batch_encoder(model), temperature=1.0).collect()}
    seen = sorted(line for f in Path(log).iterdir() for line in f.read_text().split("\n"))
    assert seen == sorted(["who@1999-05-05", "when@2021-11-09", "a@2021-11-09", "void@2021-11-09", *(f"{t}@2021-11-09" for t in "abc")])
    assert set(got) == {("who", "a"), ("who", "b"), ("when", "a"), ("a", "a")} and got["when", "a"] == 1.0
    want = 1 / (1 + (0.022**2 / (2 * 0.25)) / 2)  # variances are equal, so only the first dimension's gap is left
    assert abs(got["who", "a"] - want) < 1e-9
    assert scoring.temporal_similarity(items.where("false"), scoring.batch_encoder(model)).count() == 0
