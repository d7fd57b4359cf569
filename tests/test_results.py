"""Report files, the command line on small benchmarks, negatives, and close expressions."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave import __main__ as command
from chronoweave.functions.temporal import ground, offset_kind
from chronoweave.operators import building, datagen
from chronoweave.sources import files, results


def test_small_formats(spark, tmp_path):
    assert [results.rate_text(n, 2) for n in (4_000_000, 5_000, 10)] == ["2,000,000 rows/s", "2,500 rows/s", "5 rows/s"] and results.rate_text(1, 0) == "-"
    assert [results.duration_text(s) for s in (3725, 65, 5.9, -1)] == ["1:02:05", "0:01:05", "0:00:06", "0:00:00"]
    assert [results.p_text(p) for p in (0.0, 1e-5, 0.04, None)] == ["0", "1.000e-05", "0.04", "-"] and [results.stars(p) for p in (1e-4, 0.004, 0.04, 0.4, None)] == ["***", "**", "*", "ns", "n/a"]
    assert results.slug("hybrid: a/b @0.5") == "hybrid_a_b_0.5" and results.slug("//") == "run"
    assert results.benchmark_path("r/", "menat_qa") == "r/menat_qa" and results.benchmark_path("r", "x/y.json") == "x/y.json"
    rows = [{"run_id": "b", "alpha": None, "benchmark": "z"}, {"run_id": "a", "alpha": 0.3, "benchmark": "menat_qa"}, {"run_id": "b", "alpha": 0.1, "benchmark": "z"}]
    assert results.alpha_domain(rows) == [0.1, 0.3] and len(results.alpha_domain(rows[:1])) == 9
    assert results.benchmark_order(rows) == ["menat_qa", "z"] and {k: len(v) for k, v in results.by_run(rows).items()} == {"b": 2, "a": 1}
    folder = str(tmp_path / "f")
    results.put_json(spark, f"{folder}/a.json", {"é": 1})
    assert json.loads((tmp_path / "f" / "a.json").read_text()) == {"é": 1}
    results.clear_folder(spark, folder)
    assert [p for p in (tmp_path / "f").iterdir() if not p.name.endswith(".crc")] == []


def test_flips_and_answers(spark, tmp_path):
    stats = {"n": 4, **{f"{r}_{c}": i for i, (r, c) in enumerate((r, c) for r in ("semantic", "hybrid", "fixed", "broken") for c in ("top1", "topk"))}}
    example = {"question": "Q?", "years": [1999], "num_candidates": 3, "rank_semantic": 2, "rank_temporal": 1, "rank_hybrid": 1, "semantic_best": ["s"], "hybrid_best": ["h"]}
    shown = results.flips_markdown(stats, [example], "base", 0.6)
    assert "| Gold@1 | 0.000 (0/4) | 0.500 (2/4) | 4 | 6 |" in shown and "alone 2, temporal 1, fused 1" in shown and "- h" in shown
    row = {"label": "base @1", "alpha": None, "num_queries": 2, "num_scored": 2, "recall": 0.5, "mrr": 0.5, "ndcg": 0.5, "em": 0.0, "f1": 0.25, "containment": 1.0}
    predictions = spark.createDataFrame([("base @1", 1, "p")], "run_id string, item int, prediction string")
    results.write_answers(spark, str(tmp_path), predictions, [row], {"top_k": 5}, benchmark="b", generator="g", top_k=5, split="test")
    assert "| base @1 | - | 2 | 2 | 0.500000 |" in (tmp_path / "report.md").read_text() and json.loads((tmp_path / "metrics" / "base_1.json").read_text())["f1"] == 0.25
    assert spark.read.json(str(tmp_path / "predictions")).first()["prediction"] == "p"


def test_builders(spark):
    raw = spark.createDataFrame([(" q ", "a", "a", "narrow", [("x 1 . y . y",)], "y . z"), ("r", "a", "b", "narrow", [("x",)], "x")], "updated_question string, updated_answer string, answer string, type string, context array<struct<text string>>, annotated_para string")
    assert [tuple(r) for r in building.build("menat_qa_narrow", raw).collect()] == [("q", ["x 1", "y", "z"], [1, 2])]
    assert building.build("menat_qa_expand", raw).count() == 0
    lines = spark.createDataFrame([("q", "a 1\nb 1\na 2", (["a"],), ["2"]), ("r", None, (["t", "u"],), None)], "question string, fact_context string, text_answers struct<text array<string>>, neg_answers array<string>")
    assert sorted(tuple(r) for r in building.build("temp_reason", lines).collect()) == [("q", ["a 1", "b 1", "a 2"], [0]), ("r", ["t"], [0])]
    for wrong in ("other", "menat_qa_wide"):
        with pytest.raises(ValueError):
            building.build(wrong, raw)


def test_negatives(spark):
    rows = [(1, "red car", "a red car", True), (1, "red car", "blue sky", False), (2, "tall tree", "the tall tree", True), (2, "tall tree", "red leaf", False)]
    items = spark.createDataFrame(rows, "item_id int, question string, paragraph string, is_gold boolean")
    got = building.with_negatives(items, 1).collect()  # a word in half of the texts weighs 0, so all others tie
    assert {(r["item_id"], r["paragraph"]): r["is_gold"] for r in got} == {(1, "a red car"): True, (1, "blue sky"): False, (2, "the tall tree"): True, (2, "a red car"): False}
    whole = building.with_negatives(items, -1).collect()
    assert len(whole) == 2 * 5 and sum(r["is_gold"] for r in whole) == 2 and sorted(r["idx"] for r in whole if r["item_id"] == 1) == [0, 1, 2, 3, 4]
    assert building.with_negatives(items, 0) is items
    with pytest.raises(ValueError):
        building.with_negatives(items, -2)


def test_fetch_bm25_follows_the_corpus_engine(spark):
    from chronoweave.operators.scoring import bm25

    texts = ["red car red", "blue car", "tall tree", "red sky at night", "car"]
    items = spark.createDataFrame([(1, "red car", texts), (2, "red", texts[:2])], "i int, question string, paragraphs array<string>")
    got = {(r["i"], r["place"]): r["paragraph"] for r in building.fetch_bm25(items, "i", 3).collect()}
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    scores = {r["id"]: r["score"] for r in bm25(items.where("i = 1"), docs, "i", "question", "id", "text").collect()}
    best = sorted(range(5), key=lambda k: (-scores.get(k, 0.0), k))[:3]
    assert [got[1, p] for p in (1, 2, 3)] == [texts[k] for k in best] and [got[2, p] for p in (1, 2)] == texts[:2] and len(got) == 5


def test_close_expressions(spark):
    forms = ["1987", "1987-05", "1980s-mid", "2001-02-03,2003-04", "OFFSET P-3D", "THIS P2W OFFSET P-2W", "THIS P4M", "PREV_IMMEDIATE P1Y", "THIS NI", "nothing"]
    rows = spark.range(40).crossJoin(spark.createDataFrame([(f,) for f in forms], "e string")).withColumn("a", F.lit("2005-06-07").cast("date"))
    key = F.concat_ws("/", "id", "e")
    got = datagen.close_expressions(rows.withColumn("k", key), "e", "a", "k", 3)
    got = datagen.fixed(got, g=ground(F.col("close"), F.col("a"))).cache()
    assert {r["e"] for r in got.where("g IS NULL").collect()} == {"nothing"}
    years = got.where("e IN ('1987', '1987-05')").agg(F.min("g.start"), F.max("g.end")).first()
    assert years[0].year >= 1980 and years[1].year <= 1989
    offsets = datagen.fixed(rows.where("e LIKE '% P%'"), c=datagen.close_offset(3, key, F.col("e")))
    offsets = datagen.fixed(offsets, x=offset_kind(F.col("e")), y=offset_kind(F.col("c"))).cache()
    assert offsets.where("x IS NULL OR y IS NULL OR x != y").count() == 0
    assert {r["c"] for r in offsets.where("e = 'OFFSET P-3D'").collect()} == {f"OFFSET P-{n}D" for n in range(1, 8)}


def test_relation_tuples(spark):
    got = datagen.relation_tuples(command.months(spark, 200, 42), "id").toPandas()
    sizes = got.groupby("id")
    assert (sizes.size() == 5).all() and (sizes["sent1"].nunique() == 5).all() and (sizes["score"].max() == 1.0).all() and got["score"].between(0, 1).all()


def test_command_line(spark, tmp_path):
    items = [{"question": f"q{i}", "paragraphs": [f"p{i}a", f"p{i}b", f"p{i}c"], "answer": [i % 3]} for i in range(12)]
    raw, tagged, caches = str(tmp_path / "raw.json"), str(tmp_path / "tagged"), str(tmp_path / "caches")
    (tmp_path / "raw.json").write_text(json.dumps(items))
    command.main(["tag", raw, tagged, "--val-fraction", "0.25"])
    assert {r["split"]: r["count"] for r in spark.read.json(tagged).groupBy("split").count().collect()} == {"val": 3, "test": 9}
    for engine, model, right in (("temporal", "t", 1.0), ("semantic", "s", 0.4)):
        scores = [(x["question"], p, right if j in x["answer"] else 0.5 - 0.1 * j) for x in items for j, p in enumerate(x["paragraphs"])]
        files.write_cache(spark.createDataFrame(scores, files.SCORES), files.cache_path(caches, "b", engine, model))
    (tmp_path / "config.json").write_text(json.dumps({"benchmarks": {"b": tagged}, "temporal_models": ["t"], "semantic_models": ["s"], "alphas": [0.2, 0.8]}, indent=1))
    config = str(tmp_path / "config.json")
    for name in ("evaluate", "tune", "significance"):
        command.main([name, config, caches, str(tmp_path / name), *(["--alpha", "0.8", "--rounds", "100"] if name == "significance" else [])])
    report = (tmp_path / "evaluate").read_text()
    assert "| temporal:t | temporal | t | - | - | b | 9 | 1.000000 |" in report and "hybrid:t+s@0.8" in report
    found = json.loads((tmp_path / "tune.json").read_text())["b"]
    assert found["num_val_queries"] == 3 and set(found["mean_by_alpha"]) == {"0.2", "0.8"} and "Best" in (tmp_path / "tune.md").read_text()
    assert "## b (9 queries)" in (tmp_path / "significance").read_text()
    command.main(["plot", str(tmp_path / "evaluate"), str(tmp_path / "plot.svg")])
    assert (tmp_path / "plot.svg").read_text().startswith("<svg")
