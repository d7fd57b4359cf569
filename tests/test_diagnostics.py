"""Diagnoses, generated answers, single runs and configurations in sections, against plain Python."""

import json
import re

import pytest

from chronoweave import __main__ as command
from chronoweave.operators import answering, diagnostics, evaluation
from chronoweave.sources import files, reports

PAIRS = "item_id bigint, idx int, is_gold boolean, question string, paragraph string, t double, s double, nt double, ns double"
YEAR = re.compile(r"\b(1[0-9]{3}|20[0-9]{2})\b")


def pairs(spark, items):
    """items: question, and for each passage its text, whether it is gold, and both scores, which are their own scaled values."""
    return spark.createDataFrame([(i, j, gold, q, p, t, s, t, s) for i, (q, ps) in enumerate(items) for j, (p, gold, t, s) in enumerate(ps)], PAIRS)


ITEMS = [
    ("in 1990?", [("of 1985", False, 0.1, 1.0), ("of 1990", True, 1.0, 0.6), ("of 1990 and 1991", False, 0.0, 0.0)]),
    ("from 1990 to 1995?", [("x", False, 0.0, 1.0), ("of 1993", True, 1.0, 0.5), ("of 1990", False, 0.2, 0.4)]),
    ("when?", [("of 2001", True, 0.0, 1.0), (None, False, 1.0, 0.0)]),
    (None, [("same", True, 0.5, 0.5), ("same", True, 0.5, 0.5)]),
    ("no gold in 1990", [("of 1990", False, 1.0, 1.0)]),
]


def direct(items, alpha):
    out = {}
    for i, (q, ps) in enumerate(items):
        if not any(p[1] for p in ps):
            continue
        asked = {int(y) for y in YEAR.findall(q or "")}
        told = [{int(y) for y in YEAR.findall(p[0] or "")} for p in ps]
        token = [bool(asked & y) for y in told]
        between = [bool(asked) and any(min(asked) <= x <= max(asked) for x in y) for y in told]
        scores = {"semantic": [p[3] for p in ps], "token": [10 * m + p[3] for m, p in zip(token, ps)], "interval": [10 * m + p[3] for m, p in zip(between, ps)]}
        scores |= {"temporal": [p[2] for p in ps], "hybrid": [alpha * p[2] + (1 - alpha) * p[3] for p in ps]}
        ranks = {}
        for name, v in scores.items():
            order = sorted(range(len(ps)), key=lambda j: (-round(v[j], 9), -j))
            ranks[name] = min(order.index(j) + 1 for j, p in enumerate(ps) if p[1])
        first = max(range(len(ps)), key=lambda j: (ps[j][3], j))
        out[i] = (ranks, sum(token), sum(m and p[1] for m, p in zip(token, ps)), any(m and p[1] for m, p in zip(between, ps)), token[first])
    return out


def test_cases_and_what_follows(spark):
    ranked = diagnostics.ranked_pairs(pairs(spark, ITEMS), 0.6)
    found = diagnostics.cases(ranked)
    rows = {r["item_id"]: ({n: r[f"rank_{n}"] for n in diagnostics.RETRIEVERS}, r["n_match"], r["n_gold_match"], r["gold_in_interval"], r["first_matches"]) for r in found.collect()}
    assert rows == direct(ITEMS, 0.6) and set(rows) == {0, 1, 2, 3}
    compared = {r["retriever"]: (r["n"], round(r["mrr"], 6), r["top_1"], r["recall_k"]) for r in diagnostics.compare(found, 1).collect()}
    for name in diagnostics.RETRIEVERS:
        ranks = [x[0][name] for x in rows.values()]
        assert compared[name] == (4, round(sum(1 / r for r in ranks) / 4, 6), sum(r == 1 for r in ranks) / 4, sum(r == 1 for r in ranks) / 4)
    assert diagnostics.year_evidence(found).first().asDict() == {
        "n": 4, "dated": 2, "undated": 2, "gold_lacks_token": 1, "gold_lacks_interval": 0, "wins": 2, "wins_filter_fails": 0, "wins_gold_lacks_interval": 0,
    }
    shown = diagnostics.with_lists(diagnostics.showcase(found), ranked, 2).orderBy("place").collect()
    assert [(r["item_id"], r["distracted"], r["gain"]) for r in shown] == [(0, True, 1), (1, False, 1)]
    assert shown[0]["semantic_best"] == ["of 1985 (1985)", "[gold] of 1990 (1990)"] and shown[0]["hybrid_best"] == ["[gold] of 1990 (1990)", "of 1985 (1985)"]
    assert shown[1]["semantic_best"][0] == "x (no year)"
    flips = diagnostics.flips(found, 2).first().asDict()
    assert (flips["n"], flips["fixed_top1"], flips["broken_top1"], flips["semantic_topk"], flips["hybrid_topk"]) == (4, 2, 1, 4, 4)


def test_no_pairs(spark):
    ranked = diagnostics.ranked_pairs(pairs(spark, ITEMS).where("false"), 0.6)
    found = diagnostics.cases(ranked)
    assert diagnostics.flips(found).first()["n"] == 0 and diagnostics.showcase(found).count() == 0
    assert [(r["n"], r["mrr"]) for r in diagnostics.compare(found).collect()] == [(0, None)] * 5
    assert diagnostics.with_lists(diagnostics.showcase(found), ranked).count() == 0


def test_matcher_of_years_equals_all_orders(spark):
    """The mean over all orders of matches before all orders of the rest."""
    from itertools import permutations

    got = {r["item_id"]: r["mrr_timestamp"] for r in diagnostics.matcher_items(diagnostics.cases(diagnostics.ranked_pairs(pairs(spark, ITEMS), 0.5))).collect()}
    for i, (q, ps) in enumerate(ITEMS[:4]):
        asked = set(YEAR.findall(q or ""))
        match = [bool(asked & set(YEAR.findall(p[0] or ""))) for p in ps]
        values = []
        for a in permutations([j for j in range(len(ps)) if match[j]]):
            for b in permutations([j for j in range(len(ps)) if not match[j]]):
                values.append(1 / (1 + min(n for n, j in enumerate([*a, *b]) if ps[j][1])))
        assert got[i] == pytest.approx(sum(values) / len(values))


def test_single_runs(spark):
    rows = [(0, "q", 0, "a", True, None), (0, "q", 1, "b", False, None), (1, "q", 0, "c", False, None), (1, "q", 1, "a", True, None)]
    candidates = spark.createDataFrame(rows, "item_id bigint, question string, idx int, paragraph string, is_gold boolean, split string")
    t = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 3.0), ("q", "c", 2.0)], files.SCORES)
    s = spark.createDataFrame([("q", "a", 9.0), ("q", "b", 1.0), ("q", "c", 5.0)], files.SCORES)

    def scores(*a):
        return {(r["item_id"], r["idx"]): round(r["score"], 6) for r in evaluation.single(candidates, *a).collect()}

    assert scores(t, None, 0.5) == {(0, 0): 1.0, (0, 1): 3.0, (1, 0): 2.0, (1, 1): 1.0}
    assert scores(t, s, 0.25) == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.75}
    fused = {p: round(0.25 / (60 + rt) + 0.75 / (60 + rs), 6) for p, rt, rs in (("a", 3, 1), ("b", 1, 3), ("c", 2, 2))}
    assert scores(t, s, -0.25) == {(0, 0): fused["a"], (0, 1): fused["b"], (1, 0): fused["c"], (1, 1): fused["a"]}
    assert evaluation.measured(evaluation.single(candidates, t, s, 0.25), "mrr", 1).first().asDict() == {"n_items": 2, "mrr": 1.0}
    assert set(evaluation.measured(evaluation.single(candidates, t, s, 0.25), "all", 1).columns) == {"n_items", "top", "mrr", "ndcg", "precision", "recall", "f1"}
    with pytest.raises(ValueError, match="no metric"):
        evaluation.measured(candidates, "auc", 1)
    with pytest.raises(ValueError, match="semantic lacks"):
        evaluation.single(candidates, t, s.where("paragraph = 'a'"), 0.5).count()
    with pytest.raises(ValueError, match="neither"):
        evaluation.single(candidates, None, None, 0.5)


SECTIONS = {
    "global": {"top_k": 5}, "benchmarks": {"temp_reason": {"enabled": True}, "ts_retriever": {"enabled": False}}, "temporal": {"enabled": True, "model_name": "t"},
    "semantic_baselines": {"enabled": True, "models": ["s", "u"]}, "hybrid": {"enabled": True, "temporal_model_name": "t2", "semantic_models": ["s"], "alphas": [0.5, 1.0]},
    "sutime_hybrid": {"enabled": True, "similarity_mode": "product", "semantic_models": ["u"], "alphas": [0.3]}, "report": {"output_path": "x", "include_macro_average": False},
}


def test_configurations_in_sections():
    c = reports.Config.parse(json.dumps(SECTIONS), "root")
    assert c.benchmarks == {"temp_reason": "root/temp_reason"} and not c.macro_average
    assert [r[0] for r in c.runs()] == ["temporal:t", "semantic:s", "semantic:u", "hybrid:t2+s@0.5", "hybrid:t2+s@1", "tagger_hybrid:product+u@0.3"]
    assert set(c.engines()) == {("temporal", "t"), ("semantic", "s"), ("semantic", "u"), ("temporal", "t2"), ("tagger", "product")}
    for change, told in (
        ({"sutime_hybrid": SECTIONS["sutime_hybrid"] | {"similarity_mode": "sum"}}, "mode"), ({"benchmarks": {"other": {"enabled": True}}}, "unknown"), ({"benchmarks": {}}, "no benchmark"),
        ({"hybrid": {"enabled": True, "semantic_models": []}}, "empty"), ({n: {"enabled": False} for n in ("temporal", "semantic_baselines", "hybrid", "sutime_hybrid")}, "no run"),
    ):
        with pytest.raises(ValueError, match=told):
            reports.Config.parse(json.dumps(SECTIONS | change))
    with pytest.raises(ValueError, match="sections are missing"):
        reports.Config.parse('{"global": {}}')
    answers = {"global": {"top_k": 3}, "retrieval": {"temporal_model_name": "t", "include_temporal_only": True, "baselines": [{"name": "n", "model": "s", "alpha": 0.6}, {"name": "m", "model": "u", "alpha": 0.4}]}}
    c = reports.Config.parse(json.dumps(answers))
    assert c.top_k == 3 and [r[0] for r in c.runs()] == ["temporal:t", "semantic:s", "semantic:u", "hybrid:t+s@0.6", "hybrid:t+u@0.4"]


def test_equal_prompts_are_asked_once(spark, tmp_path):
    marks = str(tmp_path / "marks")
    found = spark.createDataFrame([("r1", 0, "q", [0], ["Paris is"]), ("r2", 0, "q", [0], ["Paris is"]), ("r1", 1, "p", [1], ["Rome"]), ("r2", 1, "p", [2], ["Bonn"])], "run_id string, item_id bigint, question string, places array<int>, passages array<string>")

    def generator(talks):
        with open(marks, "a") as f:
            f.write("x" * len(talks))
        return [re.search(r"\[1\] (\w+)", talk[-1]["content"])[1] for talk in talks]

    got = answering.answered(found, generator)
    golds = spark.createDataFrame([("q", "paris"), ("q", "Lutetia")], "question string, answer string")
    means = {r["run_id"]: (r["num_queries"], r["num_scored"], r["em"], r["f1"]) for r in answering.measured(got, golds).collect()}
    assert means == {"r1": (2, 1, 1.0, 1.0), "r2": (2, 1, 1.0, 1.0)}
    assert {(r["run_id"], r["item_id"]): r["prediction"] for r in got.collect()} == {("r1", 0): "Paris", ("r2", 0): "Paris", ("r1", 1): "Rome", ("r2", 1): "Bonn"}
    assert (tmp_path / "marks").read_text() == "xxx"


def test_commands(spark, tmp_path):
    items = [{"question": f"q{i} in {1990 + i}", "paragraphs": [f"a {1980 + i}. x", f"b {1990 + i}. y", "c"], "answer": [1], "split": "test"} for i in range(8)]
    bench, caches = str(tmp_path / "time_sensitive_qa"), str(tmp_path / "caches")
    (tmp_path / "time_sensitive_qa").write_text(json.dumps(items))
    for engine, model, values in (("temporal", "t", (0.1, 1.0, 0.0)), ("semantic", "s", (1.0, 0.8, 0.0)), ("tagger", "product", (0.0, 1.0, 0.5))):
        files.write_cache(spark.createDataFrame([(x["question"], p, v) for x in items for p, v in zip(x["paragraphs"], values)], files.SCORES), files.cache_path(caches, "time_sensitive_qa", engine, model))
    out = {}
    for name, *options in (("flips",), ("retrievers",), ("reducible",), ("single", "--alpha", "-0.5", "--metric", "all", "--top-k", "2"), ("single", "--tagger", "product", "--alpha", "0.6", "--metric", "mrr")):
        command.main([name, bench, caches, str(tmp_path / "out"), "--temporal", "t", "--semantic", "s", *options])
        out[name, bool(options) and options[0]] = (tmp_path / "out").read_text()
    assert "| Gold@1 | 0.000 (0/8) | 1.000 (8/8) | 8 | 0 |" in out["flips", False] and "- [gold] b 1990. y (1990)" in out["flips", False]
    assert "| Fusion | 1.0000 | 1.000 | 1.000 |" in out["retrievers", False] and "Questions that name a year: 8 of 8 (100.0%)." in out["retrievers", False]
    assert "| time_sensitive_qa | 8 | 100.0% | 1.000 | 1.000 | 0.500 |" in out["reducible", False]
    assert json.loads(out["single", "--alpha"])["n_items"] == 8 and json.loads(out["single", "--tagger"]) == {"n_items": 8, "mrr": 1.0}
    config = {"benchmarks": {"time_sensitive_qa": bench}, "temporal_models": ["t"], "semantic_models": ["s"], "alphas": [0.6]}
    (tmp_path / "config.json").write_text(json.dumps(config))
    (tmp_path / "raw.json").write_text("\n".join(json.dumps({"idx": i, "questions": [[x["question"], [{"answer": f"B {1990 + i}", "para": 0}, {"para": 1}]]]}) for i, x in enumerate(items)))
    command.main(["answers", str(tmp_path / "config.json"), caches, str(tmp_path / "raw.json"), str(tmp_path / "answers")])
    report = (tmp_path / "answers" / "report.md").read_text()
    assert "| hybrid:t+s@0.6 | 0.6 | 8 | 8 | 1.000000 | 1.000000 | 1.000000 | 1.000000 | 1.000000 | 1.000000 |" in report
    assert "| semantic:s | - | 8 | 8 | 1.000000 | 0.500000 |" in report
    assert spark.read.json(str(tmp_path / "answers" / "predictions")).count() == 24
