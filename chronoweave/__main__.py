"""Command line: python -m chronoweave COMMAND ... Paths are Spark's; master and memory come from spark-submit or the defaults."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions import temporal
from .operators import answering, benchmarks, building, datagen, diagnostics, evaluation, ranking
from .sources import files, reports, results


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronoweave")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, what: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=what)
        for path in paths:
            p.add_argument(path)
        p.add_argument("--seed", type=int, default=42)
        return p

    add("synthetic", "labelled pairs of random expressions", "output").add_argument("--size", type=int, default=400_000)
    add("real-world", "labelled pairs of tagged texts", "input", "output")
    add("relations", "relation phrases with right and wrong months", "output").add_argument("--size", type=int, default=1_000_000)
    add("merge", "tuples of all inputs in one random order", "output").add_argument("inputs", nargs="+")
    add("build", "a benchmark's items from its raw JSON", "name", "input", "output")
    add("tag", "items with val and test splits", "input", "output").add_argument("--val-fraction", type=float, default=0.2)
    for name, what in (("evaluate", "a report of all configured runs"), ("tune", "the best alpha by benchmark"), ("significance", "paired tests of baselines and fusions")):
        p = add(name, what, "config", "caches", "output")
        p.add_argument("--split", default="val" if name == "tune" else "test")
        if name == "tune":
            p.add_argument("--metric", default="mrr")
        if name == "significance":
            p.add_argument("--alpha", type=float, default=0.6)
            p.add_argument("--rounds", type=int, default=10_000)
    for name, what in (("single", "the means of one run"), ("flips", "what a fusion fixes and breaks, with examples"), ("retrievers", "five retrievers, and what years explain"), ("reducible", "how far years alone go")):
        p = add(name, what, "benchmark", "caches", "output")
        p.add_argument("--name", help="the benchmark's name in the caches; by default its last folder")
        p.add_argument("--temporal", default="")
        p.add_argument("--semantic", default="")
        p.add_argument("--split", default=None if name == "single" else "test")
        p.add_argument("--top-k", type=int, default=1 if name == "single" else 5)
        if name != "reducible":
            p.add_argument("--alpha", type=float, default=0.5 if name == "single" else 0.6)
        if name == "single":
            p.add_argument("--metric", default="top")
            p.add_argument("--negatives", type=int, default=0)
            p.add_argument("--tagger", choices=reports.TAGGER_MODES, help="the temporal engine is a tagger's expressions, combined so")
        if name == "flips":
            p.add_argument("--examples", type=int, default=12)
    p = add("answers", "answers generated from retrieved passages", "config", "caches", "raw", "output")
    p.add_argument("--generator", default="chronoweave.operators.qa:extract_first", help="module:function from conversations to texts")
    p.add_argument("--split", default="test")
    p = add("plot", "MRR over alpha of a report, as SVG", "report", "output")
    for option in ("--benchmarks", "--run-types", "--semantic-models"):
        p.add_argument(option, nargs="*")
    return top


def months(spark: SparkSession, size: int, seed: int):
    """size phrases: a month, one to ten years and up to eleven months, either way; those out of the calendar fall out."""
    def u(c: str, n: int):
        return F.floor(datagen.uniform(seed, F.col("id"), F.lit(c)) * n).cast("int")

    first, last = int(datagen.FIRST_DAY[:4]), int(datagen.LAST_DAY[:4])
    rows = spark.range(size).select("id", F.make_date(first + u("year", last - first + 1), 1 + u("month", 12), F.lit(1)).alias("m"), (1 + u("years", 10)).alias("y"), u("months", 12).alias("k"), (u("back", 2) == 0).alias("b"))
    return datagen.relation_phrases(rows, "m", "y", "k", "b")


def _scores(spark: SparkSession, a: argparse.Namespace, engine: str, model: str):
    name = a.name or a.benchmark.rstrip("/").rsplit("/", 1)[-1]
    return files.read_cache(spark, files.cache_path(a.caches, name, engine, model), strict=True)


def single(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the means of one run as JSON."""
    candidates = files.read_benchmark(spark, a.benchmark)
    if a.split:
        candidates = benchmarks.select_split(candidates, a.split)
    kind, model = ("tagger", a.tagger) if a.tagger else ("temporal", a.temporal)
    engines = [_scores(spark, a, e, m) if m else None for e, m in ((kind, model), ("semantic", a.semantic))]
    scored = evaluation.single(building.with_negatives(candidates, a.negatives, a.seed), *engines, a.alpha)
    results.put_json(spark, a.output, evaluation.measured(scored, a.metric, a.top_k).first().asDict())


def diagnose(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the report of flips, of five retrievers, or of years alone."""
    label = a.semantic
    pairs = evaluation.two_engines(files.read_benchmark(spark, a.benchmark), _scores(spark, a, "temporal", a.temporal), _scores(spark, a, "semantic", label), a.split)
    ranked = cut(diagnostics.ranked_pairs(pairs, getattr(a, "alpha", 0.0)))
    found = cut(diagnostics.cases(ranked))
    if a.command == "reducible":
        rows = diagnostics.reducible(diagnostics.matcher_items(found), temporal.question_subtype(F.col("question"))).collect()
        content = results.reducible_markdown([r.asDict() for r in rows], a.name or a.benchmark.rstrip("/").rsplit("/", 1)[-1])
    elif a.command == "retrievers":
        content = results.comparison_markdown([r.asDict() for r in diagnostics.compare(found, a.top_k).collect()], diagnostics.year_evidence(found).first().asDict(), label, a.top_k)
    else:
        shown = diagnostics.with_lists(diagnostics.showcase(found, a.examples), ranked, a.top_k).orderBy("place").collect()
        content = results.flips_markdown(diagnostics.flips(found, a.top_k).first().asDict(), [r.asDict() for r in shown], label, a.alpha, a.top_k)
    results.put_text(spark, a.output, content)


def answers(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the report, measures and predictions of all configured runs; raw: the benchmark's raw JSON. Questions without an answer there count as queries but aren't scored."""
    content = "\n".join(r["value"] for r in spark.read.text(a.config).collect())
    config, given = reports.Config.parse(content), json.loads(content).get("generator", {})
    module, _, function = a.generator.partition(":")
    generator = getattr(importlib.import_module(module), function)
    (benchmark, path), *others = config.benchmarks.items()
    if others:
        raise ValueError("answers are generated for one benchmark")
    candidates = files.read_benchmark(spark, path)
    caches = {m: files.read_cache(spark, files.cache_path(a.caches, benchmark, e, m), strict=True) for e, m in config.engines()}
    scored = cut(evaluation.fused_runs(candidates, caches, config.runs(), a.split))
    raw = files.read_raw_answers(spark, a.raw)
    told = answering.answered(answering.contexts(scored, candidates, config.top_k), generator, given.get("system_prompt") or answering.SYSTEM, int(given.get("max_retries", 5)))
    means = ranking.mean_metrics(ranking.item_metrics(scored.withColumn("rn", ranking.rank_desc(["run_id", "item_id"])), ["run_id", "alpha", "item_id"], config.top_k), ["run_id", "alpha"], ("recall", "mrr", "ndcg"))
    rows = [r.asDict() | {"label": r["run_id"]} for r in means.join(answering.measured(told, raw), "run_id").orderBy("run_id").collect()]
    results.write_answers(spark, a.output, told, rows, json.loads(content), benchmark=benchmark, generator=given.get("model_name_or_path", a.generator), top_k=config.top_k, split=a.split)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "synthetic":
        print(files.write_tuples(datagen.synthetic_pairs(spark, a.size, a.seed), a.output))
    elif a.command == "real-world":
        rows = datagen.tagged_values(files.read_json(spark, a.input, files.TAGGED)).withColumn("id", F.xxhash64("text", "dct"))
        print(files.write_tuples(datagen.document_pairs(rows, a.seed), a.output))
    elif a.command == "relations":
        print(files.write_tuples(datagen.relation_tuples(months(spark, a.size, a.seed), "id", a.seed).drop("id"), a.output))
    elif a.command == "merge":
        rows = datagen.shuffled_union([files.read_tuples(spark, p) for p in a.inputs], ["sent0", "sent0_date", "sent1", "sent1_date"], a.seed)
        print(files.write_tuples(rows.orderBy("position").drop("position"), a.output))
    elif a.command == "build":
        raw = spark.read.option("multiLine", files.is_json_array(spark, a.input)).json(a.input)
        files.write_benchmark(building.build(a.name, raw), a.output)
    elif a.command == "tag":
        items = files.read_items(spark, a.input, files.BENCHMARK).drop("split")
        files.write_benchmark(benchmarks.val_test_split(items, "item_id", a.input, a.val_fraction, a.seed).drop("item_id"), a.output)
    elif a.command == "single":
        single(spark, a)
    elif a.command in ("flips", "retrievers", "reducible"):
        diagnose(spark, a)
    elif a.command == "answers":
        answers(spark, a)
    elif a.command == "plot":
        rows = reports.filter_rows(reports.read_report(spark, a.report), a.benchmarks, a.run_types, a.semantic_models)
        results.put_text(spark, a.output, reports.alpha_svg([r.asDict() for r in rows.collect()]))
    else:
        config = reports.Config.parse("\n".join(r["value"] for r in spark.read.text(a.config).collect()))
        items = evaluation.item_results(spark, config, a.caches, a.split)
        if a.command == "evaluate":
            results.put_text(spark, a.output, reports.report(evaluation.results(items), list(config.benchmarks), config.macro_average))
        elif a.command == "tune":
            results.write_tuning(spark, results.tuned(evaluation.results(items).where("run_type = 'hybrid'"), a.metric), a.output)
        else:
            rows = [r.asDict() for r in evaluation.paired_tests(items, a.alpha, rounds=a.rounds).collect()]
            names = [sorted({r[c] for r in rows}) for c in ("baseline", "metric")]
            results.put_text(spark, a.output, results.significance_markdown(rows, list(config.benchmarks), *names, config.top_k, a.rounds))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run(SparkSession.builder.appName("chronoweave").getOrCreate(), a)


if __name__ == "__main__":
    main()
