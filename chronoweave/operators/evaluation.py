"""Configured evaluations: score caches of all benchmarks and engines, fused into runs, ranked and measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import cache_path, read_benchmark, read_cache
from ..sources.reports import Config
from . import fusion, ranking
from .benchmarks import select_split


def _complete(rows: DataFrame, needed: dict[str, str]) -> None:
    """An error that names the caches (column: name) which lack pairs of rows, and how many."""
    if needed:
        lacks = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first().asDict()
        if any(lacks.values()):
            raise ValueError("no scores for pairs of the benchmark: " + ", ".join(f"{needed[c]} lacks {n}" for c, n in lacks.items() if n))


def fused_runs(candidates: DataFrame, caches: dict[str, DataFrame], runs: list[tuple], split: str) -> DataFrame:
    """item_id, idx, is_gold and a run's columns and score, a row for each run, of candidates (as `files.read_benchmark` gives them).

    Scores are scaled over a question's whole bucket, the distinct paragraphs of all its items of any split, and then go to
    the items of the split. Engines that a run uses alone, and temporal ones always, must have all the split's pairs, else it's
    an error; a pair that only a fusion's semantic side lacks counts 0 there.
    """
    keys = ["question", "paragraph"]
    pairs, columns = candidates.select(*keys).distinct(), {}
    for k, (model, scores) in enumerate(caches.items()):
        pairs = pairs.join(scores.groupBy(*keys).agg(F.max("score").alias(f"engine{k}")), keys, "left")
        columns[model] = f"engine{k}"
    alone = {m for _, _, t, s, alpha in runs for m in ((t, s) if alpha is None else (t,)) if m}
    scaled = fusion.scale_buckets(pairs, list(columns.values()))
    rows = select_split(candidates, split).select("item_id", "idx", "is_gold", *keys).join(scaled, keys)
    _complete(rows, {columns[m]: m for m in caches if m in alone})
    parts = []
    for run_id, kind, temporal, semantic, alpha in runs:
        t, s = (F.coalesce(columns[m], F.lit(0.0)) if m else None for m in (temporal, semantic))
        score = fusion.linear(t, s, alpha) if alpha is not None else t if s is None else s
        parts.append(F.struct(F.lit(run_id).alias("run_id"), F.lit(kind).alias("run_type"), F.lit(temporal).cast("string").alias("temporal_model"), F.lit(semantic).cast("string").alias("semantic_model"), F.lit(alpha).cast("double").alias("alpha"), F.round(score, 9).alias("score")))
    return rows.select("item_id", "idx", "is_gold", F.inline(F.array(*parts)))


def _buckets(candidates: DataFrame, engines: dict[str, DataFrame]) -> DataFrame:
    """The distinct question and paragraph of all items, with each engine's score in the column of its name."""
    keys = ["question", "paragraph"]
    pairs = candidates.select(*keys).distinct()
    for name, scores in engines.items():
        pairs = pairs.join(scores.groupBy(*keys).agg(F.max("score").alias(name)), keys, "left")
    return pairs


def two_engines(candidates: DataFrame, temporal: DataFrame, semantic: DataFrame, split: str) -> DataFrame:
    """Pairs as `diagnostics` takes them: candidates of the split with both engines' scores (t, s), and these scaled over the
    question's whole bucket (nt, ns). A pair of the split that an engine has no score for is an error."""
    scaled = _buckets(candidates, {"t": temporal, "s": semantic}).select("*", *[F.when(F.col(c).isNotNull(), fusion.minmax(F.col(c), "question")).alias(f"n{c}") for c in ("t", "s")])
    rows = select_split(candidates, split).select("item_id", "idx", "is_gold", "question", "paragraph").join(scaled, ["question", "paragraph"])
    _complete(rows, {"t": "temporal", "s": "semantic"})
    return rows


def single(candidates: DataFrame, temporal: DataFrame | None, semantic: DataFrame | None, alpha: float, split: str | None = None) -> DataFrame:
    """item_id, idx, is_gold, score of one run: an engine alone, or both fused over the question's bucket: linearly at alpha, or for a
    negative one by reciprocal ranks at its size. A pair without a score is an error."""
    engines = {n: x for n, x in (("temporal", temporal), ("semantic", semantic)) if x is not None}
    if not engines:
        raise ValueError("neither a temporal nor a semantic engine is given")
    if not -1 <= alpha <= 1:
        raise ValueError(f"alpha must lie between -1 and 1: {alpha}")
    t, s = F.col("temporal"), F.col("semantic")
    if len(engines) == 1:
        score = F.col(next(iter(engines)))
    elif alpha < 0:
        score = fusion.reciprocal_rank(t, s, ["question"], -alpha)
    else:
        score = fusion.linear(fusion.minmax(t, "question"), fusion.minmax(s, "question"), float(alpha))
    pairs = _buckets(candidates, engines).withColumn("score", F.round(score, 9))
    rows = (select_split(candidates, split) if split else candidates).join(pairs, ["question", "paragraph"])
    _complete(rows, {n: n for n in engines})
    return rows.select("item_id", "idx", "is_gold", "score")


def measured(scored: DataFrame, metric: str, k: int) -> DataFrame:
    """One row of means over items: the metric, or every one for "all"."""
    if metric != "all" and metric not in ranking.METRICS:
        raise ValueError(f"no metric {metric!r}; there are all, {', '.join(ranking.METRICS)}")
    items = ranking.item_metrics(scored.withColumn("rn", ranking.rank_desc(["item_id"])), ["item_id"], k)
    return ranking.mean_metrics(items, [], ranking.METRICS if metric == "all" else (metric,))


def _runs_of(spark: SparkSession, config: Config, caches: str, benchmark: str, path: str, split: str) -> DataFrame:
    found = {m: read_cache(spark, cache_path(caches, benchmark, e, m), strict=True) for e, m in config.engines()}
    rows = fused_runs(read_benchmark(spark, path), found, config.runs(), split)
    return rows.select(F.lit(benchmark).alias("benchmark"), *rows.columns)


def item_results(spark: SparkSession, config: Config, caches: str, split: str = "test") -> DataFrame:
    """benchmark, run columns, item_id and all metrics of every run over all items of the split. A cache that is missing, or lacks pairs, is an error."""
    rows = reduce(DataFrame.union, [_runs_of(spark, config, caches, b, p, split) for b, p in config.benchmarks.items()])
    by = ["benchmark", "run_id", "run_type", "temporal_model", "semantic_model", "alpha", "item_id"]
    ranked = rows.withColumn("rn", ranking.rank_desc(["benchmark", "run_id", "item_id"]))
    return ranking.item_metrics(ranked, by, config.top_k)


def results(items: DataFrame) -> DataFrame:
    """The report's rows: means of item results by run and benchmark."""
    by = ["run_id", "run_type", "temporal_model", "semantic_model", "alpha", "benchmark"]
    return ranking.mean_metrics(items, by, ("mrr", "ndcg", "recall", "precision")).withColumnRenamed("n_items", "num_queries")


def paired_tests(items: DataFrame, alpha: float, metrics: tuple[str, ...] = ("mrr", "ndcg", "recall"), rounds: int = 10_000) -> DataFrame:
    """Each semantic run against its fusions at one alpha: counts, means, interval and p-values by benchmark, baseline and metric."""
    spread = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    rows = items.select("benchmark", "semantic_model", "temporal_model", "run_type", "alpha", "item_id", spread)
    base = rows.where("run_type = 'semantic'").select("benchmark", "semantic_model", "item_id", "metric", F.col("v").alias("b"))
    both = rows.where((F.col("run_type") == "hybrid") & (F.col("alpha") == alpha)).withColumnRenamed("v", "a").join(base, ["benchmark", "semantic_model", "item_id", "metric"])
    both = both.select("benchmark", "item_id", F.concat_ws("+", "semantic_model", "temporal_model").alias("baseline"), "metric", "a", "b", F.round(F.col("a") - F.col("b"), 9).alias("d")).withColumn("key", F.concat_ws("\x1f", "benchmark", "baseline", "metric"))
    d = F.col("d")
    means = both.groupBy("key", "benchmark", "baseline", "metric").agg(
        F.count("*").alias("n"), F.avg("b").alias("mean_baseline"), F.avg("a").alias("mean_hybrid"), F.avg("d").alias("mean_diff"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"),
        F.count_if(d == 0).alias("ties"), F.coalesce(F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))), F.lit(0.0)).alias("t"),
    )
    signed = ranking.signed_rank(both, ["key"]).withColumnRenamed("ties", "tied")
    tests = means.select("key", "n", "t").join(signed, "key", "left").fillna(0).withColumnRenamed("tied", "ties")
    tests = ranking.p_values(tests).select("key", "p_wilcoxon", "p_t")
    return means.join(ranking.bootstrap_ci(both, "key", "item_id", rounds=rounds).select("key", "low", "high"), "key").join(tests, "key").drop("key", "t")
