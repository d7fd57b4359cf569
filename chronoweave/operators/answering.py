"""Answers from retrieved passages: prompts of every run's first passages, generated once each, and measured by run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import text
from . import qa, ranking

# Fixed value: the instruction where a configuration gives none.
SYSTEM = "Answer the question from the passages, in as few words as possible."


def contexts(scored: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """run_id, item_id, question, places, passages: the first k candidates of each run and item, the earlier one first among ties.

    scored: run_id, item_id, idx, score; candidates: item_id, idx, question, paragraph. Scores are cut to k before texts are joined.
    """
    best = ranking.top_k(scored.select("run_id", "item_id", "idx", "score"), ["run_id", "item_id"], k)
    rows = best.join(candidates.select("item_id", "idx", "question", "paragraph"), ["item_id", "idx"])
    listed = F.array_sort(F.collect_list(F.struct("rn", "idx", "paragraph")))
    rows = rows.groupBy("run_id", "item_id").agg(F.any_value("question").alias("question"), listed.alias("best"))
    return rows.select("run_id", "item_id", "question", F.col("best.idx").alias("places"), F.col("best.paragraph").alias("passages"))


def answered(found: DataFrame, generator: Callable[[list[list[dict]]], list[str]], system: str = SYSTEM, retries: int = 5) -> DataFrame:
    """contexts with `prediction`. Runs that retrieve the same passages in the same order share one call, and the calls' results are
    written before they are used, so that no later job asks the generator again."""
    asked = found.withColumn("messages", text.prompt(F.col("question"), F.col("passages"), system)).withColumn("call", F.sha2(F.to_json("messages"), 256))
    calls = asked.groupBy("call").agg(F.any_value("messages").alias("messages"))
    told = cut(qa.generate_answers(calls, "call", "messages", generator, retries))
    return asked.join(told, "call").drop("call", "messages")


def measured(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """run_id, num_queries, num_scored (items with gold answers) and the means of em, f1 and containment over those; 0 where there are none.

    golds: question, answer, a row for each; `predictions` may have any columns beside run_id, question and prediction.
    """
    rows = qa.attach_answers(predictions.select("run_id", "question", "prediction"), golds)
    p, g = F.col("prediction"), F.col("gold_answers")
    rows = rows.select("run_id", (F.size(g) > 0).alias("has"), qa.exact_match(p, g).alias("em"), qa.f1_score(p, g).alias("f1"), qa.containment(p, g).alias("containment"))
    means = [F.coalesce(F.avg(F.when(F.col("has"), F.col(c))), F.lit(0.0)).alias(c) for c in ("em", "f1", "containment")]
    return rows.groupBy("run_id").agg(F.count("*").alias("num_queries"), F.count_if("has").alias("num_scored"), *means)
