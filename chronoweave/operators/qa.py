"""Question answering: joining raw answers, and exact match, token F1 and containment."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer, strip_prediction


def _words(t: Column) -> Column:
    return F.filter(F.split(t, " "), lambda w: w != "")


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: one pass over the words of both, sorted, that counts each word's run on either side."""
    def side(x: Column, n: int) -> Column:
        return F.transform(x, lambda w: F.struct(w.alias("w"), F.lit(n).alias("side")))

    def step(s: Column, x: Column) -> Column:
        same = s["w"].eqNullSafe(x["w"])
        left, right = ((x["side"] == k).cast("int") for k in (1, 2))
        return F.struct(
            x["w"].alias("w"), (F.when(same, s["a"]).otherwise(0) + left).alias("a"), (F.when(same, s["b"]).otherwise(0) + right).alias("b"), (s["n"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("n")
        )

    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(F.concat(side(a, 1), side(b, 2))), start, step, lambda s: s["n"] + F.least(s["a"], s["b"]))


def exact_match(prediction: Column, golds: Column) -> Column:
    p = normalize_answer(strip_prediction(prediction))
    return F.exists(golds, lambda g: normalize_answer(g) == p).cast("double")


def f1_score(prediction: Column, golds: Column) -> Column:
    p = _words(normalize_answer(strip_prediction(prediction)))

    def one(g: Column) -> Column:
        w = _words(normalize_answer(g))
        common = _overlap(p, w).cast("double")
        precision, recall = F.try_divide(common, F.size(p)), F.try_divide(common, F.size(w))
        both = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
        return F.when((F.size(p) == 0) | (F.size(w) == 0), (F.size(p) == F.size(w)).cast("double")).otherwise(both)

    return F.coalesce(F.array_max(F.transform(golds, one)), F.lit(0.0))


def containment(prediction: Column, golds: Column) -> Column:
    """An empty answer is contained in everything."""
    p = normalize_answer(strip_prediction(prediction))
    return F.exists(golds, lambda g: F.instr(p, normalize_answer(g)) > 0).cast("double")


def qa_metrics(rows: DataFrame, prediction: str, golds: str) -> DataFrame:
    """em, f1, containment over rows with golds, and the share of rows that have some."""
    p, g = F.col(prediction), F.col(golds)
    has = F.coalesce(F.size(g) > 0, F.lit(False))
    scored = rows.select(has.alias("has"), exact_match(p, g).alias("em"), f1_score(p, g).alias("f1"), containment(p, g).alias("containment"))
    means = [F.coalesce(F.avg(F.when(F.col("has"), F.col(c))), F.lit(0.0)).alias(c) for c in ("em", "f1", "containment")]
    return scored.agg(*means, F.coalesce(F.avg(F.col("has").cast("double")), F.lit(0.0)).alias("answered"))


def attach_answers(items: DataFrame, raw: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """items with gold_answers: all raw answers of the question's exact text, or an empty array."""
    golds = raw.groupBy(question).agg(F.sort_array(F.collect_list(answer)).alias("gold_answers"))
    return items.join(golds, question, "left").withColumn("gold_answers", F.coalesce("gold_answers", F.array().cast("array<string>")))


def generate_answers(prompts: DataFrame, key: str, messages: str, generator: Callable[[list[list[dict]]], list[str]], retries: int = 5) -> DataFrame:
    """key, prediction: the generator, any function from conversations to texts, runs on batches; a failing batch is tried again with growing waits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            talks = [[dict(m) for m in talk] for talk in b[messages]]
            for attempt in range(retries + 1):
                try:
                    yield pd.DataFrame({key: b[key], "prediction": generator(talks)})
                    break
                except OSError:
                    if attempt == retries:
                        raise
                    time.sleep(min(30.0, 0.5 * 2**attempt))

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, messages).mapInPandas(run, f"{key} {kind}, prediction string")


def extract_first(talks: list[list[dict]]) -> list[str]:
    """The generator without a model: the first passage's first sentence."""
    out = []
    for talk in talks:
        passage = talk[-1]["content"].partition("[1] ")[2].partition("\n")[0]
        out.append(passage.partition(". ")[0])
    return out
