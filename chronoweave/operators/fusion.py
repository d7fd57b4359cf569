"""Normalising and fusing scores per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def minmax(score: Column, *by: str) -> Column:
    """Scaled to [0, 1] over the question's candidates; all 0 where the range is."""
    w = W.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 0.0).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def scale_buckets(rows: DataFrame, scores: list[str], question: str = "question", paragraph: str = "paragraph") -> DataFrame:
    """question, paragraph, scores: each scaled over the distinct paragraphs of all items that ask the question. Null scores stay null and don't count;
    where a pair has several, the largest counts. Items get theirs back by a join on the pair."""
    pairs = rows.groupBy(question, paragraph).agg(*[F.max(s).alias(s) for s in scores])
    return pairs.select(question, paragraph, *[F.when(F.col(s).isNotNull(), minmax(F.col(s), question)).alias(s) for s in scores])


def fuse_left(temporal: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """All temporal scores with the semantic ones, 0 where there is none."""
    s = semantic.withColumnRenamed("score", "semantic")
    return temporal.withColumnRenamed("score", "temporal").join(s, keys, "left").fillna(0.0, ["semantic"])


def restricted(pairs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """A cache's scores (keys, score) of just these pairs; 0 for those it lacks. Repeated entries of the cache count once."""
    return pairs.join(cache.groupBy(*keys).agg(F.max("score").alias("score")), keys, "left").fillna(0.0, ["score"])


def linear(temporal: Column, semantic: Column, alpha: Column | float) -> Column:
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return alpha * temporal + (1 - alpha) * semantic


def reciprocal_rank(temporal: Column, semantic: Column, by: list[str], alpha: float = 0.5, k: int = 60) -> Column:
    """Fusion of smallest ranks among ties."""
    rt = F.rank().over(W.partitionBy(*by).orderBy(temporal.desc()))
    rs = F.rank().over(W.partitionBy(*by).orderBy(semantic.desc()))
    return alpha / (k + rt) + (1 - alpha) / (k + rs)


def oracle(match: Column, normalized: Column) -> Column:
    """Matches first, then by the normalised score."""
    return F.when(match, 10.0).otherwise(0.0) + normalized


def uncovered(pairs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that a cache of scores lacks."""
    return pairs.join(scores, keys, "left_anti")


def covers(pairs: DataFrame, scores: DataFrame, keys: list[str]) -> bool:
    return uncovered(pairs, scores, keys).isEmpty()
