"""Readers and writers of benchmark JSON, training tuples, tagged corpora and score caches."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut

BENCHMARK = "question string, paragraphs array<string>, answer array<int>, split string, reference_date string"
TUPLES = "sent0 string, sent0_date string, sent1 string, sent1_date string, score double"
TAGGED = "text string, timex3 array<struct<value string, rulename string>>, meta_data struct<dct string>"
CONTEXTS = "question string, fact_context string, text_answers struct<text array<string>>, neg_answers array<string>"
QUERIES = "query string, positive_text array<string>"
EVIDENCE = "question string, gold_evidence_1 string, gold_evidence_2 string"
SCORES = "question string, paragraph string, score double"


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't blank opens an array; the file is read by Spark alone."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    return bool(first) and first["value"].lstrip().startswith("[")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or one object a line."""
    return spark.read.schema(schema).option("multiLine", is_json_array(spark, path)).json(path)


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or one object a line, with item_id: the object's place, from 0, in the files by path and in each file.

    A block of a file is read by one task in the file's order, so (path, block, number in the task) is an order over all objects.
    Equal objects stay apart.
    """
    from ..operators.benchmarks import positions

    rows = read_json(spark, path, schema)
    own = rows.columns
    rows = rows.select(F.struct(*own).alias("item"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return positions(rows, ["path", "block", "row"]).select(F.col("position").alias("item_id"), "item.*")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Flat candidates: item_id (the item's place), question, idx, paragraph, is_gold, split, reference_date."""
    items = read_items(spark, path, BENCHMARK)
    flat = items.select("item_id", "question", "answer", "split", "reference_date", F.posexplode("paragraphs").alias("idx", "paragraph"))
    return flat.select("item_id", "question", "idx", "paragraph", F.coalesce(F.array_contains("answer", F.col("idx")), F.lit(False)).alias("is_gold"), "split", "reference_date")


def write_benchmark(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def fraction(rows: DataFrame, order: list[str], low: float, high: float) -> DataFrame:
    """Rows by position, from low to high as shares of all."""
    from ..operators.benchmarks import contiguous_splits

    n = rows.count()
    placed = contiguous_splits(rows, order).drop("split")
    return placed.where((F.col("position") >= int(n * low)) & (F.col("position") < int(n * high))).drop("position")


def read_tuples(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(TUPLES).option("header", True).option("escape", '"').csv(list(paths))


def write_tuples(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes the tuples; returns how many there are and how many score above 0.9."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    n, high = read_tuples(rows.sparkSession, path).agg(F.count("*"), F.count_if(F.col("score") > 0.9)).first()
    return {"rows": n, "similar": high}


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Bytes that aren't UTF-8 become replacement characters."""
    return spark.read.schema(EVIDENCE).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_raw_answers(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, a row for each answer of raw items, whose `questions` pair a text with spans that may hold an answer."""
    pairs = read_json(spark, path, "questions array<array<string>>").select(F.explode("questions").alias("q"))
    spans = F.from_json(F.get("q", F.lit(1)), "array<struct<answer string>>")
    return pairs.select(F.get("q", F.lit(0)).alias("question"), F.explode(spans).alias("span")).select("question", F.col("span.answer").alias("answer")).where(F.col("answer").isNotNull())


def cache_path(root: str, benchmark: str, engine: str, model: str) -> str:
    """Folder of an engine's scores; "-full" at a benchmark's end names the same folder."""
    return f"{root}/benchmark={benchmark.removesuffix('-full')}/engine={engine}/model={re.sub(r'[^A-Za-z0-9._-]+', '_', model)}"


def write_cache(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    scores.select("question", "paragraph", F.col("score").cast("double").alias("score")).write.mode(mode).parquet(path)


def read_cache(spark: SparkSession, path: str, strict: bool = False) -> DataFrame | None:
    """Scores, or None where there is no such folder or it has other columns; strict: an error instead. Any other fault is raised."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if strict or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if {"question", "paragraph", "score"} <= set(found.columns):
        return found.select("question", "paragraph", F.col("score").cast("double").alias("score"))
    if strict:
        raise ValueError(f"{path} holds {found.columns}, not scores")
    return None


def cached_scores(spark: SparkSession, path: str, pairs: DataFrame, compute: Callable[[DataFrame], DataFrame], parent: str | None = None) -> DataFrame:
    """Scores of pairs (question, paragraph): the cache's, else the parent's, else computed.

    Only pairs that neither holds are computed, and are appended to the cache as a new part. Where parts of a cache repeat
    a pair its largest score counts, so writers that overlap do no harm. A pair for which `compute` returns nothing has no score.
    """
    keys = ["question", "paragraph"]
    asked = cut(pairs.select(*keys).distinct())

    def held(place: str | None, among: DataFrame) -> DataFrame | None:
        found = read_cache(spark, place) if place else None
        return None if found is None else found.join(among, keys, "left_semi").groupBy(*keys).agg(F.max("score").alias("score"))

    own, told = held(path, asked), []
    rest = asked if own is None else asked.join(own, keys, "left_anti")
    inherited = held(parent, rest)
    if inherited is not None:
        told.append(cut(inherited))
        rest = rest.join(told[0], keys, "left_anti")
    rest = cut(rest)
    if not rest.isEmpty():
        write_cache(compute(rest), path, "append")
    own = held(path, asked)
    told = told if own is None else [own, *told]
    return reduce(DataFrame.unionByName, told) if told else asked.withColumn("score", F.lit(None).cast("double")).where("false")
