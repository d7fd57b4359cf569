"""Benchmark builders and negative sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.temporal import month_year_index
from ..functions.text import uniform


def select_split(items: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of the split; all rows where none is tagged; an error where tagged rows have no such split."""
    tagged, matching = items.agg(F.count_if(F.col(column).isNotNull()), F.count_if(F.col(column) == split)).first()
    if not tagged:
        return items
    if not matching:
        raise ValueError(f"no item has split {split!r}")
    return items.where(F.col(column) == split)


def answered(items: DataFrame, questions: str, *keep: str) -> DataFrame:
    """One row per non-empty answer of array<struct<question, answers array<struct<answer, para>>>>."""
    q = items.select(*keep, F.explode(questions).alias("q"))
    return q.select(*keep, F.col("q.question").alias("question"), F.explode("q.answers").alias("a")).select(*keep, "question", "a.answer", "a.para").where("answer <> ''")


def split_context(context: Column, texts: Column, wrong: Column | None = None) -> Column:
    """Lines of a context with whether a right answer and no wrong one is in each."""
    def gold(p: Column) -> Column:
        right = F.exists(texts, lambda t: p.contains(t))
        return right if wrong is None else right & ~F.exists(wrong, lambda t: p.contains(t))

    return F.transform(F.split(context, "\n"), lambda p: F.struct(p.alias("paragraph"), gold(p).alias("is_gold")))


def sentence_set(text: Column, gold: Column) -> Column:
    """Distinct trimmed sentences, missing gold ones at the end."""
    return F.array_union(F.array_distinct(F.transform(F.split(text, r" \. "), lambda s: F.trim(s))), gold)


def shared_corpus(docs: DataFrame, positives: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts of docs with the positives it lacks; queries share it rather than hold copies."""
    return docs.select(text).union(positives.select(text)).distinct()


def gold_index(docs: DataFrame, positives: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The corpus that all queries share, (text, position), and for each query its gold ones: key, gold (ascending positions).

    docs (text), positives (key, text). No query holds a copy of the corpus: a candidate is gold if its position is in the query's array.
    """
    corpus = positions(shared_corpus(docs, positives, text), [text])
    gold = positives.select(key, text).distinct().join(corpus, text).groupBy(key).agg(F.array_sort(F.collect_list("position")).alias("gold"))
    return corpus, gold


def uniform_others(own: DataFrame, texts: DataFrame, take: int, seed: int = 42) -> DataFrame:
    """qid, text, pick: for each question `take` distinct texts at random that aren't its own, all others if they are fewer.

    own (qid, text): a row at least for each question, text null where it has none. Places are drawn in the numbered corpus by a
    seeded hash of question and draw, and drawn again where they are own or taken, so no question meets all texts.
    """
    corpus = positions(texts.select("text").where("text IS NOT NULL").distinct(), ["text"])
    n = corpus.count()
    mine = cut(own.join(corpus, "text", "left").select("qid", "position").distinct())
    asked = mine.groupBy("qid").agg(F.count("position").alias("mine"))
    asked = cut(asked.withColumn("want", F.least(F.lit(take).cast("bigint"), F.lit(n) - F.col("mine"))).where("want > 0"))
    got, first, draws = None, 0, 2 * take + 6
    while True:
        have = asked.withColumn("have", F.lit(0).cast("bigint")) if got is None else asked.join(got.groupBy("qid").agg(F.count("*").alias("have")), "qid", "left").fillna(0, ["have"])
        short = have.where("have < want")
        if short.isEmpty():
            break
        draw = F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1)))
        drawn = short.select("qid", "want", "have", draw.alias("draw"))
        u = uniform(seed, F.col("qid"), F.col("draw")) + uniform(seed + 1, F.col("qid"), F.col("draw")) / 4294967296.0
        drawn = drawn.withColumn("position", F.least(F.floor(u * n), F.lit(n - 1))).groupBy("qid", "want", "have", "position").agg(F.min("draw").alias("draw"))
        drawn = drawn.join(mine.where("position IS NOT NULL"), ["qid", "position"], "left_anti")
        drawn = drawn if got is None else drawn.join(got, ["qid", "position"], "left_anti")
        drawn = drawn.withColumn("pick", F.col("have") + F.row_number().over(W.partitionBy("qid").orderBy("draw"))).where("pick <= want").select("qid", "position", "pick")
        got = cut(drawn if got is None else got.unionByName(drawn))
        first, draws = first + draws, 2 * draws
    empty = asked.select("qid", F.lit(0).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("pick")).where("false")
    return (empty if got is None else got).join(corpus, "position").select("qid", "text", "pick")


def evidence(*columns: str) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `position`, their exact place from 0 on in that order, at any size: counts of range partitions, then a number in each.

    The sorted partitions are written once, with each row's partition and number, and are then counted and read as written: a second
    exchange would have other bounds. All columns come along, whatever they are called; rows that tie in `order` stand in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*[rows[c] for c in rows.columns]).alias("row")
    keys = [f"k{i}" for i in range(len(order))]
    parts = rows.select(whole, *[rows[c].alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    part = F.spark_partition_id()
    parts = cut(parts.select("row", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)).alias("place")))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    numbered = parts.join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return numbered.select("row.*", (F.col("place") + F.col("before")).alias("position"))


def contiguous_splits(rows: DataFrame, order: list[str], fraction: float = 1.0) -> DataFrame:
    """Training tuples by position: the first 90 % train, then, from 98 %, a hundredth each for val and test; the rest none."""
    total = rows.agg(F.floor(F.count("*") * F.lit(fraction)).alias("_n"))
    out = positions(rows, order).crossJoin(F.broadcast(total))
    at, n = F.col("position"), F.col("_n")
    split = F.when(at < F.floor(n * 0.9), "train").when(at < F.floor(n * 0.98), None).when(at < F.floor(n * 0.99), "val").when(at < n, "test")
    return out.withColumn("split", split).drop("_n")


def val_test_split(items: DataFrame, key: str, name: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The first round-half-even(n * fraction) items of a seeded order are val, the rest test."""
    n = items.agg(F.bround(F.count("*") * F.lit(fraction)).cast("bigint").alias("_v"))
    placed = positions(items.withColumn("_u", uniform(seed, F.lit(name), F.col(key))), ["_u", key])
    return placed.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("position") < F.col("_v"), "val").otherwise("test")).drop("_u", "position", "_v")


def nearest_dated(questions: DataFrame, candidates: DataFrame, pool: int = 20, take: int = 5, seed: int = 42) -> DataFrame:
    """Hard negatives: of the `pool` candidate texts nearest in months to the question's date, a seeded `take`.

    questions (qid, question, gold); candidates (text). Texts of the gold's month, and the gold, are left out. Ranks run on
    distinct months, which are few, and only the nearest months' texts are joined. A question without a date takes its texts from all of them at random,
    the gold left out; its ranks are null.
    """
    dated = candidates.select("text", month_year_index(F.col("text")).alias("m")).where("m IS NOT NULL").distinct()
    q = questions.select("qid", "gold", month_year_index(F.col("question")).alias("qm"), month_year_index(F.col("gold")).alias("gm")).where("qm IS NOT NULL")
    months = dated.groupBy("m").agg(F.count("*").alias("c"))
    kinds = q.select("qm", "gm").distinct().join(F.broadcast(months), F.col("gm").isNull() | (F.col("m") != F.col("gm")))
    by = W.partitionBy("qm", "gm").orderBy(F.abs(F.col("m") - F.col("qm")), "m")
    near = kinds.withColumn("before", F.sum("c").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")).where(F.col("before") < pool + 1)
    rows = q.join(near.select(F.col("qm").alias("kq"), F.col("gm").alias("kg"), "m"), (F.col("qm") == F.col("kq")) & F.col("gm").eqNullSafe(F.col("kg"))).join(dated, "m")
    rows = rows.where(F.col("gold").isNull() | (F.col("text") != F.col("gold")))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.abs(F.col("m") - F.col("qm")), "m", "text"))).where(F.col("rank") <= pool)
    pick = F.row_number().over(W.partitionBy("qid").orderBy(uniform(seed, F.col("qid"), F.col("text")), "text"))
    nearest = ranked.withColumn("pick", pick).where(F.col("pick") <= take).select("qid", "text", "rank", "pick")
    undated = questions.where(month_year_index(F.col("question")).isNull()).select("qid", F.col("gold").alias("text"))
    others = uniform_others(undated, candidates, take, seed).select("qid", "text", F.lit(None).cast("int").alias("rank"), F.col("pick").cast("int").alias("pick"))
    return nearest.unionByName(others)


def top_negatives(scores: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """Of scores (query_id, id, score), the n best that aren't positives (query_id, id)."""
    rest = scores.join(positives, ["query_id", "id"], "left_anti")
    return rest.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rn") <= n)


def stage_finetune(train: DataFrame, val: DataFrame, order: str) -> DataFrame:
    """Training rows, then val rows in turn until there are ceil(10 * train / 9): part, position, and the row's order key."""
    def numbered(rows: DataFrame) -> DataFrame:
        return positions(rows.select(F.col(order).alias("key")), ["key"])

    n_t, n_v = train.count(), val.count()
    extra = max(0, -(-10 * n_t // 9) - n_t) if n_v else 0
    tail = train.sparkSession.range(extra).withColumn("i", F.pmod("id", F.lit(max(1, n_v)))).join(numbered(val).withColumnRenamed("position", "i"), "i")
    return numbered(train).select(F.lit("train").alias("part"), "key", "position").union(tail.select(F.lit("val"), "key", F.col("id") + n_t))
