"""Benchmark items from raw files by name, the candidates they get, and the items that can be evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .benchmarks import answered, evidence, positions, split_context
from .scoring import bm25

# The mark of a question without an answer, the types that a name may end in, the length of a passage.
UNANSWERABLE = "unanswerable"
TYPES = ("granularity", "counterfactual", "expand", "narrow")
PASSAGE = 400


def settled(items: DataFrame, kind: str | None = None) -> DataFrame:
    """Items whose updated answer is their answer, two nulls included, and isn't the unanswerable mark; of one type if `kind` names it."""
    if kind is not None and kind not in TYPES:
        raise ValueError(f"no type {kind!r}; there are {', '.join(TYPES)}")
    same = F.col("updated_answer").eqNullSafe(F.col("answer")) & ~F.col("updated_answer").eqNullSafe(F.lit(UNANSWERABLE))
    return items.where(same & (F.col("type") == kind) if kind else same)


def _places(paragraphs: Column, is_gold: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(paragraphs, lambda p, i: F.when(is_gold(p), i)), lambda i: i.isNotNull())


def _all_places(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda _, i: i)


def first_answer(items: DataFrame) -> DataFrame:
    """The first text answer as the only paragraph, and gold; items without one fall out."""
    rows = items.where(F.size("text_answers.text") > 0)
    return rows.select("question", F.array(F.get("text_answers.text", F.lit(0))).alias("paragraphs"), F.array(F.lit(0)).alias("answer"))


def context_lines(items: DataFrame) -> DataFrame:
    """A context's lines; gold are those with a right answer and no wrong one."""
    rows = items.select("question", split_context(F.col("fact_context"), F.col("text_answers.text"), F.col("neg_answers")).alias("l"))
    gold = F.filter(F.transform("l", lambda p, i: F.when(p["is_gold"], i)), lambda i: i.isNotNull())
    return rows.select("question", F.transform("l", lambda p: p["paragraph"]).alias("paragraphs"), gold.alias("answer"))


def either_level(items: DataFrame) -> DataFrame:
    """Items with a context by its lines, those without one by their first answer."""
    return context_lines(items.where("fact_context IS NOT NULL")).union(first_answer(items.where("fact_context IS NULL")))


def sentences(items: DataFrame, kind: str | None = None) -> DataFrame:
    """Distinct sentences of all contexts, missing gold ones at the end; gold are those that hold an annotated sentence."""
    def cut(t: Column) -> Column:
        return F.transform(F.split(t, r" \. "), lambda s: text.strip(s))

    gold = cut(F.col("annotated_para"))
    rows = settled(items, kind).select(F.trim("updated_question").alias("question"), gold.alias("gold"), F.array_union(F.flatten(F.transform("context", lambda c: cut(c["text"]))), gold).alias("paragraphs"))
    return rows.select("question", "paragraphs", _places(F.col("paragraphs"), lambda p: F.exists("gold", lambda g: p.contains(g))).alias("answer"))


def passages(items: DataFrame) -> DataFrame:
    """A row for each non-empty answer, with the item's passages."""
    rows = answered(items, "questions", "paras")
    return rows.select("question", F.transform("paras", lambda p: text.prefix(p, PASSAGE)).alias("paragraphs"), F.array("para").alias("answer"))


def positives(items: DataFrame) -> DataFrame:
    """A query's positive texts; the corpus all queries share stays a table of its own."""
    t = F.transform("positive_text", lambda p: text.prefix(p, PASSAGE))
    return items.select(F.col("query").alias("question"), t.alias("paragraphs"), _all_places(t).alias("answer"))


def evidenced(items: DataFrame) -> DataFrame:
    kept = evidence("gold_evidence_1", "gold_evidence_2")
    return items.select("question", kept.alias("paragraphs"), _all_places(kept).alias("answer"))


#: Builders by the start of a benchmark's name, longer starts first.
BUILDERS = {
    "time_sensitive_qa": passages, "temp_reason_l1": first_answer, "temp_reason_l2": context_lines, "temp_rag_eval": evidenced,
    "ts_retriever": positives, "temp_reason": either_level, "menat_qa": sentences,
}


def build(name: str, items: DataFrame) -> DataFrame:
    """question, paragraphs, answer of the benchmark of this name from its raw items."""
    low = name.lower()
    for start, builder in BUILDERS.items():
        if low.startswith(start):
            kind = low.removeprefix(start).strip("_")
            return builder(items, kind or None) if builder is sentences else builder(items)
    raise ValueError(f"no benchmark {name!r}; names start with {', '.join(BUILDERS)}")


def generated_items(items: DataFrame) -> DataFrame:
    """Question-answering items as benchmark items."""
    return items.select("question", "paragraphs", F.col("gold_paragraph_indices").alias("answer"))


def evaluable(candidates: DataFrame, *scores: DataFrame) -> DataFrame:
    """Candidates (item_id, question, paragraph, is_gold) of the items that have a gold paragraph and whose pairs all tables of scores hold."""
    rows, inside = candidates.select("item_id", "question", "paragraph", "is_gold"), F.bool_or("is_gold")
    for k, s in enumerate(scores):
        rows = rows.join(s.select("question", "paragraph").distinct().withColumn(f"in{k}", F.lit(True)), ["question", "paragraph"], "left")
        inside = inside & F.bool_and(F.coalesce(f"in{k}", F.lit(False)))
    return candidates.join(rows.groupBy("item_id").agg(inside.alias("ok")).where("ok").select("item_id"), "item_id", "left_semi")


def fetch_random(paragraphs: Column, key: Column, k: int, seed: int = 42) -> Column:
    """k of the paragraphs by a seeded hash of the key and their places; all of them, in order, if they are k or fewer."""
    drawn = F.array_sort(F.transform(paragraphs, lambda p, i: F.struct(text.uniform(seed, key, i).alias("u"), i.alias("i"), p.alias("p"))))
    return F.when(F.size(paragraphs) <= k, paragraphs).otherwise(F.transform(F.slice(drawn, 1, k), lambda s: s["p"]))


def fetch_bm25(items: DataFrame, key: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """items (key, question, paragraphs). Returns key, place, paragraph: the k best by Okapi BM25 over the item's own paragraphs, earlier ones first
    among ties; all of them, in order, if they are k or fewer. Weights follow `scoring.bm25`, with an item's paragraphs as the corpus."""
    rows = items.select(F.col(key).alias("key"), F.size("paragraphs").alias("n"), F.posexplode("paragraphs").alias("at", "paragraph"))
    words = rows.select("key", "at", "n", text.tokens(F.col("paragraph")).alias("w")).withColumn("dl", F.size("w"))
    sizes = words.groupBy("key").agg(F.avg("dl").alias("avg_dl"))
    index = words.select("key", "at", "n", "dl", F.explode("w").alias("term")).groupBy("key", "at", "n", "dl", "term").agg(F.count("*").alias("tf"))
    df = index.groupBy("key", "n", "term").agg(F.count("*").alias("df"))
    idf = df.select("key", "term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    floor = idf.groupBy("key").agg((epsilon * F.avg("idf")).alias("least"))
    asked = items.select(F.col(key).alias("key"), F.explode(text.tokens(F.col("question"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("qtf"))
    hits = asked.join(idf, ["key", "term"]).join(floor, "key").join(sizes, "key").join(index.drop("n"), ["key", "term"])
    weight = F.when(F.col("idf") < 0, F.col("least")).otherwise(F.col("idf"))
    tf = F.col("tf").cast("double")
    scores = hits.groupBy("key", "at").agg(F.sum(F.col("qtf") * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))).alias("score"))
    rows = rows.join(scores, ["key", "at"], "left").withColumn("s", F.when(F.col("n") <= k, 0.0).otherwise(F.coalesce("score", F.lit(0.0))))
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.col("s").desc(), "at")))
    return placed.where(F.col("place") <= k).select(F.col("key").alias(key), "place", "paragraph")


def best_others(items: DataFrame, scores: DataFrame, own: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """item_id, paragraph, score, rn: each item's n best texts that aren't its own, all of them if they are fewer; ties in the texts' order.

    scores (item_id, paragraph, score) hold pairs that share a word; all others score 0 and aren't listed. An item whose positive scores
    don't fill its n places gets as many texts by their place in the corpus as may stand in the way (its scored and own ones) and it still needs.
    """
    hits = scores.join(own, ["item_id", "paragraph"], "left_anti")
    have = hits.groupBy("item_id").agg(F.count("*").alias("hits"), F.count_if(F.col("score") > 0).alias("good"))
    mine = own.groupBy("item_id").agg(F.count("*").alias("mine"))
    short = items.distinct().join(have, "item_id", "left").join(mine, "item_id", "left").fillna(0, ["hits", "good", "mine"]).where(F.col("good") < n)
    places = short.select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - F.col("good") + F.col("hits") + F.col("mine") - 1)).alias("position"))
    blank = places.join(positions(texts.select("paragraph"), ["paragraph"]), "position").select("item_id", "paragraph")
    blank = blank.join(own, ["item_id", "paragraph"], "left_anti").join(hits.select("item_id", "paragraph"), ["item_id", "paragraph"], "left_anti")
    rows = hits.select("item_id", "paragraph", "score").unionByName(blank.withColumn("score", F.lit(0.0)))
    best = W.partitionBy("item_id").orderBy(F.col("score").desc(), "paragraph")
    return rows.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= n)


def with_negatives(candidates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """candidates (item_id, question, paragraph, is_gold) with negatives, shuffled: item_id, question, idx, paragraph, is_gold.

    0: as they are, without idx; -1: the gold paragraphs and all distinct paragraphs, which is items times texts by definition (`shared_corpus`
    keeps the texts once); above: the gold ones and the n best others by BM25, or all others if they are fewer. Where a text is there
    twice, the first place is the gold one. Anything else is an error.
    """
    if n < -1:
        raise ValueError("negatives: -1 for all paragraphs, 0 for none, or how many by BM25")
    if n == 0:
        return candidates
    gold = candidates.where("is_gold").select("item_id", "question", "paragraph")
    texts, asked = candidates.select("paragraph").distinct(), candidates.select("item_id", "question").distinct()
    if n == -1:
        rest = asked.crossJoin(texts)
    else:
        scores = bm25(asked, texts, "item_id", "question", "paragraph", "paragraph").select(F.col("query_id").alias("item_id"), F.col("id").alias("paragraph"), "score")
        best = best_others(asked.select("item_id"), scores, gold.select("item_id", "paragraph").distinct(), texts, n)
        rest = best.select("item_id", "paragraph").join(asked, "item_id").select("item_id", "question", "paragraph")
    rows = gold.withColumn("own", F.lit(1)).unionByName(rest.withColumn("own", F.lit(0)))
    order = W.partitionBy("item_id").orderBy(text.uniform(seed, F.col("item_id"), F.col("paragraph"), F.col("own")), "paragraph", "own")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1)
    same = W.partitionBy("item_id", "paragraph")
    return rows.select("item_id", "question", "idx", "paragraph", ((F.max("own").over(same) == 1) & (F.col("idx") == F.min("idx").over(same))).alias("is_gold"))
