"""Diagnoses of a fusion: five retrievers by item, what a match of years alone explains, and the flips a report shows.

All start from pairs: item_id, idx, is_gold, question, paragraph, the temporal score t and the semantic score s, and both scaled over
the question's bucket (nt, ns), as `evaluation.two_engines` gives them. Items without gold fall out; an item's rank is that of its
best gold candidate, with later candidates first among ties. A null text names no year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import temporal, text
from . import fusion, ranking

#: The semantic engine, it behind a filter of the question's years or of all years between them, the temporal engine, and the fusion.
RETRIEVERS = ("semantic", "token", "interval", "temporal", "hybrid")


def _years(column: str) -> Column:
    return F.coalesce(temporal.year_tokens(F.col(column)), F.array().cast("array<int>"))


def ranked_pairs(pairs: DataFrame, alpha: float) -> DataFrame:
    """pairs with the years of both texts (asked, told), whether they match by year or by interval, and a rank for each retriever.

    All ranks are windows over the item, so pairs cross one exchange.
    """
    rows = pairs.withColumns({"asked": _years("question"), "told": _years("paragraph")})
    within = F.exists("told", lambda y: y.between(F.array_min("asked"), F.array_max("asked")))
    rows = rows.withColumns({"by_token": F.arrays_overlap("asked", "told"), "by_interval": F.coalesce(within, F.lit(False))})
    ns = F.col("ns")
    scores = (F.col("s"), fusion.oracle(F.col("by_token"), ns), fusion.oracle(F.col("by_interval"), ns), F.col("t"), fusion.linear(F.col("nt"), ns, alpha))
    rows = rows.withColumns({f"score_{r}": F.round(score, 9) for r, score in zip(RETRIEVERS, scores, strict=True)})
    return rows.withColumns({f"rank_{r}": ranking.rank_desc(["item_id"], f"score_{r}") for r in RETRIEVERS})


def cases(ranked: DataFrame) -> DataFrame:
    """A row for each item with gold: its ranks, its years, how many candidates and gold ones match them, and what the semantic engine puts first."""
    gold, token = F.col("is_gold"), F.col("by_token")
    out = ranked.groupBy("item_id").agg(
        F.any_value("question").alias("question"), F.any_value("asked").alias("years"), F.count("*").alias("num_candidates"), F.count_if(gold).alias("n_gold"),
        F.count_if(token).alias("n_match"), F.count_if(gold & token).alias("n_gold_match"), F.bool_or(gold & F.col("by_interval")).alias("gold_in_interval"),
        F.bool_or((F.col("rank_semantic") == 1) & token).alias("first_matches"), *[F.min(F.when(gold, F.col(f"rank_{r}"))).alias(f"rank_{r}") for r in RETRIEVERS],
    )
    return out.where("n_gold > 0").withColumn("gold_matches", F.col("n_gold_match") > 0)


def compare(found: DataFrame, k: int = 5) -> DataFrame:
    """retriever, n, mrr, top_1, recall_k (items with gold among the first k) over cases; one pass and one row a retriever."""
    def means(r: str) -> list[Column]:
        rank = F.col(f"rank_{r}")
        return [F.avg(1 / rank).alias(f"{r}_mrr"), F.avg((rank == 1).cast("int")).alias(f"{r}_top_1"), F.avg((rank <= k).cast("int")).alias(f"{r}_recall_k")]

    one = found.agg(F.count("*").alias("n"), *[c for r in RETRIEVERS for c in means(r)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("retriever"), "n", *[F.col(f"{r}_{m}").alias(m) for m in ("mrr", "top_1", "recall_k")]) for r in RETRIEVERS])))


def year_evidence(found: DataFrame) -> DataFrame:
    """One row: how many questions name a year, how often gold lacks it, and how many of the fusion's wins a filter of years misses."""
    dated, won = F.size("years") > 0, (F.col("rank_hybrid") == 1) & (F.col("rank_semantic") > 1)
    return found.agg(
        F.count("*").alias("n"), F.count_if(dated).alias("dated"), F.count_if(~dated).alias("undated"), F.count_if(dated & ~F.col("gold_matches")).alias("gold_lacks_token"),
        F.count_if(dated & ~F.col("gold_in_interval")).alias("gold_lacks_interval"), F.count_if(won).alias("wins"), F.count_if(won & (F.col("rank_interval") > 1)).alias("wins_filter_fails"),
        F.count_if(won & dated & ~F.col("gold_in_interval")).alias("wins_gold_lacks_interval"),
    )


def flips(found: DataFrame, k: int = 5) -> DataFrame:
    """One row: n, and by first place and by the first k how many items each run gets right, and how many the fusion fixes and breaks."""
    out = [F.count("*").alias("n")]
    for name, place in (("top1", 1), ("topk", k)):
        s, h = F.col("rank_semantic") <= place, F.col("rank_hybrid") <= place
        out += [F.count_if(c).alias(f"{a}_{name}") for a, c in (("semantic", s), ("hybrid", h), ("fixed", ~s & h), ("broken", s & ~h))]
    return found.agg(*out)


def showcase(found: DataFrame, n: int = 12) -> DataFrame:
    """The report's n items that the fusion puts first and the semantic engine doesn't, of dated questions, with their place.

    First those where gold has a year of the question and the semantic engine's first choice has none, then where gold has one, then by gain in rank,
    fewer candidates, and the item's place.
    """
    rows = found.where("rank_hybrid = 1 AND rank_semantic > 1 AND size(years) > 0")
    rows = rows.withColumns({"distracted": F.col("gold_matches") & ~F.col("first_matches"), "gain": F.col("rank_semantic") - F.col("rank_hybrid")})
    order = [F.col("distracted").desc(), F.col("gold_matches").desc(), F.col("gain").desc(), F.col("num_candidates").asc(), F.col("item_id").asc()]
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order)))


def with_lists(shown: DataFrame, ranked: DataFrame, k: int = 5, width: int = 240) -> DataFrame:
    """The shown items with the first k passages of both runs as lines: snippet, years, and a mark on gold."""
    years = F.when(F.size("told") > 0, F.array_join(F.transform("told", lambda y: y.cast("string")), ", ")).otherwise("no year")
    line = F.concat(F.when(F.col("is_gold"), "[gold] ").otherwise(""), text.snippet(F.coalesce("paragraph", F.lit("")), width), F.lit(" ("), years, F.lit(")"))
    rows = ranked.join(shown.select("item_id"), "item_id", "left_semi").where((F.col("rank_semantic") <= k) | (F.col("rank_hybrid") <= k))

    def best(r: str) -> Column:
        rank = F.col(f"rank_{r}")
        return F.transform(F.array_sort(F.collect_list(F.when(rank <= k, F.struct(rank.alias("rank"), line.alias("line"))))), lambda x: x["line"]).alias(f"{r}_best")

    return shown.join(rows.groupBy("item_id").agg(best("semantic"), best("hybrid")), "item_id")


def matcher_items(found: DataFrame) -> DataFrame:
    """Reciprocal ranks by item of a matcher that only sees years (expected, over random order within matches and the rest), the temporal and the semantic engine."""
    top = F.col("n_gold_match") > 0
    n = F.when(top, F.col("n_match")).otherwise(F.col("num_candidates") - F.col("n_match"))
    expected = ranking.expected_reciprocal_rank(n, F.when(top, F.col("n_gold_match")).otherwise(F.col("n_gold")), F.when(top, 0).otherwise(F.col("n_match")))
    return found.select("item_id", "question", "gold_matches", expected.alias("mrr_timestamp"), (1 / F.col("rank_temporal")).alias("mrr_temporal"), (1 / F.col("rank_semantic")).alias("mrr_semantic"))


def reducible(items: DataFrame, subset: Column | None = None) -> DataFrame:
    """subset, n, gold_share and the three mean reciprocal ranks, over all items and by a subset's name, where one is given."""
    names = F.array(F.lit("all")) if subset is None else F.array_compact(F.array(F.lit("all"), subset))
    rows = items.withColumn("subset", F.explode(names))
    means = [F.avg(c).alias(c) for c in ("mrr_timestamp", "mrr_temporal", "mrr_semantic")]
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.avg(F.col("gold_matches").cast("int")).alias("gold_share"), *means)
