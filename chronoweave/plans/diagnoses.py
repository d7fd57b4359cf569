"""Queries that diagnose a fusion: five retrievers, evidence of years, a matcher of years, and the flips of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import gaussian, temporal
from ..operators import diagnostics, fusion
from .base import SCALED, query
from .temporal import candidates

#: SQL: the candidates with years. A fifth of the questions names none, the others their own year and, of a closed range, a later one.
_CASES_SQL = f"""WITH {SCALED},
y AS (SELECT nm.*, q % 5 <> 0 AS dated, year(DATE '1000-01-01' + qa::INT) AS qy, year(DATE '1000-01-01' + qa::INT) + q % 3 AS qz, year(DATE '1000-01-01' + pa::INT) AS py FROM nm JOIN cand USING (q, idx)),
m AS (SELECT *, dated AND py IN (qy, qz) AS tok, dated AND py BETWEEN qy AND qz AS itv FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, idx DESC) AS r_semantic, row_number() OVER (PARTITION BY q ORDER BY round(tok::INT * 10 + ns, 9) DESC, idx DESC) AS r_token,
  row_number() OVER (PARTITION BY q ORDER BY round(itv::INT * 10 + ns, 9) DESC, idx DESC) AS r_interval, row_number() OVER (PARTITION BY q ORDER BY round(t, 9) DESC, idx DESC) AS r_temporal,
  row_number() OVER (PARTITION BY q ORDER BY round(0.6 * nt + 0.4 * ns, 9) DESC, idx DESC) AS r_hybrid FROM m),
c AS (SELECT q, dated, count(*) AS n, count_if(gold) AS g, count_if(tok) AS n_top, count_if(gold AND tok) AS g_top, bool_or(gold AND itv) AS g_itv, bool_or(r_semantic = 1 AND tok) AS first_top,
  {', '.join(f'min(CASE WHEN gold THEN r_{r} END) AS {r}' for r in diagnostics.RETRIEVERS)} FROM r GROUP BY q, dated HAVING bool_or(gold))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, q = F.lit(temporal.FIRST_DAY).cast("date"), F.col("q")
    year = F.year(F.date_add(first, F.col("qa")))
    asked = F.when(q % 5 == 0, F.lit("when was it shipped")).otherwise(F.concat(F.lit("between "), year.cast("string"), F.lit(" and "), (year + q % 3).cast("string")))
    told = F.concat(F.lit("shipped in "), F.year(F.date_add(first, F.col("pa"))).cast("string"))
    t = gaussian.interval_similarity(F.col("qa"), F.col("qb"), F.col("pa"), F.col("pb"))
    rows = candidates(spark, sf_dir).select(q.alias("item_id"), "idx", "is_gold", asked.alias("question"), told.alias("paragraph"), t.alias("t"), F.col("sem").alias("s"))
    return diagnostics.ranked_pairs(rows.withColumns({f"n{c}": fusion.minmax(F.col(c), "item_id") for c in ("t", "s")}), 0.6)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.cases(_ranked(spark, sf_dir))


@query(f"""{_CASES_SQL}, u AS (SELECT unnest([{', '.join(f"{{'retriever': '{r}', 'best': {r}}}" for r in diagnostics.RETRIEVERS)}]) AS u FROM c)
SELECT u.retriever AS retriever, count(*)::BIGINT AS n, round(avg(1.0 / u.best), 6) AS mrr, round(avg((u.best = 1)::INT), 6) AS top_1, round(avg((u.best <= 3)::INT), 6) AS recall_k FROM u GROUP BY ALL""")
def retriever_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five, by the first three places."""
    found = diagnostics.compare(_cases(spark, sf_dir), 3)
    return found.select("retriever", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "top_1", "recall_k")])


@query(f"""{_CASES_SQL} SELECT count(*)::BIGINT AS n, count_if(dated)::BIGINT AS dated, count_if(NOT dated)::BIGINT AS undated, count_if(dated AND g_top = 0)::BIGINT AS gold_lacks_token, count_if(dated AND NOT g_itv)::BIGINT AS gold_lacks_interval,
  count_if(hybrid = 1 AND semantic > 1)::BIGINT AS wins, count_if(hybrid = 1 AND semantic > 1 AND interval > 1)::BIGINT AS wins_filter_fails, count_if(hybrid = 1 AND semantic > 1 AND dated AND NOT g_itv)::BIGINT AS wins_gold_lacks_interval FROM c""")
def year_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.year_evidence(_cases(spark, sf_dir))


@query(f"""{_CASES_SQL}, tier AS (SELECT q, g_top > 0 AS m, temporal, semantic, CASE WHEN g_top > 0 THEN n_top ELSE n - n_top END AS n, CASE WHEN g_top > 0 THEN g_top ELSE g END AS g, CASE WHEN g_top > 0 THEN 0 ELSE n_top END AS o FROM c),
x AS (SELECT q, n, g, o, unnest(generate_series(1, (n - g + 1)::BIGINT)) AS r FROM tier),
e AS (SELECT q, sum(factorial((n - r)::INT) / factorial((g - 1)::INT) / factorial((n - r - g + 1)::INT) * factorial(g::INT)::DOUBLE * factorial((n - g)::INT) / factorial(n::INT) / (o + r)) AS e FROM x GROUP BY q),
s AS (SELECT unnest(['all', CASE WHEN q % 5 = 0 THEN 'undated' ELSE 'dated' END]) AS subset, * FROM tier JOIN e USING (q))
SELECT subset, count(*)::BIGINT AS n, round(avg(m::INT), 6) AS gold_share, round(avg(e), 6) AS mrr_timestamp, round(avg(1.0 / temporal), 6) AS mrr_temporal, round(avg(1.0 / semantic), 6) AS mrr_semantic FROM s GROUP BY subset""")
def timestamp_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far years alone go, by whether the question names one."""
    items = diagnostics.matcher_items(_cases(spark, sf_dir))
    found = diagnostics.reducible(items, F.when(F.col("item_id") % 5 == 0, "undated").otherwise("dated"))
    return found.select("subset", "n", *[F.round(c, 6).alias(c) for c in ("gold_share", "mrr_timestamp", "mrr_temporal", "mrr_semantic")])


@query(f"""{_CASES_SQL} SELECT count(*)::BIGINT AS n, {', '.join(f"count_if({c})::BIGINT AS {a}_{name}" for name, k in (('top1', 1), ('topk', 3)) for a, c in (('semantic', f'semantic <= {k}'), ('hybrid', f'hybrid <= {k}'), ('fixed', f'semantic > {k} AND hybrid <= {k}'), ('broken', f'semantic <= {k} AND hybrid > {k}')))} FROM c""")
def flip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.flips(_cases(spark, sf_dir), 3)


def _list_sql(run: str) -> str:
    return f"string_agg(CASE WHEN gold THEN '[gold] ' ELSE '' END || 'shipped in ' || py || ' (' || py || ')', ' | ' ORDER BY r_{run}) FILTER (r_{run} <= 3) AS {run}_best"


@query(f"""{_CASES_SQL}, w AS (SELECT q, n, semantic, temporal, semantic - hybrid AS gain, g_top > 0 AND NOT first_top AS distracted, row_number() OVER (ORDER BY g_top > 0 AND NOT first_top DESC, g_top > 0 DESC, semantic - hybrid DESC, n, q) AS place FROM c WHERE hybrid = 1 AND semantic > 1 AND dated),
l AS (SELECT q, {_list_sql('semantic')}, {_list_sql('hybrid')} FROM r GROUP BY q)
SELECT place::BIGINT AS place, q AS item_id, distracted, gain::BIGINT AS gain, n::BIGINT AS num_candidates, semantic::BIGINT AS rank_semantic, temporal::BIGINT AS rank_temporal, semantic_best, hybrid_best FROM w JOIN l USING (q) WHERE place <= 12""")
def flip_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's twelve examples with both runs' first three passages."""
    ranked = cut(_ranked(spark, sf_dir))
    shown = diagnostics.with_lists(diagnostics.showcase(diagnostics.cases(ranked)), ranked, 3)
    lists = [F.array_join(c, " | ").alias(c) for c in ("semantic_best", "hybrid_best")]
    return shown.select(*[F.col(c).cast("bigint").alias(c) for c in ("place", "item_id", "gain", "num_candidates", "rank_semantic", "rank_temporal")], "distracted", *lists)
