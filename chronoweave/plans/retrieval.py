"""Queries on candidates, scores, fusion, ranking, metrics, sweeps, significance and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import gaussian, temporal
from ..operators import evaluation, fusion, ranking, scoring
from .base import CANDIDATES, SCALED, day, kl_similarity, query, ranked_sql, table
from .temporal import DATED_SQL, _dated_docs, candidates

ALPHAS = tuple(round(i / 10, 1) for i in range(1, 10))
KS = (1, 5, 10, 20, 50, 100)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, idx, is_gold with temporal (t) and second (s) scores, and both scaled per question (nt, ns)."""
    t = gaussian.interval_similarity(F.col("qa"), F.col("qb"), F.col("pa"), F.col("pb"))
    rows = candidates(spark, sf_dir).select("q", "idx", "is_gold", t.alias("t"), F.col("sem").alias("s"))
    return rows.select("*", fusion.minmax(F.col("t"), "q").alias("nt"), fusion.minmax(F.col("s"), "q").alias("ns"))


def _ranked(rows: DataFrame, score, by: list[str]) -> DataFrame:
    return rows.withColumn("score", F.round(score, 9)).withColumn("rn", ranking.rank_desc(by)).select(*by, "idx", "is_gold", "rn")


_METRICS_SQL = """im AS (
  SELECT q, coalesce(1.0 / min(CASE WHEN gold THEN rn END), 0) AS mrr, (max(CASE WHEN gold AND rn <= 5 THEN 1 ELSE 0 END))::DOUBLE AS top, sum(CASE WHEN gold AND rn <= 5 THEN 1 ELSE 0 END) AS hit, sum(gold::INT) AS n,
    sum(CASE WHEN gold AND rn <= 5 THEN 1.0 / log2(rn + 1) ELSE 0 END) AS gain FROM rk GROUP BY q),
me AS (SELECT q, top, mrr, CASE WHEN n > 0 THEN gain / list_sum(list_transform(generate_series(1, least(n, 5)::INT), lambda i: 1.0 / log2(i + 1))) ELSE 0 END AS ndcg, hit / 5.0 AS p, CASE WHEN n > 0 THEN hit / n::DOUBLE ELSE 0 END AS r FROM im),
m AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM me)"""


@query("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return scoring.candidate_pairs(rows, "o_custkey", "l_partkey")


@query("SELECT o_custkey AS q, l_partkey AS p, c_acctbal AS q_value, p_retailprice AS p_value FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = candidate_pairs(spark, sf_dir).withColumnsRenamed({"o_custkey": "q", "l_partkey": "p"})
    texts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("text"), F.col("c_acctbal").alias("value"))
    texts = texts.union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey"), "p_retailprice"))
    keyed = pairs.select("q", "p", F.concat(F.lit("c"), "q").alias("question"), F.concat(F.lit("p"), "p").alias("paragraph"))
    return scoring.lookup(keyed, texts, "question", "paragraph", "text").select("q", "p", "q_value", "p_value")


@query(f"WITH {CANDIDATES} SELECT q, idx::BIGINT AS idx, round({kl_similarity('qa', 'qb', 'pa', 'pb')}, 6) AS temporal, CASE WHEN idx % 2 = 0 THEN round(sem, 6) ELSE 0 END::DOUBLE AS semantic FROM cand")
def fusion_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    t, s = rows.select("q", "idx", F.col("t").alias("score")), rows.where("idx % 2 = 0").select("q", "idx", F.col("s").alias("score"))
    both = fusion.fuse_left(t, s, ["q", "idx"])
    return both.select("q", F.col("idx").cast("bigint").alias("idx"), F.round("temporal", 6).alias("temporal"), F.round("semantic", 6).alias("semantic"))


@query("SELECT l_orderkey AS q, count(*)::BIGINT AS missing FROM lineitem WHERE l_linenumber % 4 = 0 GROUP BY 1")
def cache_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("p"))
    return fusion.uncovered(pairs, pairs.where("p % 4 <> 0"), ["q", "p"]).groupBy("q").agg(F.count("*").alias("missing"))


@query(f"WITH {SCALED} SELECT q, idx::BIGINT AS idx, round(nt, 6) AS nt, round(ns, 6) AS ns FROM nm")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("q", F.col("idx").cast("bigint").alias("idx"), F.round("nt", 6).alias("nt"), F.round("ns", 6).alias("ns"))


@query(f"WITH {SCALED} SELECT q, idx::BIGINT AS idx, round(0.6::DOUBLE * nt + 0.4::DOUBLE * ns, 6) AS score FROM nm")
def linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("q", F.col("idx").cast("bigint").alias("idx"), F.round(fusion.linear(F.col("nt"), F.col("ns"), 0.6), 6).alias("score"))


@query(f"WITH {SCALED} SELECT q, idx::BIGINT AS idx, round(0.5 / (60 + rank() OVER (PARTITION BY q ORDER BY round(t, 9) DESC)) + 0.5 / (60 + rank() OVER (PARTITION BY q ORDER BY round(s, 9) DESC)), 8)::DOUBLE AS score FROM nm")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("q", "idx", F.round("t", 9).alias("t"), F.round("s", 9).alias("s"))
    return rows.select("q", F.col("idx").cast("bigint").alias("idx"), F.round(fusion.reciprocal_rank(F.col("t"), F.col("s"), ["q"]), 8).alias("score"))


_YEARS_SQL = f"""{CANDIDATES},
y AS (SELECT c.*, year(DATE '1000-01-01' + qa::INT) AS qy, year(DATE '1000-01-01' + qa::INT) + q % 3 AS qz, year(DATE '1000-01-01' + pa::INT) AS py FROM cand c),
yn AS (SELECT *, CASE WHEN max(sem) OVER w = min(sem) OVER w THEN 0 ELSE (sem - min(sem) OVER w) / (max(sem) OVER w - min(sem) OVER w) END AS ns FROM y WINDOW w AS (PARTITION BY q))"""


def _with_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with years as text: the question names its own year and, for a closed range, a later one."""
    first = F.lit(temporal.FIRST_DAY).cast("date")
    rows = candidates(spark, sf_dir)
    qy = F.year(F.date_add(first, F.col("qa")))
    asked = F.concat(F.lit("between "), qy.cast("string"), F.lit(" and "), (qy + F.col("q") % 3).cast("string"))
    rows = rows.select("*", asked.alias("question"), F.concat(F.lit("shipped in "), F.year(F.date_add(first, F.col("pa"))).cast("string")).alias("paragraph"))
    return rows.withColumn("ns", fusion.minmax(F.col("sem"), "q"))


@query(f"WITH {_YEARS_SQL} SELECT q, idx::BIGINT AS idx, round(CASE WHEN py IN (qy, qz) THEN 10 ELSE 0 END + ns, 6) AS score FROM yn")
def oracle_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = F.arrays_overlap(temporal.year_tokens(F.col("question")), temporal.year_tokens(F.col("paragraph")))
    return _with_years(spark, sf_dir).select("q", F.col("idx").cast("bigint").alias("idx"), F.round(fusion.oracle(match, F.col("ns")), 6).alias("score"))


@query(f"WITH {_YEARS_SQL} SELECT q, idx::BIGINT AS idx, round(CASE WHEN py BETWEEN qy AND qz THEN 10 ELSE 0 END + ns, 6) AS score FROM yn")
def oracle_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = F.arrays_overlap(temporal.year_interval(F.col("question")), temporal.year_tokens(F.col("paragraph")))
    return _with_years(spark, sf_dir).select("q", F.col("idx").cast("bigint").alias("idx"), F.round(fusion.oracle(match, F.col("ns")), 6).alias("score"))


@query(f"WITH {SCALED}, {ranked_sql('s')} SELECT q, idx::BIGINT AS idx, rn::BIGINT AS rn FROM rk")
def rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(scored(spark, sf_dir), F.col("s"), ["q"]).select("q", F.col("idx").cast("bigint").alias("idx"), F.col("rn").cast("bigint").alias("rn"))


@query(f"WITH {SCALED}, k AS (SELECT q, idx, row_number() OVER (PARTITION BY q ORDER BY round(s / 10) DESC, idx) AS rn FROM nm) SELECT q, string_agg(idx::VARCHAR, ',' ORDER BY rn) AS top FROM k WHERE rn <= 3 GROUP BY q")
def topk_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse scores, so that ties keep candidate order."""
    best = ranking.top_k(scored(spark, sf_dir).withColumn("score", F.round(F.col("s") / 10)), ["q"], 3)
    return best.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "idx"))), lambda x: x["idx"].cast("string")), ",").alias("top"))


@query(f"WITH {SCALED}, {ranked_sql('t')} SELECT q, min(rn)::BIGINT AS best, sum(gold::INT)::BIGINT AS n_gold FROM rk WHERE gold GROUP BY q")
def gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(scored(spark, sf_dir), F.col("t"), ["q"]).where("is_gold").groupBy("q").agg(F.min("rn").cast("bigint").alias("best"), F.count("*").alias("n_gold"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.item_metrics(_ranked(scored(spark, sf_dir), F.col("t"), ["q"]), ["q"], 5)


_ITEMS_SQL = f"WITH {SCALED}, {ranked_sql('t')}, {_METRICS_SQL}"


@query(f"{_ITEMS_SQL} SELECT q, top FROM m")
def metric_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("q", "top")


@query(f"{_ITEMS_SQL} SELECT q, round(mrr, 6)::DOUBLE AS mrr FROM m")
def metric_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("q", F.round("mrr", 6).alias("mrr"))


@query(f"{_ITEMS_SQL} SELECT q, round(ndcg, 6)::DOUBLE AS ndcg FROM m")
def metric_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("q", F.round("ndcg", 6).alias("ndcg"))


@query(f"{_ITEMS_SQL} SELECT q, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1 FROM m")
def metric_precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("q", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SCALED}, rk AS (SELECT q, idx, gold, idx AS rn FROM nm), {_METRICS_SQL} SELECT count(*)::BIGINT AS n_items, round(avg(top), 6) AS top, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(f), 6) AS f1 FROM m")
def metrics_from_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that come with the data: the lines' numbers."""
    rows = scored(spark, sf_dir).withColumn("rn", F.col("idx"))
    means = ranking.mean_metrics(ranking.item_metrics(rows, ["q"], 5), [], ("top", "mrr", "ndcg", "f1"))
    return means.select("n_items", *[F.round(c, 6).alias(c) for c in ("top", "mrr", "ndcg", "f1")])


_MULTI_SQL = """im AS (
  SELECT q, k, coalesce(1.0 / min(CASE WHEN gold THEN rn END), 0) AS mrr, sum(CASE WHEN gold AND rn <= k THEN 1 ELSE 0 END) AS hit, sum(gold::INT) AS n, sum(CASE WHEN gold AND rn <= k THEN 1.0 / log2(rn + 1) ELSE 0 END) AS gain
  FROM rk, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) GROUP BY q, k),
m AS (SELECT q, k, mrr, CASE WHEN n > 0 THEN gain / list_sum(list_transform(generate_series(1, least(n, k)::INT), lambda i: 1.0 / log2(i + 1))) ELSE 0 END AS ndcg, hit / k::DOUBLE AS p, CASE WHEN n > 0 THEN hit / n::DOUBLE ELSE 0 END AS r FROM im)"""


@query(f"WITH {SCALED}, {ranked_sql('t')}, {_MULTI_SQL} SELECT k::BIGINT AS k, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM m GROUP BY k")
def metrics_multi_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(scored(spark, sf_dir), F.col("t"), ["q"]).withColumn("k", F.explode(F.array(*map(F.lit, KS))))
    means = ranking.mean_metrics(ranking.item_metrics(rows, ["q", "k"], F.col("k")), ["k"], ("mrr", "ndcg", "precision", "recall"))
    return means.select(F.col("k").cast("bigint").alias("k"), *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "precision", "recall")])


#: Runs: name, share of the temporal score.
RUNS = (("temporal", 1.0), ("semantic", 0.0), ("hybrid-0.6", 0.6))
_RUNS_SQL = """ru AS (SELECT * FROM (VALUES ('temporal', 1.0::DOUBLE), ('semantic', 0.0::DOUBLE), ('hybrid-0.6', 0.6::DOUBLE)) AS v(run, alpha)),
rr AS (SELECT run, q, idx, gold, row_number() OVER (PARTITION BY run, q ORDER BY round(alpha * nt + (1 - alpha) * ns, 9) DESC, idx DESC) AS rn FROM nm, ru),
ri AS (SELECT run, q, coalesce(1.0 / min(CASE WHEN gold THEN rn END), 0) AS mrr, sum(CASE WHEN gold AND rn <= 5 THEN 1 ELSE 0 END) / 5.0 AS p, coalesce(sum(CASE WHEN gold AND rn <= 5 THEN 1 ELSE 0 END) / nullif(sum(gold::INT), 0)::DOUBLE, 0) AS r FROM rr GROUP BY run, q)"""


def _runs(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    spec = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(a).alias("alpha")) for n, a in runs])
    rows = scored(spark, sf_dir).withColumn("r", F.explode(spec)).select("*", "r.run", "r.alpha")
    return _ranked(rows, fusion.linear(F.col("nt"), F.col("ns"), F.col("alpha")), ["run", "q"])


def _run_items(spark: SparkSession, sf_dir: str, runs=RUNS) -> DataFrame:
    return ranking.item_metrics(_runs(spark, sf_dir, runs), ["run", "q"], 5)


@query(f"""WITH {SCALED}, {_RUNS_SQL}, b AS (SELECT run, o_orderpriority AS benchmark, avg(mrr) AS mrr, avg(p) AS p, avg(r) AS r FROM ri JOIN orders ON q = o_orderkey GROUP BY ALL)
SELECT run, round(avg(mrr), 6) AS mrr, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, count(*)::BIGINT AS n_benchmarks FROM b GROUP BY run""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmarks are the orders' priorities."""
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("benchmark"))
    per = ranking.mean_metrics(_run_items(spark, sf_dir).join(b, "q"), ["run", "benchmark"], ("mrr", "precision", "recall"))
    return per.groupBy("run").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("mrr", "precision", "recall")], F.count("*").alias("n_benchmarks"))


@query(f"WITH {SCALED}, {_RUNS_SQL} SELECT run, o_orderpriority AS benchmark, count(*)::BIGINT AS n_items, round(avg(mrr), 6) AS mrr, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM ri JOIN orders ON q = o_orderkey GROUP BY ALL")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("benchmark"))
    per = ranking.mean_metrics(_run_items(spark, sf_dir).join(b, "q"), ["run", "benchmark"], ("mrr", "precision", "recall"))
    return per.select("run", "benchmark", "n_items", *[F.round(c, 6).alias(c) for c in ("mrr", "precision", "recall")])


@query(f"""WITH {SCALED}, al AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS alpha),
rr AS (SELECT alpha, q, gold, row_number() OVER (PARTITION BY alpha, q ORDER BY round(alpha * nt + (1 - alpha) * ns, 9) DESC, idx DESC) AS rn FROM nm, al),
ri AS (SELECT alpha, q, coalesce(1.0 / min(CASE WHEN gold THEN rn END), 0) AS mrr FROM rr GROUP BY alpha, q), a AS (SELECT alpha, round(avg(mrr), 6) AS mrr FROM ri GROUP BY alpha)
SELECT alpha, mrr, (alpha = (SELECT min(alpha) FROM a WHERE mrr = (SELECT max(mrr) FROM a))) AS best FROM a""")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _run_items(spark, sf_dir, tuple((str(a), a) for a in ALPHAS))
    swept = items.groupBy(F.col("run").cast("double").alias("alpha")).agg(F.round(F.avg("mrr"), 6).alias("mrr"))
    best = ranking.best_alpha(swept, []).select(F.col("alpha").alias("b"))
    return swept.crossJoin(F.broadcast(best)).select("alpha", "mrr", (F.col("alpha") == F.col("b")).alias("best"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _run_items(spark, sf_dir)
    a, b = (items.where(F.col("run") == r).select("q", F.round("mrr", 9).alias(c)) for r, c in (("hybrid-0.6", "a"), ("semantic", "b")))
    return a.join(b, "q").select(F.lit("mrr").alias("metric"), "q", "a", "b", (F.col("a") - F.col("b")).alias("d"))


_PAIRED_SQL = f"""WITH {SCALED}, {_RUNS_SQL},
pd AS (SELECT x.q, round(x.mrr, 9) AS a, round(y.mrr, 9) AS b, round(x.mrr, 9)::DOUBLE - round(y.mrr, 9)::DOUBLE AS d FROM ri x JOIN ri y ON x.q = y.q AND x.run = 'hybrid-0.6' AND y.run = 'semantic')"""


@query(f"{_PAIRED_SQL} SELECT 'mrr' AS metric, count(*)::BIGINT AS n, count_if(d > 0)::BIGINT AS wins, count_if(d < 0)::BIGINT AS losses, count_if(d = 0)::BIGINT AS ties, round(avg(d), 6) AS mean_diff FROM pd")
def paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).groupBy("metric").agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.round(F.avg("d"), 6).alias("mean_diff"))


@query(f"""{_PAIRED_SQL}, z AS (SELECT round(d, 9) AS d, abs(round(d, 9)) AS a FROM pd WHERE round(d, 9) <> 0),
r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a) AS t FROM z)
SELECT 'mrr' AS metric, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, count(*)::BIGINT AS n_nonzero, sum(t * t - 1)::DOUBLE AS ties FROM r""")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.signed_rank(_paired(spark, sf_dir).withColumn("d", F.round("d", 9)), ["metric"])


@query(f"{_PAIRED_SQL} SELECT 'mrr' AS metric, count(*)::BIGINT AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM pd")
def ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))), 6).alias("t"))


@query()
def paired_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of both tests: special functions, held against known values in the tests."""
    return ranking.p_values(wilcoxon(spark, sf_dir).join(ttest(spark, sf_dir), "metric"))


_BOOTSTRAP_SQL = f"""{_PAIRED_SQL}, k AS (SELECT d, md5('42:' || q) AS h FROM pd),
ac AS (SELECT d, ('0x' || substr(h, 1, 8))::BIGINT % {ranking.PRIME} AS a, ('0x' || substr(h, 9, 8))::BIGINT % {ranking.PRIME} AS c FROM k),
x AS (SELECT d, r, (a * (r * {ranking.ROUND_STEP} % {ranking.PRIME}) + c) % {ranking.PRIME} AS x FROM ac, range(1, 10001) t(r)),
s AS (SELECT d, r, x, (x * x % {ranking.PRIME}) * (x * x % {ranking.PRIME}) % {ranking.PRIME} AS s FROM x),
w AS (SELECT d, r, {' + '.join(f'(s * x % {ranking.PRIME} >= {t})::INT' for t in ranking.POISSON)} AS w FROM s),
m AS (SELECT r, sum(w * d) / nullif(sum(w), 0) AS m FROM w GROUP BY r)
SELECT 'mrr' AS metric, (SELECT round(avg(d), 6) FROM pd) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""


@query(_BOOTSTRAP_SQL)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 rounds."""
    got = ranking.bootstrap_ci(_paired(spark, sf_dir), "metric", "q")
    return got.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_SHARED_SQL = """WITH c AS (SELECT o_custkey AS question, o_orderkey AS item, l_partkey AS paragraph, bool_or(l_returnflag = 'R') AS gold FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT DISTINCT question, paragraph, (question * 7919 + paragraph * 104729) % 1009 AS t, (question * 31 + paragraph * 17) % 503 AS s FROM c),
z AS (SELECT question, paragraph, CASE WHEN max(t) OVER w = min(t) OVER w THEN 0 ELSE (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w)::DOUBLE END AS t, CASE WHEN max(s) OVER w = min(s) OVER w THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w)::DOUBLE END AS s FROM p WINDOW w AS (PARTITION BY question)),
f AS (SELECT item, paragraph, gold, unnest([{'run': 'fused', 's': 0.6 * t + 0.4 * s}, {'run': 'first', 's': t}, {'run': 'second', 's': s}]) AS u FROM c JOIN z USING (question, paragraph)),
r AS (SELECT u.run AS run, item, gold, row_number() OVER (PARTITION BY u.run, item ORDER BY round(u.s, 9) DESC, paragraph DESC) AS rn FROM f),
i AS (SELECT run, item, coalesce(1.0 / min(CASE WHEN gold THEN rn END), 0) AS mrr FROM r GROUP BY ALL)
SELECT run, count(*)::BIGINT AS n, round(avg(mrr), 6) AS mrr FROM i GROUP BY run"""


@query(_SHARED_SQL)
def shared_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as questions that several orders, the items, ask over parts: scores are scaled over a customer's parts in all orders, as `evaluate` does."""
    orders, lines = (table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    c = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("item_id"), F.col("l_partkey").alias("paragraph"))
    c = c.agg(F.bool_or(F.col("l_returnflag") == "R").alias("is_gold")).withColumn("idx", F.col("paragraph")).withColumn("split", F.lit("test")).transform(cut)
    pairs = c.select("question", "paragraph").distinct()
    q, p = F.col("question"), F.col("paragraph")
    caches = {"t": pairs.withColumn("score", ((q * 7919 + p * 104729) % 1009).cast("double")), "s": pairs.withColumn("score", ((q * 31 + p * 17) % 503).cast("double"))}
    runs = [("fused", "hybrid", "t", "s", 0.6), ("first", "temporal", "t", None, None), ("second", "semantic", None, "s", None)]
    rows = evaluation.fused_runs(c, caches, runs, "test").withColumnRenamed("run_id", "run").withColumn("rn", ranking.rank_desc(["run", "item_id"]))
    items = ranking.item_metrics(rows, ["run", "item_id"], 5)
    return items.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"))


_MATCH_SQL = f"""{_YEARS_SQL}, mt AS (SELECT q, count(*) AS n, count_if(py IN (qy, qz)) AS n_top, count_if(gold) AS g, count_if(gold AND py IN (qy, qz)) AS g_top FROM yn GROUP BY q)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = F.arrays_overlap(temporal.year_tokens(F.col("question")), temporal.year_tokens(F.col("paragraph")))
    rows = _with_years(spark, sf_dir).withColumn("match", match)
    return rows.groupBy("q").agg(F.count("*").alias("n"), F.count_if("match").alias("n_top"), F.count_if("is_gold").alias("g"), F.count_if(F.col("is_gold") & F.col("match")).alias("g_top"))


@query(f"""WITH {_MATCH_SQL},
tier AS (SELECT q, CASE WHEN g_top > 0 THEN n_top ELSE n - n_top END AS n, CASE WHEN g_top > 0 THEN g_top ELSE g - g_top END AS g, CASE WHEN g_top > 0 THEN 0 ELSE n_top END AS o FROM mt),
x AS (SELECT q, n, g, o, unnest(generate_series(1, greatest(n - g + 1, 1)::BIGINT)) AS r FROM tier),
c AS (SELECT *, CASE WHEN g > 0 THEN factorial((n - r)::INT) / factorial((g - 1)::INT) / factorial((n - r - g + 1)::INT) * factorial(g::INT)::DOUBLE * factorial((n - g)::INT) / factorial(n::INT) / (o + r) ELSE 0 END AS e FROM x)
SELECT q, round(sum(e), 6)::DOUBLE AS expected FROM c GROUP BY q""")
def expected_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("g_top") > 0
    m = _matches(spark, sf_dir).select("q", F.when(top, F.col("n_top")).otherwise(F.col("n") - F.col("n_top")).alias("n"), F.when(top, F.col("g_top")).otherwise(F.col("g") - F.col("g_top")).alias("g"), F.when(top, 0).otherwise(F.col("n_top")).alias("o"))
    return m.select("q", F.round(ranking.expected_reciprocal_rank(F.col("n"), F.col("g"), F.col("o")), 6).alias("expected"))


@query(f"""WITH {_MATCH_SQL}, s AS (SELECT unnest(['all', CASE WHEN q % 2 = 0 THEN 'even' ELSE 'odd' END]) AS subset, * FROM mt)
SELECT subset, count(*)::BIGINT AS n, round(avg((g_top > 0)::INT), 6) AS gold_matches, round(avg(n_top / n::DOUBLE), 6) AS match_share FROM s GROUP BY subset""")
def reducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("q") % 2 == 0, "even").otherwise("odd")))
    rows = _matches(spark, sf_dir).withColumn("subset", subset)
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.round(F.avg((F.col("g_top") > 0).cast("int")), 6).alias("gold_matches"), F.round(F.avg(F.col("n_top") / F.col("n")), 6).alias("match_share"))


@query(f"""WITH {_YEARS_SQL}, v AS (
  SELECT q, gold, unnest([{{'name': 'semantic', 's': sem}}, {{'name': 'token', 's': CASE WHEN py IN (qy, qz) THEN 10 ELSE 0 END + ns}}, {{'name': 'interval', 's': CASE WHEN py BETWEEN qy AND qz THEN 10 ELSE 0 END + ns}}]) AS u, idx FROM yn),
r AS (SELECT u.name AS retriever, q, gold, row_number() OVER (PARTITION BY q, u.name ORDER BY round(u.s, 9) DESC, idx DESC) AS rn FROM v), b AS (SELECT retriever, q, min(rn) AS best FROM r WHERE gold GROUP BY ALL)
SELECT retriever, count(*)::BIGINT AS n, round(avg((best <= 3)::INT), 6) AS acc_3, round(avg(1.0 / best), 6) AS mrr, round(avg((best = 1)::INT), 6) AS top_1 FROM b GROUP BY retriever""")
def oracle_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_years(spark, sf_dir)
    p = temporal.year_tokens(F.col("paragraph"))
    token, interval = (fusion.oracle(F.arrays_overlap(f(F.col("question")), p), F.col("ns")) for f in (temporal.year_tokens, temporal.year_interval))
    long = rows.select("q", "idx", "is_gold", F.explode(F.create_map(F.lit("semantic"), F.col("sem"), F.lit("token"), token, F.lit("interval"), interval)).alias("retriever", "s"))
    best = _ranked(long, F.col("s"), ["retriever", "q"]).where("is_gold").groupBy("retriever", "q").agg(F.min("rn").alias("best"))
    return best.groupBy("retriever").agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") <= 3).cast("int")), 6).alias("acc_3"), F.round(F.avg(1 / F.col("best")), 6).alias("mrr"), F.round(F.avg((F.col("best") == 1).cast("int")), 6).alias("top_1"))


_FLIPS_SQL = f"""WITH {SCALED}, {_RUNS_SQL}, gr AS (SELECT q, run, min(rn) AS best FROM rr WHERE gold GROUP BY ALL), fl AS (SELECT x.q, x.best AS sem, y.best AS hyb FROM gr x JOIN gr y ON x.q = y.q AND x.run = 'semantic' AND y.run = 'hybrid-0.6')"""


def _flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _runs(spark, sf_dir).where("is_gold").groupBy("run", "q").agg(F.min("rn").alias("best"))
    return best.groupBy("q").agg(F.max(F.when(F.col("run") == "semantic", F.col("best"))).alias("sem"), F.max(F.when(F.col("run") == "hybrid-0.6", F.col("best"))).alias("hyb"))


@query(f"{_FLIPS_SQL} SELECT count(*)::BIGINT AS n, count_if(sem > 1 AND hyb = 1)::BIGINT AS fixed_1, count_if(sem = 1 AND hyb > 1)::BIGINT AS broken_1, count_if(sem > 3 AND hyb <= 3)::BIGINT AS fixed_3, count_if(sem <= 3 AND hyb > 3)::BIGINT AS broken_3 FROM fl")
def flip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, h = F.col("sem"), F.col("hyb")
    return _flips(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if((s > 1) & (h == 1)).alias("fixed_1"), F.count_if((s == 1) & (h > 1)).alias("broken_1"), F.count_if((s > 3) & (h <= 3)).alias("fixed_3"), F.count_if((s <= 3) & (h > 3)).alias("broken_3"))


@query(f"{_FLIPS_SQL} SELECT q, (sem - hyb)::BIGINT AS gain, rank() OVER (ORDER BY sem - hyb DESC, q)::BIGINT AS place FROM fl WHERE hyb = 1 AND sem > 1 ORDER BY gain DESC, q LIMIT 12")
def showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's twelve questions with the largest gain in rank."""
    rows = _flips(spark, sf_dir).where("hyb = 1 AND sem > 1").select("q", (F.col("sem") - F.col("hyb")).cast("bigint").alias("gain"))
    best = rows.orderBy(F.col("gain").desc(), "q").limit(12)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.col("gain").desc(), "q")).cast("bigint"))


_TOKENS_SQL = "list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"
_BM25_SQL = f"""WITH d AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text), dw AS (SELECT id, {_TOKENS_SQL.format(t='text')} AS w FROM d),
ix AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM dw), tf AS (SELECT id, dl, term, count(*)::DOUBLE AS tf FROM ix GROUP BY ALL),
sz AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avg_dl FROM dw), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, avg_dl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, sz), idf AS (SELECT term, avg_dl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qw AS (SELECT item_id, unnest({_TOKENS_SQL.format(t='text')}) AS term FROM benchmark), qt AS (SELECT item_id, term, count(*) AS qtf FROM qw GROUP BY ALL),
sc AS (SELECT item_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("id"))
    return scoring.bm25(table(spark, sf_dir, "benchmark"), docs, "item_id", "text", "id", "text")


@query(f"{_BM25_SQL} SELECT item_id, id AS doc_id, round(score, 5) AS score FROM sc")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts against every distinct document text."""
    return _bm25(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))


@query(f"{_BM25_SQL} SELECT item_id, id AS doc_id, rn::BIGINT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, id) AS rn FROM sc) WHERE rn <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 8).desc(), "id"))
    return _bm25(spark, sf_dir).withColumn("rn", rn).where("rn <= 10").select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("rn").cast("bigint").alias("rn"))


_TAGGED_SQL = f"""{CANDIDATES}, g AS (
  SELECT q, idx, (qa + qb + 1) / 2.0::DOUBLE AS qm, 31 * 31 / 12.0::DOUBLE AS qv, unnest([1, 2]) AS j, qa, qb, pa FROM cand),
e AS (SELECT *, CASE j WHEN 1 THEN pa ELSE pa + 60 END AS a FROM g)"""


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs, and as a tagger would find them: an interval in each question; two days in each passage and one that means nothing."""
    first = F.lit(temporal.FIRST_DAY).cast("date")
    c = candidates(spark, sf_dir).select(F.concat(F.lit("q"), "q").alias("question"), F.concat_ws("/", F.lit("p"), "q", "idx").alias("paragraph"), "q", "idx", "qa", "qb", "pa")

    def day_text(x):
        return F.date_format(F.date_add(first, x), "yyyy-MM-dd")

    of_q = c.select(F.col("question").alias("text"), F.concat_ws(",", day_text(F.col("qa")), day_text(F.col("qb"))).alias("expr")).distinct()
    of_p = c.select(F.col("paragraph").alias("text"), F.explode(F.array(day_text(F.col("pa")), day_text(F.col("pa") + 60), F.lit("XXXX-WXX"))).alias("expr"))
    found = of_q.union(of_p).withColumn("anchor", F.lit("2021-11-09").cast("date"))
    return c.select("question", "paragraph", "q", "idx"), found


def _tagger(mode: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs, found = _tagged(spark, sf_dir)
        s = scoring.tagger_similarity(pairs, found, mode, "question", "paragraph", "text")
        key = F.split("paragraph", "/")
        return s.select(F.get(key, F.lit(1)).cast("bigint").alias("q"), F.get(key, F.lit(2)).cast("bigint").alias("idx"), F.round("score", 9).alias("score"))

    run.__name__ = f"tagger_{mode}"
    query(sql)(run)


_PAIR = kl_similarity("qa", "qb", "a", "a")
_tagger("merge", f"WITH {_TAGGED_SQL}, m AS (SELECT q, idx, any_value(qm) AS qm, any_value(qv) AS qv, avg(a + 0.5) AS pm, 1 / 12.0::DOUBLE + var_pop(a) AS pv FROM e GROUP BY q, idx) SELECT q, idx::BIGINT AS idx, round(1 / (1 + greatest(0, 0.5 * ln(pv / qv) + (qv + (qm - pm) * (qm - pm)) / (2 * pv) - 0.5)), 9) AS score FROM m")
_tagger("union", f"WITH {_TAGGED_SQL} SELECT q, idx::BIGINT AS idx, round({kl_similarity('min(qa)', 'min(qb)', 'min(a)', 'max(a)')}, 9) AS score FROM e GROUP BY q, idx")
_tagger("max", f"WITH {_TAGGED_SQL} SELECT q, idx::BIGINT AS idx, round(max({_PAIR}), 9) AS score FROM e GROUP BY q, idx")
_tagger("mean", f"WITH {_TAGGED_SQL} SELECT q, idx::BIGINT AS idx, round(sum({_PAIR}) / 3, 9) AS score FROM e GROUP BY q, idx")
_tagger("product", f"WITH {_TAGGED_SQL} SELECT q, idx::BIGINT AS idx, 0.0::DOUBLE AS score FROM e GROUP BY q, idx")


@query()
def head_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temporal head with small fixed weights over all embeddings; held against a direct computation in the tests."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", gaussian.date_encoding(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("vec_id") % 9000).cast("int"))).alias("enc"))
    return scoring.encode_temporal(rows, "embedding", "enc", scoring.TemporalHead.random(64, 32, 48, 16), "vec_id")


@query(
    f"""WITH i AS (SELECT o_orderkey AS item, c_name AS q, p_name AS p, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS d
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
f AS (SELECT q, d FROM (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY item) AS rn FROM i) WHERE rn = 1), pr AS (SELECT DISTINCT q, p FROM i),
k AS (SELECT pr.q, p, {day("coalesce(d, DATE '2021-11-09')")}::DOUBLE AS kq, {day("DATE '2021-11-09'")}::DOUBLE AS kp, length(pr.q)::DOUBLE AS lq, length(p)::DOUBLE AS lp FROM pr JOIN f USING (q)),
x AS (SELECT *, unnest(generate_series(0, 7)) AS j, 0.5 + lq / 20 AS sq, 0.5 + lp / 20 AS sp FROM k), w AS (SELECT *, power(10000.0, 2.0 * (j // 2) / 8) AS r FROM x),
m AS (SELECT *, lq / 10 + CASE WHEN j % 2 = 0 THEN sin(kq / r) ELSE cos(kq / r) END AS mq, lp / 10 + CASE WHEN j % 2 = 0 THEN sin(kp / r) ELSE cos(kp / r) END AS mp FROM w)
SELECT q AS question, p AS paragraph, round(1 / (1 + sum(ln(sp / sq) + (sq * sq + (mq - mp) * (mq - mp)) / (2 * sp * sp) - 0.5) / 8) / 0.05, 5) AS score FROM m GROUP BY q, p"""
)
def temporal_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, each at the date of its first order (every seventh order has none), against names of parts; the encoder takes date and length."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part")}
    rows = t["orders"].join(t["customer"], F.expr("c_custkey = o_custkey")).join(t["lineitem"], F.expr("l_orderkey = o_orderkey")).join(t["part"], F.expr("p_partkey = l_partkey"))
    dated = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    items = rows.select(F.col("o_orderkey").alias("item_id"), F.col("c_name").alias("question"), F.col("p_name").alias("paragraph"), dated.alias("reference_date"))

    def encoder(texts: DataFrame) -> DataFrame:
        n = F.length("text").cast("double")
        mu = F.transform(gaussian.date_encoding(F.col("anchor"), 8), lambda x: x + n / 10)
        return texts.select("id", mu.alias("mu"), F.array_repeat(0.5 + n / 20, 8).alias("std"))

    return scoring.temporal_similarity(items, encoder).withColumn("score", F.round("score", 5))


@query(f"SELECT doc_id, (list_min(y) BETWEEN 1985 AND 1990) AS early FROM ({DATED_SQL})")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = temporal.year_tokens(F.col("text"))
    return _dated_docs(spark, sf_dir).select("doc_id", F.array_min(y).between(1985, 1990).alias("early"))
