"""Queries on benchmark building, negatives, caches restricted to candidates, and close expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import building, datagen, fusion
from .base import query, table
from .texts import _u_sql


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'unanswerable' WHEN 1 THEN o_orderpriority ELSE o_orderstatus END AS u, CASE WHEN o_orderkey % 5 = 0 THEN 'unanswerable' ELSE o_orderstatus END AS a, o_custkey % 2 AS t FROM orders) WHERE u = a AND u <> 'unanswerable' AND t = 0""")
def answers_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions of two types; some answers were updated to another value, some to the unanswerable mark."""
    k = F.col("o_orderkey") % 5
    mark = F.lit(building.UNANSWERABLE)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k == 0, mark).when(k == 1, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("updated_answer"),
        F.when(k == 0, mark).otherwise(F.col("o_orderstatus")).alias("answer"), F.when(F.col("o_custkey") % 2 == 0, "narrow").otherwise("expand").alias("type"),
    )
    return building.settled(rows, "narrow").select("o_orderkey")


@query("SELECT o_orderkey AS question, o_orderpriority AS paragraph, 0 AS gold FROM orders WHERE o_orderstatus <> 'O'")
def build_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two text answers; open ones have none."""
    found = F.when(F.col("o_orderstatus") == "O", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.struct(found.alias("text")).alias("text_answers"))
    return building.build("temp_reason_l1", items).select("question", F.col("paragraphs")[0].alias("paragraph"), F.col("answer")[0].alias("gold"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 5),
x AS (SELECT l.l_orderkey AS item_id, l.l_linenumber::BIGINT AS paragraph, l_returnflag = 'R' AS g, s.l_orderkey IS NOT NULL AS i FROM lineitem l LEFT JOIN s ON s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber)
SELECT item_id, paragraph FROM x QUALIFY bool_or(g) OVER (PARTITION BY item_id) AND bool_and(i) OVER (PARTITION BY item_id)""")
def evaluable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as candidates; those of small quantities have no score."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_orderkey").alias("item_id"), F.col("l_orderkey").alias("question"), F.col("l_linenumber").cast("bigint").alias("paragraph"), (F.col("l_returnflag") == "R").alias("is_gold"), "l_quantity")
    kept = building.evaluable(pairs.drop("l_quantity"), pairs.where("l_quantity > 5").select("question", "paragraph"))
    return kept.select("item_id", "paragraph")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::DOUBLE AS score FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
SELECT l_orderkey AS question, l_linenumber::BIGINT AS paragraph, coalesce(score, 0) AS score FROM p LEFT JOIN c USING (l_orderkey, l_linenumber)""")
def cache_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that has the scores of large quantities only."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").cast("bigint").alias("paragraph"), F.col("l_quantity").cast("double").alias("score"))
    return fusion.restricted(lines.select("question", "paragraph").distinct(), lines.where("score > 25"), ["question", "paragraph"])


@query(f"""WITH d AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber::VARCHAR || '/' || l_partkey || '/' || l_suppkey AS p FROM lineitem)
SELECT q, p AS paragraph FROM d QUALIFY n <= 3 OR row_number() OVER (PARTITION BY q ORDER BY {_u_sql(42, 'q::VARCHAR', 'i::VARCHAR')}, i) <= 3""")
def fetch_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of an order's lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("s"))
    items = lines.groupBy("q").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat_ws("/", s["l_linenumber"], s["l_partkey"], s["l_suppkey"])).alias("p"))
    return items.select("q", F.explode(building.fetch_random(F.col("p"), F.col("q"), 3)).alias("paragraph"))


@query(f"""WITH r AS (SELECT n_nationkey AS item_id, n_name AS p, 1 AS own FROM nation UNION ALL SELECT a.n_nationkey, b.p, 0 FROM nation a, (SELECT DISTINCT n_name AS p FROM nation) b),
x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_u_sql(42, 'item_id::VARCHAR', 'p', 'own::VARCHAR')}, p, own) - 1 AS idx FROM r)
SELECT item_id, idx::BIGINT AS idx, p AS paragraph, (max(own) OVER s = 1 AND idx = min(idx) OVER s) AS is_gold FROM x WINDOW s AS (PARTITION BY item_id, p)""")
def negatives_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as questions and their gold paragraphs, among all names: the corpus is a fixed table of 25."""
    items = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item_id"), F.col("n_name").alias("question"), F.col("n_name").alias("paragraph"), F.lit(True).alias("is_gold"))
    return building.with_negatives(items, -1).select("item_id", F.col("idx").cast("bigint").alias("idx"), "paragraph", "is_gold")


@query(f"""WITH x AS (SELECT o_orderkey, (o_orderkey % 23)::INT - 11 AS v, {_u_sql(7, 'o_orderkey::VARCHAR', "'close'")} AS u FROM orders), b AS (SELECT *, greatest(1, abs(v) - 4) AS lo, least(15, abs(v) + 4) AS hi FROM x)
SELECT o_orderkey, 'OFFSET P' || (lo + floor(u * (hi - lo + 1))::INT) * CASE WHEN v < 0 THEN -1 ELSE 1 END || 'M' AS e FROM b""")
def gen_offsets_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("OFFSET P"), (F.col("o_orderkey") % 23 - 11).cast("int").cast("string"), F.lit("M"))
    return table(spark, sf_dir, "orders").select("o_orderkey", datagen.close_offset(7, F.col("o_orderkey"), own).alias("e"))
