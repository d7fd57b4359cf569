"""Registry of queries, table access, and the SQL pieces that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers the function under its name, with its SQL for DuckDB if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts at a time, before runs or cuts multiply them.
TASK_ROWS = 150_000


def in_parts(n: int, *keyed: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables dealt out by their keys into as many parts as n rows ask for, so what a task sorts grows with no table; small ones stay as they are."""
    if n <= TASK_ROWS:
        return [df for df, _ in keyed]
    return [df.repartition(max(-(-n // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), key) for df, key in keyed]


def day(e: str) -> str:
    """SQL: days since the calendar's first day."""
    return f"date_diff('day', DATE '1000-01-01', CAST({e} AS DATE))"


def kl_similarity(qa: str, qb: str, da: str, db: str) -> str:
    """SQL: similarity of two inclusive day intervals."""
    def mu(a: str, b: str) -> str:
        return f"(({a}) + ({b}) + 1) / 2.0::DOUBLE"

    def var(a: str, b: str) -> str:
        return f"(({b}) - ({a}) + 1) * (({b}) - ({a}) + 1) / 12.0::DOUBLE"

    gap = f"({mu(qa, qb)} - {mu(da, db)})"
    return f"1 / (1 + 0.5 * ln(({var(da, db)}) / ({var(qa, qb)})) + ({var(qa, qb)} + {gap} * {gap}) / (2 * {var(da, db)}) - 0.5)"


#: SQL: orders as questions, their lines as candidate passages with intervals, a second score, and gold marks.
CANDIDATES = f"""cand AS (
  SELECT o_orderkey AS q, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS idx, {day('o_orderdate')} AS qa, {day('o_orderdate')} + 30 AS qb,
    {day('l_shipdate')} AS pa, {day('l_shipdate')} + l_linenumber * 7 AS pb, l_quantity / (1 + l_discount) AS sem, l_returnflag = 'R' AS gold
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""

#: SQL: the candidates' temporal and second scores, scaled per question.
SCALED = f"""{CANDIDATES},
sc AS (SELECT q, idx, gold, {kl_similarity('qa', 'qb', 'pa', 'pb')} AS t, sem AS s FROM cand),
nm AS (SELECT *, CASE WHEN max(t) OVER w = min(t) OVER w THEN 0 ELSE (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) END AS nt,
  CASE WHEN max(s) OVER w = min(s) OVER w THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS ns FROM sc WINDOW w AS (PARTITION BY q))"""


def ranked_sql(score: str, source: str = "nm") -> str:
    """SQL: full ranking by a rounded score, later candidates first among ties."""
    return f"rk AS (SELECT q, idx, gold, row_number() OVER (PARTITION BY q ORDER BY round({score}, 9) DESC, idx DESC) AS rn FROM {source})"
