"""Queries on grounding, intervals and Gaussians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import gaussian, temporal
from .base import CANDIDATES, day, in_parts, kl_similarity, query, table

_FORMS_SQL = """f AS (
  SELECT o_orderkey, form, CASE form WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m') WHEN 3 THEN strftime(d, '%Y') WHEN 4 THEN substr(strftime(d, '%Y'), 1, 3) || '0s'
    WHEN 5 THEN substr(strftime(d, '%Y'), 1, 3) || '0s-early' WHEN 6 THEN substr(strftime(d, '%Y'), 1, 3) || '0s-mid' WHEN 7 THEN substr(strftime(d, '%Y'), 1, 3) || '0s-late'
    WHEN 8 THEN '2' || strftime(d, '%Y') WHEN 9 THEN '0' || substr(strftime(d, '%Y'), 2) ELSE strftime(d, '%Y') || '-' || (12 + month(d))::VARCHAR END AS e
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, unnest(generate_series(1, 10)) AS form FROM orders))"""

_BOUNDS_SQL = """b AS (
  SELECT *, CASE WHEN form = 1 THEN e::DATE WHEN form = 2 THEN (e || '-01')::DATE WHEN form = 3 THEN make_date(e::INT, 1, 1)
      WHEN form BETWEEN 4 AND 7 THEN make_date(substr(e, 1, 4)::INT + CASE form WHEN 6 THEN 4 WHEN 7 THEN 7 ELSE 0 END, 1, 1) END AS s,
    CASE WHEN form = 1 THEN e::DATE WHEN form = 2 THEN last_day((e || '-01')::DATE) WHEN form = 3 THEN make_date(e::INT, 12, 31)
      WHEN form BETWEEN 4 AND 7 THEN make_date(substr(e, 1, 4)::INT + CASE form WHEN 5 THEN 3 WHEN 6 THEN 6 ELSE 9 END, 12, 31) END AS t FROM f)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    y = F.date_format(d, "yyyy")
    decade = F.concat(F.substring(y, 1, 3), F.lit("0s"))
    forms = [
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM"), y, decade, F.concat(decade, F.lit("-early")), F.concat(decade, F.lit("-mid")), F.concat(decade, F.lit("-late")),
        F.concat(F.lit("2"), y), F.concat(F.lit("0"), F.substring(y, 2, 3)), F.concat(y, F.lit("-"), (12 + F.month(d)).cast("string")),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*forms)).alias("i", "e")).withColumn("form", (F.col("i") + 1).cast("bigint")).drop("i")


@query(f"SELECT o_orderkey, {day('o_orderdate')}::BIGINT AS day_index FROM orders")
def day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.day_index(F.col("o_orderdate").cast("date")).cast("bigint").alias("day_index"))


@query(f"WITH {_FORMS_SQL} SELECT o_orderkey, form, e, CASE WHEN form = 1 THEN 'yyyy-mm-dd' WHEN form = 2 THEN 'yyyy-mm' WHEN form = 3 THEN 'yyyy' WHEN form <= 7 THEN 'yyyys' END AS kind FROM f")
def date_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).select("o_orderkey", "form", "e", temporal.date_kind(F.col("e")).alias("kind"))


@query(f"WITH {_FORMS_SQL}, {_BOUNDS_SQL} SELECT o_orderkey, form, strftime(s, '%Y-%m-%d') AS start_day, strftime(t, '%Y-%m-%d') AS end_day FROM b WHERE form NOT BETWEEN 4 AND 7")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = temporal.date_bounds(F.col("e"))
    return _forms(spark, sf_dir).where("form NOT BETWEEN 4 AND 7").select("o_orderkey", "form", b["start"].cast("string").alias("start_day"), b["end"].cast("string").alias("end_day"))


@query(f"WITH {_FORMS_SQL}, {_BOUNDS_SQL} SELECT o_orderkey, form, strftime(s, '%Y-%m-%d') AS start_day, strftime(t, '%Y-%m-%d') AS end_day FROM b WHERE form BETWEEN 4 AND 7")
def decade_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = temporal.date_bounds(F.col("e"))
    return _forms(spark, sf_dir).where("form BETWEEN 4 AND 7").select("o_orderkey", "form", b["start"].cast("string").alias("start_day"), b["end"].cast("string").alias("end_day"))


_OFFSETS_SQL = """l AS (
  SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, l_linenumber * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS n, ['D', 'W', 'M', 'Y'][l_partkey % 4 + 1] AS u
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _offsets(spark: SparkSession, sf_dir: str, family: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    u = F.get(F.array(*map(F.lit, "DWMY")), (F.col("l_partkey") % 4).cast("int"))
    rows = rows.select("l_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("a"), n.alias("n"), u.alias("u"))
    size, num = F.abs("n").cast("string"), F.col("n").cast("string")
    e = {
        "point": F.concat(F.lit("OFFSET P"), num, "u"),
        "span": F.concat(F.lit("THIS P"), size, "u", F.lit(" OFFSET P"), num, "u"),
        "this": F.concat(F.lit("THIS P"), size, "u"),
        "near": F.concat(F.when(F.col("n") < 0, "PREV_IMMEDIATE P").otherwise("NEXT_IMMEDIATE P"), size, "u"),
        "far": F.concat(F.lit("OFFSET P"), (F.col("n") * 10).cast("string"), "u"),
    }
    if family:
        return rows.withColumn("e", e[family])
    return rows.select("*", F.explode(F.create_map(*[x for k, v in e.items() for x in (F.lit(k), v)])).alias("family", "e"))


def _grounded(rows: DataFrame) -> DataFrame:
    b = temporal.ground(F.col("e"), F.col("a"))
    return rows.select("l_orderkey", "l_linenumber", "e", b["start"].cast("string").alias("start_day"), b["end"].cast("string").alias("end_day"))


def _offset_sql(e: str, start: str, end: str) -> str:
    return f"WITH {_OFFSETS_SQL} SELECT l_orderkey, l_linenumber, {e} AS e, strftime(CAST({start} AS DATE), '%Y-%m-%d') AS start_day, strftime(CAST({end} AS DATE), '%Y-%m-%d') AS end_day FROM l"


@query(
    f"""WITH {_OFFSETS_SQL}, x AS (
  SELECT *, unnest(['point', 'span', 'this', 'near', 'far']) AS family FROM l)
SELECT l_orderkey, l_linenumber, family, CASE family WHEN 'point' THEN lower(u) WHEN 'span' THEN 't' || lower(u) WHEN 'this' THEN 'this' || lower(u) WHEN 'near' THEN 'immediate' || lower(u)
  ELSE CASE WHEN abs(n * 10) < 30 THEN lower(u) END END AS kind FROM x"""
)
def offset_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("l_orderkey", "l_linenumber", "family", temporal.offset_kind(F.col("e")).alias("kind"))


_POINT = "(a + (n * CASE u WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 ELSE 365 END)::INT)"
_OTHER = "(a + (n * CASE u WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 ELSE 356 END)::INT)"


@query(_offset_sql("'OFFSET P' || n || u", _POINT, _POINT))
def offset_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(_offsets(spark, sf_dir, "point"))


@query(_offset_sql("'THIS P' || abs(n) || u || ' OFFSET P' || n || u", f"least(a, {_OTHER})", f"greatest(a, {_OTHER})"))
def offset_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(_offsets(spark, sf_dir, "span"))


def _windows_sql(off: str, n: str) -> tuple[str, str]:
    week = f"(date_trunc('week', a)::DATE + (7 * ({off}))::INT)"
    month, year = f"date_trunc('month', a + to_months(({off})::INT))::DATE", f"make_date((year(a) + ({off}))::INT, 1, 1)"
    start = f"CASE u WHEN 'W' THEN {week} WHEN 'M' THEN {month} ELSE {year} END"
    end = f"CASE u WHEN 'W' THEN {week} + (7 * ({n}))::INT WHEN 'M' THEN last_day(CAST({month} + to_months((({n}) - 1)::INT) AS DATE)) ELSE make_date((year(a) + ({off}) + ({n}) - 1)::INT, 12, 31) END"
    return start, end


_T = _windows_sql("1 - abs(n)", "abs(n)")
_N = _windows_sql("n", "abs(n)")


@query(_offset_sql("'THIS P' || abs(n) || u", f"CASE u WHEN 'D' THEN a + (1 - abs(n))::INT ELSE {_T[0]} END", f"CASE u WHEN 'D' THEN a ELSE {_T[1]} END"))
def this_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(_offsets(spark, sf_dir, "this"))


@query(_offset_sql("CASE WHEN n < 0 THEN 'PREV_IMMEDIATE P' ELSE 'NEXT_IMMEDIATE P' END || abs(n) || u", f"CASE u WHEN 'D' THEN CASE WHEN n = 1 THEN a + 1 ELSE least(a, a + n::INT) END ELSE {_N[0]} END", f"CASE u WHEN 'D' THEN greatest(a, a + n::INT) ELSE {_N[1]} END"))
def immediate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(_offsets(spark, sf_dir, "near"))


def _window_query(unit: str, f) -> tuple:
    start, end = _windows_sql("n", "abs(n)")
    sql = f"WITH {_OFFSETS_SQL}, x AS (SELECT l_orderkey, l_linenumber, a, n, '{unit}' AS u FROM l) SELECT l_orderkey, l_linenumber, strftime(CAST({start} AS DATE), '%Y-%m-%d') AS start_day, strftime(CAST({end} AS DATE), '%Y-%m-%d') AS end_day FROM x"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = f(F.col("a"), F.col("n"), F.abs("n"))
        return _offsets(spark, sf_dir, "point").select("l_orderkey", "l_linenumber", b["start"].cast("string").alias("start_day"), b["end"].cast("string").alias("end_day"))

    return sql, run


for _name, _unit, _f in (("week_window", "W", temporal.week_window), ("month_window", "M", temporal.month_window), ("year_window", "Y", temporal.year_window)):
    _sql, _run = _window_query(_unit, _f)
    _run.__name__ = _name
    query(_sql)(_run)


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y') || ',' || strftime(CAST(o_orderdate AS DATE) + INTERVAL 400 DAY, '%Y-%m') AS e, strftime(make_date(year(o_orderdate), 1, 1), '%Y-%m-%d') AS start_day, strftime(last_day(CAST(CAST(o_orderdate AS DATE) + INTERVAL 400 DAY AS DATE)), '%Y-%m-%d') AS end_day FROM orders")
def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    e = F.concat_ws(",", F.date_format(d, "yyyy"), F.date_format(F.date_add(d, 400), "yyyy-MM"))
    b = temporal.interval_bounds(F.col("e"))
    return table(spark, sf_dir, "orders").select("o_orderkey", e.alias("e")).select("o_orderkey", "e", b["start"].cast("string").alias("start_day"), b["end"].cast("string").alias("end_day"))


@query(
    f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN {day('make_date(year(a), 1, 1)')} WHEN 1 THEN {day('a')} - 21 WHEN 2 THEN {day('a')} WHEN 3 THEN {day('make_date(year(a), 1, 1)')} END::BIGINT AS a,
  CASE k WHEN 0 THEN {day('make_date(year(a), 12, 31)')} WHEN 1 THEN {day('a')} - 21 WHEN 2 THEN {day('a')} WHEN 3 THEN {day('a')} END::BIGINT AS b FROM x"""
)
def ground_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    forms = F.array(F.date_format(d, "yyyy"), F.lit("OFFSET P-3W"), F.lit("PRESENT_REF"), F.concat_ws(",", F.date_format(d, "yyyy"), F.date_format(d, "yyyy-MM-dd")), F.lit("P3Y"))
    i = temporal.day_interval(temporal.ground(F.col("e"), F.col("d")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.get(forms, (F.col("o_orderkey") % 5).cast("int")).alias("e"))
    return rows.select("o_orderkey", i["a"].cast("bigint").alias("a"), i["b"].cast("bigint").alias("b"))


@query("SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS month_index, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_year_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    t = F.concat(F.lit("Delivered on 12 parts, "), F.date_format(d, "MMM"), F.lit(", "), F.date_format(d, "yyyy"), F.lit(" or so"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", temporal.month_year_index(F.col("t")).cast("bigint").alias("month_index"), temporal.month_year_date(F.col("t")).alias("month"))


def _dated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("In "), (1990 + F.col("doc_id") % 30).cast("string"), F.lit(" and "), (1985 + F.col("doc_id") % 7).cast("string"), F.lit(": "), "text").alias("text"))


#: SQL: the distinct years of each text.
DATED_SQL = r"SELECT doc_id, list_transform(list_distinct(regexp_extract_all('In ' || (1990 + doc_id % 30) || ' and ' || (1985 + doc_id % 7) || ': ' || text, '@', 1)), lambda y: y::BIGINT) AS y FROM documents".replace("@", temporal.YEAR)


@query(f"SELECT doc_id, list_min(y) AS first_year, list_max(y) AS last_year, len(y)::BIGINT AS n_years FROM ({DATED_SQL})")
def year_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = temporal.year_tokens(F.col("text"))
    rows = _dated_docs(spark, sf_dir).select("doc_id", y.alias("y"))
    return rows.select("doc_id", F.array_min("y").cast("bigint").alias("first_year"), F.array_max("y").cast("bigint").alias("last_year"), F.size("y").cast("bigint").alias("n_years"))


@query(f"SELECT doc_id, (list_max(y) - list_min(y) + 1)::BIGINT AS n_years FROM ({DATED_SQL})")
def query_year_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_docs(spark, sf_dir).select("doc_id", F.size(temporal.year_interval(F.col("text"))).cast("bigint").alias("n_years"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'L1_arithmetic' ELSE 'L2_time_event' END AS subtype FROM events")
def question_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("What is the TIME after "), "event_type")).otherwise(F.concat(F.lit("Which one did "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", temporal.question_subtype(q).alias("subtype"))


@query(f"SELECT l_orderkey, l_linenumber, ({day('l_shipdate')} * 2 + l_linenumber + 1) / 2.0::DOUBLE AS mu, round((l_linenumber + 1) * (l_linenumber + 1) / 12.0::DOUBLE, 6) AS var FROM lineitem")
def interval_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = temporal.day_index(F.col("l_shipdate").cast("date"))
    m = gaussian.moments(a, a + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m["mu"].alias("mu"), F.round(m["var"], 6).alias("var"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions, their lines as candidates: q, idx, q and p intervals, a second score, gold."""
    orders, lines = in_parts(table(spark, sf_dir, "lineitem").count(), (table(spark, sf_dir, "orders"), "o_orderkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    qa, pa = temporal.day_index(F.col("o_orderdate").cast("date")), temporal.day_index(F.col("l_shipdate").cast("date"))
    order = W.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")  # line numbers repeat
    return rows.select(
        F.col("o_orderkey").alias("q"), F.row_number().over(order).alias("idx"), qa.alias("qa"), (qa + 30).alias("qb"), pa.alias("pa"), (pa + F.col("l_linenumber") * 7).alias("pb"),
        (F.col("l_quantity") / (1 + F.col("l_discount"))).alias("sem"), (F.col("l_returnflag") == "R").alias("is_gold"),
    )


@query(
    f"""WITH {CANDIDATES}, c AS (SELECT q, idx, {kl_similarity('qa', 'qb', 'pa', 'pb')} AS s FROM cand)
SELECT q, idx::BIGINT AS idx, rn::BIGINT AS rn, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, idx DESC) AS rn FROM c) WHERE rn <= 5"""
)
def temporal_kl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gaussian.interval_similarity(F.col("qa"), F.col("qb"), F.col("pa"), F.col("pb"))
    rows = candidates(spark, sf_dir).select("q", "idx", s.alias("s"))
    rn = F.row_number().over(W.partitionBy("q").orderBy(F.round("s", 9).desc(), F.col("idx").desc()))
    return rows.withColumn("rn", rn).where("rn <= 5").select("q", F.col("idx").cast("bigint").alias("idx"), F.col("rn").cast("bigint").alias("rn"), F.round("s", 6).alias("score"))


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS a, {day('l_shipdate')} AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE {kl_similarity(day('make_date(year(a), 1, 1)'), day('make_date(year(a), 12, 31)'), 's', 's')} END, 6) AS score FROM x"""
)
def expr_similarity_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = F.col("o_orderdate").cast("date")
    e2 = F.when(F.col("l_linenumber") % 3 == 0, "P3Y").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = rows.select("l_orderkey", "l_linenumber", d.alias("d"), F.date_format(d, "yyyy").alias("e1"), e2.alias("e2"))
    return rows.select("l_orderkey", "l_linenumber", F.round(gaussian.expression_similarity(F.col("e1"), F.col("d"), F.col("e2"), F.col("d"), lenient=True), 6).alias("score"))


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, {day('o_orderdate')} AS a1, {day('o_orderdate')} + 30 AS b1, {day('l_shipdate')} AS a2, {day('l_shipdate')} + l_linenumber AS b2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT *, greatest(0, greatest(a1, a2) - least(b1, b2))::DOUBLE AS gap, least(b1 - a1, b2 - a2) + 1 AS unit, least(b1, b2) - greatest(a1, a2) + 1 AS common, greatest(b1, b2) - least(a1, a2) + 1 AS un FROM x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a1 = a2 AND b1 = b2 THEN 1.0 WHEN a1 < a2 AND b1 > b2 THEN 0.9 WHEN common > 0 THEN least(0.2::DOUBLE, common / un::DOUBLE) WHEN gap / unit >= 10 THEN gap / unit ELSE gap END, 6)::DOUBLE AS value, ((a1 = a2 AND b1 = b2) OR common > 0) AS similar FROM y"""
)
def legacy_interval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a1, a2 = temporal.day_index(F.col("o_orderdate").cast("date")), temporal.day_index(F.col("l_shipdate").cast("date"))
    s = gaussian.legacy_interval_score(a1, a1 + 30, a2, a2 + F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", F.round("s.value", 6).alias("value"), "s.similar")


@query(
    f"""SELECT o_orderkey, i::BIGINT AS i, round(CASE WHEN i % 2 = 0 THEN sin(k / power(10000.0, 2.0 * (i // 2) / 32)) ELSE cos(k / power(10000.0, 2.0 * (i // 2) / 32)) END, 6) AS p
FROM (SELECT o_orderkey, {day('o_orderdate')}::DOUBLE AS k, unnest(generate_series(0, 31)) AS i FROM orders)"""
)
def date_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(gaussian.date_encoding(F.col("o_orderdate").cast("date"))).alias("i", "p"))
    return rows.select("o_orderkey", F.col("i").cast("bigint").alias("i"), F.round("p", 6).alias("p"))


_VECTORS_SQL = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label)"""


def _centres(vectors: DataFrame) -> DataFrame:
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


@query(
    f"""WITH {_VECTORS_SQL}
SELECT vec_id, round(1 / (1 + list_sum(list_transform(list_zip(v, c), lambda p: ln((0.1 + abs(p[2])) / (0.1 + abs(p[1]))) + ((0.1 + abs(p[1])) * (0.1 + abs(p[1])) + (p[1] - p[2]) * (p[1] - p[2])) / (2 * (0.1 + abs(p[2])) * (0.1 + abs(p[2]))) - 0.5)) / len(v)) / 0.05, 6) AS score
FROM e JOIN c USING (label)"""
)
def gaussian_vec_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    rows = v.join(_centres(v), "label")

    def std(a):
        return F.transform(a, lambda x: 0.1 + F.abs(x.cast("double")))

    return rows.select("vec_id", F.round(gaussian.vector_similarity(F.col("embedding"), std(F.col("embedding")), F.col("c"), std(F.col("c"))), 6).alias("score"))


@query(
    f"""WITH {_VECTORS_SQL}, s AS (SELECT c.label, vec_id, list_cosine_similarity(v, c) AS s FROM e, c)
SELECT label, vec_id, rn::BIGINT AS rn, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rn FROM s) WHERE rn <= 20"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's centre against all vectors; there is one centre a label."""
    v = table(spark, sf_dir, "embeddings")
    rows = v.select("vec_id", "embedding").crossJoin(F.broadcast(_centres(v))).select("label", "vec_id", gaussian.cosine(F.col("embedding"), F.col("c")).alias("s"))
    rn = F.row_number().over(W.partitionBy("label").orderBy(F.round("s", 9).desc(), "vec_id"))
    return rows.withColumn("rn", rn).where("rn <= 20").select("label", "vec_id", F.col("rn").cast("bigint").alias("rn"), F.round("s", 6).alias("score"))
