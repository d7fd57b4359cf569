"""Queries on text functions, question answering, benchmark builders, generators, training metrics, reports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import benchmarks, datagen, qa
from ..sources import reports
from ..streaming import event_counts
from .base import query, table
from .retrieval import _BM25_SQL, _bm25

_TOKENS = "list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"
_PUNCT = "translate({t}, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"


def _squeeze_sql(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _norm_sql(t: str) -> str:
    bare = _PUNCT.format(t=f"lower({t})")
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def _u_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick_sql(u: str, *options: str) -> str:
    return f"list_extract([{', '.join(options)}], floor({u} * {len(options)})::INT + 1)"


@query(f"SELECT doc_id, len({_TOKENS.format(t='text')})::BIGINT AS n_tokens, len(list_distinct({_TOKENS.format(t='text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


@query(f"SELECT doc_id FROM documents WHERE len({_TOKENS.format(t='text')}) < 100")
def long_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.token_count(F.col("text")) < 100).select("doc_id")


@query(f"SELECT conv_id, turn, md5({_norm_sql('text')}) AS normal FROM conversations")
def squad_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.normalize_answer(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, CASE WHEN length({_squeeze_sql('text')}) > 160 THEN rtrim(substr({_squeeze_sql('text')}, 1, 160)) || ' …' ELSE {_squeeze_sql('text')} END AS snippet FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(f"{_BM25_SQL}, t AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, id) AS rn FROM sc), p AS (SELECT item_id, string_agg('[' || rn || '] ' || d.text, chr(10) ORDER BY rn) AS lines FROM t JOIN d USING (id) WHERE rn <= 3 GROUP BY item_id)\n"
       "SELECT b.item_id, md5('Passages:' || chr(10) || lines || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer:') AS user_message FROM p JOIN benchmark b USING (item_id)")  # fmt: skip
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 8).desc(), "id"))
    best = _bm25(spark, sf_dir).withColumn("rn", rn).where("rn <= 3")
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("id")).withColumnRenamed("text", "passage")
    passages = best.join(docs, "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "passage"))), lambda x: x["passage"]).alias("passages"))
    rows = table(spark, sf_dir, "benchmark").join(passages, F.col("item_id") == F.col("query_id"))
    return rows.select("item_id", F.md5(text.prompt(F.col("text"), F.col("passages"), "Answer from the passages.")[1]["content"]).alias("user_message"))


@query(f"{_BM25_SQL}, t AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, id) AS rn FROM sc) SELECT t.item_id, string_agg(printf('%2d. %s%s', rn::INT, CASE WHEN contains(d.text, b.text) THEN '* ' ELSE '  ' END, t.id::VARCHAR), chr(10) ORDER BY rn) AS block FROM t JOIN d ON d.id = t.id JOIN benchmark b ON b.item_id = t.item_id WHERE rn <= 5 GROUP BY t.item_id")
def ranked_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 8).desc(), "id"))
    best = _bm25(spark, sf_dir).withColumn("rn", rn).where("rn <= 5")
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("id"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("asked"))
    line = F.format_string("%2d. %s%s", "rn", F.when(F.col("text").contains(F.col("asked")), "* ").otherwise("  "), F.col("id").cast("string"))
    rows = best.join(docs, "id").join(items, "query_id").select("query_id", "rn", line.alias("line"))
    return rows.groupBy(F.col("query_id").alias("item_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("block"))


_MONTHS_SQL = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {_u_sql(42, 'o_orderkey::VARCHAR')} AS u FROM orders)
SELECT o_orderkey, {_pick_sql('u', f"day(d) || ' ' || {_MONTHS_SQL}[month(d)] || ' ' || year(d)", f"day(d) || ', ' || substr({_MONTHS_SQL}[month(d)], 1, 3) || ', ' || year(d)")} AS day_text,
  {_pick_sql('u', f"substr({_MONTHS_SQL}[month(d)], 1, 3) || ', ' || year(d)", f"{_MONTHS_SQL}[month(d)] || ' ' || year(d)")} AS month_text, 'late ' || substr(year(d)::VARCHAR, 1, 3) || '0s' AS decade_text FROM x""")
def date_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u = F.col("o_orderdate"), text.uniform(42, F.col("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", u.alias("u"), F.date_format(d, "yyyy-MM-dd").alias("a"), F.date_format(d, "yyyy-MM").alias("b"), F.concat(F.substring(F.date_format(d, "yyyy"), 1, 3), F.lit("0s-late")).alias("c"))
    return rows.select("o_orderkey", *[text.date_to_text(F.col(x), F.col("u")).alias(n) for x, n in (("a", "day_text"), ("b", "month_text"), ("c", "decade_text"))])


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber AS n, {_u_sql(42, 'l_orderkey::VARCHAR', 'l_linenumber::VARCHAR')} AS u, l_linenumber || ' week' || CASE WHEN l_linenumber = 1 THEN '' ELSE 's' END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, {_pick_sql('u', "c || ' ago'", "c || ' earlier'", "c || ' before'")} AS back, CASE WHEN n = 1 THEN 'next week' ELSE 'the next ' || c END AS ahead FROM x""")
def offset_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, n = text.uniform(42, F.col("l_orderkey"), F.col("l_linenumber")), F.col("l_linenumber")
    back, ahead = (text.offset_to_text(F.lit(f), F.lit("W"), x, u) for f, x in (("OFFSET", -n), ("NEXT_IMMEDIATE", n)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", back.alias("back"), ahead.alias("ahead"))


@query(f"""WITH x AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS a, (year(o_orderdate) + 2)::VARCHAR AS b, {_u_sql(42, 'o_orderkey::VARCHAR')} AS u FROM orders)
SELECT o_orderkey, {_pick_sql('u', "'from ' || a || ' to ' || b", "'between ' || a || ' and ' || b", "a || ' - ' || b")} AS span_text FROM x""")
def interval_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.interval_to_text(y.cast("string"), (y + 2).cast("string"), text.uniform(42, F.col("o_orderkey"))).alias("span_text"))


_TURNS_SQL = "a AS (SELECT conv_id, turn, text AS prediction, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS later FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a prediction; the next two as answers."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prediction"), F.lead("text").over(w).alias("a"), F.lead("text", 2).over(w).alias("b"))
    return rows.select("conv_id", "turn", "prediction", F.filter(F.array("a", "b"), lambda x: x.isNotNull()).alias("golds"))


def _strip_sql(t: str) -> str:
    """As strip_prediction does."""
    def ends(x: str) -> str:
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    bare = ends(f"regexp_replace({ends(t)}, '^answer\\s*[:\\-]\\s*', '', 'i')")
    bare = f"regexp_replace(regexp_replace({bare}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
    marked = ends(f"regexp_replace({ends(bare)}, '\\s*\\[\\d+\\]\\s*', ' ', 'g')")
    return ends(f"split_part({marked}, chr(10), 1)")


_SCORES_SQL = f"""{_TURNS_SQL}, g AS (SELECT conv_id, turn, {_norm_sql(_strip_sql('prediction'))} AS p, unnest(CASE WHEN nxt IS NULL THEN [NULL] WHEN later IS NULL THEN [nxt] ELSE [nxt, later] END) AS g, row_number() OVER () AS id FROM a),
t AS (SELECT *, {_norm_sql('g')} AS n, list_filter(string_split(p, ' '), lambda w: w <> '') AS pw, list_filter(string_split({_norm_sql('g')}, ' '), lambda w: w <> '') AS gw FROM g),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))), 0)::DOUBLE AS c FROM t),
s AS (SELECT conv_id, turn, p, bool_or(g IS NOT NULL) AS has, max((n = p)::INT) AS em, max(contains(p, n)::INT) AS containment,
  max(CASE WHEN g IS NULL THEN 0 WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = len(gw))::INT ELSE coalesce(2 * (c / len(pw)) * (c / len(gw)) / nullif(c / len(pw) + c / len(gw), 0), 0) END) AS f1 FROM o GROUP BY conv_id, turn, p)"""


@query(f"WITH {_SCORES_SQL} SELECT conv_id, turn, em::DOUBLE AS em, round(f1, 6)::DOUBLE AS f1, containment::DOUBLE AS containment FROM s WHERE has")
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match, token F1 and containment of every turn that has answers."""
    rows, p, g = _turns(spark, sf_dir).where(F.size("golds") > 0), F.col("prediction"), F.col("golds")
    return rows.select("conv_id", "turn", qa.exact_match(p, g).alias("em"), F.round(qa.f1_score(p, g), 6).alias("f1"), qa.containment(p, g).alias("containment"))


@query(f"WITH {_SCORES_SQL} SELECT round(avg(CASE WHEN has THEN em END), 6)::DOUBLE AS em, round(avg(CASE WHEN has THEN f1 END), 6)::DOUBLE AS f1, round(avg(CASE WHEN has THEN containment END), 6)::DOUBLE AS containment, round(avg(has::INT), 6) AS answered FROM s")
def qa_em_f1_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.qa_metrics(_turns(spark, sf_dir), "prediction", "golds").select(*[F.round(c, 6).alias(c) for c in ("em", "f1", "containment", "answered")])


@query(f"WITH {_TURNS_SQL} SELECT conv_id, turn, ((coalesce({_norm_sql('nxt')}, '?') = {_norm_sql('prediction')}) OR (coalesce({_norm_sql('later')}, '?') = {_norm_sql('prediction')}))::INT::BIGINT AS em FROM (SELECT conv_id, turn, split_part(prediction, chr(10), 1) AS prediction, nxt, later FROM a) WHERE nxt IS NOT NULL")
def qa_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).where(F.size("golds") > 0)
    p = text.normalize_answer(F.substring_index("prediction", "\n", 1))
    return rows.select("conv_id", "turn", F.exists("golds", lambda g: text.normalize_answer(g) == p).cast("bigint").alias("em"))


@query(r"""WITH p AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, text FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(split_part(regexp_replace(regexp_replace(text, '^\s+', ''), '\s*\[\d+\]\s*', ' ', 'g'), chr(10), 1), '\s+$', '')) AS answer FROM p""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a generator might put them: after blank lines, with a heading, in quotes, with marks of sources; cleaned they are their first lines again."""
    rows = table(spark, sf_dir, "conversations").withColumn("k", (F.col("conv_id") + F.col("turn")) % 6)
    first = F.substring_index(F.regexp_replace(F.regexp_replace("text", r"^\s+", ""), r"\s*\[\d+\]\s*", " "), "\n", 1)
    forms = [F.concat(F.lit("\n"), first), F.concat(F.lit("\n\nAnswer: "), "text"), F.concat(F.lit(" \t"), "text"), F.concat(F.lit("ANSWER -\n"), "text"), F.concat(F.lit("answer: \""), first, F.lit("\"\n")), F.concat(F.lit("[1] "), "text")]
    return rows.select("conv_id", "turn", text.strip_prediction(F.get(F.array(*forms), F.col("k").cast("int"))).alias("answer"))


@query("SELECT p_partkey, len(list_filter([p_brand, p_type], lambda x: x IS NOT NULL))::BIGINT AS n_evidence, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand)::BIGINT AS n_answers FROM part p")
def rag_join_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    raw = part.select(F.col("p_brand").alias("question"), F.col("p_name").alias("answer"))
    items = part.select("p_partkey", F.col("p_brand").alias("question"), benchmarks.evidence("p_brand", "p_type").alias("e"))
    return qa.attach_answers(items, raw).select("p_partkey", F.size("e").cast("bigint").alias("n_evidence"), F.size("gold_answers").cast("bigint").alias("n_answers"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS label, l_extendedprice AS s FROM lineitem),
r AS (SELECT rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS b FROM x) SELECT round(100 * corr(a, b), 6) AS spearman FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


@query("""WITH x AS (SELECT o_custkey AS batch, year(o_orderdate) AS label, o_totalprice / 100000 AS s FROM orders),
p AS (SELECT a.batch, sum(exp(a.s - b.s)) AS t FROM x a JOIN x b ON a.batch = b.batch AND a.label < b.label GROUP BY a.batch)
SELECT x.batch, round(ln(1 + coalesce(max(t), 0)), 6) AS loss FROM x LEFT JOIN p USING (batch) GROUP BY x.batch""")
def cosent_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.year("o_orderdate").alias("label"), (F.col("o_totalprice") / 100000).alias("s"))
    return datagen.cosent(rows, "batch", "label", "s").select("batch", F.round("loss", 6).alias("loss"))


_DAY_SQL = f"(DATE '2030-12-31' - floor(376564 * (1 - power(1 - {_u_sql(7, 'o_orderkey::VARCHAR', chr(39) + 'day' + chr(39))}, 1.0::DOUBLE / 3)))::INT)"


def _date_sql(d: str, g: str, p: str) -> str:
    """SQL: the date expression of a day and the draws for its grain and a decade's part."""
    decade = f"substr(strftime({d}, '%Y'), 1, 3) || '0s' || CASE WHEN {p} < 0.5 THEN '' ELSE {_pick_sql(f'(({p} - 0.5) * 2)', "'-early'", "'-mid'", "'-late'")} END"
    return f"CASE WHEN {g} < 0.1 THEN {decade} WHEN {g} < 0.4 THEN strftime({d}, '%Y') WHEN {g} < 0.7 THEN strftime({d}, '%Y-%m') ELSE strftime({d}, '%Y-%m-%d') END"


@query(f"""WITH x AS (SELECT o_orderkey, {_DAY_SQL} AS d, {_u_sql(7, 'o_orderkey::VARCHAR', "'part'")} AS p, {_u_sql(7, 'o_orderkey::VARCHAR', "'grain'")} AS g FROM orders)
SELECT o_orderkey, {_date_sql('d', 'g', 'p')} AS e FROM x""")
def gen_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", datagen.random_date(7, F.col("o_orderkey")).alias("e"))


@query(f"""WITH x AS (SELECT o_orderkey, 1 + floor({_u_sql(7, 'o_orderkey::VARCHAR', "'n'")} * 10)::INT AS n, CASE WHEN {_u_sql(7, 'o_orderkey::VARCHAR', "'sign'")} < 0.5 THEN -1 ELSE 1 END AS s, {_pick_sql(_u_sql(7, 'o_orderkey::VARCHAR', "'unit'"), "'D'", "'W'", "'M'", "'Y'")} AS u, {_u_sql(7, 'o_orderkey::VARCHAR', "'form'")} AS f FROM orders)
SELECT o_orderkey, {_pick_sql('f', "'OFFSET P' || n * s || u", "'THIS P' || n || u || ' OFFSET P' || n * s || u", "'THIS P' || n || u", "CASE WHEN s < 0 THEN 'PREV_IMMEDIATE P' ELSE 'NEXT_IMMEDIATE P' END || n || u")} AS e FROM x""")
def gen_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", datagen.random_offset(7, F.col("o_orderkey")).alias("e"))


def _to_u(name: str) -> str:
    return _u_sql(7, "o_orderkey || '/to'", f"'{name}'")


@query(f"""WITH x AS (SELECT o_orderkey, DATE '2030-12-31' - floor(376564 * (1 - power(1 - {_u_sql(7, 'o_orderkey::VARCHAR', "'from'")}, 1.0::DOUBLE / 3)))::INT AS d, {_u_sql(7, 'o_orderkey::VARCHAR', "'igrain'")} AS g, {_u_sql(7, 'o_orderkey::VARCHAR', "'span'")} AS w,
  {_to_u('day')} AS u2, {_to_u('part')} AS p2, {_to_u('grain')} AS g2 FROM orders),
s AS (SELECT *, CASE WHEN g < 0.1 THEN make_date(year(d) // 10 * 10, 1, 1) WHEN g < 0.4 THEN make_date(year(d), 1, 1) WHEN g < 0.7 THEN make_date(year(d), month(d), 1) ELSE d END AS a,
  CASE WHEN g < 0.4 THEN 365 + floor(w * 6936) WHEN g < 0.7 THEN 30 + floor(w * 701) ELSE 1 + floor(w * 365) END::INT AS days FROM x),
e AS (SELECT *, least(a + days, DATE '2030-12-31') AS z FROM s), t AS (SELECT *, z - floor((z - a) * (1 - power(1 - u2, 1.0::DOUBLE / 3)))::INT AS b FROM e),
v AS (SELECT *, {_date_sql('b', 'g2', 'p2')} AS second, CASE WHEN g2 < 0.1 THEN make_date(year(b) // 10 * 10 + CASE WHEN p2 < 0.5 THEN 0 ELSE {_pick_sql('((p2 - 0.5) * 2)', '0', '4', '7')} END, 1, 1) WHEN g2 < 0.4 THEN make_date(year(b), 1, 1) WHEN g2 < 0.7 THEN make_date(year(b), month(b), 1) ELSE b END AS b_start FROM t)
SELECT o_orderkey, CASE WHEN b_start < a THEN second || ',' || strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || ',' || second END AS e FROM v""")
def gen_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", datagen.random_interval(7, F.col("o_orderkey")).alias("e"))


@query()
def gen_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many expressions as there are orders, with up to five partners each."""
    return datagen.synthetic_pairs(spark, table(spark, sf_dir, "orders").count())


@query(f"""WITH x AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m, (o_orderkey % 4)::INT AS y, (o_custkey % 12)::INT AS k, o_orderkey % 2 = 0 AS b FROM orders),
c AS (SELECT *, CASE WHEN k = 0 THEN y || ' year' || CASE WHEN y = 1 THEN '' ELSE 's' END WHEN y = 0 THEN k || ' month' || CASE WHEN k = 1 THEN '' ELSE 's' END ELSE y || ' year' || CASE WHEN y = 1 THEN '' ELSE 's' END || ' and ' || k || ' month' || CASE WHEN k = 1 THEN '' ELSE 's' END END AS a FROM x)
SELECT o_orderkey, a || CASE WHEN b THEN ' before ' ELSE ' after ' END || substr({_MONTHS_SQL}[month(m)], 1, 3) || ', ' || year(m) AS phrase, strftime(m + to_months((y * 12 + k) * CASE WHEN b THEN -1 ELSE 1 END), '%Y-%m') AS answer FROM c""")
def gen_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("m"), (F.col("o_orderkey") % 4).cast("int").alias("y"), (F.col("o_custkey") % 12).cast("int").alias("k"), (F.col("o_orderkey") % 2 == 0).alias("b"))
    return datagen.relation_phrases(rows, "m", "y", "k", "b").select("o_orderkey", "phrase", "answer")


@query()
def gen_real_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two values each against random expressions at their date."""
    d = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 8000).cast("int"))
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array(F.date_format(d, "yyyy"), F.date_format(d, "yyyy-MM")).alias("values"), d.alias("dct"))
    return datagen.document_pairs(entries)


#: Columns that tuples carry beside their key.
_CARRIED = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(f"WITH u AS (SELECT o_orderkey AS k, * FROM orders) SELECT k, {', '.join(_CARRIED)}, row_number() OVER (ORDER BY {_u_sql(42, 'k::VARCHAR')}, k)::BIGINT AS place FROM u")
def shuffle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *_CARRIED)
    whole = datagen.shuffled_union([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")], ["k"])
    return whole.select("k", *_CARRIED, (F.col("position") + 1).alias("place"))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {_u_sql(42, chr(39) + 'orders' + chr(39), 'o_orderkey::VARCHAR')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {', '.join(_CARRIED)}, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM r")
def split_val_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.val_test_split(table(spark, sf_dir, "orders").select("o_orderkey", *_CARRIED), "o_orderkey", "orders")


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {', '.join(_CARRIED)}, i::BIGINT AS position, CASE WHEN i < floor(n * 0.9) THEN 'train' WHEN i < floor(n * 0.98) THEN NULL WHEN i < floor(n * 0.99) THEN 'val' ELSE 'test' END AS split FROM r")
def split_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.contiguous_splits(table(spark, sf_dir, "orders").select("o_orderkey", *_CARRIED), ["o_orderkey"])


@query("""WITH t AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer), v AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
e AS (SELECT unnest(generate_series(0, (SELECT ceil(count(*) * 10 / 9.0)::BIGINT - count(*) - 1 FROM t))) AS id)
SELECT 'train' AS part, key, position::BIGINT AS position FROM t UNION ALL SELECT 'val', key, (id + (SELECT count(*) FROM t))::BIGINT FROM e JOIN v ON v.i = e.id % (SELECT count(*) FROM v)""")
def stage_finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return benchmarks.stage_finetune(train, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT o_orderkey AS question, l_linenumber::BIGINT AS para, l_shipmode AS answer FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE l_shipmode <> 'NO'")
def build_timeqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions with their lines' flags as answers; one kind of answer is empty and falls out."""
    answer = F.concat("l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.when(answer == "NO", "").otherwise(answer).alias("answer"), F.col("l_linenumber").cast("bigint").alias("para")).alias("a"))
    items = table(spark, sf_dir, "orders").join(lines.groupBy("l_orderkey").agg(F.collect_list("a").alias("answers")), F.col("o_orderkey") == F.col("l_orderkey"))
    nested = items.select(F.array(F.struct(F.col("o_orderkey").alias("question"), "answers")).alias("questions"))
    return benchmarks.answered(nested, "questions").select("question", "para", "answer")


@query("WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(contains(p, 'the') AND NOT contains(p, 'and'))::BIGINT AS n_gold FROM p GROUP BY doc_id")
def build_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = benchmarks.split_context(F.col("text"), F.array(F.lit("the")), F.array(F.lit("and")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("l"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("l.is_gold").alias("n_gold"))


@query("SELECT count(*)::BIGINT AS n FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)")
def build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.shared_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT doc_id, list_distinct(list_transform(string_split(text, '. '), lambda x: trim(x, ' '))) AS s FROM documents) SELECT doc_id, (len(s) + CASE WHEN list_contains(s, 'gold') THEN 0 ELSE 1 END)::BIGINT AS n FROM s")
def build_menat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences here end with a full stop and a space."""
    t = F.replace("text", F.lit(". "), F.lit(" . "))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(benchmarks.sentence_set(t, F.array(F.lit("gold")))).cast("bigint").alias("n"))


@query("SELECT c_custkey, len(list_filter([c_mktsegment, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END], lambda x: x <> ''))::BIGINT AS n FROM customer")
def build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("second", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")))
    return rows.select("c_custkey", F.size(benchmarks.evidence("c_mktsegment", "second")).cast("bigint").alias("n"))


@query(f"{_BM25_SQL}, ps AS (SELECT b.item_id, d.id FROM benchmark b JOIN d ON contains(d.text, b.text)), r AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rn FROM (SELECT item_id, id, round(score, 8) AS score FROM sc) s ANTI JOIN ps USING (item_id, id)) SELECT item_id, id AS doc_id, rn::BIGINT AS rn FROM r WHERE rn <= 5")
def negatives_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("id"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("asked"))
    positives = docs.join(F.broadcast(items), F.col("text").contains(F.col("asked"))).select("query_id", "id")
    best = benchmarks.top_negatives(_bm25(spark, sf_dir).withColumn("score", F.round("score", 8)), positives, 5)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("rn").cast("bigint").alias("rn"))


@query("""WITH c AS (SELECT DISTINCT strftime(o_orderdate, '%b, %Y') AS t, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders),
q AS (SELECT o_orderkey AS qid, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), r AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY abs(c.m - q.m), c.m, t) AS rank FROM q JOIN c ON c.m <> q.m) SELECT qid, t AS text, rank::BIGINT AS rank FROM r WHERE rank <= 5""")
def hard_negatives_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's month against the months of all orders."""
    t = F.date_format("o_orderdate", "MMM, yyyy")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), t.alias("question"), t.alias("gold"))
    picked = benchmarks.nearest_dated(o, o.select(F.col("gold").alias("text")), pool=5, take=5)
    return picked.select("qid", "text", F.col("rank").cast("bigint").alias("rank"))


_PLACE_SQL = f"least(floor(({_u_sql(42, 'qid::VARCHAR', 'draw::VARCHAR')} + {_u_sql(43, 'qid::VARCHAR', 'draw::VARCHAR')} / 4294967296.0::DOUBLE) * (SELECT count(*) FROM c))::BIGINT, (SELECT count(*) FROM c) - 1)"


@query(f"""WITH c AS (SELECT t, m, row_number() OVER (ORDER BY t) - 1 AS pos FROM (SELECT DISTINCT strftime(o_orderdate, '%b, %Y') AS t, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders)),
q AS (SELECT o_orderkey AS qid, strftime(o_orderdate, '%b, %Y') AS gold, year(o_orderdate) * 12 + month(o_orderdate) AS m, o_orderkey % 7 > 0 AS dated FROM orders),
r AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY abs(c.m - q.m), c.m, t) AS rank FROM q JOIN c ON c.m <> q.m WHERE dated),
p AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY {_u_sql(42, 'qid::VARCHAR', 't')}, t) AS pick FROM r WHERE rank <= 20),
d AS (SELECT qid, pos, min(draw) AS draw FROM (SELECT qid, draw, {_PLACE_SQL} AS pos FROM q, range(0, 16) x(draw) WHERE NOT dated) GROUP BY ALL),
u AS (SELECT d.qid, c.t, row_number() OVER (PARTITION BY d.qid ORDER BY draw) AS pick FROM d JOIN c USING (pos) JOIN q ON q.qid = d.qid WHERE c.t <> q.gold)
SELECT qid, t AS text, pick::BIGINT AS pick FROM p WHERE pick <= 5 UNION ALL SELECT qid, t, pick::BIGINT FROM u WHERE pick <= 5""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of the twenty nearest months for each order, or of all months for orders whose question has no date."""
    t = F.date_format("o_orderdate", "MMM, yyyy")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 7 > 0, t).otherwise("some day").alias("question"), t.alias("gold"))
    return benchmarks.nearest_dated(o, o.select(F.col("gold").alias("text"))).select("qid", "text", F.col("pick").cast("bigint").alias("pick"))


@query("""WITH c AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS pos FROM (SELECT text FROM documents UNION SELECT text FROM conversations) WHERE text IS NOT NULL)
SELECT conv_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS gold FROM (SELECT DISTINCT conv_id, pos FROM conversations JOIN c USING (text)) GROUP BY conv_id""")
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as queries whose turns are gold in a corpus of all documents and turns."""
    docs, turns = (table(spark, sf_dir, t).where("text IS NOT NULL") for t in ("documents", "conversations"))
    _, gold = benchmarks.gold_index(docs, turns, "conv_id")
    return gold.select("conv_id", F.array_join(F.transform("gold", lambda g: g.cast("string")), ",").alias("gold"))


@query("SELECT n_nationkey, count(*)::BIGINT AS n_negatives FROM nation JOIN (SELECT DISTINCT n_name AS other FROM nation) ON other <> n_name GROUP BY 1")
def negatives_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's question against all other nations' texts: the corpus is a fixed table of 25."""
    n = table(spark, sf_dir, "nation")
    corpus = n.select(F.col("n_name").alias("other")).distinct()
    return n.join(F.broadcast(corpus), F.col("other") != F.col("n_name")).groupBy("n_nationkey").agg(F.count("*").alias("n_negatives"))


@query("SELECT o_orderpriority AS benchmark, o_orderstatus AS run_id, round(avg(o_totalprice) / 1000000, 6) AS mrr FROM orders GROUP BY ALL")
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows rendered as a Markdown report's lines and read back."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg((F.avg("o_totalprice") / 1000000).alias("m"))
    cells = [F.col("o_orderstatus"), F.lit("hybrid"), F.lit("t"), F.lit("s"), F.lit("-"), F.col("o_orderpriority"), F.lit("1"), F.format_string("%.6f", "m"), F.lit("0.5"), F.lit("0.5"), F.lit("0.5")]
    lines = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return reports.parse_rows(lines).select("benchmark", "run_id", "mrr")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS VARCHAR) AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by day and type until all are read."""
    return event_counts(spark, sf_dir)
