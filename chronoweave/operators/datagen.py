"""Training tuples: random expressions, labelled pairs, relation phrases, and the global shuffle.

All randomness is an md5 of a seed and a row's key, so any row can be made again on its own, here or in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import gaussian, text
from ..functions.temporal import FIRST_DAY, LAST_DAY, date_bounds, ground, integers, interval_bounds, is_reference, let, offset_kind
from ..functions.text import choose, uniform
from .benchmarks import positions
from .ranking import value_ranks
from .rows import fixed

# Shares of date, offset, reference and interval among partner expressions.
KINDS = (0.30, 0.04, 0.01, 0.65)
# Shares of decade, year, month and day among dates.
GRAINS = (0.1, 0.3, 0.3, 0.3)
# Shortest and longest span in days that an interval's end is drawn from, by the grain of its first date.
SPANS = ((365, 7300), (365, 7300), (30, 730), (1, 365))


def by_share(u: Column, shares: tuple[float, ...], options: list[Column]) -> Column:
    out, total = None, 0.0
    for share, option in zip(shares[:-1], options[:-1], strict=True):
        total += share
        out = F.when(u < total, option) if out is None else out.when(u < total, option)
    return out.otherwise(options[-1])


def random_day(u: Column, first: Column, last: Column) -> Column:
    """Recent days more often: the distance back from the last is the range times a Beta(1, 3) draw."""
    return F.date_sub(last, F.floor(F.datediff(last, first) * (1 - F.pow(1 - u, F.lit(1 / 3)))).cast("int"))


def random_date(seed: int, key: Column, first: Column | None = None, last: Column | None = None, grains: tuple[float, ...] = GRAINS) -> Column:
    first, last = first if first is not None else F.lit(FIRST_DAY).cast("date"), last if last is not None else F.lit(LAST_DAY).cast("date")
    day = random_day(uniform(seed, key, F.lit("day")), first, last)
    part = uniform(seed, key, F.lit("part"))
    decade = F.concat(F.date_format(day, "yyyy").substr(1, 3), F.lit("0s"))
    decade = F.when(part < 0.5, decade).otherwise(F.concat(decade, choose((part - 0.5) * 2, ["-early", "-mid", "-late"])))
    return by_share(uniform(seed, key, F.lit("grain")), grains, [decade, F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy-MM-dd")])


def random_offset(seed: int, key: Column) -> Column:
    """One of 16 forms with a number from 1 to 10 either way."""
    n = (1 + F.floor(uniform(seed, key, F.lit("n")) * 10)).cast("int")
    sign = F.when(uniform(seed, key, F.lit("sign")) < 0.5, -1).otherwise(1)
    unit = choose(uniform(seed, key, F.lit("unit")), ["D", "W", "M", "Y"])
    m = (n * sign).cast("string")
    forms = [
        F.concat(F.lit("OFFSET P"), m, unit), F.concat(F.lit("THIS P"), n.cast("string"), unit, F.lit(" OFFSET P"), m, unit),
        F.concat(F.lit("THIS P"), n.cast("string"), unit),
        F.concat(F.when(sign < 0, "PREV_IMMEDIATE P").otherwise("NEXT_IMMEDIATE P"), n.cast("string"), unit),
    ]
    return choose(uniform(seed, key, F.lit("form")), forms)


def close_offset(seed: int, key: Column, e: Column) -> Column:
    """An offset of the same kind and sign whose number is at most 4 away, from 1 to 15; null if there is none or e is no offset.

    A single step may turn round. Of spans the second number counts.
    """
    kind, numbers = offset_kind(e), integers(e)
    own = F.when(kind.startswith("t") & (F.length(kind) == 2), F.get(numbers, F.lit(1))).otherwise(F.get(numbers, F.lit(0))).try_cast("int")
    low, high = F.greatest(F.lit(1), F.abs(own) - 4), F.least(F.lit(15), F.abs(own) + 4)
    size = low + F.floor(uniform(seed, key, F.lit("close")) * (high - low + 1)).cast("int")
    n, m = F.when(own < 0, -size).otherwise(size).cast("string"), size.cast("string")
    unit = F.upper(F.right(kind, F.lit(1)))
    step = F.when(uniform(seed, key, F.lit("turn")) < 0.5, "PREV_IMMEDIATE P").otherwise("NEXT_IMMEDIATE P")
    made = (
        F.when(F.length(kind) == 1, F.concat(F.lit("OFFSET P"), n, unit)).when(F.length(kind) == 2, F.concat(F.lit("THIS P"), m, unit, F.lit(" OFFSET P"), n, unit))
        .when(kind.startswith("this"), F.concat(F.lit("THIS P"), n, unit)).otherwise(F.concat(step, n, unit))
    )
    return F.when(kind.isNotNull() & (low <= high), made)


def random_reference(seed: int, key: Column) -> Column:
    return choose(uniform(seed, key, F.lit("ref")), ["PRESENT_REF", "THIS MO", "THIS NI"])


def _begun(seed: int, key: Column, day: Column, grains: tuple[float, ...]) -> Column:
    """An interval's first day, from its random day, and the longest span that may follow."""
    grain, w = uniform(seed, key, F.lit("igrain")), uniform(seed, key, F.lit("span"))
    decade = F.make_date(F.year(day) - F.year(day) % 10, F.lit(1), F.lit(1))
    start = by_share(grain, grains, [decade, F.trunc(day, "year"), F.trunc(day, "month"), day])
    return F.struct(start.alias("start"), by_share(grain, grains, [(low + F.floor(w * (high - low + 1))).cast("int") for low, high in SPANS]).alias("days"))


def _ended(seed: int, key: Column, x: Column, last: Column, grains: tuple[float, ...]) -> Column:
    """The interval's random second date."""
    return random_date(seed, F.concat_ws("/", key.cast("string"), F.lit("to")), x["start"], F.least(F.date_add(x["start"], x["days"]), last), grains)


def _joined(start: Column, second: Column) -> Column:
    a = F.date_format(start, "yyyy-MM-dd")
    return F.when(date_bounds(second)["start"] < start, F.concat_ws(",", second, a)).otherwise(F.concat_ws(",", a, second))


def random_interval(seed: int, key: Column, first: Column | None = None, last: Column | None = None, grains: tuple[float, ...] = GRAINS) -> Column:
    """The first day of a random date, and a random date of any grain from there to the end of a span, which is longer the coarser the first date was; the earlier start stands first."""
    first, last = first if first is not None else F.lit(FIRST_DAY).cast("date"), last if last is not None else F.lit(LAST_DAY).cast("date")
    begun = let(random_day(uniform(seed, key, F.lit("from")), first, last), lambda day: _begun(seed, key, day, grains))
    ended = let(begun, lambda x: F.struct(x["start"].alias("start"), _ended(seed, key, x, last, grains).alias("b")))
    return let(ended, lambda x: _joined(x["start"], x["b"]))


def random_expressions(rows: DataFrame, name: str, seed: int, key: Column, shares: tuple[float, ...] = KINDS) -> DataFrame:
    """rows with a random expression each under this name: a date, an offset, a reference or an interval, by shares."""
    first, last = (F.lit(d).cast("date") for d in (FIRST_DAY, LAST_DAY))
    rows = fixed(rows, _kind=uniform(seed, key, F.lit("kind")))

    def if_interval(c: Column) -> Column:
        return by_share(F.col("_kind"), shares, [F.lit(None), F.lit(None), F.lit(None), c])

    rows = fixed(rows, _day=if_interval(random_day(uniform(seed, key, F.lit("from")), first, last)))
    rows = fixed(rows, _begun=if_interval(_begun(seed, key, F.col("_day"), GRAINS)))
    rows = fixed(rows, _second=if_interval(_ended(seed, key, F.col("_begun"), last, GRAINS)))
    options = [random_date(seed, key), random_offset(seed, key), random_reference(seed, key), _joined(F.col("_begun.start"), F.col("_second"))]
    return fixed(rows, **{name: by_share(F.col("_kind"), shares, options)}).drop("_kind", "_day", "_begun", "_second")


def close_expressions(rows: DataFrame, e: str, anchor: str, key: str, seed: int = 42) -> DataFrame:
    """rows with `close`, an expression near e: a date of its year, an interval drawn from its own days, a close offset or a reference, or, of these two, the anchor's day; else null.

    Half of dates and intervals are days, the others of any grain.
    """
    k, value = F.col(key), F.col(e)
    rows = fixed(rows, _own=date_bounds(value), _span=interval_bounds(value), _kind=offset_kind(value), _coin=uniform(seed, k, F.lit("coin")) < 0.5)
    coin, days_only = F.col("_coin"), (0.0, 0.0, 0.0, 1.0)
    offset = F.when(F.col("_kind").isNotNull() & ~coin, close_offset(seed, k, value))
    rows = fixed(rows, _first=F.trunc("_own.start", "year"), _last=F.make_date(F.year("_own.start"), F.lit(12), F.lit(31)), _offset=offset)
    date, interval = (
        F.when(coin, draw(seed, k, F.col(a), F.col(b), days_only)).otherwise(draw(seed, k, F.col(a), F.col(b)))
        for draw, a, b in ((random_date, "_first", "_last"), (random_interval, "_span.start", "_span.end"))
    )
    day = F.date_format(anchor, "yyyy-MM-dd")
    made = (
        F.when(F.col("_own").isNotNull(), date).when(F.col("_span.start") <= F.col("_span.end"), interval)
        .when(F.col("_kind").isNotNull(), F.when(coin, day).otherwise(F.col("_offset"))).when(is_reference(value), F.when(coin, random_reference(seed, k)).otherwise(day))
    )
    return fixed(rows, close=made).drop("_own", "_span", "_kind", "_coin", "_first", "_last", "_offset")


def _days_text(g: Column) -> Column:
    start, end = F.date_format(g["start"], "yyyy-MM-dd"), F.date_format(g["end"], "yyyy-MM-dd")
    return F.when(g["start"] == g["end"], start).when(g.isNotNull(), F.concat_ws(",", start, end))


def own_days(e: Column, anchor: Column) -> Column:
    """The days that e stands for, as an expression: one day, or the first and last."""
    return let(ground(e, anchor), _days_text)


def expression_text(e: Column, u: Column) -> Column:
    """The expression in words."""
    family, n, unit = (F.regexp_extract(e, r"^(OFFSET|THIS|NEXT_IMMEDIATE|PREV_IMMEDIATE) P(-?\d+)([DWMY])", i) for i in (1, 2, 3))
    n = F.when(family == "PREV_IMMEDIATE", F.abs(n.try_cast("int"))).otherwise(n.try_cast("int"))
    sides = F.substring_index(e, ",", 1), F.substring_index(F.substring_index(e, ",", 2), ",", -1)
    return (
        F.when(family != "", text.offset_to_text(family, unit, n, u)).when(e.isin("PRESENT_REF", "THIS MO", "THIS NI"), text.reference_to_text(e, u))
        .when(e.contains(","), text.interval_to_text(text.date_to_text(sides[0], u), text.date_to_text(sides[1], u), u)).otherwise(text.date_to_text(e, u))
    )


def synthetic_pairs(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """sent0, sent0_date, sent1, sent1_date, score: n expressions with four random partners and their own interval each.

    What belongs to an expression is made before it meets its partners.
    """
    own, other = F.col("id").cast("string"), F.concat_ws("/", "id", "j")
    first, last = F.lit("1900-01-01").cast("date"), F.lit(LAST_DAY).cast("date")
    rows = random_expressions(spark.range(n), "e0", seed, own)
    rows = fixed(rows, d0=random_day(uniform(seed, own, F.lit("a0")), first, last))
    rows = _first_side(rows, seed).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = random_expressions(rows, "other", seed + 1, other)
    rows = fixed(rows, d1=random_day(uniform(seed, other, F.lit("a1")), first, last), e1=F.when(F.col("j") == 4, _days_text(F.col("g0"))).otherwise(F.col("other")))
    return _second_side(rows.drop("other"), seed)


def _first_side(rows: DataFrame, seed: int) -> DataFrame:
    """rows (id, e0, d0) with g0 and sent0; those that don't ground within the calendar are dropped."""
    rows = fixed(rows, g0=ground(F.col("e0"), F.col("d0")), u0=uniform(seed, F.col("id"), F.lit("t0")))
    rows = rows.where((F.col("g0.start") >= F.lit(FIRST_DAY).cast("date")) & (F.col("g0.start") <= F.col("g0.end")))
    return fixed(rows, sent0=expression_text(F.col("e0"), F.col("u0"))).drop("u0")


def _second_side(rows: DataFrame, seed: int) -> DataFrame:
    """Of what `_first_side` gives, with j, e1 and d1: the tuples."""
    rows = fixed(rows, g1=ground(F.col("e1"), F.col("d1")), u1=uniform(seed, F.col("id"), F.col("j"), F.lit("t1")))
    rows = rows.where(F.col("g1.start") >= F.lit(FIRST_DAY).cast("date"))
    rows = fixed(rows, score=gaussian.similarity_of_bounds(F.col("g0"), F.col("g1"))).where("score IS NOT NULL")
    return rows.select(
        "sent0", F.date_format("d0", "yyyy-MM-dd").alias("sent0_date"),
        expression_text(F.col("e1"), F.col("u1")).alias("sent1"), F.date_format("d1", "yyyy-MM-dd").alias("sent1_date"), "score",
    )


def labelled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows (id, j, e0, d0, e1, d1) as training tuples; pairs that don't ground within the calendar are dropped."""
    return _second_side(_first_side(rows, seed), seed)


def document_pairs(entries: DataFrame, seed: int = 42) -> DataFrame:
    """entries (id, text, values array<string>, dct date): the text against four random expressions and each value's own days, all at the document's date."""
    rows = fixed(entries, sent0=text.one_line(F.col("text"))).drop("text").withColumn("e0", F.explode("values"))
    rows = fixed(rows, g0=ground(F.col("e0"), F.col("dct"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    key = F.concat_ws("/", "id", "e0", "j")
    rows = random_expressions(rows, "other", seed, key)
    rows = fixed(rows, e1=F.when(F.col("j") == 4, _days_text(F.col("g0"))).otherwise(F.col("other")), u=uniform(seed, key, F.lit("t")))
    rows = fixed(rows, g1=ground(F.col("e1"), F.col("dct")))
    rows = fixed(rows, score=gaussian.similarity_of_bounds(F.col("g0"), F.col("g1"))).where("score IS NOT NULL")
    return rows.select("sent0", F.date_format("dct", "yyyy-MM-dd").alias("sent0_date"), expression_text(F.col("e1"), F.col("u")).alias("sent1"), F.date_format("dct", "yyyy-MM-dd").alias("sent1_date"), "score")


def relation_phrases(rows: DataFrame, month: str, years: str, months: str, back: str) -> DataFrame:
    """rows with phrase, "k years and m months before or after Mon, Y", and answer, the month it names."""
    step = (F.col(years) * 12 + F.col(months)) * F.when(F.col(back), -1).otherwise(1)
    target = F.add_months(F.trunc(month, "month"), step)

    def counted(c: str, unit: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.lit(f" {unit}"), F.when(F.col(c) == 1, "").otherwise("s"))

    amount = F.when(F.col(months) == 0, counted(years, "year")).when(F.col(years) == 0, counted(months, "month")).otherwise(F.concat(counted(years, "year"), F.lit(" and "), counted(months, "month")))
    named = F.concat(text.month_name(F.month(month), 3), F.lit(", "), F.year(month).cast("string"))
    phrase = F.concat(amount, F.when(F.col(back), " before ").otherwise(" after "), named)
    inside = target.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    return rows.withColumn("phrase", phrase).withColumn("answer", F.date_format(target, "yyyy-MM")).where(inside)


def relation_tuples(phrases: DataFrame, key: str, seed: int = 42, wrong: int = 4) -> DataFrame:
    """phrases (key, phrase, answer yyyy-MM) as training tuples: the right month with score 1, and `wrong` distinct other months of the calendar by their similarity.

    A row draws three times as many months as it needs, as equal ones and the answer fall out.
    """
    first, last = (int(d[:4]) for d in (FIRST_DAY, LAST_DAY))
    at = F.transform(F.sequence(F.lit(1), F.lit(3 * wrong)), lambda i: F.floor(uniform(seed, F.col(key), F.lit("wrong"), i) * (12 * (last - first + 1))).cast("int"))
    months = F.transform(at, lambda m: F.concat((first + F.floor(m / 12)).cast("string"), F.lit("-"), F.lpad((m % 12 + 1).cast("string"), 2, "0")))
    others = F.slice(F.filter(F.array_distinct(months), lambda m: m != F.col("answer")), 1, wrong)
    rows = phrases.select(key, "phrase", "answer", F.posexplode(F.concat(F.array("answer"), others)).alias("j", "month"))
    score = F.when(F.col("j") == 0, 1.0).otherwise(gaussian.bounds_similarity(date_bounds(F.col("answer")), date_bounds(F.col("month"))))
    span = (last - first + 1) * 365
    days = [F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(uniform(seed, F.col(key), F.col("j"), F.lit(c)) * span).cast("int")), "yyyy-MM-dd") for c in ("d0", "d1")]
    named = F.concat(text.month_name(F.substring("month", 6, 2).cast("int"), 3), F.lit(", "), F.substring("month", 1, 4))
    return rows.select(key, F.col("phrase").alias("sent0"), days[0].alias("sent0_date"), named.alias("sent1"), days[1].alias("sent1_date"), score.alias("score"))


def tagged_values(corpus: DataFrame) -> DataFrame:
    """text, values, dct of a tagged corpus's entries that have explicit date or interval values and a document date."""
    kept = F.filter("timex3", lambda t: t["rulename"].contains("explicit") & t["value"].isNotNull() & (date_bounds(t["value"]).isNotNull() | interval_bounds(t["value"]).isNotNull()))
    rows = corpus.select("text", F.transform(kept, lambda t: t["value"]).alias("values"), F.try_to_date(F.col("meta_data.dct"), "yyyy-MM-dd").alias("dct"))
    return rows.where((F.size("values") > 0) & F.col("dct").isNotNull())


def shuffled_union(parts: list[DataFrame], key: list[str], seed: int = 42) -> DataFrame:
    """All parts in one random order, with each row's `position` in it: a distributed sort by a hash of the row."""
    whole = reduce(DataFrame.unionByName, parts).withColumn("_u", uniform(seed, *[F.col(k) for k in key]))
    return positions(whole, ["_u", *key]).drop("_u")


def spearman(rows: DataFrame, label: str, score: str) -> DataFrame:
    """100 times the rank correlation of |label| and score. Ranks are over distinct values, whose counts are joined back."""
    both = rows.select(F.abs(F.col(label)).cast("double").alias("a"), F.col(score).cast("double").alias("b"))
    counts = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in "ab"]))).groupBy("side", "v").agg(F.count("*").alias("n"))
    ranks = value_ranks(counts, ["side"], "v")
    for c in "ab":
        both = both.join(ranks.where(F.col("side") == c).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")), c)
    return both.agg((100 * F.corr("ra", "rb")).alias("spearman"))


def cosent(rows: DataFrame, batch: str, label: str, score: str, scale: float = 1.0) -> DataFrame:
    """Per batch: ln(1 + sum of exp(s_i - s_j) over pairs with label_i < label_j). A batch's pairs factor by label, so no pairs are listed."""
    s = F.col(score) * scale
    top = rows.groupBy(batch).agg(F.max(s).alias("hi"), F.min(s).alias("lo"))
    by = rows.join(top, batch).groupBy(batch, label).agg(F.sum(F.exp(s - F.col("hi"))).alias("up"), F.sum(F.exp(F.col("lo") - s)).alias("down"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    below = F.coalesce(F.sum("up").over(W.partitionBy(batch).orderBy(label).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    terms = by.withColumn("t", F.col("down") * below)
    out = terms.groupBy(batch).agg(F.sum("t").alias("t"), F.max(F.col("hi") - F.col("lo")).alias("g"))
    power = F.col("g") + F.ln("t")  # ln(1 + exp(power)), whichever side of 0 it lies
    return out.select(batch, F.when(F.col("t") > 0, F.greatest(power, F.lit(0.0)) + F.log1p(F.exp(-F.abs(power)))).otherwise(0.0).alias("loss"))
