"""Intervals as Gaussians, and similarities of Gaussians and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import day_index, day_interval, days_between, ground, let

#: What the vector similarity is divided by.
TEMPERATURE = 0.05


def moments(a: Column, b: Column) -> Column:
    """Mean and variance of the inclusive day interval [a, b]."""
    a, b = a.cast("double"), b.cast("double")
    width = b - a + 1
    return F.struct(((a + b + 1) / 2).alias("mu"), (width * width / 12).alias("var"))


def kl(q: Column, d: Column) -> Column:
    """KL(q || d) of two scalar Gaussians."""
    gap = q["mu"] - d["mu"]
    return 0.5 * F.ln(d["var"] / q["var"]) + (q["var"] + gap * gap) / (2 * d["var"]) - 0.5


def similarity(q: Column, d: Column) -> Column:
    return 1 / (1 + kl(q, d))


def clamped_similarity(q: Column, d: Column) -> Column:
    return 1 / (1 + F.greatest(kl(q, d), F.lit(0.0)))


def interval_similarity(qa: Column, qb: Column, da: Column, db: Column) -> Column:
    return similarity(moments(qa, qb), moments(da, db))


def bounds_similarity(q: Column, d: Column) -> Column:
    """Similarity of two struct<start, end>; null where either is null or runs backwards."""
    both = F.struct(day_interval(q).alias("q"), day_interval(d).alias("d"))
    return let(both, lambda i: interval_similarity(i["q"]["a"], i["q"]["b"], i["d"]["a"], i["d"]["b"]))


def similarity_of_bounds(q: Column, d: Column) -> Column:
    """`bounds_similarity` of two columns, which it mentions several times."""
    q, d = days_between(q), days_between(d)
    return interval_similarity(q["a"], q["b"], d["a"], d["b"])


def expression_similarity(e1: Column, anchor1: Column, e2: Column, anchor2: Column, lenient: bool = False) -> Column:
    s = bounds_similarity(ground(e1, anchor1), ground(e2, anchor2))
    return F.coalesce(s, F.lit(0.0)) if lenient else s


def interval_gap(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Days between two intervals, 0 if they overlap."""
    return F.greatest(F.lit(0), F.greatest(a1, a2) - F.least(b1, b2))


def legacy_interval_score(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """struct<value, similar>: 1 for equal, 0.9 if the first strictly holds the second, at most 0.2 of overlap; else the gap, in widths of the shorter from ten of them on."""
    common = F.least(b1, b2) - F.greatest(a1, a2) + 1
    union = F.greatest(b1, b2) - F.least(a1, a2) + 1
    gap = interval_gap(a1, b1, a2, b2).cast("double")
    unit = F.least(b1 - a1, b2 - a2) + 1

    def out(value: Column, similar: bool) -> Column:
        return F.struct(value.cast("double").alias("value"), F.lit(similar).alias("similar"))

    return (
        F.when((a1 == a2) & (b1 == b2), out(F.lit(1.0), True)).when((a1 < a2) & (b1 > b2), out(F.lit(0.9), True))
        .when(common > 0, out(F.least(F.lit(0.2), common / union), True)).when(gap / unit >= 10, out(gap / unit, False)).otherwise(out(gap, False))
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_similarity(mu1: Column, std1: Column, mu2: Column, std2: Column, temperature: float = TEMPERATURE) -> Column:
    """Of diagonal Gaussians: 1 / (1 + mean KL over dimensions), divided by the temperature."""
    pairs = F.zip_with(F.arrays_zip(mu1.alias("m1"), std1.alias("s1")), F.arrays_zip(mu2.alias("m2"), std2.alias("s2")), lambda x, y: F.struct(
        x["m1"].cast("double").alias("m1"), x["s1"].cast("double").alias("s1"), y["m2"].cast("double").alias("m2"), y["s2"].cast("double").alias("s2")))
    terms = F.transform(pairs, lambda p: F.ln(p["s2"] / p["s1"]) + (p["s1"] * p["s1"] + (p["m1"] - p["m2"]) * (p["m1"] - p["m2"])) / (2 * p["s2"] * p["s2"]) - 0.5)
    return 1 / (1 + _sum(terms) / F.size(mu1)) / temperature


def date_encoding(day: Column, dim: int = 32, base: float = 10000.0) -> Column:
    k = day_index(day).cast("double")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda i: F.array(F.sin(k / F.pow(F.lit(base), 2.0 * i / dim)), F.cos(k / F.pow(F.lit(base), 2.0 * i / dim)))))


def half_tanh(x: Column) -> Column:
    return F.tanh(0.5 * x)


def scaled_list(values: Column) -> Column:
    """Min-max of an array; all zero where the range is."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high == low, 0.0).otherwise((v - low) / F.nullif(high - low, F.lit(0.0))))
