"""Ranking, retrieval metrics, sweeps and paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut

METRICS = ("top", "mrr", "ndcg", "precision", "recall", "f1")


def rank_desc(by: list[str], score: str = "score", idx: str = "idx", stable: bool = False) -> Column:
    """Full ranking by falling score. Ties: the later candidate first; `stable`: the earlier."""
    tie = F.col(idx).asc() if stable else F.col(idx).desc()
    return F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), tie))


def top_k(scored: DataFrame, by: list[str], k: int, stable: bool = True) -> DataFrame:
    return scored.withColumn("rn", rank_desc(by, stable=stable)).where(F.col("rn") <= k)


def item_metrics(ranked: DataFrame, by: list[str], k: Column | int, gold: str = "is_gold", rn: str = "rn") -> DataFrame:
    """All six metrics per item. Precision divides by k, and the reciprocal rank isn't cut at k."""
    k = F.lit(k) if isinstance(k, int) else k
    g, r = F.col(gold), F.col(rn)
    hit = F.sum(F.when(g & (r <= k), 1).otherwise(0))
    n = F.sum(g.cast("int"))
    gain = F.sum(F.when(g & (r <= k), F.lit(1.0) / F.log2(r + 1.0)).otherwise(0.0))
    agg = ranked.groupBy(*by).agg(
        hit.alias("_hit"), n.alias("_n"), gain.alias("_gain"), F.max(k).alias("_k"), F.coalesce(1.0 / F.min(F.when(g, r)), F.lit(0.0)).alias("mrr"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("_n", F.col("_k")).cast("int"))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    p, rc = F.col("_hit") / F.col("_k"), F.coalesce(F.try_divide("_hit", "_n"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * rc, p + rc), F.lit(0.0))
    return agg.select(
        *by, (F.col("_hit") > 0).cast("double").alias("top"), "mrr", F.when(F.col("_n") > 0, F.col("_gain") / ideal).otherwise(0.0).alias("ndcg"),
        p.alias("precision"), rc.alias("recall"), f1.alias("f1"),
    )


def mean_metrics(items: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {', '.join(METRICS)}")
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), *[F.avg(m).alias(m) for m in metrics])


def best_alpha(swept: DataFrame, by: list[str], metric: str = "mrr") -> DataFrame:
    """Of alpha rows with a metric, the best; the smallest alpha wins ties."""
    w = W.partitionBy(*by).orderBy(F.col(metric).desc(), F.col("alpha"))
    return swept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def value_ranks(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """counts (by, value, n: how many rows have the value, other columns) with `rank`, the average rank of those rows within `by`, from 1.

    Distinct values are dealt out by range and written once; each partition adds up its own counts, and the sums of the
    partitions before it, one row for each group and partition, come on top. So neither a group nor all values meet in one task. `by` isn't null.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()))
    own = F.sum(n).over(W.partitionBy("_part", *by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    sums = placed.groupBy("_part", *by).agg(F.sum(n).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_part", *by, F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, ["_part", *by])
    return ranked.select(*counts.columns, (F.col("_before") + F.col("_own") + (F.col(n) + 1) / 2.0).alias("rank"))


def signed_rank(paired: DataFrame, by: list[str], diff: str = "d") -> DataFrame:
    """W+, W-, the number of non-zero differences and the tie term sum(t^3 - t), with average ranks, over distinct sizes of differences."""
    d = paired.where(F.col(diff) != 0).groupBy(*by, F.abs(diff).alias("_a")).agg(F.count("*").alias("n"), F.count_if(F.col(diff) > 0).alias("_up"))
    r, n = F.col("rank"), F.col("n")
    return value_ranks(d, by, "_a").groupBy(*by).agg(
        F.sum(r * F.col("_up")).alias("w_plus"), F.sum(r * (n - F.col("_up"))).alias("w_minus"), F.sum("n").alias("n_nonzero"), F.sum((n * (n * n - 1)).cast("double")).alias("ties"),
    )


def wilcoxon_p(w: float, n: int, ties: float) -> float:
    """Two-sided p of the smaller rank sum: exact for up to 50 differences without ties, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(math.erfc(abs(w - mean) / math.sqrt(2 * var))) if var > 0 else 1.0


def t_p(t: float, df: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if df < 1 or not math.isfinite(t):
        return 0.0 if math.isinf(t) else 1.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * f if swap else front * f


#: A prime below 2^31: weights come from arithmetic modulo it, which SQL elsewhere can repeat.
PRIME = 2_147_483_647
ROUND_STEP = 1_103_515_245
#: Where the weights 1, 2, ... begin in [0, PRIME): a Poisson distribution with mean 1, up to a share of 1e-9.
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12))


#: Rows that a task of the bootstrap draws weights for, at most and at least, and weights that it makes at a time.
TASK_DRAWS, LEAST_DRAWS, DRAW_BLOCK = 50_000, 1_000, 1 << 16


def _fold(x: np.ndarray, t: np.ndarray) -> None:
    """x modulo PRIME, which is 2^31 - 1, but for a multiple of it: the high bits are added to the low ones."""
    np.right_shift(x, np.uint64(31), out=t)
    np.bitwise_and(x, np.uint64(PRIME), out=x)
    np.add(x, t, out=x)


def poisson_weights(a: np.ndarray, c: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How often each row (keys a, c, below PRIME) counts in each round (steps: round * ROUND_STEP % PRIME), a line for each row. All of uint64."""
    x = a[:, None] * steps
    x += c[:, None]
    t, u = np.empty_like(x), np.empty_like(x)
    _fold(x, t)  # below 2^32
    np.multiply(x, x, out=u)
    _fold(u, t)
    _fold(u, t)  # below 2^31 + 8
    np.multiply(u, u, out=u)
    _fold(u, t)  # below 2^32
    u *= x  # the fifth power permutes the numbers below the prime
    _fold(u, t)
    _fold(u, t)
    if u.max(initial=0) >= PRIME:
        u[u >= PRIME] -= np.uint64(PRIME)
    u = u.astype(np.uint32)
    w = (u >= POISSON[0]).view(np.uint8)
    for k in POISSON[1:5]:
        w += u >= k
    flat, many = w.reshape(-1), np.flatnonzero(u >= POISSON[5])
    for k in POISSON[5:]:
        flat[many] += u.reshape(-1)[many] >= k
    return w


def bootstrap_ci(paired: DataFrame, by: str, row: str, diff: str = "d", rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """by, mean, low, high: percentile interval of the mean difference over `rounds` resamples.

    In each round each row counts as often as a Poisson draw says, which given their sum is a draw with replacement of as many rows. The
    draw is a function of (seed, row, round): two keys of the row from its md5, mixed with the round by arithmetic modulo a
    prime. Rows are written once and dealt out evenly; each task adds up its own rows' weights by (by, round), and only these sums meet, so
    rows never do and reruns agree. `row` names the row within its group.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))
    a, c = (F.conv(F.substring(key, k, 8), 16, 10).cast("bigint") % PRIME for k in (1, 9))
    rows = cut(paired.where(F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col(diff).cast("double").alias("d"), a.alias("a"), c.alias("c")))
    n = rows.count()
    tasks = max(1, n // TASK_DRAWS, min(n // LEAST_DRAWS, 3 * rows.sparkSession.sparkContext.defaultParallelism))
    steps = (np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(ROUND_STEP)) % np.uint64(PRIME)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}

        def flush() -> Iterator[pd.DataFrame]:
            for name, (total, known) in found.items():
                yield pd.DataFrame({"by": [name] * rounds, "round": np.arange(rounds), "w": total[0].astype(np.int64), "wd": total[1] if known else [None] * rounds})
            found.clear()

        for b in batches:
            for name, own in b.groupby("by"):
                total, known = found.get(name, (np.zeros((2, rounds)), False))
                x, y = own["a"].to_numpy(np.uint64), own["c"].to_numpy(np.uint64)
                sides = np.stack([np.ones(len(own)), own["d"].to_numpy(np.float64)])
                high = min(len(own), 32)
                wide = max(1, DRAW_BLOCK // high)
                for i in range(0, len(own), high):
                    for k in range(0, rounds, wide):
                        w = poisson_weights(x[i : i + high], y[i : i + high], steps[k : k + wide])
                        total[:, k : k + wide] += sides[:, i : i + high] @ w.astype(np.float64)
                found[name] = total, known or bool(own["known"].any())
            if len(found) > 64:
                yield from flush()
        yield from flush()

    dealt = rows.select("by", F.coalesce("d", F.lit(0.0)).alias("d"), "a", "c", F.col("d").isNotNull().alias("known")).repartition(tasks, "a", "c")
    kind = rows.schema["by"].dataType.simpleString()
    drawn = dealt.mapInPandas(sums, f"by {kind}, round int, w bigint, wd double")
    means = drawn.groupBy("by", "round").agg(F.try_divide(F.sum("wd"), F.sum("w")).alias("m"))
    ends = means.groupBy("by").agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("p"))
    mean = rows.groupBy("by").agg(F.avg("d").alias("mean"))
    return mean.join(ends, "by").select(F.col("by").alias(by), "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def p_values(tests: DataFrame) -> DataFrame:
    """tests (w_plus, w_minus, n_nonzero, ties, t, n) with p_wilcoxon and p_t."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(
                p_wilcoxon=[wilcoxon_p(min(p, m), int(n), s) for p, m, n, s in zip(b["w_plus"], b["w_minus"], b["n_nonzero"], b["ties"], strict=True)],
                p_t=[t_p(t, int(n) - 1) for t, n in zip(b["t"], b["n"], strict=True)],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema.fields) + ", p_wilcoxon double, p_t double"
    return tests.mapInPandas(run, schema)


def expected_reciprocal_rank(n: Column, g: Column, offset: Column) -> Column:
    """Mean of 1 / (offset + R), where R is the rank of the first of g gold items among n tied ones in random order."""
    # p: probability that none of the first r - 1 is gold
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - g + 1).cast("int")), F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("e")), lambda s, r: F.struct(
        (s["p"] * (n - g - r + 1) / (n - r + 1)).cast("double").alias("p"), (s["e"] + s["p"] * g / (n - r + 1) / (offset + r)).alias("e")), lambda s: s["e"])
    return F.when((g > 0) & (n > 0), total).otherwise(0.0)
