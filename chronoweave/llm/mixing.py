"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source is a stream: its documents in the order of md5(seed:id), as often as needed. The stream's first
words, as many as the source's target, are cut into blocks of `block_words` words. A binary tree over the output
shards divides the blocks: each node's block counts by source are divided between its two halves by one
multivariate hypergeometric draw, so every shard gets an exact number of blocks and the sources' counts always add
up to their quotas. A shard walks its own path from the root; draws are keyed by node, so all shards see the same
tree and no node is held by more than one task's row. Shards then own disjoint ranges of each source's permuted
blocks and order what they own by a hash.

Nulls: a null source is a source of its own, last in order; a null text has no words; a null id is an id.
Documents without words are in no block (`taken` 0). Rows that repeat an id are separate documents; ties in the
permutation are broken by size and text hash, so rows that still tie are equal and interchangeable.
A very long text spans as many blocks as it needs. Columns of docs may have any names: they travel in one struct.
An empty table gives an empty result. A window without partition and one row for the tree hold a number for each source,
not for its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

#: Leading bits of the permutation hash that split a source: no window holds more than a 65,536th of a source.
FINE_HEX = 4
#: Words of a block, and blocks of a shard, the unit that is shuffled locally.
BLOCK_WORDS, SHARD_BLOCKS = 8_192, 32
#: Blocks and shards that one row stands for until they are dealt out, so that no task emits all of a source's.
BLOCK_RUN, SHARD_RUN = 1_024, 16
#: Standard deviation up to which a draw inverts the distribution function, which takes steps in proportion; beyond it, it is by rejection.
#: Both draw from the same distribution.
INVERT_SD = 256
#: Tries of a rejection, each of which succeeds more often than not; where all fail, a chance below 2^-128, the mean is taken.
TRIES = 128


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*keys: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the keys alone."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8; its error is below 1e-12."""

    def stirling(n: Column) -> Column:
        z = n + F.lit(8.0)
        product = F.lit(1.0)
        for k in range(1, 9):
            product = product * (n + float(k))
        return (z + 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) - F.ln(product)

    return _let(n, stirling)


def hypergeometric(total: Column, good: Column, draws: Column, *keys: Column) -> Column:
    """How many of `draws` blocks, out of `total`, are of the source that has `good` of them.

    Inverse distribution function from 12 standard deviations below the mean; for large draws ratio-of-uniforms rejection under
    a table mountain hat (Stadlober 1990), whose probabilities come from log factorials.
    """
    given = F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), draws.cast("double").alias("d"))
    return _let(given, lambda g: _drawn(g["n"], g["k"], g["d"], *keys))


def _drawn(n: Column, k: Column, d: Column, *keys: Column) -> Column:
    low, high = F.greatest(F.lit(0.0), d + k - n), F.least(k, d)
    mean = d * k / F.greatest(n, F.lit(1.0))
    sd = F.sqrt(mean * F.greatest(n - k, F.lit(0.0)) / F.greatest(n, F.lit(1.0)) * F.greatest(n - d, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0)))
    u = _uniform(F.lit("u"), *keys)

    def varying(x: Column) -> Column:  # the part of the log probability that depends on the outcome
        return -_log_factorial(x) - _log_factorial(k - x) - _log_factorial(d - x) - _log_factorial(n - k - d + x)

    def exact(first: Column) -> Column:
        log_p = _log_factorial(k) + _log_factorial(n - k) - _log_factorial(n) + _log_factorial(d) + _log_factorial(n - d) + varying(first)
        last = F.least(high, F.ceil(mean + 12 * sd + 2).cast("double"))
        state = F.struct(F.exp(log_p).alias("p"), F.lit(0.0).alias("below"), first.alias("x"))

        def step(s: Column, i: Column) -> Column:
            x = i.cast("double")
            odds = (k - x) * (d - x) / ((x + 1) * F.greatest(n - k - d + x + 1, F.lit(1.0)))
            return F.struct((s["p"] * odds).alias("p"), (s["below"] + s["p"]).alias("below"), F.when(s["below"] <= u, x).otherwise(s["x"]).alias("x"))

        return F.aggregate(F.sequence(first.cast("bigint"), last.cast("bigint")), state, step, lambda s: s["x"])

    def rejected(top: Column) -> Column:  # top: the log probability of the mode, but for the constant part
        centre, width = mean + 0.5, 2 * math.sqrt(2 / math.e) * F.sqrt(sd * sd + 0.5) + (3 - 2 * math.sqrt(3 / math.e))

        def tried(i: Column) -> Column:
            x, y = _uniform(F.lit("x"), i, *keys), _uniform(F.lit("y"), i, *keys)
            z = F.floor(centre + width * (y - 0.5) / x).cast("double")
            return _let(z, lambda z: F.when((z < low) | (z > high), None).when(2 * F.ln(x) <= varying(z) - top, z))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda s, i: F.coalesce(s, tried(i)), lambda s: F.coalesce(s, F.floor(centre).cast("double")))

    start = F.greatest(low, F.floor(mean - 12 * sd - 2).cast("double"))
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2))))
    return F.when(low >= high, low).when(sd > INVERT_SD, _let(varying(mode), rejected)).otherwise(_let(start, exact)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """sizes (source, s): words by source and part. Returns source, source_size, weight, target, quota.

    Targets share all words by weight, stop at max_repeat times the source's size, and the excess is shared again
    among the others. With sources in ascending order of size over weight, those that stop come first; the level of
    the rest is the largest of the levels that each prefix would leave. The table has a row for each source, and
    that alone goes through one task.
    """
    by = sizes.groupBy("source").agg(F.sum("s").cast("bigint").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("sidx", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sidx") - 1, F.lit(len(weights))) + 1))
    most = max_repeat * F.col("source_size")
    rise = W.orderBy(most / F.col("weight"), "sidx")
    by = by.withColumn("_before", F.coalesce(F.sum(most).over(rise.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("_rest", F.sum("weight").over(rise.rowsBetween(W.currentRow, W.unboundedFollowing)))
    everything = W.partitionBy()
    by = by.withColumn("_all", F.sum("source_size").over(everything))
    by = by.withColumn("_level", F.max((F.col("_all") - F.col("_before")).cast("double") / F.col("_rest").cast("double")).over(everything))
    target = F.least(most.cast("double"), F.col("_level") * F.col("weight"))
    return by.select("source", "sidx", "source_size", "weight", target.alias("target"), F.floor(target + 0.5).cast("bigint").alias("quota"))


def _numbered(rows: DataFrame, n: Column, name: str, run: int, *by: str) -> DataFrame:
    """Each of rows, which are few, n times (1 or more) with the numbers from 0 as `name`. The task that holds a row emits one row
    for each run of numbers; these are dealt out by `by` and run, and become single numbers where they arrive."""
    zero, size = F.lit(0).cast("bigint"), F.lit(run).cast("bigint")
    runs = rows.withColumn("_n", n).withColumn("_run", F.explode(F.sequence(zero, F.floor((F.col("_n") - 1) / size)))).repartition(*by, "_run")
    first = F.col("_run") * size
    return runs.withColumn(name, F.explode(F.sequence(first, F.least(first + size, F.col("_n")) - 1))).drop("_n", "_run")


def shard_blocks(targets: DataFrame, seed: int, block_words: int, shard_blocks_: int) -> DataFrame:
    """The splitting tree. Returns sidx, perm (a place in the source's permuted blocks), shard, n_shards."""
    blocks = F.ceil(F.col("quota") / F.lit(float(block_words))).cast("bigint")
    root = targets.select(F.struct("sidx", blocks.alias("n")).alias("b")).agg(F.sort_array(F.collect_list("b")).alias("b"))
    root = root.select(F.col("b.sidx").alias("sidx"), F.col("b.n").alias("quota"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("total"))
    root = root.withColumn("leaves", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(shard_blocks_)))).cast("bigint"))
    shards = _numbered(root, F.col("leaves"), "shard", SHARD_RUN)
    total, leaves, shard = F.col("total"), F.col("leaves"), F.col("shard")

    def bound(leaf: Column) -> Column:  # blocks in all leaves before this one
        return F.floor(leaf * total / leaves).cast("bigint")

    def split(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("bigint")
        left_n = bound(middle) - bound(s["lo"])
        first = F.struct((bound(s["hi"]) - bound(s["lo"])).alias("n"), left_n.alias("d"), F.array().cast("array<bigint>").alias("x"))

        def draw(a: Column, i: Column) -> Column:
            good = F.element_at(s["quota"], i)
            return _let(hypergeometric(a["n"], good, a["d"], F.lit(seed), s["lo"], s["hi"], i), lambda x: F.struct((a["n"] - good).alias("n"), (a["d"] - x).alias("d"), F.concat(a["x"], F.array(x)).alias("x")))

        drawn = F.aggregate(F.sequence(F.lit(1), F.size(s["quota"])), first, draw, lambda a: a["x"])

        def half(x: Column) -> Column:
            left = shard < middle
            return F.struct(
                F.when(left, s["lo"]).otherwise(middle).alias("lo"),
                F.when(left, middle).otherwise(s["hi"]).alias("hi"),
                F.when(left, x).otherwise(F.zip_with(s["quota"], x, lambda a, b: a - b)).alias("quota"),
                F.when(left, s["skip"]).otherwise(F.zip_with(s["skip"], x, lambda a, b: a + b)).alias("skip"),
            )

        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(_let(drawn, half))

    top = F.struct(F.lit(0).cast("bigint").alias("lo"), leaves.alias("hi"), F.col("quota"), F.transform("quota", lambda _: F.lit(0).cast("bigint")).alias("skip"))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(leaves.cast("double"))).cast("int") + 1))
    leaf = shards.select("shard", "leaves", "sidx", F.aggregate(levels, top, split).alias("end"))
    own = leaf.select("shard", "leaves", F.explode(F.arrays_zip(F.col("sidx"), F.col("end.quota").alias("quota"), F.col("end.skip").alias("skip"))).alias("o"))
    own = own.where("o.quota > 0")
    return own.select("shard", F.col("leaves").alias("n_shards"), F.col("o.sidx").alias("sidx"), F.explode(F.sequence(F.col("o.skip"), F.col("o.skip") + F.col("o.quota") - 1)).alias("perm"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, max_repeat: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with `pos`, the words before them in their source's stream; and the sources' targets."""
    size = F.regexp_count(text_of(docs[text_col]), F.lit(WORD)).cast("bigint")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))))
    rows = docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), order.alias("h"), F.xxhash64(docs[text_col]).alias("t"),
        F.conv(F.substring(order, 1, FINE_HEX), 16, 10).cast("int").alias("fine"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    if not carry:
        rows = cut(rows)
    parts = cut(rows.groupBy("source", "fine").agg(F.sum("size").alias("s")))
    targets = source_targets(parts, max_repeat=max_repeat)
    before = W.partitionBy("source").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)  # 65,536 rows a source at most
    parts = parts.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    parts = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(parts["source"].alias("p_source"), F.col("fine").alias("p_fine"), "before", "sidx", "source_size", "target", "quota")
    rows = rows.join(parts, rows["source"].eqNullSafe(F.col("p_source")) & (rows["fine"] == F.col("p_fine"))).drop("p_source", "p_fine")
    within = W.partitionBy("source", "fine").orderBy("h", "size", "t")
    rows = rows.withColumn("rn", F.row_number().over(within))
    rows = rows.withColumn("pos", F.col("before") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    return rows, targets


def permuted_blocks(targets: DataFrame, seed: int, block_words: int) -> DataFrame:
    """Each source's blocks in the order of a keyed hash. Returns sidx, block, perm: one-to-one from 0 to the source's blocks.

    A window holds the blocks with the same leading bits only, a 65,536th of a source's.
    """
    n = F.ceil(F.col("quota") / F.lit(float(block_words))).cast("bigint")
    blocks = _numbered(targets.where("quota > 0").select("sidx", n.alias("n")), F.col("n"), "block", BLOCK_RUN, "sidx").select("sidx", "block")
    h = F.xxhash64(F.lit(seed), F.col("sidx"), F.col("block"))
    blocks = blocks.withColumn("h", h).withColumn("fine", F.shiftright("h", 64 - 4 * FINE_HEX))
    before = W.partitionBy("sidx").orderBy("fine").rowsBetween(W.unboundedPreceding, -1)  # 65,536 rows a source at most
    parts = blocks.groupBy("sidx", "fine").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = W.partitionBy("sidx", "fine").orderBy("h", "block")
    return blocks.join(parts, ["sidx", "fine"]).select("sidx", "block", (F.col("before") + F.row_number().over(own) - 1).alias("perm"))


def owned_blocks(targets: DataFrame, seed: int, block_words: int, blocks_per_shard: int) -> DataFrame:
    """sidx, block, perm, shard: who owns each block of each source's stream."""
    leaves = shard_blocks(targets, seed, block_words, blocks_per_shard)
    return permuted_blocks(targets, seed, block_words).join(leaves, ["sidx", "perm"]).select("sidx", "block", "perm", "shard")


def mix_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 42, block_words: int = BLOCK_WORDS, blocks_per_shard: int = SHARD_BLOCKS, max_repeat: int = 3) -> DataFrame:
    """The mix as spans of words: shard, shard_order, id, source, size, source_size, target, epoch, word_start,
    word_end; and `part`, `rn`, which with the source tell rows that repeat an id apart.

    Each source gives exactly its target, rounded to a word. Documents of which nothing is taken have one row with
    a null shard; so would have words in a block that no shard owns.
    """
    rows, targets = _placed(docs, id_col, text_col, source_col, seed, max_repeat, carry=False)
    quota, size, pos, total = F.col("quota"), F.col("size"), F.col("pos"), F.col("source_size")

    def spans(e: Column) -> Column:
        first = e * total + pos
        last = F.least(first + size, quota)
        cuts = F.transform(
            F.sequence(F.floor(first / block_words).cast("bigint"), F.floor((last - 1) / block_words).cast("bigint")),
            lambda j: F.struct(j.alias("block"), e.alias("epoch"), (F.greatest(first, j * block_words) - first).alias("word_start"), (F.least(last, (j + 1) * block_words) - first).alias("word_end")),
        )
        return F.when(last > first, cuts).otherwise(F.array().cast("array<struct<block:bigint,epoch:bigint,word_start:bigint,word_end:bigint>>"))

    epochs = F.sequence(F.lit(0).cast("bigint"), F.lit(max_repeat - 1).cast("bigint"))
    out = rows.withColumn("span", F.explode_outer(F.flatten(F.transform(epochs, spans))))
    out = out.withColumn("block", F.col("span.block")).join(owned_blocks(targets, seed, block_words, blocks_per_shard), ["sidx", "block"], "left")
    return out.select(
        "shard", F.xxhash64(F.lit(seed), "sidx", "perm", "h", "span.epoch").alias("shard_order"), "id", "source", "size", "source_size", "target",
        "span.epoch", "span.word_start", "span.word_end", F.col("fine").alias("part"), "rn",
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 42, block_words: int = BLOCK_WORDS, blocks_per_shard: int = SHARD_BLOCKS, max_repeat: int = 3) -> DataFrame:
    """The mix as whole documents with all columns of docs, repeated where the target asks for it.

    A copy that the quota's end cuts is kept if at least half of its words are within. Rows come shard by shard, in
    shuffled order within each.
    """
    rows, targets = _placed(docs, id_col, text_col, source_col, seed, max_repeat, carry=True)
    quota, size, first = F.col("quota"), F.col("size"), F.col("e") * F.col("source_size") + F.col("pos")
    out = rows.withColumn("e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_repeat - 1).cast("bigint"))))
    out = out.where((size > 0) & (first < quota) & (2 * (F.least(first + size, quota) - first) >= size))
    out = out.withColumn("block", F.floor(first / block_words).cast("bigint")).join(owned_blocks(targets, seed, block_words, blocks_per_shard), ["sidx", "block"])
    out = out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "sidx", "perm", "h", "e"))
    return out.select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    spans = mix_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.sum(F.when(F.col("shard").isNotNull(), F.col("word_end") - F.col("word_start")).otherwise(0))  # what the tree's shards own
    by = spans.groupBy("id", "size", "source", "source_size", "target", "part", "rn").agg(taken.cast("bigint").alias("taken"))
    return by.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || doc_id::VARCHAR) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sidx FROM d GROUP BY source),
w AS (SELECT *, (sidx - 1) % 3 + 1 AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY 3 * source_size / weight, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, quota - pos)) + greatest(0, least(size, quota - pos - source_size)) + greatest(0, least(size, quota - pos - 2 * source_size)))::BIGINT AS taken
FROM p
"""
