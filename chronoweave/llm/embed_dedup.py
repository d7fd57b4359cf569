"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one row kept of a group.

Equal vectors are put together first. Centroids are fitted on `SAMPLE` vectors at most, taken in hash order; that bounds
the fit, not the search, which is exact. A vector's home is its nearest cell, and it visits every later cell that can be
the home of a vector linked to it: of vectors within the threshold's angle of x, some lie on the far side of the plane
between two centroids only if x is at most that angle's sine away from the plane. So each pair meets in the later of its two
homes, and only there. How many cells a vector visits follows from the data: few where cells lie far apart, and all of
them where vectors are spread evenly in many dimensions, as no bound separates cells there.
Within a cell its own vectors and its visitors are dealt into blocks, and each pair of blocks with one of its own is one
group. A block pair returns a count for each vector and a spanning forest of its links, never the pairs, so a large group
of copies costs no more rows than it has members.

Vectors that are null, zero or hold a null or non-finite component, and rows with a null id, link with nothing: their
n_links is 0 and they are their own component (null for a null id). Vectors of different lengths don't link. Rows that
repeat count as rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, cut
from .components import components
from .simhash import _forest

#: A vector is sent once to each block that it is compared with, so large blocks are few copies; a pair of them is what one group holds in memory.
#: Rows of vectors of up to 64 components; longer ones have fewer, see `rows_for`.
CELL_ROWS, MOST_CELLS, SAMPLE, BLOCK, VISITORS = 16_384, 4096, 32_768, 16_384, 32_768


def rows_for(most: int, dim: Column | int) -> Column | int:
    """`most` rows of vectors of 64 components, and fewer of longer ones in their measure, an eighth at least."""
    if isinstance(dim, int):
        return max(most // 8, most * 64 // max(dim, 64), 1)
    return F.greatest(F.lit(max(most // 8, 1)), F.floor(F.lit(most * 64) / F.greatest(dim, F.lit(64)))).cast("int")


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that aren't zero."""
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def unit(vectors) -> np.ndarray:
    x = np.array(vectors if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else list(vectors), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(vectors, single: bool) -> list[bytes]:
    """The vectors as they came, in four bytes a component where they are of that type; `unit` of what is read back is that of the vectors."""
    return [np.asarray(v, np.float32 if single else np.float64).tobytes() for v in vectors]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def visits(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and for each vector and cell whether it is its home or a later cell that can hold a link."""
    product = x @ c.T
    home = product.argmax(axis=1)
    reach = math.sqrt(max(0.0, 1 - threshold**2)) if threshold > 0 else math.inf
    goes = np.arange(len(c)) == home[:, None]
    for h in np.unique(home):
        i = np.flatnonzero(home == h)
        apart = np.linalg.norm(c[h + 1 :] - c[h], axis=1)
        goes[i, h + 1 :] = (product[i, h, None] - product[i, h + 1 :] <= reach * apart + 1e-9) | math.isinf(reach)
    return home, goes


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """id, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    batch_bytes(spark)
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].alias("v"))
    single = rows.schema["v"].dataType.simpleString() == "array<float>"
    valid = F.col("id").isNotNull() & usable(F.col("v"))
    classes = cut(rows.where(valid).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("cnt")).withColumn("dim", F.size("v")))
    by_dim = sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect())
    centres = {}
    for dim, n in by_dim:
        k = min(MOST_CELLS, -(-n // rows_for(CELL_ROWS, dim)))
        if k > 1:
            sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toPandas()
            centres[dim] = spherical_kmeans(unit(sample["v"]), min(k, len(sample)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby("dim"):
                x = unit(b["v"])
                c = centres.get(dim)
                if c is None:
                    home, goes = np.zeros(len(b), np.int32), np.ones((len(b), 1), bool)
                else:
                    home, goes = visits(x, c, threshold)
                yield pd.DataFrame({"dim": dim, "rep": b["rep"].to_numpy(), "cnt": b["cnt"].to_numpy(), "home": home, "cell": [np.flatnonzero(y).astype(np.int32) for y in goes], "x": packed(b["v"], single)})

    assigned = cut(classes.select("dim", "rep", "cnt", "v").mapInPandas(assign, "dim int, rep bigint, cnt bigint, home int, cell array<int>, x binary"))
    assigned = assigned.withColumn("cell", F.explode("cell")).withColumn("own", F.col("cell") == F.col("home"))
    n_blocks = [F.ceil(F.count_if(own) / rows_for(size, F.col("dim"))).cast("int").alias(name) for own, size, name in ((F.col("own"), BLOCK, "n_own"), (~F.col("own"), VISITORS, "n_visit"))]
    blocks = assigned.groupBy("dim", "cell").agg(*n_blocks).where("n_own > 0")
    at = F.xxhash64("rep")
    block = F.when(F.col("own"), F.pmod(at, F.col("n_own"))).otherwise(F.col("n_own") + F.pmod(at, F.greatest("n_visit", F.lit(1))))
    others = F.col("n_own") + F.when(F.col("own"), F.col("n_visit")).otherwise(F.lit(0)) - 1
    dealt = assigned.join(blocks, ["dim", "cell"]).withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others)))
    dealt = dealt.select("dim", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "cnt", "x")
    dealt = dealt.repartition("dim", "cell", "lo", "hi")  # else a cell's block pairs all stay in the task of the join

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, _, lo, hi = (int(x) for x in key)
        pdf = pdf.sort_values("rep")
        a, b = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]

        def read(p: pd.DataFrame):
            return p["rep"].to_numpy(), p["cnt"].to_numpy(), unit(np.frombuffer(b"".join(p["x"]), np.float32 if single else np.float64).reshape(-1, dim))

        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "n": [], "to": [], "link": []})
        (ra, ca, xa), (rb, cb, xb) = read(a), read(b)
        na, nb, src, dst = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), [], []
        for s in range(0, len(a), 256):
            i, j = np.nonzero(xa[s : s + 256] @ xb.T >= threshold)
            i += s
            if lo == hi:
                i, j = i[i < j], j[i < j]
            for t in range(0, len(i), 1 << 18):
                x, y = i[t : t + (1 << 18)], j[t : t + (1 << 18)]
                na += np.bincount(x, weights=cb[y], minlength=len(a)).astype(np.int64)
                nb += np.bincount(y, weights=ca[x], minlength=len(b)).astype(np.int64)
                u, v = _forest(ra[x], rb[y])
                src.append(u)
                dst.append(v)
        u, v = _forest(np.concatenate(src), np.concatenate(dst)) if src else (ra[:0], ra[:0])
        out = [(ra[na > 0], na[na > 0], np.full((na > 0).sum(), -1)), (rb[nb > 0], nb[nb > 0], np.full((nb > 0).sum(), -1)), (u, np.zeros(len(u), np.int64), v)]
        rep, n, to = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"rep": rep, "n": n, "to": to, "link": n == 0})

    found = cut(dealt.groupBy("dim", "cell", "lo", "hi").applyInPandas(compare, "rep bigint, n bigint, to bigint, link boolean"))
    counts = found.where("NOT link").groupBy("rep").agg(F.sum("n").alias("n"))
    member = components(found.where("link").select(F.col("rep").alias("src"), F.col("to").alias("dst"))).withColumnRenamed("node", "rep")
    label = classes.select("rep", "v", "cnt").join(counts, "rep", "left").join(member, "rep", "left")
    label = cut(label.select(F.col("v").alias("l_v"), (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(label, valid & (rows["v"] == F.col("l_v")), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
