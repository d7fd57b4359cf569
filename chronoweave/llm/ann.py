"""Approximate nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit tables, exact rerank.

A vector's dimensions are cut into pairs, each with 16 centres. Codes and centres minimise a residual whose part
parallel to the vector weighs more than the rest, as that part is what changes large inner products. Centres are
fitted on `SAMPLE` vectors at most, in hash order; every vector is encoded and scanned. A query's tables hold its
products with all centres, two four-bit codes to a lookup. The best `RERANK` of every block of the index are scored
on the original vectors in double precision first. An entry keeps the norm of what its code leaves of it, which times
the query's norm bounds the error of its approximate product (Cauchy and Schwarz); every entry that can reach the last of
the k best by that bound is scored too, so no neighbour is lost, and the best of all blocks are the result.

Equal vectors are one entry of the index with as many of their smallest ids as a result can hold, which is exact and
keeps a large group of copies from filling the rerank. Queries and index are dealt into blocks, and each pair of blocks
is one task; nothing grows in a task, and nothing is broadcast but the centres.

Vectors that are null, zero, of another length than most or hold a null or non-finite component, and rows with a null
id, take no part. Rows with the query's id are its own. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_bytes, cut
from .embed_dedup import usable

CENTRES, SAMPLE, RERANK, INDEX_BLOCK, QUERY_BLOCK = 16, 20_000, 128, 8192, 2048
#: The inner product, of unit vectors, above which errors should be small: sets the parallel part's weight.
THRESHOLD = 0.2


class Quantizer:
    """Anisotropic product quantiser with 4-bit codes for pairs of dimensions."""

    def __init__(self, x: np.ndarray, rounds: int = 6, seed: int = 42):
        self.dim = x.shape[1]
        self.parts = -(-self.dim // 2)
        self.ratio = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self._pad(x)
        rng = np.random.default_rng(seed)
        self.centres = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m] for m in range(self.parts)])
        for _ in range(rounds):
            codes = self._codes(x, 1)
            self._fit(x, codes)

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * 2 - x.shape[1]))).reshape(len(x), self.parts, 2)

    def _codes(self, x: np.ndarray, passes: int) -> np.ndarray:
        """Coordinate descent from the nearest centres; along: the residual's product with the vector."""
        n = np.maximum((x**2).sum(axis=(1, 2)), 1e-300)
        codes = np.stack([((x[:, m, None, :] - self.centres[m][None]) ** 2).sum(axis=2).argmin(axis=1) for m in range(self.parts)], axis=1)
        along = sum(((x[:, m] - self.centres[m][codes[:, m]]) * x[:, m]).sum(axis=1) for m in range(self.parts))
        for _ in range(passes):
            for m in range(self.parts):
                residual = x[:, m, None, :] - self.centres[m][None]
                product = (residual * x[:, m, None, :]).sum(axis=2)
                rest = along - np.take_along_axis(product, codes[:, m, None], 1)[:, 0]
                loss = (residual**2).sum(axis=2) + (self.ratio - 1) * (rest[:, None] + product) ** 2 / n[:, None]
                codes[:, m] = loss.argmin(axis=1)
                along = rest + np.take_along_axis(product, codes[:, m, None], 1)[:, 0]
        return codes

    def _fit(self, x: np.ndarray, codes: np.ndarray) -> None:
        n = np.maximum((x**2).sum(axis=(1, 2)), 1e-300)
        along = np.stack([((x[:, m] - self.centres[m][codes[:, m]]) * x[:, m]).sum(axis=1) for m in range(self.parts)], axis=1)
        for m in range(self.parts):
            rest, own = along.sum(axis=1) - along[:, m], x[:, m]
            for c in range(CENTRES):
                i = codes[:, m] == c
                if i.any():
                    v, w = own[i], (self.ratio - 1) / n[i]
                    left = i.sum() * np.eye(2) + np.einsum("n,na,nb->ab", w, v, v)
                    right = v.sum(axis=0) + ((w * ((v**2).sum(axis=1) + rest[i]))[:, None] * v).sum(axis=0)
                    self.centres[m, c] = np.linalg.solve(left, right)
            along[:, m] = ((own - self.centres[m][codes[:, m]]) * own).sum(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two codes to a byte; the norm of each vector's residual, and what rounding in a query's tables can add to it."""
        x = self._pad(x)
        codes = self._codes(x, 2)
        rest = np.sqrt(sum(((x[:, m] - self.centres[m][codes[:, m]]) ** 2).sum(axis=1) for m in range(self.parts)))
        rest += (self.parts + 4) * float(np.finfo(np.float32).eps) * (np.sqrt((x**2).sum(axis=(1, 2))) + rest)
        codes = np.pad(codes, ((0, 0), (0, self.parts % 2)))
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8), rest

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each byte of a code, its two centres' products with the query."""
        t = np.einsum("pcd,pd->pc", self.centres, self._pad(q[None])[0])
        t = np.pad(t, ((0, self.parts % 2), (0, 0)))
        return (t[1::2, :, None] + t[0::2, None, :]).reshape(-1, 256).astype(np.float32)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest to each row of vectors where `queries` holds: query_id, rank, vec_id, score."""
    batch_bytes(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    out = "query_id bigint, vec_id bigint, score double"
    common_dim = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common_dim is None:
        return vectors.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(0)).select("query_id", "rank", "vec_id", "score")
    rows = rows.where(F.col("dim") == common_dim["dim"])
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))
    entries = cut(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(SAMPLE).select("v").toPandas()
    quantizer = Quantizer(np.array(list(sample["v"])))
    asked = rows.where("q").select("id", "v")
    n_index, n_query = max(1, -(-n // INDEX_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(list(b["v"]))
            for at in range(0, len(b), 4096):
                p = b.iloc[at : at + 4096]
                code, rest = quantizer.encode(x[at : at + 4096])
                yield pd.DataFrame({"ib": p["ib"], "ids": p["ids"], "x": [y.tobytes() for y in x[at : at + 4096]], "code": [y.tobytes() for y in code], "rest": rest})

    index = entries.withColumn("ib", F.pmod(F.xxhash64("v"), F.lit(n_index))).select("ib", "ids", "v").mapInPandas(encode, "ib bigint, ids array<bigint>, x binary, code binary, rest double")
    index = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_query - 1).cast("bigint"))))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_query))).withColumn("ib", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_index - 1).cast("bigint"))))

    def scan(ix: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ix) and len(qs):
            x = np.frombuffer(b"".join(ix["x"]), np.float64).reshape(len(ix), -1)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(ix["code"]), np.uint8).reshape(len(ix), -1).T)
            ids = [np.asarray(i, np.int64) for i in ix["ids"]]
            size, rest = np.array([len(i) for i in ids]), ix["rest"].to_numpy()
            first = max(RERANK, k + 1)

            def last_of(exact: np.ndarray, best: np.ndarray) -> float:
                """The score from which on there are k ids besides the query's, or the least."""
                order = np.argsort(-exact, kind="stable")
                return exact[order[: np.searchsorted(np.cumsum(size[best[order]]), k + 1) + 1][-1]]

            for qid, v in zip(qs["id"], qs["v"], strict=True):
                q = np.asarray(v, np.float64)
                best = np.arange(len(x))
                if len(x) > first:
                    t = quantizer.tables(q)
                    approx = t[0][codes[0]]
                    for j in range(1, len(t)):
                        approx += t[j][codes[j]]
                    best = np.argpartition(-approx, first)[:first]
                    last = last_of((x[best] * q).sum(axis=1), best)
                    best = np.flatnonzero(~(approx + rest * np.linalg.norm(q) < last) | ~np.isfinite(approx))
                exact = (x[best] * q).sum(axis=1)
                enough = np.flatnonzero(exact >= last_of(exact, best))
                got = np.concatenate([ids[i] for i in best[enough]])
                score = np.repeat(exact[enough], size[best[enough]])
                score, got = score[got != qid], got[got != qid]
                top = np.lexsort((got, -score))[:k]
                found.append((np.full(len(top), qid), got[top], score[top]))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, c = (np.concatenate(z) for z in zip(*found, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    near = index.groupBy("ib", "qb").cogroup(asked.groupBy("ib", "qb")).applyInPandas(scan, out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors["vec_id"] % 20 == 0)
