"""Documents whose sets of word shingles have a Jaccard similarity of `threshold` or more, exactly, by prefix filtering.

A document's distinct shingles are put in one order for all documents: rare before common ones, by a sample's counts.
Two sets of similarity t share one of the first n - ceil(t * n) + 1 shingles of each, whatever that order is, so the sample
only decides how many candidates there are. A candidate stays if the sizes and the shingle's places in both sets allow
the similarity, and is then verified on the whole sets. Equal sets are one entry.

Where entries meet in a shingle, all are first compared with the one of the smallest id; that joins large groups of
near copies in as many pairs as they have members. Then all other pairs are compared whose ends aren't connected yet.
Texts without words have no shingles and link with nothing here, nor do rows with a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import expand, squeeze
from .common import TEXT_BYTES, Tables, among, batch_bytes, release, trim
from .components import components
from .simhash import SEED

#: Documents that the order of shingles is taken from, at least, and one of how many where there are more; in how many of them a shingle
#: is a common one, and how many of those are told apart. The share keeps the documents that meet in an uncommon shingle as few in a large corpus as in a small one.
SAMPLE, SHARE, COMMON, MOST_COMMON = 4_000, 12, 4, 200_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word shingles, ascending."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.int64)
    parts = [w] if len(w) <= words else zip(*(w[i:] for i in range(words)), strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in parts], np.uint64).view(np.int64))


def _whole(shingles: np.ndarray) -> np.ndarray:
    """A set's 128-bit hash as two numbers."""
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)


def _packed(docs: DataFrame) -> DataFrame:
    """docs (id, text). Returns id, s: the compressed text, which takes a third of what its shingles' hashes take."""

    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([squeeze((x or "").encode("utf-8", "surrogatepass")) for x in t])
        trim()

    return docs.select("id", F.pandas_udf(packed, "binary")("text").alias("s"))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets are similar enough."""
    tables = Tables(docs.sparkSession)
    wanted = tables.put("wanted", pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = tables.put("texts", _packed(among(docs, wanted, "left_semi")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")

    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(64)
        def own(data: bytes) -> np.ndarray:
            return shingle_set(expand(data).decode("utf-8", "surrogatepass"), words)

        for xs, ys in batches:
            out = []
            for x, y in zip(map(own, xs), map(own, ys), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pd.Series(out, dtype=bool)
        own.cache_clear()
        trim()

    out = tables.put("similar", both.where(F.pandas_udf(similar, "boolean")("x", "y")).select("a", "b").distinct())
    tables.drop("wanted", "texts")
    return out


def _possible(n: Column, at: Column, m: Column, to: Column, threshold: float) -> Column:
    """Whether sets of n and m shingles whose first common one is at these places (from 0) can be similar enough."""
    return F.least(n - at, m - to) >= F.lit(threshold / (1 + threshold)) * (n + m) - 1e-6


def sampled_rows(rows: DataFrame) -> DataFrame:
    """The rows (with a column id) of the smallest hashes of their ids: a share of them, SAMPLE at least."""
    last = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    return rows.where(F.xxhash64("id") <= F.lit(None if last is None else max(last, (1 << 64) // SHARE - (1 << 63))))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """src, dst: links between ids that connect all documents that similarities of at least `threshold` connect."""
    batch_bytes(docs.sparkSession, TEXT_BYTES)
    tables = Tables(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("id IS NOT NULL")
    sample = sampled_rows(rows)

    def singles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                s = shingle_set(t, words)
                yield pd.DataFrame({"token": np.r_[s, _whole(s)[:1]]})
        trim()

    counted = sample.select("text").repartition(F.xxhash64("text")).mapInPandas(singles, "token bigint").groupBy("token").agg(F.count("*").alias("n"))
    top = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MOST_COMMON).toPandas().sort_values("token")
    common, common_n = top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)

    def sampled(tokens: np.ndarray) -> np.ndarray:
        if not len(common):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        return np.where(common[at] == tokens, common_n[at], 0)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ns, ats, tokens = [], [], [], []
            for i, t in zip(b["id"], b["text"], strict=True):
                s = shingle_set(t, words)
                if not len(s):
                    continue
                first = s[np.lexsort((s, sampled(s)))][: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]
                whole = _whole(s)  # the whole set is an entry too, at place -1; its other half stands for the size
                tokens += [whole[:1], first]
                ns += [whole[1:], np.full(len(first), len(s))]
                ats.append(np.arange(-1, len(first), dtype=np.int32))
                ids += [i] * (len(first) + 1)
            if ids:
                token = np.concatenate(tokens)
                out = pd.DataFrame({"id": ids, "n": np.concatenate(ns), "at": np.concatenate(ats), "token": token})
                yield out.assign(salts=(sampled(token) // COMMON).astype(np.int32))
                trim()

    # One exchange of all entries. A token that the sample has often is dealt to several tasks, the more the more common it is.
    kind = docs.schema[id_col].dataType.simpleString()
    posted = rows.mapInPandas(prefixes, f"id {kind}, n bigint, at int, token bigint, salts int")
    posted = posted.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts") + 1)).where("token IS NOT NULL AND salt IS NOT NULL").repartition("token", "salt")
    # all columns and both filters on this side too, so that the exchange is the same and is used twice
    local = posted.groupBy("token", "salt").agg(F.min(F.struct("id", "n", "at")).alias("hub"), F.count("*").alias("met"), F.max("salts").alias("most"))
    shared = tables.put("met", posted.join(local, ["token", "salt"]).where("met > 1 or most > 0").drop("met", "salt", "most"))
    del posted, local
    release(docs.sparkSession)
    hubs = shared.where("salts > 0").groupBy("token").agg(F.min("hub").alias("least"))  # MOST_COMMON rows at most
    shared = shared.join(F.broadcast(hubs), "token", "left").withColumn("hub", F.coalesce("least", "hub")).drop("least", "salts")
    found = tables.put("equal", shared.where("at < 0 and id != hub.id and n = hub.n").select(F.col("id").alias("src"), F.col("hub.id").alias("dst")).distinct())
    shared = tables.put("shared", shared.where("at >= 0").join(found.select(F.col("src").alias("id")), "id", "left_anti"))
    tables.drop("met")
    near = _possible(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), threshold)
    tried = tables.put("tried", shared.where((F.col("id") != F.col("hub.id")) & near).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
    links = _verified(tried, rows, words, threshold)
    del near
    release(docs.sparkSession)
    member = components(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    named = shared.drop("hub").join(member.withColumnRenamed("node", "id"), "id", "left").withColumn("of", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo != hi").select("token")
    named = tables.put("named", named.join(mixed, "token"))
    tables.drop("shared")
    x, y = named.alias("x"), named.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.of") != F.col("y.of"))
    rest = x.join(y, apart & _possible(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), threshold))
    rest = tables.put("rest", rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    tables.drop("named", "tried")
    links = links.union(_verified(rest, rows, words, threshold))
    return found.union(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
