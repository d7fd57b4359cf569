"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

Words are lower-cased (A-Z) runs without white space. A document's score is the sum over its words of the logarithm of
S(w | context): count(context w) / count(context) for the longest context, of up to order - 1 words of the document, whose
n-gram occurs; each step to a shorter context costs a factor of 0.4, and a word that occurs nowhere counts 0.5. All
counts are over the other documents: a document's own n-grams are subtracted, else every n-gram would be known.

Counts live in a table partitioned by the n-gram's hash. A chunk of documents joins it with its distinct n-grams, pre-aggregated
(chunks.py), and the counts that come back are summed per document. The table has as many buckets as the number of n-grams asks
for; a chunk sends a row to each bucket that it asks, so there are never more rows than distinct n-grams of chunks. N-grams are
known by 64-bit hashes: of N distinct ones about N / 2^64 share theirs with another, 1 in two million at 10^13.

Nulls: a null text is an empty one: no words, score 0, mean null. A null id stays. Rows that repeat are other documents
to each other. Where a document is the only one with words, its words have probability 0.5 each. An empty table gives an
empty result. Very long texts are scored whole, in one chunk each; ties have no effect. Only the id and text columns are read, so
no other column's name can clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_CHARS, bucket_edges, load_counts, load_sorted, pack, store_counts, store_sorted, unpack
from .common import WORD, cut, text_of

ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: N-grams that a bucket of the count table is asked for, on average.
BUCKET_KEYS = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The document of each word; and for n = 1 to order the hash of the n-gram that ends there, 0 where it would begin before."""
    import xxhash

    codes, known, hashes, n = [], {}, [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").lower().split()
        n.append(len(words))
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = len(hashes)
                hashes.append(xxhash.xxh64_intdigest(w, 7))
            codes.append(c)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) if len(doc) else np.zeros(0, np.int64)
    h = np.array(hashes, np.uint64)[np.array(codes, np.int64)] if codes else np.zeros(0, np.uint64)
    out = [_mix(h + _A)]
    for k in range(1, order):
        prefix = np.r_[np.zeros(1, np.uint64), out[-1][:-1]] if len(h) else out[-1]
        out.append(np.where(place >= k, _mix(prefix * _B + h + np.array([k], np.uint64) * _A), np.uint64(0)))
    return doc, out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, *, chunk_chars: int = CHUNK_CHARS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """id, n_words, log_score (natural logarithm), for every row of docs."""
    packed, _ = pack(docs, id_col, text_col, chunk_chars)
    n_words = int(cut(docs.select(F.regexp_count(text_of(docs[text_col]), F.lit(WORD)).cast("bigint").alias("n"))).agg(F.sum("n")).first()[0] or 0)
    n = max(1, -(-n_words * order // bucket_keys))

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, grams = ngrams(unpack(pdf["blob"])[1], order)
        keys, counts = np.unique(np.concatenate([g[g > 0] for g in grams]), return_counts=True)
        edges = bucket_edges(keys, n)
        parts = [(b, int(key[0]), edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges))]
        return pd.DataFrame([(int(b), c, store_sorted(keys[x:y]), store_counts(counts[x:y])) for b, c, x, y in parts], columns=["bucket", "chunk", "keys", "counts"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [load_sorted(k) for k in pdf["keys"]]
        counts = np.concatenate([load_counts(c) for c in pdf["counts"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)[at]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": key[0], "counts": [store_counts(total[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]})

    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, texts = unpack(docs["blob"])
        doc, grams = ngrams(texts, order)
        words = len(doc)
        keys, at = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.concatenate([np.zeros(0, np.int64), *(load_counts(c) for c in answers.sort_values("bucket")["counts"])])
        total = np.concatenate([np.zeros(len(keys) - len(counts), np.int64), counts])  # the key 0 isn't asked for
        pair, _ = pd.factorize(np.tile(doc, order) * np.int64(len(keys)) + at)
        own = np.bincount(pair)[pair] if len(pair) else pair
        size = np.bincount(doc, minlength=len(ids)).astype(np.int64)
        known = [g > 0 for g in grams]
        others = [np.where(known[k], (total[at] - own)[k * words : (k + 1) * words], 0) for k in range(order)]
        rest = n_words - size[doc]
        p = np.maximum(others[0], UNSEEN) / np.maximum(rest, 1)
        for k in range(1, order):
            context = np.r_[np.zeros(1, np.int64), others[k - 1][:-1]] if len(p) else p
            seen = known[k] & (others[k] > 0)
            p = np.where(seen, others[k] / np.maximum(context, 1), np.where(known[k], BACKOFF * p, p))
        return pd.DataFrame({"id": ids, "n_words": size, "log_score": np.bincount(doc, weights=np.log(p), minlength=len(ids))})

    asked = packed.groupBy("chunk").applyInPandas(ask, "bucket bigint, chunk bigint, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "chunk bigint, bucket bigint, counts binary")
    scores = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, "id string, n_words bigint, log_score double")
    return scores.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def op3(spark, sf_dir: str) -> DataFrame:
    s = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.try_divide("log_score", "n_words"), 6).alias("mean_log_score"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS w3, unnest(generate_series(1, len(l))) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents)),
g AS (
  SELECT doc_id, i, w3, lag(w3) OVER o AS w2, lag(w3, 2) OVER o AS w1 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w3, count(*) AS c FROM g GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n FROM w),
o AS (
  SELECT doc_id, i, w1, w2, w3, count(*) OVER (PARTITION BY doc_id) AS len,
    count(*) OVER (PARTITION BY doc_id, w3) AS o1, count(*) OVER (PARTITION BY doc_id, w2, w3) AS o2, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS o3 FROM g),
j AS (
  SELECT o.doc_id, o.i, o.w1, o.w2, greatest(c1.c - o1, 0.5) / greatest(n.n - len, 1) AS p1, c1.c - o1 AS x1, c2.c - o2 AS x2, c3.c - o3 AS x3
  FROM o JOIN c1 USING (w3) LEFT JOIN c2 ON c2.w2 = o.w2 AND c2.w3 = o.w3 LEFT JOIN c3 ON c3.w1 = o.w1 AND c3.w2 = o.w2 AND c3.w3 = o.w3, n),
k AS (SELECT *, lag(x1) OVER z AS y1, lag(x2) OVER z AS y2 FROM j WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
p AS (
  SELECT doc_id, CASE WHEN w2 IS NULL THEN p1 WHEN x2 > 0 THEN x2::DOUBLE / y1 ELSE 0.4 * p1 END AS p2, w1, x3, y2 FROM k),
q AS (SELECT doc_id, ln(CASE WHEN w1 IS NULL THEN p2 WHEN x3 > 0 THEN x3::DOUBLE / y2 ELSE 0.4 * p2 END) AS l FROM p)
SELECT d.doc_id, count(l)::BIGINT AS n_words, round(coalesce(sum(l), 0), 4) AS log_score, round(sum(l) / nullif(count(l), 0), 6) AS mean_log_score
FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id
"""
