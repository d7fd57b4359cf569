"""Toxicity by non-negative positive-unlabelled learning, in numpy, over words and word beginnings and their density.

Positives are confirmed toxic documents; unlabelled text is a sample of all documents that may be learned from, whatever
their labels. With the class prior p, the share of toxic documents among the labelled ones, the risk is
p E+[l(f)] + max(0, E[l(-f)] - p E+[l(-f)]): unlabelled text counts as negative, less the positives in it, and where
that estimate falls below zero the step goes the other way, so the classifier can't profit from overfitting it.

The fit's bounds are parameters: POSITIVES and UNLABELLED documents in hash order, and FEATURES features, chosen by
how much more or less often positives have them than unlabelled text has. The scores are then shifted so that
THRESHOLD is where recall squared over the share called toxic is highest, which needs no confirmed negatives. Scoring
covers every document and whole texts.

Nulls: a null text is an empty one and gets the score of a text without words; a null id belongs to the learning side
and has no label. A null label is none; a document with several labels is toxic if any says so. Rows that repeat are each scored. Without
a confirmed example every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, batch_bytes, cut, trim

POSITIVES, UNLABELLED, FEATURES, LEAST_DOCS, LEAST_Z = 4_000, 12_000, 500, 5, 4.0
THRESHOLD = 0.7
_WORDS = re.compile(r"\w+")


#: Lengths of the word beginnings that are features: inflected and compound forms share them.
BEGINNINGS = (3, 4, 5, 6)
#: A feature that a document has at least twice is also one for each of these shares of its words that it reaches.
SHARES = (0.005, 0.01, 0.02, 0.04)
#: Words whose features a worker remembers.
_REMEMBERED = 300_000


def stems_of(word: str) -> list[str]:
    """The word itself, and its beginnings with a mark."""
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def features(text: str | None, stems=stems_of) -> list[str]:
    """All features of a text, in order; stems gives those of a word."""
    counts: Counter[str] = Counter()
    words = _WORDS.findall((text or "").lower())
    for w, k in Counter(words).items():
        for f in stems(w):
            counts[f] += k
    out = []
    for f, k in counts.items():
        out.append(f)
        if k > 1:
            out += [f"{f}|{x:g}" for x in SHARES if k >= x * len(words)]
    return sorted(out)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self._known: dict[str, tuple[str, ...]] = {}
        self._stems = {f.rpartition("|")[0] or f for f in self.weights}

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def _own(self, word: str) -> tuple[str, ...]:
        own = self._known.get(word)
        if own is None:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            own = self._known[word] = tuple(f for f in stems_of(word) if f in self._stems)
        return own

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        return _logistic(self.bias + sum(self.weights.get(f, 0.0) for f in features(text, self._own)))


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))


def operating_point(f: np.ndarray, positive: np.ndarray) -> float:
    """The cut of f with the highest recall squared over the share of unlabelled rows above it; the middle of its gap."""
    cuts = np.unique(f)
    if len(cuts) < 2:
        return float(cuts[0]) + 1 if len(cuts) else 0.0
    p, u = np.sort(f[positive]), np.sort(f[~positive])
    recall = 1 - np.searchsorted(p, cuts) / len(p)
    share = np.maximum(1 - np.searchsorted(u, cuts) / len(u), 1 / len(u))
    best = 1 + int(np.argmax((recall**2 / share)[1:]))
    return float((cuts[best - 1] + cuts[best]) / 2)


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, rounds: int = 600, rate: float = 0.05, l2: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier; rows hold the indices of each document's features. Adam, full batches."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share_p = np.where(positive, 1 / max(1, positive.sum()), 0.0)
    share_u = np.where(positive, 0.0, 1 / max(1, (~positive).sum()))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        f = w[-1] + np.bincount(doc, weights=w[at], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
        negative = np.logaddexp(0, f)
        rest = share_u @ negative - prior * (share_p @ negative)
        g_rest = (share_u - prior * share_p) * p
        g = -prior * share_p * (1 - p) + g_rest if rest >= 0 else -g_rest
        grad = np.append(np.bincount(at, weights=g[doc], minlength=n_features), g.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """labels (id, toxic). `learn`, a condition on the column `id`, says which documents may be learned from."""
    spark = docs.sparkSession
    learn = ~held_out(F.col("id")) if learn is None else learn
    marks = labels.select(labels[id_col].alias("id"), labels["toxic"].alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & learn)
    marks = cut(marks.groupBy("id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    prior = marks.agg(F.avg("toxic")).first()[0]
    if not prior:
        return Model({}, -np.inf)
    prior = min(max(prior, 1e-4), 0.9)
    order = F.xxhash64("id")
    p_ids = marks.where("toxic = 1").orderBy(order, "id").limit(positives).select("id", F.lit(True).alias("positive"))
    u_ids = docs.select(docs[id_col].alias("id")).where(F.col("id").isNotNull() & learn).distinct().orderBy(order, "id").limit(unlabelled).select("id", F.lit(False).alias("positive"))
    ids = p_ids.union(u_ids)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    batch_bytes(spark, TEXT_BYTES)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "positive": b["positive"], "words": [features(t) for t in b["text"]]})
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    sample = cut(texts.join(F.broadcast(cut(ids)), "id").select("id", "positive", "text").mapInPandas(split, f"id {kind}, positive boolean, words array<string>"))
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p or not n_u:
        return Model({}, -np.inf)
    by_word = sample.select("positive", F.explode("words").alias("w")).groupBy("w").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    a, b = F.col("p") / n_p, F.col("u") / n_u
    mean = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean + 1e-9) * (1 / n_p + 1 / n_u))
    chosen = by_word.where(F.col("p") + F.col("u") >= LEAST_DOCS).withColumn("z", z).orderBy(F.desc("z"), "w").limit(FEATURES)
    words = [r["w"] for r in chosen.where(f"z > {LEAST_Z}").collect()]
    at = {w: i for i, w in enumerate(words)}
    own = sample.select("id", "positive", F.array_intersect("words", F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("words")).toPandas()
    own = own.sort_values(["positive", "id"], kind="stable")
    rows = [np.array(sorted(at[w] for w in x), np.int64) for x in own["words"]]
    positive = own["positive"].to_numpy(bool)
    weights, bias = fit_nnpu(rows, positive, len(words), prior)
    cut_at = operating_point(np.array([bias + weights[r].sum() for r in rows]), positive)
    bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut_at
    return Model(dict(zip(words, weights.tolist(), strict=True)), bias)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of docs: the score of each whole text, from 0 to 1."""
    batch_bytes(docs.sparkSession, TEXT_BYTES)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([model.score(x) for x in t], dtype=float)
        trim()

    return F.pandas_udf(run, "double")(docs[text_col])


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier calls toxic."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(scored(docs, model, text_col) < THRESHOLD)


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    score = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, train(docs, labels)).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
