"""Candidate pairs and scoring engines. Scores are long relations (question, paragraph, score); nothing is pivoted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian, text
from ..functions.temporal import days_between, ground
from .rows import fixed

# Fixed value: the anchor of texts that have no reference date.
DEFAULT_DATE = "2021-11-09"


def candidate_pairs(items: DataFrame, question: str = "question", paragraph: str = "paragraph") -> DataFrame:
    """Each question with the union of its items' paragraphs, once each."""
    return items.select(question, paragraph).distinct()


def lookup(pairs: DataFrame, vectors: DataFrame, question: str, paragraph: str, key: str) -> DataFrame:
    """pairs with q_* and p_* columns of both texts; Spark broadcasts vectors only where they are small."""
    q = vectors.select([F.col(c).alias(question if c == key else f"q_{c}") for c in vectors.columns])
    p = vectors.select([F.col(c).alias(paragraph if c == key else f"p_{c}") for c in vectors.columns])
    return pairs.join(q, question).join(p, paragraph)


def inverted_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> DataFrame:
    """id, term, tf, dl (the document's length); `terms` (term): of just these."""
    words = docs.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("w"))
    words = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    words = words if terms is None else words.join(terms, "term", "left_semi")
    return words.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


#: Rows of the queries' terms that may be broadcast.
BROADCAST_TERMS = 500_000


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25: query_id, id, score for pairs that share a term; all others score 0.

    Terms in more than half of the documents get epsilon times the mean weight. Query terms keep their multiplicity.

    Documents cross one exchange, by id; their terms and scores are counted and added up where they then are, against the queries' terms, which
    are broadcast. Only where these are too many (counted) do both sides meet by term and the scores by pair.
    """
    words = docs.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("w"))
    size = docs.select(F.count("*").cast("double").alias("n"), F.avg(text.token_count(F.col(text_col))).alias("avg_dl"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    df = df.withColumn("idf", raw)
    floor = df.agg((epsilon * F.avg("idf")).alias("least"))
    df = df.crossJoin(F.broadcast(floor)).select("term", "avg_dl", F.when(F.col("idf") < 0, F.col("least")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(text.tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    by_term = asked.groupBy("term").agg(F.collect_list(F.struct("query_id", "qtf")).alias("asked")).join(df, "term")
    if asked.count() <= BROADCAST_TERMS:
        index, by_term = inverted_index(docs.repartition(id_col), id_col, text_col, F.broadcast(by_term.select("term"))), F.broadcast(by_term)
    else:
        index = inverted_index(docs, id_col, text_col)
    hits = index.join(by_term, "term").select("id", "tf", "dl", "idf", "avg_dl", F.inline("asked"))
    tf = F.col("tf").cast("double")
    weight = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return hits.groupBy("query_id", "id").agg(F.sum(weight).alias("score"))


def _grounded(expressions: DataFrame, key: str, expr: str = "expr", anchor: str = "anchor") -> DataFrame:
    """key, i: the days of each expression, null where it doesn't resolve. Grounded in a column of its own, so once."""
    g = fixed(expressions.select(F.col(key), F.col(expr).alias("_e"), F.col(anchor).alias("_anchor")), _g=ground(F.col("_e"), F.col("_anchor")))
    return g.select(key, days_between(F.col("_g")).alias("i"))


def text_gaussians(expressions: DataFrame, key: str, expr: str = "expr", anchor: str = "anchor") -> DataFrame:
    """Per text: mixture mean and variance (mu, var) and covering interval (a, b) of its resolvable expressions."""
    grounded = _grounded(expressions, key, expr, anchor).where("i IS NOT NULL")
    m = gaussian.moments(F.col("i.a"), F.col("i.b"))
    rows = grounded.select(key, "i", m["mu"].alias("m"), m["var"].alias("v"))
    return rows.groupBy(key).agg(F.avg("m").alias("mu"), (F.avg("v") + F.var_pop("m")).alias("var"), F.min("i.a").alias("a"), F.max("i.b").alias("b"))


def tagger_similarity(pairs: DataFrame, expressions: DataFrame, mode: str, question: str, paragraph: str, key: str) -> DataFrame:
    """question, paragraph, score by mode merge, union, max, mean or product; texts without resolvable expressions score 0.

    expressions (key, expr, anchor): what a tagger found in each text.
    """
    pairs = pairs.select(F.col(question).alias("_question"), F.col(paragraph).alias("_paragraph"))
    if mode in ("merge", "union"):
        g = text_gaussians(expressions, key)
        q = g.select(F.col(key).alias("_question"), F.struct("mu", "var", "a", "b").alias("q"))
        p = g.select(F.col(key).alias("_paragraph"), F.struct("mu", "var", "a", "b").alias("p"))
        both = pairs.join(q, "_question", "left").join(p, "_paragraph", "left")
        s = gaussian.clamped_similarity(F.col("q"), F.col("p")) if mode == "merge" else gaussian.interval_similarity(F.col("q.a"), F.col("q.b"), F.col("p.a"), F.col("p.b"))
        return both.select(F.col("_question").alias(question), F.col("_paragraph").alias(paragraph), F.coalesce(s, F.lit(0.0)).alias("score"))
    fold = {"max": F.max, "mean": F.avg, "product": F.product}[mode]
    e = _grounded(expressions, key)
    q = e.select(F.col(key).alias("_question"), F.col("i").alias("q"), F.lit(True).alias("has_q"))
    p = e.select(F.col(key).alias("_paragraph"), F.col("i").alias("p"), F.lit(True).alias("has_p"))
    both = pairs.join(q, "_question", "left").join(p, "_paragraph", "left")
    s = F.coalesce(gaussian.interval_similarity(F.col("q.a"), F.col("q.b"), F.col("p.a"), F.col("p.b")), F.lit(0.0))
    s = F.when(F.col("has_q") & F.col("has_p"), s)
    return both.groupBy(F.col("_question").alias(question), F.col("_paragraph").alias(paragraph)).agg(F.coalesce(fold(s), F.lit(0.0)).alias("score"))


class TemporalHead:
    """Masked attention pooling over token states, a date encoding, two dense layers, and mean and deviation heads; in numpy."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def forward(self, states: np.ndarray, mask: np.ndarray, encoding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.w
        score = np.tanh(states @ w["attend"] + w["attend_bias"]) @ w["context"]
        score = np.where(mask > 0, score, -np.inf)
        a = np.exp(score - score.max(axis=1, keepdims=True))
        pooled = ((a / a.sum(axis=1, keepdims=True))[..., None] * states).sum(axis=1)
        h = np.concatenate([pooled, encoding], axis=1) @ w["dense"] + w["dense_bias"]
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5) * w["scale"] + w["shift"]
        h = np.maximum(h, 0)
        return np.tanh(h @ w["mean"] + w["mean_bias"]), np.sqrt(np.exp(h @ w["log_var"] + w["log_var_bias"]))

    @staticmethod
    def random(dim: int, enc: int, hidden: int, out: int, seed: int = 42) -> TemporalHead:
        rng = np.random.default_rng(seed)
        shapes = {"attend": (dim, dim), "attend_bias": (dim,), "context": (dim,), "dense": (dim + enc, hidden), "dense_bias": (hidden,), "scale": (hidden,), "shift": (hidden,), "mean": (hidden, out), "mean_bias": (out,), "log_var": (hidden, out), "log_var_bias": (out,)}
        return TemporalHead({k: rng.normal(0, 0.1, s) + (k == "scale") for k, s in shapes.items()})


def encode_temporal(rows: DataFrame, states: str, encoding: str, head: TemporalHead, key: str) -> DataFrame:
    """key, mu, std by the head; `states` is one token's vector, or an array of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.atleast_2d(np.stack([np.asarray(r, np.float64) for r in s]) if np.ndim(s[0]) else np.asarray(s, np.float64)) for s in b["s"]]
            n = max(map(len, x))
            padded, mask = np.zeros((len(x), n, x[0].shape[1])), np.zeros((len(x), n))
            for i, r in enumerate(x):
                padded[i, : len(r)], mask[i, : len(r)] = r, 1
            mu, std = head.forward(padded, mask, np.stack([np.asarray(e, np.float64) for e in b["e"]]))
            yield pd.DataFrame({key: b[key], "mu": list(mu), "std": list(std)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(states).alias("s"), F.col(encoding).alias("e")).mapInPandas(run, f"{key} {kind}, mu array<double>, std array<double>")


def encode_texts(texts: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], instruction: str | None = None, chars: int | None = 400) -> DataFrame:
    """text, embedding for every distinct text; the encoder is any function from texts to a matrix."""
    t = F.col(text_col)
    shown = text.prefix(t, chars) if chars else t
    rows = texts.select(t.alias("text"), (text.instruct(instruction, shown) if instruction else shown).alias("shown")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "embedding": list(np.asarray(encoder(b["shown"].tolist()), np.float32))})

    return rows.mapInPandas(run, "text string, embedding array<float>")


def text_id(role: str, t: Column) -> Column:
    """Stands for a text in joins: 32 bytes, however long the text."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{role}:"), t), 256))


def anchored_texts(items: DataFrame, default: str = DEFAULT_DATE) -> tuple[DataFrame, DataFrame]:
    """The distinct questions and the distinct paragraphs to encode: id, text, anchor (date) each.

    items (item_id, question, paragraph, reference_date), as `files.read_benchmark` gives them. A question's anchor is the
    reference date of its first item; the default stands for dates that are missing or no dates, and for all
    paragraphs. Null texts are left out; a text that is both is encoded in either role.
    """
    day = F.lit(default).cast("date")
    first = F.min(F.struct("item_id", F.col("reference_date").try_cast("date").alias("d")))
    asked = items.where("question IS NOT NULL").groupBy(F.col("question").alias("text")).agg(first.alias("first"))
    told = items.where("paragraph IS NOT NULL").select(F.col("paragraph").alias("text")).distinct()
    return (
        asked.select(text_id("question", F.col("text")).alias("id"), "text", F.coalesce("first.d", day).alias("anchor")),
        told.select(text_id("paragraph", F.col("text")).alias("id"), "text", day.alias("anchor")),
    )


def batch_encoder(model: Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]) -> Callable[[DataFrame], DataFrame]:
    """An encoder for `temporal_similarity` of any function from texts and their dates (yyyy-mm-dd) to rows of means and deviations."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mu, std = model(b["text"].tolist(), b["anchor"].tolist())
            yield pd.DataFrame({"id": b["id"], "mu": list(np.asarray(mu, np.float64)), "std": list(np.asarray(std, np.float64))})

    return lambda texts: texts.select("id", "text", F.date_format("anchor", "yyyy-MM-dd").alias("anchor")).mapInPandas(run, "id binary, mu array<double>, std array<double>")


def temporal_similarity(items: DataFrame, encoder: Callable[[DataFrame], DataFrame], default: str = DEFAULT_DATE, temperature: float = gaussian.TEMPERATURE) -> DataFrame:
    """question, paragraph, score for every distinct pair of items (see `anchored_texts`) without a null side.

    encoder: from (id, text, anchor) to (id, mu, std), a row each. Every distinct text is encoded once, however many pairs it is in; vectors
    meet the pairs by id, and texts come with the pairs.
    """
    asked, told = (encoder(t).select(F.col("id").alias(f"{s}_id"), F.struct("mu", "std").alias(s)) for s, t in zip(("q", "p"), anchored_texts(items, default), strict=True))
    pairs = candidate_pairs(items).where("question IS NOT NULL AND paragraph IS NOT NULL")
    both = pairs.withColumns({"q_id": text_id("question", F.col("question")), "p_id": text_id("paragraph", F.col("paragraph"))}).join(asked, "q_id").join(told, "p_id")
    return both.select("question", "paragraph", gaussian.vector_similarity(F.col("q.mu"), F.col("q.std"), F.col("p.mu"), F.col("p.std"), temperature).alias("score"))


#: Engines by name: what each needs and returns is in its docstring.
ENGINES = {"bm25": bm25, "tagger": tagger_similarity, "semantic": encode_texts, "temporal": temporal_similarity}


def engine(name: str) -> Callable:
    for prefix, f in ENGINES.items():
        if name.lower().startswith(prefix):
            return f
    raise ValueError(f"no engine for {name!r}; there are {', '.join(ENGINES)}")
