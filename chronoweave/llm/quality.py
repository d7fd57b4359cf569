"""Quality of documents by their lines: a linear-chain conditional random field marks each as content or boilerplate.

Every line with a word is a place in the chain. Its features are shares (of symbols, capitals, exclamation marks, digits, words in repeated
three-word windows), its length, its words' length, and whether the text has it more than once, each as one of a few ranges; the
chain adds a weight for each pair of neighbouring marks. The most likely marks are found by Viterbi decoding, ties to content, and a
document whose words stand in content lines for LEAST_CONTENT or more is kept, if the plain rules (50 words, repetition) don't fail it.

Labels are of documents, not lines, so training starts with every line marked as its document is and on its own, and goes on with the lines of
bad documents decoded anew, as long as one of them is boilerplate; only then are the weights of neighbouring marks learned. The fit takes a bounded sample of labelled documents
(DOCUMENTS of each label, by the hash of the id, none of more than SAMPLE_LINES lines); everything else covers whole texts.

Null and empty texts have no words: all counts are zero and the rules fail them. A text's lines are told apart by '\\n' alone. Null ids stay. Repeated rows
get equal results. Very long texts are read whole. Without usable labels of both kinds every line is content. Only
the id and text columns are read (and those of labels), so no other column's name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, cut, text_of

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED, LEAST_CONTENT = 50, 50, 0.5
DOCUMENTS, SAMPLE_LINES = 3_000, 256
#: Where the ranges of a feature begin, but for the first.
SHARES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
RANGES = (SHARES, SHARES, SHARES, SHARES, SHARES, (2, 4, 8, 16, 32, 64, 128), (2, 3, 4, 5, 6, 8, 10, 14), (0.5,), (0.5,))
_FROM = np.concatenate([[0], np.cumsum([len(r) + 1 for r in RANGES])])
N_FEATURES = int(_FROM[-1])


def _marks(of: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


_SPACE, _SYMBOL, _BANG, _DIGIT = (_marks(x) for x in (SPACES, SYMBOLS, b"!?", b"0123456789"))
_UPPER = _marks(bytes(range(65, 91)))
_LETTER = _UPPER | _marks(bytes(range(97, 123))) | (np.arange(256) >= 0xC0)
_POINT = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Lines:
    """Counts of a batch's documents, and its lines with words: their documents, features, words and places in the text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    features: np.ndarray
    words: np.ndarray
    place: np.ndarray


def repeated(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a three-word window that their document has twice or more."""
    covered = np.zeros(len(ids), bool)
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(ids) > 2 else np.zeros(0, np.int64)
    if len(at):
        name, most = ids[at], int(ids.max()) + 1
        for step in (1, 2):
            name = np.unique(name * most + ids[at + step], return_inverse=True)[1].astype(np.int64)
        _, name, n = np.unique(doc[at] * (int(name.max()) + 1) + name, return_inverse=True, return_counts=True)
        twice = at[n[name] > 1]
        for step in range(3):
            covered[twice + step] = True
    return covered


def read_lines(texts: list[str | None]) -> Lines:
    raw = [(t or "").encode() for t in texts]
    data = b"\n".join([*raw, b""])
    byte = np.frombuffer(data, np.uint8)
    line_to = np.flatnonzero(byte == 10) + 1
    line_from = np.concatenate([[0], line_to[:-1]]) if len(line_to) else line_to
    doc_to = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    doc_of = np.searchsorted(doc_to, line_from, "right")

    def per_line(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[byte], dtype=np.int32)])
        return sums[line_to] - sums[line_from]

    chars, symbols, upper, letters, bangs, digits = (per_line(t) for t in (_POINT & ~_SPACE, _SYMBOL, _UPPER, _LETTER & _POINT, _BANG, _DIGIT))
    solid = ~_SPACE[byte]
    start = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]])) if len(byte) else np.zeros(0, np.int64)
    line_of = np.searchsorted(line_to, start, "right")
    names: dict[bytes, int] = {}
    tokens = data.split()
    ids = np.fromiter((names.setdefault(w, len(names)) for w in tokens), np.int64, len(tokens))
    again = repeated(ids, doc_of[line_of])
    words = np.bincount(line_of, minlength=len(line_to))
    repeats = np.bincount(line_of[again], minlength=len(line_to))
    texts_of: dict[bytes, int] = {}
    own = np.fromiter((texts_of.setdefault(x, len(texts_of)) for x in data.split(b"\n")[:-1]), np.int64, len(line_to))
    _, first, group, n = np.unique(doc_of * (len(texts_of) + 1) + own, return_index=True, return_inverse=True, return_counts=True)
    later = np.arange(len(own)) != first[group] if len(own) else np.zeros(0, bool)
    wordy = np.flatnonzero(words)
    total, some = np.maximum(chars, 1), np.maximum(words, 1)
    values = (symbols / total, upper / np.maximum(letters, 1), bangs / total, digits / total, repeats / some, words, chars / some, later, n[group] > 1)
    features = np.stack([np.searchsorted(r, v[wordy], "right") + lo for r, v, lo in zip(RANGES, values, _FROM, strict=False)], axis=1)
    doc_n = len(raw)

    def per_doc(of: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of, weights=of, minlength=doc_n).astype(np.int64)

    first_line = np.searchsorted(doc_of, np.arange(doc_n))
    return Lines(
        per_doc(words), per_doc(chars), per_doc(symbols), per_doc(later & (words > 0)), per_doc(repeats), doc_of[wordy], features.astype(np.int32), words[wordy], wordy - first_line[doc_of[wordy]]
    )


@dataclass
class Chain:
    """Weights of features for boilerplate against content (0), and of neighbouring marks [before, after]; mark 1 is boilerplate."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, lines: Lines) -> np.ndarray:
        """The most likely mark of every line."""
        return viterbi(self.weights[lines.features].sum(axis=1), self.steps, lines.doc)


def no_chain() -> Chain:
    return Chain(np.zeros(N_FEATURES), np.zeros((2, 2)))


def viterbi(scores: np.ndarray, steps: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks (0 or 1) of chains one after the other; scores are those of 1 against 0. Ties go to 0, the last place first."""
    (cc, cb), (bc, bb) = steps.tolist()
    marks = np.zeros(len(scores), np.int8)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    flat = scores.tolist()
    for lo, hi in zip(bounds, bounds[1:]):
        if lo == hi:
            continue
        c, b, back = 0.0, flat[lo], []
        for s in flat[lo + 1 : hi]:
            c_c, c_b, b_c, b_b = c + cc, b + bc, c + cb, b + bb
            back.append((c_b > c_c, b_b > b_c))
            c, b = max(c_c, c_b), max(b_c, b_b) + s
        m = int(b > c)
        marks[hi - 1] = m
        for k in range(len(back) - 1, -1, -1):
            m = int(back[k][m])
            marks[lo + k] = m
    return marks


def log_likelihood(chain: Chain, features: np.ndarray, marks: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of chains padded to one length, longest first, and its gradients: features (lines of one chain after the other, groups), marks (chains, places), length."""
    n, most = marks.shape
    live = [int((length > t).sum()) for t in range(most)]
    mask = np.arange(most)[None] < length[:, None]
    score = np.zeros((n, most))
    score[mask] = chain.weights[features].sum(axis=1)
    unary = np.stack([np.zeros_like(score), score], axis=2)
    ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    ahead[:, 0] = unary[:, 0]
    for t in range(1, most):
        k = live[t]
        ahead[:k, t] = np.logaddexp(ahead[:k, t - 1, :1] + chain.steps[0], ahead[:k, t - 1, 1:] + chain.steps[1]) + unary[:k, t]
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        on = unary[:k, t + 1] + behind[:k, t + 1]
        behind[:k, t] = np.logaddexp(on[:, :1] + chain.steps[:, 0], on[:, 1:] + chain.steps[:, 1])
    log_z = np.logaddexp(*(ahead[np.arange(n), length - 1]).T)
    own = np.broadcast_to(log_z[:, None], mask.shape)
    sure = np.exp(ahead[:, :, 1][mask] + behind[:, :, 1][mask] - own[mask])
    grad = np.bincount(features.ravel(), weights=np.repeat(marks[mask] - sure, features.shape[1]), minlength=len(chain.weights))
    value = float((score * marks)[mask].sum() - log_z.sum())
    step_grad = np.zeros((2, 2))
    pairs = mask[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            p = np.exp(ahead[:, :-1, i][pairs] + chain.steps[i, j] + unary[:, 1:, j][pairs] + behind[:, 1:, j][pairs] - own[:, 1:][pairs])
            seen = ((marks[:, :-1] == i) & (marks[:, 1:] == j))[pairs].sum()
            step_grad[i, j] = seen - p.sum()
            value += float(seen * chain.steps[i, j])
    return value, grad, step_grad


def fit_chain(rows: list[np.ndarray], bad: np.ndarray, passes: int = 3, rounds: int = 80, rate: float = 0.1, l2: float = 1.0) -> Chain:
    """rows: each document's features (lines, groups); bad: its label. Adam on the penalised likelihood, marks of bad documents renewed after each pass."""
    chain, order = no_chain(), np.argsort([-len(r) for r in rows], kind="stable")
    rows, bad = [rows[i] for i in order], bad[order]
    length = np.array([len(r) for r in rows])
    most = int(length.max(initial=0))
    if not most or bad.all() or not bad.any():
        return chain
    features = np.concatenate(rows)
    mask = np.arange(most)[None] < length[:, None]
    marks = np.where(mask, bad[:, None], 0).astype(np.int8)
    size = N_FEATURES + 4
    for k in range(passes):
        m, v = np.zeros(size), np.zeros(size)
        for step in range(1, rounds + 1):
            _, grad, steps = log_likelihood(chain, features, marks, length)
            both = np.concatenate([grad, steps.ravel()]) - l2 * np.concatenate([chain.weights, chain.steps.ravel()])
            both[N_FEATURES:] *= k > 0  # marks that are a document's can't tell how marks follow each other
            m, v = 0.9 * m + 0.1 * both, 0.999 * v + 0.001 * both**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            chain = Chain(chain.weights + move[:N_FEATURES], chain.steps + move[N_FEATURES:].reshape(2, 2))
        doc = np.repeat(np.arange(len(rows)), length)
        new = np.zeros_like(marks)
        new[mask] = viterbi(chain.weights[features].sum(axis=1), chain.steps, doc)
        stays = bad & new.any(axis=1)
        marks[stays] = new[stays]
    return chain


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, sample_lines: int = SAMPLE_LINES) -> Chain:
    """From labels (id, quality: 1 good, 0 bad). Labels that contradict each other count as bad."""
    marks = labels.select(labels[id_col].alias("id"), labels["quality"].alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    marks = cut(marks.groupBy("id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good")))
    best = [marks.where(F.col("good") == g).orderBy(F.xxhash64("id"), "id").limit(documents) for g in (0, 1)]
    chosen = cut(best[0].union(best[1]))
    batch_bytes(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).join(F.broadcast(chosen), "id").select("good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lines = read_lines(x.column("text").to_pylist())
            to = np.searchsorted(lines.doc, np.arange(x.num_rows + 1))
            keep = np.flatnonzero((np.diff(to) > 0) & (np.diff(to) <= sample_lines))
            own = pa.array([lines.features[to[i] : to[i + 1]].ravel() for i in keep], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([x.column("good").take(pa.array(keep)), own], ["good", "features"])

    rows = texts.mapInArrow(run, "good int, features array<int>").orderBy(F.xxhash64("features"), "features").collect()
    return fit_chain([np.array(r["features"], np.int32).reshape(-1, len(RANGES)) for r in rows], np.array([r["good"] == 0 for r in rows], bool))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """For each document: id, its counts, base_failed, kept, content_share (of its words), boilerplate (the numbers of such lines, from 0)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    batch_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lines = read_lines(x.column("text").to_pylist())
            marks = chain.decode(lines)
            content = np.bincount(lines.doc, weights=lines.words * (marks == 0), minlength=x.num_rows)
            share = content / np.maximum(lines.n_words, 1)
            failed = (lines.n_words < LEAST_WORDS) | (100 * lines.n_repeat_words > MOST_REPEATED * lines.n_words)
            other = np.flatnonzero(marks)
            to = np.searchsorted(lines.doc[other], np.arange(x.num_rows + 1)).astype(np.int32)
            boiler = pa.ListArray.from_arrays(pa.array(to), pa.array(lines.place[other], pa.int32()))
            counts = [pa.array(getattr(lines, c), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([x.column("id"), *counts, pa.array(failed), pa.array(~failed & (share >= least_content)), pa.array(share), boiler], ["id", *COUNTS, "base_failed", "kept", "content_share", "boilerplate"])

    longs = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {longs}, base_failed boolean, kept boolean, content_share double, boilerplate array<int>")


def op13(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return assess(docs, train(docs, labels)).withColumnRenamed("id", "doc_id").drop("boilerplate")
