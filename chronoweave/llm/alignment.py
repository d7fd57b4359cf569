"""How the tokens of two tokenizers line up, byte by byte.

Tokenizer A is byte-level, B has pieces with byte fallback. Both encode a space and the text, so both sequences spell the
same bytes; where an A and a B token end at the same byte the text can be cut, and the tokens between two cuts are a group.

No token of either tokenizer reaches over a single space between two characters that are no white space into what stands before it,
so texts are cut there into parts, each of which has the tokens in any text that it has alone. Parts are encoded and
aligned once for an Arrow batch, however often its texts have them: they are laid end to end, the ends of all A and of all B
tokens are counted by byte once, and prefix sums at the parts' own byte offsets give each its share back. A text's tokens,
groups and links are those of its parts in a row.

A link is an A and a B token whose bytes end together. No token of either vocabulary is empty (checked), so every cut
has one link. How often the corpus has a link between two ids is counted over batches: each batch sends its distinct
id pairs with their counts, the table of pairs is joined back to the batches that hold them, and batches keep their links
packed meanwhile. A frequent pair is one row for each batch, however often it occurs.

Null and empty texts have no tokens, and neither has a text that either tokenizer doesn't give back byte by byte (one that holds U+2581,
say); their rows stay, with zeros. Null ids stay. Rows that repeat are documents of their own, each with its links. Of equally frequent A ids all
are the best of their B id. Very long texts are encoded whole. Only the id and text columns are read, so no other
column's name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import expand, squeeze
from .common import Tables, batch_bytes

#: Characters that a tokenizer gets at a time: its own objects take a hundred bytes a token.
ENCODE_CHARS = 500_000
#: Parts that a tokenizer gets as one text.
JOIN = 200
#: Where texts are cut into parts. Python's white space includes all that A's pattern takes for it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with each token's bytes. Made once in a worker."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        assert all(self.a_bytes) and all(self.b_bytes), "an empty token would end where the one before it ends"
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        split = self.a.pre_tokenizer
        self.can_cut = self.a.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not any("▁" in p.lstrip("▁") for p in pieces)

    def cut(self, text: str) -> list[str]:
        """The text's parts: each is encoded with a space before it."""
        return _CUT.split(text) if self.can_cut else [text]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """For each text its A and B ids; None where they don't spell the text."""
        got = zip(self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True)
        for t, (x, b) in zip(texts, got, strict=True):
            a, want = x.ids, b" " + t.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == want and b"".join([self.b_bytes[i] for i in b]) == want
            yield (np.array(a, np.int32), np.array(b, np.int32)) if same else None

    @cached_property
    def marks(self) -> np.ndarray:
        """Every A id before a comma and before a bar, then every B id before a comma and before a semicolon."""
        own = [f"{i}{s}" for s in ",|" for i in range(len(self.a_len))] + [f"{i}{s}" for s in ",;" for i in range(len(self.b_len))]
        return np.array(own, object)


@lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


@dataclass
class Batch:
    """The tokens of texts one after the other. `_to` arrays end with each text, `_cut` arrays with each group."""

    a: np.ndarray
    b: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    group_to: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _gather(to: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs end at `to`: the places of the runs `at`, one after the other, and where each ends there."""
    first = np.concatenate([[0], to])
    n = first[at + 1] - first[at]
    ends = np.cumsum(n)
    return np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0), ends


def _upto(ends: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends])[to]


def _encode_parts(parts: list[str], pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ids, B ids, each part's numbers of both, and whether they spell it; other parts have none.

    Parts are cut from joined texts again by bytes. Those that can't be joined go alone: with white space at an end, or U+2581,
    which B gives back as a space.
    """
    alone = [not pair.can_cut or p[0].isspace() or p[-1].isspace() or "▁" in p for p in parts]
    joined, single = ([i for i, x in enumerate(alone) if x is k] for k in (False, True))
    lines = [joined[i : i + JOIN] for i in range(0, len(joined), JOIN)]
    held: list[list[int]] = []
    order: list[int] = []
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def flush() -> None:
        texts = [" ".join([parts[i] for i in line]) for line in held]
        for line, got in zip(held, pair.encode(texts), strict=True):
            if got:
                order.extend(line)
                a.append(got[0])
                b.append(got[1])
            elif len(line) > 1:
                lines.extend([i] for i in line)
        held.clear()

    lines.extend([i] for i in single)
    chars = 0
    for line in lines:  # grows by the parts of a line that isn't spelled
        held.append(line)
        chars += sum(len(parts[i]) for i in line)
        if chars > ENCODE_CHARS or line is lines[-1]:
            flush()
            chars = 0
    own = np.array(order, np.int64)
    flat_a, flat_b = _flat(a), _flat(b)
    ends = np.cumsum(pc.binary_length(pa.array(parts, pa.string())).to_numpy().astype(np.int64)[own] + 1) if parts else own
    back = np.argsort(own)
    ok = np.zeros(len(parts), bool)
    ok[own] = True
    out = []
    for flat, size in ((flat_a, pair.a_len), (flat_b, pair.b_len)):
        token_ends = np.cumsum(size[flat])
        to = np.searchsorted(token_ends, ends, "right")
        assert (token_ends[to - 1] == ends).all(), "a token reaches over a cut"
        places, _ = _gather(to, back)
        n = np.zeros(len(parts), np.int64)
        n[own] = np.diff(to, prepend=0)
        out += [flat[places], n]
    return out[0], out[2], out[1], out[3], ok


def _align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, pair: Pair) -> Batch:
    a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
    a_end, b_end = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    total = int(a_end[-1]) if len(a) else 0
    both = (np.bincount(a_end, minlength=total + 1) > 0) & (np.bincount(b_end, minlength=total + 1) > 0)
    cuts = np.flatnonzero(both)
    group_to = np.cumsum(both, dtype=np.int64)[_upto(a_end, a_to)]
    return Batch(a, b, a_to, b_to, group_to, np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right"))


@dataclass
class Parts:
    """The distinct parts of texts, aligned, and the parts `at` each place of the texts, which end at the places `to`."""

    own: Batch
    at: np.ndarray
    to: np.ndarray

    def texts(self) -> Batch:
        """The texts' own tokens and groups."""
        x = self.own
        (a, a_end), (b, b_end), (g, g_end) = (_gather(to, self.at) for to in (x.a_to, x.b_to, x.group_to))
        cuts = []
        for cut, to, ends in ((x.a_cut, x.a_to, a_end), (x.b_cut, x.b_to, b_end)):
            moved = ends - to[self.at]  # from the part's place among parts to that in the texts
            cuts.append(cut[g] + np.repeat(moved, np.diff(g_end, prepend=0)))
        return Batch(x.a[a], x.b[b], _upto(a_end, self.to), _upto(b_end, self.to), _upto(g_end, self.to), *cuts)


def align_parts(texts: list[str | None], pair: Pair) -> Parts:
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    at = [np.array(list(map(number.__getitem__, pair.cut(t))) if t else [], np.int32) for t in texts]
    to = np.cumsum([len(x) for x in at], dtype=np.int64)
    at = _flat(at).astype(np.int64)
    a, b, n_a, n_b, ok = _encode_parts(list(number), pair)
    if not ok.all():  # a text with a part that isn't spelled has no tokens
        bad = np.concatenate([[0], np.cumsum(~ok[at])])
        n = np.diff(to, prepend=0)
        keep = bad[to] == bad[to - n]
        at, to = at[np.repeat(keep, n)], np.cumsum(n * keep)
    return Parts(_align(a, b, n_a, n_b, pair), at, to)


def align_batch(texts: list[str | None], pair: Pair) -> Batch:
    return align_parts(texts, pair).texts()


def spelled(got: Batch, pair: Pair) -> list[str]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
    table, n_a, n_b = pair.marks, len(pair.a_len), len(pair.b_len)
    a_group, b_group = (np.searchsorted(cut, np.arange(len(x)), "right") for cut, x in ((got.a_cut, got.a), (got.b_cut, got.b)))
    b_before = np.concatenate([[0], got.b_cut])
    order = np.empty(len(got.a) + len(got.b), np.int64)
    a_last, b_last = np.zeros(len(got.a), np.int64), np.zeros(len(got.b), np.int64)
    a_last[got.a_cut - 1] = 1
    b_last[got.b_cut - 1] = 1
    order[np.arange(len(got.a)) + b_before[a_group]] = got.a + n_a * a_last
    order[np.arange(len(got.b)) + (got.a_cut[b_group] if len(got.b) else 0)] = 2 * n_a + got.b + n_b * b_last
    to = np.concatenate([[0], got.a_to + got.b_to]).tolist()
    marks = table[order].tolist()
    return ["".join(marks[i:j])[:-1] for i, j in zip(to, to[1:])]


def text_sums(got: Parts, pair: Pair) -> list[str]:
    """The SHA-256 of each text's groups; '' without any."""
    own = np.array(spelled(got.own, pair) or [""], object)
    to = np.concatenate([[0], got.to]).tolist()
    return [hashlib.sha256(";".join(own[got.at[i:j]].tolist()).encode()).hexdigest() if i < j else "" for i, j in zip(to, to[1:])]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    batch_bytes(docs.sparkSession)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))


def _lists(values: np.ndarray, to: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(values, pa.int32()))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """id, a, b (the token ids), a_cut, b_cut (how many A and B tokens stand before the end of each group), arrays of int."""
    a_path, b_path = tokenizers or paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for x in batches:
            got = align_batch(x.column("text").to_pylist(), pair)
            per = np.diff(got.group_to, prepend=0)
            a_cut, b_cut = (cut - np.repeat(np.concatenate([[0], to])[:-1], per) for cut, to in ((got.a_cut, got.a_to), (got.b_cut, got.b_to)))
            yield pa.RecordBatch.from_arrays([x.column("id"), _lists(got.a, got.a_to), _lists(got.b, got.b_to), _lists(a_cut, got.group_to), _lists(b_cut, got.group_to)], ["id", "a", "b", "a_cut", "b_cut"])

    rows = _documents(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, a array<int>, b array<int>, a_cut array<int>, b_cut array<int>")


def _linked(docs: DataFrame, id_col: str, text_col: str, tokenizers: tuple[str, str] | None) -> DataFrame:
    """A row for each Arrow batch: what its documents come to, their links packed, and the batch's distinct id pairs with counts."""
    a_path, b_path = tokenizers or paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for k, x in enumerate(batches):
            got = align_parts(x.column("text").to_pylist(), pair)
            own = got.own
            codes, place = np.unique(own.a[own.a_cut - 1].astype(np.int64) * len(pair.b_len) + own.b[own.b_cut - 1], return_inverse=True)
            links, link_end = _gather(own.group_to, got.at)
            at = place.astype(np.int32)[links]
            n = np.bincount(at, minlength=len(codes))
            used = n > 0  # parts of texts without tokens have links of nobody
            codes, n, at = codes[used], n[used], (np.cumsum(used) - 1)[at]
            sums = text_sums(got, pair)
            chunk = TaskContext.get().partitionId() << 32 | k
            links = squeeze(np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
            ends = (np.cumsum(np.diff(own.a_to, prepend=0)[got.at]), np.cumsum(np.diff(own.b_to, prepend=0)[got.at]), link_end)
            counts = [np.diff(_upto(e, got.to), prepend=0) for e in ends]
            lists = [x.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string())]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (*lists, pa.array(codes // len(pair.b_len), pa.int64()), pa.array(codes % len(pair.b_len), pa.int64()), pa.array(n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([links], pa.binary()), *whole], ["chunk", "links", "ids", "n_a", "n_b", "n_groups", "groups_sha256", "a_id", "b_id", "n"])

    rows = _documents(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups"))
    return rows.mapInArrow(run, f"chunk bigint, links binary, ids array<{kind}>, {longs}, groups_sha256 array<string>, a_id array<bigint>, b_id array<bigint>, n array<bigint>")


def _counted(linked: DataFrame) -> DataFrame:
    """a_id, b_id, count, best: how many links hold the ids, and whether no A id has more with that B id."""
    counts = linked.select(F.explode(F.arrays_zip("a_id", "b_id", "n")).alias("p")).groupBy("p.a_id", "p.b_id").agg(F.sum("p.n").alias("count"))
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, count, best of all links of the corpus."""
    return _counted(Tables(docs.sparkSession).put("linked", _linked(docs, id_col, text_col, tokenizers)))


def alignment_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """For each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    tables = Tables(docs.sparkSession)
    linked = tables.put("linked", _linked(docs, id_col, text_col, tokenizers))
    counted = tables.put("counted", _counted(linked))
    asked = linked.select("chunk", F.explode(F.arrays_zip("a_id", "b_id")).alias("p")).select("chunk", "p.a_id", "p.b_id")
    told = asked.join(counted, ["a_id", "b_id"]).groupBy("chunk").agg(F.collect_list(F.struct("b_id", "a_id", "count", "best")).alias("told"))
    rows = linked.select("chunk", "links", "ids", "n_a", "n_b", "n_groups", "groups_sha256").join(told, "chunk", "left").drop("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
                lists = {c: one[c].flatten() for c in ("ids", "n_a", "n_b", "n_groups", "groups_sha256")}
                at = np.ascontiguousarray(np.frombuffer(expand(one["links"][0].as_py()), np.uint8).reshape(4, -1).T).view("<u4").ravel()
                table = one["told"].flatten()
                b, a, count, best = (table.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                order = np.lexsort((b, a))
                to = np.concatenate([[0], np.cumsum(lists["n_groups"].to_numpy())])
                sums = [np.concatenate([[0], np.cumsum(v[order].astype(np.int64)[at])]) for v in (best, count)]
                n_best, count_sum = (pa.array(s[to[1:]] - s[to[:-1]], pa.int64()) for s in sums)
                yield pa.RecordBatch.from_arrays([lists["ids"], lists["n_a"], lists["n_b"], lists["n_groups"], lists["n_groups"], n_best, count_sum, lists["groups_sha256"]], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return rows.mapInArrow(run, f"id {kind}, {longs}, groups_sha256 string")


def op11(spark, sf_dir: str) -> DataFrame:
    return alignment_summary(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
