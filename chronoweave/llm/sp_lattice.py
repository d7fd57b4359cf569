"""SentencePiece encoding and decoding on a relational lattice.

Texts are cut into words: a line break, or a run of spaces with what follows up to the next space or line break; and words into
parts, where two neighbouring characters are neighbours in no piece of the table, so that no piece can span the cut and the best path of a
word is that of its parts. Every distinct part of the corpus is encoded once. Its substrings of up to the longest piece's
length are exploded and joined by equality with the piece table; the edges found are grouped by their end and then by part, and folded
from left to right with Spark's aggregate(): each position keeps its best path, the largest sum of piece scores (ties: the
shorter last piece). Parts of any length are encoded whole: beyond SEGMENT characters their substrings are exploded by
segments, each with the characters before it that a piece can reach back to, and the fold carries the last scores across.

A task keeps its documents as numbers of parts, by chunks of about CHUNK_CHARS characters, and asks the table of parts, which is
partitioned by hash, once for each distinct part of a chunk: a row for each bucket that it asks, so never more rows than parts that
are asked for. A frequent part is asked for once by each chunk. A chunk's documents are those that its task reads one after
another; should a repeated task read others, the answers don't fit their checksum and the job ends with an error.

A character without a piece is an edge for its UTF-8 byte pieces, scored below every piece. As in the library, a space is put
before a text that isn't empty, and decoding takes it off; line breaks and literal U+2581 are bytes, so decoding gives
back every text exactly.

The path is the best by score. The installed model was made by merging pairs, and the library replays its merges, so
its ids for a word can differ; see README.md for how often. The piece table is the model's, whose size bounds what is broadcast.

Nulls: a null text is an empty one, with no ids; a null id stays. Rows that repeat are each encoded, and ties between rows have no
effect. Very long texts and words are encoded whole; one text is held by one task at a time. An empty table gives an empty
result. Only the id and text columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import expand, squeeze
from .common import TEXT_BYTES, batch_bytes, shuffle_parts, text_of, trim

#: Characters of the documents that a Python worker holds at a time, characters for each bucket of the table of parts, and those of a segment.
CHUNK_CHARS, BUCKET_CHARS, SEGMENT = 3_000_000, 6_000_000, 256
_SPACE = "▁"
_SPLIT = re.compile(r"\n| *[^ \n]+| +")
#: Below the sum of any path of real pieces: of two paths the one with fewer unknown characters wins.
_UNKNOWN = -1e12
#: Bits of a packed edge below the piece's length.
_LOW = 32


def words_of(text: str) -> list[str]:
    """The text's words with a space before the first; joined they are the text with that space."""
    return _SPLIT.findall(" " + text) if text else []


class Pieces:
    """The model's pieces: texts with plain spaces, ids, scores; the ids of the 256 bytes; and which characters are neighbours in a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rows, self.bytes, self.text = [], [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(_SPACE, " ").encode())
                self.rows.append((piece.replace(_SPACE, " "), i, float(model.get_score(i))))
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.neighbours = np.array(sorted({ord(a) << 21 | ord(b) for p, _, _ in self.rows for a, b in zip(p, p[1:], strict=False)}), np.int64)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.rows, columns=["piece", "id", "score"]), "piece string, id int, score double")

    def reach(self, spark: SparkSession, tail: int) -> DataFrame:
        """The last `tail` characters of the pieces that have so many, and the length of the longest piece with them."""
        longest: dict[str, int] = {}
        for p, _, _ in self.rows:
            if len(p) >= tail:
                longest[p[-tail:]] = max(longest.get(p[-tail:], 0), len(p))
        return spark.createDataFrame(pd.DataFrame(list(longest.items()), columns=["tail", "reach"]), "tail string, reach int")

    def parts(self, words: list[str], block: int = 16_384) -> tuple[list[str], np.ndarray]:
        """The parts of all words, one after another, and how many each word has; `block` words are looked at together."""
        parts, counts = [], [np.zeros(0, np.int64)]
        for k in range(0, len(words), block):
            own = words[k : k + block]
            text = "".join(own)
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            pair = code[:-1] << 21 | code[1:]
            at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
            begins = np.r_[True, self.neighbours[at] != pair]
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            begins[ends[:-1]] = True
            start = np.flatnonzero(begins)
            counts.append(np.diff(np.searchsorted(start, np.r_[0, ends])))
            bounds = [*start.tolist(), len(text)]
            parts += [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return parts, np.concatenate(counts)

    def expand(self, path: list[int]) -> list[int]:
        """Ids of a path in which characters without a piece are -1 - codepoint."""
        return [j for i in path for j in ([i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")])]

    def decode(self, ids) -> str:
        return b"".join([self.text[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def best_paths(parts: DataFrame, pieces: Pieces, *by: str) -> DataFrame:
    """parts (by, base, skip, part), hash-partitioned by one of `by`, which tell parts apart: a segment of a part, the characters of the part
    before it, and how many characters in front belong to the segment before.

    Returns by, back: for each position of the part, after one for its begin, the edge that the best path comes by, as `came_by` reads it.
    """
    spark, tail = parts.sparkSession, 4
    ends = parts.withColumn("b", F.explode(F.sequence(F.col("skip") + 1, F.length("part"))))
    ends = ends.withColumn("tail", F.substring("part", F.greatest(F.lit(1), F.col("b") - (tail - 1)), F.least(F.lit(tail), "b")))
    ends = ends.join(F.broadcast(pieces.reach(spark, tail)), "tail", "left")
    spans = ends.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(tail - 1)), "b"))))
    spans = spans.withColumn("piece", F.substring("part", F.col("b") - F.col("n") + 1, F.col("n")))
    edges = spans.join(F.broadcast(pieces.table(spark)), "piece", "left").where(F.col("id").isNotNull() | (F.col("n") == 1))
    came = F.shiftleft((F.lit(pieces.longest) - F.col("n")).cast("bigint"), _LOW) + F.coalesce("id", -1 - F.ascii("piece")).cast("bigint")
    edge = F.struct("n", F.coalesce("score", F.lit(_UNKNOWN)).alias("score"), came.alias("came"))
    edges = edges.select(*by, (F.col("base") + F.col("b") - F.col("skip")).alias("at"), edge.alias("edge"))
    lattice = edges.groupBy(*by, "at").agg(F.collect_list("edge").alias("edges")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "edges"))).alias("ends"))
    ends = F.col("ends.edges")

    def step(done: Column, edges: Column) -> Column:  # of equal sums the shorter piece has the larger `came`
        paths = F.transform(edges, lambda e: F.struct((F.element_at(done, -e["n"])["sum"] + e["score"]).alias("sum"), e["came"].alias("came")))
        return F.concat(done, F.array(F.array_max(paths)))

    def segment(done: Column, k: Column) -> Column:  # done: arrays of positions; the last one's end is all that pieces reach back to
        last = F.element_at(done, -1)
        begin = F.slice(last, F.greatest(F.lit(1), F.size(last) - pieces.longest + 1), F.lit(pieces.longest))
        own = F.aggregate(F.slice(ends, k * SEGMENT + 1, F.lit(SEGMENT)), begin, step)
        return F.concat(done, F.array(own))

    start = "array(struct(0.0D as sum, 0L as came))"
    short = F.transform(F.aggregate(ends, F.expr(start), step), lambda x: x["came"])
    many = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("ends") - 1) / SEGMENT).cast("int")), F.expr(f"array({start})"), segment)
    # each segment's array begins with the end of the one before
    long = F.flatten(F.transform(many, lambda own, k: F.transform(F.when(k == 0, own).otherwise(F.slice(own, F.least(F.lit(pieces.longest), (k - 1) * SEGMENT + 1) + 1, F.lit(SEGMENT))), lambda x: x["came"])))
    return lattice.select(*by, F.when(F.size("ends") <= SEGMENT, short).otherwise(long).alias("back"))


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] of them, then the same for 1, and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def walk_back(back: np.ndarray, n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths of parts whose positions' edges stand one after another in `back`, n for each part. Returns ids, and how many each part has."""
    begin = np.cumsum(n) - n
    at, part, found = begin + n - 1, np.arange(len(n)), []
    size = np.zeros(len(n), np.int64)
    while len(part):
        go = at > begin[part]
        at, part = at[go], part[go]
        found.append((part, ((back[at] & 0xFFFFFFFF).astype(np.uint32).view(np.int32))))
        size[part] += 1
        at = at - (longest - ((back[at] - found[-1][1]) >> _LOW))
    ids = np.empty(int(size.sum()), np.int32)
    ends = np.cumsum(size)
    for k, (part, own) in enumerate(found):
        ids[ends[part] - 1 - k] = own
    return ids, size


def _hashed(parts: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in parts), np.uint64, len(parts))


def _store(numbers: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _load(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _numbered(ids: list, codes: list[np.ndarray], words: list[str], pieces: Pieces) -> bytes:
    """A chunk: its distinct parts, the more frequent ones first; and its documents' ids, lengths in parts and parts by number."""
    flat = np.concatenate([np.zeros(0, np.int32), *codes])
    parts, n = pieces.parts(words)
    number: dict[str, int] = {}
    own = np.fromiter((number.setdefault(w, len(number)) for w in parts), np.int32, len(parts))
    flat_n = n[flat]
    sizes = np.diff(np.r_[0, np.cumsum(flat_n)][np.r_[0, np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))]])
    flat = own[ragged((np.cumsum(n) - n)[flat], flat_n)]
    often = np.log2(np.maximum(1, np.bincount(flat, minlength=len(number)))).astype(np.int32)
    asked = sorted(number, key=lambda w: (-often[number[w]], w))
    rank = np.empty(len(asked), np.int32)
    rank[np.fromiter(map(number.__getitem__, asked), np.int64, len(asked))] = np.arange(len(asked), dtype=np.int32)
    return pickle.dumps((squeeze(pickle.dumps(asked)), squeeze(pickle.dumps((ids, sizes.astype(np.int32)))), _store(rank[flat])))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", *, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """id, ids array<int>, exact (the ids decode to the text), for every row of docs."""
    spark, pieces = docs.sparkSession, Pieces(model)
    batch_bytes(spark, TEXT_BYTES)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        ids, codes, known, size = [], [], {}, 0
        for b in batches:
            for i, t in zip(b["id"], b["text"], strict=True):
                codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int32))
                ids.append(i)
                size += len(t)
                if size >= chunk_chars:
                    words, known = list(known), {}
                    yield pd.DataFrame({"chunk": [chunk], "blob": [_numbered(ids, codes, words, pieces)]})
                    ids, codes, words, size, chunk = [], [], [], 0, chunk + 1
                    trim()
        if ids:
            yield pd.DataFrame({"chunk": [chunk], "blob": [_numbered(ids, codes, list(known), pieces)]})
        trim()

    rows = docs.select(docs[id_col].cast("string").alias("id"), text_of(docs[text_col]).alias("text"))
    spread = max(shuffle_parts(spark), -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_chars))
    chunks = rows.mapInPandas(number, "chunk bigint, blob binary").repartition("chunk")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, x in zip(batch["chunk"], batch["blob"], strict=True):
                asked = pickle.loads(expand(pickle.loads(x)[0]))
                hashes = _hashed(asked)
                order = np.argsort(hashes, kind="stable")
                bucket = ((hashes[order] >> np.uint64(32)) * np.uint64(spread) >> np.uint64(32)).astype(np.int64)
                asked, edge = [asked[i] for i in order.tolist()], np.searchsorted(bucket, np.arange(spread + 1))
                rows = [(b, chunk, squeeze(pickle.dumps(asked[edge[b] : edge[b + 1]]))) for b in np.flatnonzero(np.diff(edge)).tolist()]
                asked = hashes = order = bucket = None
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "asked"])
                rows = None
                trim()

    def distinct(blobs) -> list[str]:
        return sorted({w for x in blobs for w in pickle.loads(expand(x))})

    def segments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, before = [], pieces.longest - 1
        for k, w in enumerate(distinct(pdf["asked"])):
            if len(w) <= SEGMENT:
                rows.append((k, 0, 0, w))
            else:
                rows += [(k, a, min(a, before), w[max(0, a - before) : a + SEGMENT]) for a in range(0, len(w), SEGMENT)]
        out = pd.DataFrame(rows, columns=["k", "base", "skip", "part"])
        del rows
        trim()
        return out.assign(bucket=key[0])[["bucket", "k", "base", "skip", "part"]]

    def answer(asked: pa.Table, paths: pa.Table) -> pa.Table:
        blobs, order = asked["asked"].to_pylist(), np.argsort(paths["k"].to_numpy())
        words = distinct(blobs)
        lists = paths["back"].combine_chunks().take(pa.array(order))
        edges = np.asarray(lists.offsets)
        ids, size = walk_back(lists.values.to_numpy(zero_copy_only=False), np.diff(edges), pieces.longest)
        if (ids < 0).any():
            own = [pieces.expand(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1])]
            ids, size = np.array([i for x in own for i in x], np.int32), np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(size) - size
        texts = [pieces.text[i] for i in ids.tolist()]
        exact = np.array([b"".join(texts[a : a + z]) == w.encode("utf-8", "surrogatepass") for a, z, w in zip(first.tolist(), size.tolist(), words, strict=True)], np.uint8)
        place, rows = {w: i for i, w in enumerate(words)}, []
        for x in blobs:
            own = pickle.loads(expand(x))
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            check = int(np.bitwise_xor.reduce(_hashed(own)))
            rows.append(pickle.dumps((check, squeeze(pickle.dumps((size[at].astype(np.int32), exact[at]))), _store(ids[ragged(first[at], size[at])]))))
        trim()
        return pa.table({"chunk": asked["chunk"].combine_chunks(), "bucket": asked["bucket"].combine_chunks(), "paths": pa.array(rows, pa.binary())})

    def encode(coded: pa.Table, answers: pa.Table) -> pa.Table:
        asked, docs, codes = pickle.loads(coded["blob"][0].as_py())
        (ids, n_parts), codes, hashes = pickle.loads(expand(docs)), _load(codes), _hashed(pickle.loads(expand(asked)))
        blobs = answers["paths"].to_pylist()
        got = [pickle.loads(blobs[i]) for i in np.argsort(answers["bucket"].to_numpy()).tolist()]
        meta = [pickle.loads(expand(m)) for _, m, _ in got]
        n = np.concatenate([np.zeros(0, np.int64), *(m[0] for m in meta)])
        check = int(np.bitwise_xor.reduce(hashes)) if len(hashes) else 0
        for c, *_ in got:
            check ^= c
        if len(coded) != 1 or len(n) != len(hashes) or check:
            raise RuntimeError("a chunk was read again with other documents; write docs to a table first")
        flat = np.concatenate([np.zeros(0, np.int32), *(_load(f) for _, _, f in got)])
        order, begin = np.argsort(hashes, kind="stable"), np.cumsum(n) - n
        first, size, bad = np.empty_like(n), np.empty_like(n), np.empty_like(n)
        first[order], size[order], bad[order] = begin, n, 1 - np.concatenate([np.zeros(0, np.int64), *(m[1] for m in meta)])
        batches, ends = [], np.cumsum(n_parts, dtype=np.int64)
        cuts = sorted({0, len(ids), *np.searchsorted(ends, np.arange(0, int(ends[-1]), 200_000)).tolist()})
        for a, b in zip(cuts, cuts[1:], strict=False):
            bounds = np.r_[0, ends[a:b] - (ends[a - 1] if a else 0)]
            c = codes[ends[a] - n_parts[a] : ends[b - 1]]
            total, wrong = np.r_[0, np.cumsum(size[c])][bounds], np.r_[0, np.cumsum(bad[c])][bounds]
            values = pa.array(flat[ragged(first[c], size[c])])
            batches.append(pa.record_batch({"id": pa.array(ids[a:b], pa.string()), "ids": pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), values), "exact": pa.array(np.diff(wrong) == 0)}))
        trim()
        return pa.Table.from_batches(batches)

    asked = chunks.mapInPandas(ask, "bucket bigint, chunk bigint, asked binary").repartition(spread, "bucket")
    parts = asked.groupBy("bucket").applyInPandas(segments, "bucket bigint, k int, base int, skip int, part string").repartition(spread, "bucket")
    paths = best_paths(parts, pieces, "k", "bucket")
    answers = asked.groupBy("bucket").cogroup(paths.groupBy("bucket")).applyInArrow(answer, "chunk bigint, bucket bigint, paths binary")
    encoded = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(encode, "id string, ids array<int>, exact boolean")
    return encoded.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def decode_documents(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """encoded with `text`, the ids' text; null for null ids. A column `text` that encoded has gives way."""
    pieces = Pieces(model)
    batch_bytes(encoded.sparkSession)
    decode = F.pandas_udf(lambda batch: pd.Series([None if x is None else pieces.decode(x) for x in batch], dtype=object), "string")
    return encoded.withColumn("text", decode(encoded[ids_col]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8(spark, sf_dir: str) -> DataFrame:
    encoded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"), "ids", "exact")
