"""Token ids in binary files: canonical length-limited Huffman codes from global counts, decoded by table in blocks.

Texts are encoded once; the ids, compressed, wait in the shared folder until their counts over all documents are known. A file holds a range of documents in ascending order of id:

    "CWH1", then as little-endian unsigned 32-bit integers: documents, blocks, bytes of codes;
    for each document its number of ids (32 bits) and, signed 64 bits, its id (-2**63 for null);
    for each block of BLOCK ids, its length in bits (16 bits);
    the codes: each document's start on a byte, its blocks follow bit by bit.

Block lengths add up to bit offsets, so every block can be decoded alone, and all of a file's blocks are decoded side by
side with one table of 2**LIMIT entries. Files, and the codebook of code lengths, are binary values of Parquet tables in the
shared folder, as only Spark's writers reach every store.

Words between ASCII white space are encoded one by one, as the tokenizer drops white space.

Nulls: a null text is an empty one (its only id is the end id); null ids come first. Rows that repeat are each written;
among equal ids the order is that of the codes. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import os
import re
import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import expand, squeeze
from .common import batch_bytes, cut, shared_folder, text_of

END, LIMIT, BLOCK, FILE_IDS = 1, 16, 128, 4_000_000
_NULL = -(1 << 63)
#: Documents in a row while they are ids.
RUN = 512
#: Latin letters, of which a word is one pre-token; and punctuation that may follow, which is another.
_LATIN, _TAIL = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$", string.punctuation
#: Plain words that the model gets as one text.
JOIN = 5_000
#: Plain words whose ids a worker keeps from batch to batch: about 200 bytes each.
KNOWN = 250_000
_COMPOSED = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]*)")


class WordEncoder:
    """Ids of texts, equal to those of the tokenizers library for a tokenizer that drops white space.

    Each distinct word of a batch is encoded once: plain Latin words, apart from punctuation at their end, by the library with the
    same BPE model behind a plain split, thousands at a time, all others through its whole pipeline. The first KNOWN plain words
    are kept for later batches, until fewer than a quarter of a batch's words are among them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = sorted(ByteLevel.alphabet(), key=ord)
        plain = [b for b in range(256) if chr(b) in shown]  # these bytes stand for themselves, the others follow in order
        other = iter(c for c in shown if ord(c) > 255)
        self.bytes = {b: chr(b) if b in plain else next(other) for b in range(256)}
        self.known: dict[str, bytes] = {}
        self.joined = Tokenizer(self.model)
        self.joined.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith(self.model.end_of_word_suffix or "\0")]] = True

    def _latin(self, word: str) -> list[int]:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(shown)]

    def _encode_latins(self, words: list[str]) -> Iterator[bytes]:
        """Each word's ids, in four bytes each."""
        shown = {**self.bytes, 32: " "}
        for k in range(0, len(words), JOIN):
            own = words[k : k + JOIN]
            [got] = self.joined.encode_batch_fast([" ".join(own).encode().decode("latin-1").translate(shown)], add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) == len(own) and to[-1] == len(ids):
                data, to = ids.tobytes(), [0, *(4 * to).tolist()]
                yield from [data[i:j] for i, j in zip(to, to[1:])]
            else:  # a model without ends of words
                yield from [np.array(self._latin(w), np.uint32).tobytes() for w in own]

    def _latins(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct plain Latin words, and how many each has."""
        own = list(map(self.known.get, words))
        new = [k for k, x in enumerate(own) if x is None]
        if len(self.known) >= KNOWN and 4 * (len(words) - len(new)) < len(words):
            self.known.clear()
        for k, x in zip(new, self._encode_latins([words[k] for k in new]), strict=True):
            own[k] = x
            if len(self.known) < KNOWN:
                self.known[words[k]] = x
        return np.frombuffer(b"".join(own), np.uint32).astype(np.int64), np.fromiter(map(len, own), np.int64, len(own)) // 4

    def _any(self, word: str) -> list[int]:
        m = None if word.isascii() else _COMPOSED.fullmatch(unicodedata.normalize("NFC", word).lower())
        if m:
            return self._latin(m[1]) + (self.tokenizer.encode(m[2], add_special_tokens=False).ids if m[2] else [])
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        low = pc.utf8_lower(words)
        latin = pc.match_substring_regex(pc.ascii_rtrim(words, _TAIL), _LATIN)
        stem = pc.ascii_rtrim(low, _TAIL)
        # a stem and its tail each stand for themselves; any other word is a stem without a tail
        tail = pc.utf8_ltrim(pc.if_else(latin, low, ""), "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")
        stem, tail = pc.if_else(latin, stem, words).dictionary_encode(), tail.dictionary_encode()
        plain = pc.match_substring_regex(stem.dictionary, _LATIN)
        flat, size = self._latins(stem.dictionary.filter(plain).to_numpy(zero_copy_only=False).tolist())
        others = stem.dictionary.filter(pc.invert(plain)).to_pylist() + tail.dictionary.to_pylist()
        own = [self._any(w) if w else [] for w in others]
        flat = np.append(flat, np.array([i for x in own for i in x], np.int64))
        plain, n_stems = plain.to_numpy(zero_copy_only=False), len(stem.dictionary)
        order = np.append(np.argsort(~plain, kind="stable"), np.arange(n_stems, n_stems + len(tail.dictionary)))  # of stems and tails, as they stand in flat
        n = np.append(size, np.array([len(x) for x in own], np.int64))
        size, first = np.empty_like(n), np.empty_like(n)
        size[order], first[order] = n, np.cumsum(n) - n
        pair = np.stack([stem.indices.to_numpy(zero_copy_only=False), tail.indices.to_numpy(zero_copy_only=False) + n_stems], axis=1).astype(np.int64).ravel()
        n = size[pair]
        return flat[np.repeat(first[pair] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n.reshape(-1, 2).sum(axis=1)

    def runs(self, texts: pd.Series, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each run of `size` texts: its start, all ids of its texts with an end id each, and how many each has."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = pc.list_flatten(split).dictionary_encode()
        gc.disable()  # millions of small objects, none in a cycle
        try:
            own, n_own = self.words(words.dictionary)
        finally:
            gc.enable()
        flat, n_own = np.append(own, END).astype(np.uint32), np.append(n_own, 1)
        first = np.cumsum(n_own) - n_own
        codes = words.indices.to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))].astype(np.int64)
        for a in range(0, len(texts), size):
            z = min(a + size, len(texts))
            of_run = np.insert(codes[edges[a] : edges[z]], edges[a + 1 : z + 1] - edges[a], len(n_own) - 1)
            n = n_own[of_run]
            ids = flat[np.repeat(first[of_run] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            yield a, ids, np.add.reduceat(n, edges[a:z] - edges[a] + np.arange(z - a))

    def texts(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        parts = [(ids, n) for _, ids, n in self.runs(texts, max(1, len(texts)))]
        return parts[0] if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """Made once in a worker, which later tasks use again."""
    return WordEncoder(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than limit (package-merge); 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} ids need codes longer than {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        merged, is_leaf = merged[order], order < len(leaves)
        levels.append(is_leaf)
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[symbols[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in ascending order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LIMIT-bit window: the id at its head, and its code's length."""
    ids, used = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
    codes = canonical_codes(lengths)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        a = int(codes[s]) << (LIMIT - n)
        ids[a : a + (1 << (LIMIT - n))] = s
        used[a : a + (1 << (LIMIT - n))] = n
    return ids, used


def encode_documents(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Each document's codes, from a byte's start, and its blocks' lengths in bits."""
    size = lengths[ids].astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    before = np.cumsum(size) - size
    bit = before - before[first][doc]  # within the document
    bits = np.add.reduceat(size, first) if len(n) else size
    n_bytes = (bits + 7) // 8
    start = np.cumsum(n_bytes) - n_bytes
    at = start[doc] * 8 + bit
    window = codes[ids].astype(np.int64) << (24 - (at & 7) - size)
    out = np.zeros(int(n_bytes.sum()) + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(window >> (16 - 8 * k)) & 255, minlength=len(out))
    data = out.astype(np.uint8).tobytes()
    place = np.arange(len(ids)) - first[doc]
    block_starts = np.flatnonzero(place % BLOCK == 0)
    block_bits = np.add.reduceat(size, block_starts).astype("<u2") if len(ids) else np.zeros(0, "<u2")
    edge = np.searchsorted(block_starts, np.r_[first, len(ids)])
    return [data[a : a + b] for a, b in zip(start, n_bytes, strict=True)], [block_bits[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]


def build_file(doc_ids: list[int | None], n: list[int], payloads: list[bytes], blocks: list[bytes]) -> bytes:
    codes, marks = b"".join(payloads), b"".join(blocks)
    head = np.zeros(len(n), np.dtype([("n", "<u4"), ("id", "<i8")]))
    head["n"], head["id"] = n, [_NULL if i is None else i for i in doc_ids]
    return b"CWH1" + struct.pack("<III", len(n), len(marks) // 2, len(codes)) + head.tobytes() + marks + codes


def read_file(data: bytes, ids_of: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a file."""
    if data[:4] != b"CWH1":
        raise ValueError("not a token file")
    n_docs, n_blocks, n_codes = struct.unpack("<III", data[4:16])
    head = np.frombuffer(data, np.dtype([("n", "<u4"), ("id", "<i8")]), n_docs, 16)
    marks = np.frombuffer(data, "<u2", n_blocks, 16 + 12 * n_docs).astype(np.int64)
    if len(data) != 16 + 12 * n_docs + 2 * n_blocks + n_codes:
        raise ValueError("the file's length is not what its head says")
    codes = np.frombuffer(data + b"\0\0\0", np.uint8, offset=16 + 12 * n_docs + 2 * n_blocks).astype(np.uint32)
    n = head["n"].astype(np.int64)
    per_doc = -(-n // BLOCK)
    doc = np.repeat(np.arange(n_docs), per_doc)
    first_block = np.cumsum(per_doc) - per_doc
    before = np.cumsum(marks) - marks
    doc_bits = np.add.reduceat(marks, first_block) if n_docs else marks
    doc_bytes = (doc_bits + 7) // 8
    bit = (np.cumsum(doc_bytes) - doc_bytes)[doc] * 8 + before - before[first_block][doc]
    place = np.arange(n_blocks) - first_block[doc]
    count = np.minimum(BLOCK, n[doc] - place * BLOCK)
    target = (np.cumsum(n) - n)[doc] + place * BLOCK
    order = np.argsort(-count, kind="stable")
    bit, count, target = bit[order], count[order], target[order]
    ids = np.zeros(int(n.sum()), np.uint32)
    for step in range(BLOCK):
        live = int(np.searchsorted(-count, -step, side="left"))  # blocks with more ids than this
        if not live:
            break
        p = bit[:live]
        b = p >> 3
        window = ((codes[b] << np.uint32(16) | codes[b + 1] << np.uint32(8) | codes[b + 2]) >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        ids[target[:live] + step] = ids_of[window]
        p += used[window]
    return head["id"], n, ids


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids, n, tokens: documents in runs, with their numbers of ids and, compressed, the ids themselves."""
    batch_bytes(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        for b in batches:
            doc = [None if pd.isna(i) else int(i) for i in b["id"]]
            for a, ids, n in encoder.runs(b["text"], RUN):
                yield pd.DataFrame({"ids": [np.array(doc[a : a + len(n)], object)], "n": [n], "tokens": [squeeze(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())]})

    rows = docs.select(docs[id_col].cast("bigint").cast("string").alias("id"), text_of(docs[text_col]).alias("text"))
    return rows.mapInPandas(run, "ids array<bigint>, n array<bigint>, tokens binary")


def _tokens(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def count_ids(runs: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents, end ids included: as many rows as the vocabulary come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for data in (x for b in batches for x in b["tokens"]):
            own = np.bincount(_tokens(data), minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pd.DataFrame({"token": at, "n": total[at]})

    rows = runs.select("tokens").mapInPandas(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([END, *(r["token"] for r in rows)]), np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Writes folder/codebook and folder/files."""
    spark = docs.sparkSession
    runs = cut(tokenize(docs, tokenizer, id_col, text_col))
    batch_bytes(spark)
    counts = count_ids(runs)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")
    n_files = int(max(1, counts.sum() // file_ids))  # the driver and each task hold a bound for each file
    own = runs.select(F.explode("ids").alias("id"))
    bounds = sorted(set(own.approxQuantile("id", [k / n_files for k in range(1, n_files)], 0.1 / n_files))) if n_files > 1 else []

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, n, data in zip(b["ids"], b["n"], b["tokens"], strict=True):
                n = np.asarray(n, np.int64)
                coded, marks = encode_documents(_tokens(data), n, lengths, codes)
                where = np.searchsorted(bounds, np.array([_NULL if pd.isna(i) else i for i in ids], np.float64), side="left") if bounds else 0
                yield pd.DataFrame({"file": where, "id": [None if pd.isna(i) else str(int(i)) for i in ids], "n": n, "codes": coded, "marks": marks})

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, codes = [_NULL if i is None else int(i) for i in pdf["id"]], pdf["codes"].tolist()
        pdf = pdf.iloc[sorted(range(len(ids)), key=lambda r: (ids[r], codes[r]))]
        ids.sort()
        return pd.DataFrame({"file": [key[0]], "n_ids": [int(pdf["n"].sum())], "data": [build_file([None if i == _NULL else i for i in ids], pdf["n"].tolist(), pdf["codes"].tolist(), pdf["marks"].tolist())]})

    coded = runs.mapInPandas(encode, "file bigint, id string, n bigint, codes binary, marks binary")
    files = coded.groupBy("file").applyInPandas(build, "file bigint, n_ids bigint, data binary")
    files.write.option("compression", "uncompressed").parquet(f"{folder}/files")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document; with_ids: also ids array<bigint>."""
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first()["lengths"], np.uint8)
    files = spark.read.schema("file bigint, n_ids bigint, data binary").parquet(f"{folder}/files")
    batch_bytes(spark)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(lengths)
        for batch in batches:
            for file, data in zip(batch["file"], batch["data"], strict=True):
                doc, n, ids = read_file(data, *table)
                start = np.cumsum(n) - n
                raw = ids.astype("<u4").tobytes()
                out = pd.DataFrame({"file": file, "id": pd.array(doc, "Int64"), "inner": start, "n_tokens": n, "ids_crc32": [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(start, n, strict=True)]})
                out.loc[doc == _NULL, "id"] = pd.NA
                if with_ids:
                    out["ids"] = [ids[a : a + b].astype(np.int64) for a, b in zip(start, n, strict=True)]
                yield out

    rows = files.mapInPandas(decode, "file bigint, id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    offsets = files.select("file", before.alias("before"))
    out = rows.join(offsets, "file").withColumn("start", F.col("before") + F.col("inner"))
    return out.select("id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder).withColumnRenamed("id", "doc_id")
