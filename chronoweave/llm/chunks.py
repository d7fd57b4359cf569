"""Documents in packed chunks, and the sorted keys that chunks ask a hash-partitioned table for.

An operator that looks something up for every word of every text would shuffle a row for each word, there and back. Here
a chunk of about CHUNK_CHARS characters asks for each distinct key once: its keys, sorted, go to the buckets of the
key space as one compressed array each; the answers come back in the same order. A frequent key is asked for once by
each chunk, however often it occurs, so no bucket grows with a frequent word.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, text_of

CHUNK_CHARS = 8_000_000
#: Characters that a task packs at a time.
FLUSH_CHARS = 16_000_000


def squeeze(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, int]:
    """chunk, blob: documents by the hash of their id and text; and how many chunks there are. A null text is empty.

    Ids travel as strings: pandas would make floats of long integers beside a null.
    """
    rows = docs.select(docs[id_col].cast("string").alias("id"), text_of(docs[text_col]).alias("text"))
    n = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // chunk_chars))
    batch_bytes(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"chunk": list(held), "blob": [squeeze(pickle.dumps(x), 6) for x in held.values()]})

        for b in batches:
            for chunk, i, t in zip(b["chunk"], b["id"], b["text"], strict=True):
                ids, texts = held.setdefault(chunk, ([], []))
                ids.append(i)
                texts.append(t)
                size += len(t)
            if size > FLUSH_CHARS:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    packed = rows.select(chunk.alias("chunk"), "id", "text").mapInPandas(run, "chunk bigint, blob binary")
    return packed.repartition("chunk"), n


def unpack(blobs: pd.Series) -> tuple[list, list[str]]:
    ids, texts = [], []
    for b in blobs:
        i, t = pickle.loads(expand(b))
        ids += i
        texts += t
    return ids, texts


def bucket_edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets starts in the sorted 64-bit keys: buckets are equal ranges of the leading 32 bits."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def store_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte."""
    return squeeze(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def load_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def store_counts(counts: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def load_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)
