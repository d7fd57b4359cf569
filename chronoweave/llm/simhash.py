"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two documents are linked where at most three bits differ. Equal fingerprints are put
together first, so a group of copies is one row from then on, however large. Every distinct fingerprint then emits the
variants within half the radius: one bit where the half is rounded down (fingerprints of odd parity), two bits where
it is rounded up (even parity). Two fingerprints three bits apart have different parity, so one reaches two of the
three bits and the other the third, and they meet; fingerprints one or two bits apart meet within one bit of each.
Of any three differing bits two lie in the same 32-bit half, so variants in two bits flip both in one half.

Where variants collide, everything is linked to one fingerprint within one bit of the variant: all others are within
two, so the link is at most three bits long (it is verified), no pairs are listed and no link between components is
missed. A variant is met by at most 1,057 fingerprints, so no bucket grows with a group. Variants travel as sorted
arrays of differences, because a row each would cost several times the input; buckets are as many as
the number of variants asks for.

Nulls: a null text is an empty one, whose fingerprint is zero; a null id belongs to no component label but its row
stays. Empty texts are linked like any others. Very long texts are hashed whole, some shingles at a time. Rows that repeat
an id are separate rows with the same label if their texts are linked; among equal fingerprints the smallest id names the group.
Only the id and text columns are read, so no other column's name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import load_sorted, store_sorted
from .common import TEXT_BYTES, Tables, among, batch_bytes, release, trim
from .components import components

RADIUS = 3
SEED = 42
#: Variants in a bucket, on average: what one task sorts at a time.
BUCKET_VARIANTS = 2_000_000
#: Shingles hashed at a time, which bounds memory on very long texts.
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of all word shingles of the text, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _STEP):
        part = w[a : a + _STEP + words - 1]
        if len(part) <= words:
            h = [digest(b" ".join(part), SEED)]
        else:
            h = [digest(x, SEED) for x in map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))]
        bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long)."""
    batch_bytes(docs.sparkSession, TEXT_BYTES)

    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, words) for x in t], np.uint64).view(np.int64))
        trim()

    return docs.select(docs[id_col].alias("id"), F.pandas_udf(prints, "bigint")(docs[text_col]).alias("fp"))


_ONE = np.array([0, *(1 << i for i in range(64))], np.uint64)
_TWO = np.array([(1 << i) | (1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)], np.uint64)
_MIX, _UNMIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _emit(fps: np.ndarray, masks: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """bucket, by the leading 32 bits, mixed variants in order, the mask that made each."""
    mixed = (fps[:, None] ^ masks[None, :]).ravel()
    mixed *= _MIX
    order = np.argsort(mixed)
    mixed = mixed[order]
    order %= len(masks)
    mask = order.astype(np.uint16)
    del order
    first = ((np.arange(n, dtype=np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n) << np.uint64(32)  # of each bucket
    edges = np.r_[np.searchsorted(mixed, first), len(mixed)]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), mixed[edges[b] : edges[b + 1]], mask[edges[b] : edges[b + 1]]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most as many links as there are nodes, with the same components as the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's links. Variants in two bits are most of it, and few meet a hub: each row's are looked up by themselves."""
    near = pdf["near"].to_numpy(bool)
    own = pdf[near]
    key = np.concatenate([np.zeros(0, np.uint64), *map(load_sorted, own["variants"])])
    fp = (key * _UNMIX) ^ _ONE[np.frombuffer(b"".join(own["masks"]), np.uint16)]
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    hub_key, hub = key[first], fp[first]
    x, y = [fp], [np.repeat(hub, np.diff(np.r_[first, len(key)]))]
    for variants, masks in zip(pdf["variants"][~near], pdf["masks"][~near], strict=True) if len(hub_key) else ():
        far_key = load_sorted(variants)
        at = np.minimum(np.searchsorted(hub_key, far_key), len(hub_key) - 1)
        met = np.flatnonzero(hub_key[at] == far_key)
        x.append((far_key[met] * _UNMIX) ^ _TWO[np.frombuffer(masks, np.uint16)[met]])
        y.append(hub[at[met]])
    x, y = np.concatenate(x), np.concatenate(y)
    near_enough = (x != y) & (np.bitwise_count(x ^ y) <= RADIUS)
    x, y = _forest(x[near_enough], y[near_enough])
    trim()
    return pd.DataFrame({"src": x.view(np.int64), "dst": y.view(np.int64)})


def links(prints: DataFrame, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """prints (fp, distinct). Returns src, dst: links of at most three bits that connect all that such links connect."""
    spark = prints.sparkSession
    count = prints.count()
    n = max(1, -(-count * (len(_ONE) + len(_TWO) // 2) // bucket_variants))
    batch_bytes(spark, TEXT_BYTES)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2_000):
                fps = batch["fp"].to_numpy(np.int64)[a : a + 2_000].view(np.uint64)
                even = fps[np.bitwise_count(fps) % 2 == 0]
                for near, f, masks in ((True, fps, _ONE), (False, even, _TWO)):
                    rows = [(b, near, store_sorted(v), m.tobytes()) for b, v, m in _emit(f, masks, n)] if len(f) else []
                    if rows:
                        yield pd.DataFrame(rows, columns=["bucket", "near", "variants", "masks"])
                    rows = None
        trim()

    # a fingerprint makes hundreds of variants, so tasks follow their number and not that of the table's few files
    variants = prints.select("fp").repartition(n, "fp").mapInPandas(emit, "bucket bigint, near boolean, variants binary, masks binary")
    return variants.groupBy("bucket").applyInPandas(_meet, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp, component_id: the smallest id that links reach, for every row of docs."""
    tables = Tables(docs.sparkSession)
    rows = tables.put("rows", fingerprints(docs, id_col, text_col, words))
    prints = tables.put("prints", rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    member = components(links(prints)).withColumnsRenamed({"node": "fp", "component": "root"})
    prints = prints.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    label = prints.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = tables.put("label", prints.join(label, "root").select(F.col("fp").alias("l_fp"), "component_id"))
    return rows.join(label, rows["fp"] == F.col("l_fp")).select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one document of each group, that with the smallest id. Rows with a null id stay.

    Groups are what fingerprints within the radius and shingle sets of a similarity of 0.8 or more connect.
    Where rows share an id, one of them is kept. Columns of docs may have any names.
    """
    from .shingles import similar_documents

    tables = Tables(docs.sparkSession)
    found = tables.put("found", near_duplicates(docs, id_col, text_col, words).select("id", "component_id").where("id IS NOT NULL"))
    release(docs.sparkSession)  # of the variants
    links = found.select(F.col("id").alias("src"), F.col("component_id").alias("dst")).union(similar_documents(docs, id_col, text_col, words))
    out = tables.put("out", components(links).select(F.col("node").alias("id")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"))
    kept = among(rows, out, "left_anti")
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        rest = kept.where("id IS NULL")
        kept = kept.where("id IS NOT NULL").dropDuplicates(["id"]).unionByName(rest)
    return kept.select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
