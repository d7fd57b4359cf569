"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_folder  # noqa: F401  the operators take them from here

#: Words of the corpus contracts: runs without space and without the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch: what a Python worker gets of whole texts at a time, one text at least. TEXT_BYTES is for operators that
#: look at each text by itself: nothing is shared in a batch there, and task and worker each hold a batch, and what comes of it, several times.
BATCH_BYTES, TEXT_BYTES = 8 << 20, 2 << 20


def batch_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes. Of several lazy plans the one built last sets the bound for all; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nobody holds any more, which it else does when the driver's heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Parquet tables in the shared folder: each is computed once, lineage ends there, and what is read no more can go.

    A lost executor costs the tasks it was running, as the files outlive it. Shuffle files of the plan that wrote a table go when it's written.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
        """df, written under this name, with these settings, and read back."""
        settings = {self.CLEANUP: "true", **(settings or {})}
        before = {key: self.spark.conf.get(key, None) for key in settings}
        try:
            for key, value in settings.items():
                self.spark.conf.set(key, value)
            df.write.parquet(f"{self.folder}/{name}")
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Removes the tables of these names; no plan that is still to run may read them."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids whose hashes may be broadcast: 16 MB.
BROADCAST_IDS = 2_000_000


def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows (with a column id) that are, left_semi, or aren't, left_anti, among ids (id, written).

    Counted first: few ids are broadcast, the hash of each, and rows stay where they are; more ids are joined by a shuffle.
    """
    if ids.count() > BROADCAST_IDS:
        return rows.join(ids, "id", how)
    seen = F.broadcast(ids.select(F.xxhash64("id").alias("_seen")).distinct())
    near = rows.join(seen, F.xxhash64(rows["id"]) == F.col("_seen"), "left_semi").join(ids, "id", "left_semi")
    if how == "left_semi":
        return near
    own = rows.join(seen, F.xxhash64(rows["id"]) == F.col("_seen"), "left_anti")
    return own.unionByName(rows.join(seen, F.xxhash64(rows["id"]) == F.col("_seen"), "left_semi").join(ids, "id", "left_anti"))


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on, and later tasks use others of them."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
