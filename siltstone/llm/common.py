"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None
_collected = 0.0
#: rows of one key are dealt to so many tasks where keys may be hot
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    global _own_folder
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="siltstone-")
    return _own_folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    This cuts lineage so that a lost executor costs one step only, and it freezes values that a recomputation might
    not repeat. Later readers prune its columns. The driver's JVM is asked to collect its garbage (every three seconds
    at most), so that shuffle files of finished steps are removed while later ones write their own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    global _collected
    if time.monotonic() - _collected > 3:
        spark.sparkContext._jvm.System.gc()
        trim()
        _collected = time.monotonic()
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Delete tables that keep() wrote and that no later step reads."""
    for one in kept:
        spark = one.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one._kept_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the memory of a Python worker: an Arrow batch holds `rows` texts and about `size` bytes at most."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if int(spark.conf.get(key).rstrip("b")) > most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that Python objects and arrays no longer use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def frees(f):
    """For generators that a Python worker runs over batches: the worker outlives the task, so what the task's arrays
    took goes back to the system when it ends."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            trim()

    return run


class Bitmap:
    """A bit for each key at the key modulo `size`, as a table of at most 4,096 parts (part, bits) of 4 KB each."""

    def __init__(self, parts: DataFrame, size: int):
        self.parts, self.size = parts, size

    def bytes(self) -> bytes:
        """All parts in one, at most 16 MB."""
        out = np.zeros(self.size // 8, np.uint8)
        for r in self.parts.collect():
            out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
        return out.tobytes()


def bitmap_of(wanted: DataFrame, key: Column) -> Bitmap:
    """The bitmap of the keys (bigints without nulls): 128 KB to 16 MB, whatever the input."""
    size = 1 << min(27, max(20, (16 * wanted.count()).bit_length()))
    place = wanted.select(F.pmod(key, F.lit(size)).alias("place"))
    parts = place.groupBy(F.expr("cast(place div 32768 as int)").alias("part")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    return Bitmap(keep(parts, "bitmap"), size)


def hits(keys: np.ndarray, bitmap: bytes) -> np.ndarray:
    """Which keys have their bit set."""
    place = keys & np.int64(8 * len(bitmap) - 1)
    return np.frombuffer(bitmap, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """df's columns by their quoted names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def sift(df: DataFrame, key: Column, bitmap: Bitmap, hit: bool = True) -> DataFrame:
    """Rows of df whose key has its bit set (or not): what a join on that key needs, and a few more. Nothing is shuffled.

    The map's parts, 16 MB at most, are broadcast and met by a hash join on the part's number.
    """
    at, part, bits = (fresh(df, x) for x in ("_at", "_part", "_bits"))
    own = columns(df)
    placed = df.withColumn(at, F.pmod(key, F.lit(bitmap.size)))
    parts = F.broadcast(bitmap.parts.toDF(part, bits))
    met = placed.join(parts, F.expr(f"cast({at} div 32768 as int)") == F.col(part), "inner" if hit else "left")
    bit = F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast({at} % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1")
    return met.where(F.coalesce(bit, F.lit(0)) == int(hit)).select(*own)


def near(df: DataFrame, found: DataFrame, keys: list[str], salt: str | None = None) -> DataFrame:
    """The inner join of df with found, of which only the rows that found's keys may meet are shuffled.

    With a salt (a column of df) the rows of one key are dealt to SALTS tasks, and found is repeated there.
    """
    key = F.xxhash64(*keys)
    some = sift(df, key, bitmap_of(found, key))
    if salt is None:
        return some.join(found.hint("merge"), keys)
    some = some.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    again = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return some.join(again.hint("merge"), [*keys, "_salt"]).drop("_salt")


def without(df: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """df without the rows whose key (null or not) is in bad's only column: an anti join that shuffles hardly more than it drops."""
    name = fresh(df, "_key")
    own, keyed = columns(df), df.withColumn(name, key)
    bad = bad.toDF("_bad").distinct()
    bitmap = bitmap_of(bad, F.xxhash64("_bad"))
    some = sift(keyed, F.xxhash64(name), bitmap)
    turn = fresh(some, "_turn")
    # rows of one key are dealt to SALTS tasks
    some = some.withColumn(turn, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    again = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = some.join(again.hint("merge"), some[name].eqNullSafe(again["_bad"]) & (some[turn] == again["_salt"]), "left_anti")
    return sift(keyed, F.xxhash64(name), bitmap, hit=False).select(*own).unionByName(left.select(*own))
