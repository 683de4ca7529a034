"""Helpers shared by the training-data operators: words, hashes, scratch tables."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    h = (h ^ (h >> U64(30))) * MIX1
    h = (h ^ (h >> U64(27))) * MIX2
    return h ^ (h >> U64(31))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers derived from a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def gram_hashes(h: np.ndarray, k: int, seed: int = 17) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (empty when there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for i, m in enumerate(odd_multipliers(k, seed)):
        out += h[i : i + n] * m
    return mix(out)


#: Bytes of texts that a worker turns into Python objects at once; Spark's own batches are of up to 64 MB.
PART_BYTES = 4 << 20


def release() -> None:
    """Hands freed memory back to the system, which a process that goes on to other work would hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def parts(batches, limit: int = PART_BYTES):
    """The batches in parts of some `limit` bytes of strings and binaries, of one row at least; empty batches go."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        a = 0
        while a < batch.num_rows:
            b = max(int(np.searchsorted(end, (end[a - 1] if a else 0) + limit, side="right")), a + 1)
            yield batch.slice(a, b - a)
            a = b
    release()


def binary(column: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes without copying characters."""
    return column.cast(pa.binary())


#: str.split() on bytes uses exactly the separators \x20 and \x09-\x0D of the word rule [^\x20\x09-\x0D]+.
def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class Scratch:
    """Written tables in the folder that the cluster names in spark.checkpoint.dir.

    Tables cut lineage and survive lost executors. ``drop`` deletes one when nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the map that `only` broadcasts (1 MB at most, whatever the number of ids).
MAP_BITS = 1 << 23


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose `column` (a long) is among the distinct `column` of ids; a semi-join that first sieves df.

    A bitmap of fixed size over hashed ids, at most MAP_BITS / 64 rows by construction, is broadcast and
    drops most other rows before wide columns are shuffled. The exact semi-join follows.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(MAP_BITS))
    bit = lambda s: F.expr(f"shiftleft(1L, cast({s} & 63 as int))")
    words = ids.select(slot.alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(bit("__slot")).alias("__bits"))
    sieved = df.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(words), "__word")
    sieved = sieved.where(F.col("__bits").bitwiseAND(bit("__slot")) != 0).select(*df.columns)
    return sieved.join(ids.select(column).distinct(), column).select(*df.columns)  # the optimiser would move a semi-join below the sieve
