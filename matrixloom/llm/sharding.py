"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id, row number), so equal texts lie side by side. A sample
that takes records in proportion to their size gives quantile boundaries, by which records are dealt into
many ranges; ranges that turn out overfull are sampled again and subdivided. Exact totals of the ranges
then give every record its exact place in the order, and a shard is an eighth of all bytes. A group of
equal texts stays in one shard unless it is large: a boundary that falls in a small group moves to its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, table

SHARDS = 8
#: Rows that a range should hold; the number of ranges; samples taken for each range.
RANGE_ROWS, RANGES, SAMPLES = 200_000, (32, 8192), 32
#: A range is overfull beyond so many times its share of rows or bytes; rounds of subdividing.
OVERFULL, ROUNDS = 4, 4
#: Groups of equal texts of at most this share of a shard's bytes are never parted.
WHOLE = 1 / 32
LEAST = -(1 << 63)


def _place(keys: np.ndarray):
    """Adds the range of each record: how many splitters are at or below its key."""
    split = keys.T.copy() if len(keys) else np.empty((3, 0), np.int64)

    def run(batches):
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("h", "order", "rid")]
            lo, hi = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, split.shape[1])
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                s = split[:, np.minimum(mid, split.shape[1] - 1)]
                below = (s[0] < key[0]) | (s[0] == key[0]) & ((s[1] < key[1]) | (s[1] == key[1]) & (s[2] <= key[2]))
                lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo.astype(np.int32))], names=[*batch.schema.names, "range"])

    return run


def _chosen(rate: Column) -> Column:
    """A coin that a record wins with the given chance, the same on every run."""
    return (F.pmod(F.xxhash64("h", "order", "rid", F.lit(77)), F.lit(1 << 40)) / float(1 << 40)) < rate


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    size is the text's UTF-8 bytes plus 1. A null text counts as empty (size 1, crc 0). Boundaries between shards
    lie at equal shares of all bytes, but for the rest of one record, or of a group of equal texts of at most
    WHOLE of a share, which is not parted; larger groups are. Repeated rows are records of their own, and texts of
    any length are read whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    records = scratch.keep(records.withColumn("order", F.coalesce("doc_id", F.lit(LEAST))).withColumn("rid", F.monotonically_increasing_id()), "records")
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = int(min(max(rows // RANGE_ROWS, RANGES[0]), RANGES[1]))

    def sample(frame: DataFrame, rate, ranges: int) -> list[tuple]:
        """Quantile boundaries of a sample of some SAMPLES * ranges keys, each at the start of its text's group."""
        got = sorted(r.h for r in frame.where(_chosen(rate)).select("h").collect())
        return [(got[i * len(got) // ranges], LEAST, LEAST) for i in range(1, ranges)] if got else []

    keys = sorted(set(sample(records, F.col("size") * (SAMPLES * wanted / max(total, 1)), wanted)))
    schema = "doc_id long, size long, text_crc32 long, h long, `order` long, rid long, range int"
    for turn in range(ROUNDS + 1):
        ranged = scratch.keep(records.mapInArrow(_place(np.array(keys, np.int64).reshape(-1, 3)), schema), f"ranged{turn}")
        sums = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect())  # a row for each range
        full = {r: max(b * wanted / max(total, 1), n * wanted / max(rows, 1)) for r, b, n in sums}
        full = {r: x for r, x in full.items() if x > OVERFULL}
        if not full or turn == ROUNDS:
            break
        # by row: overfull ranges hold many small records, or more bytes than sampling let expect
        most = {r: n for r, _, n in sums if r in full}
        rate = F.lit(0.0)
        for r, n in most.items():
            rate = F.when(F.col("range") == r, SAMPLES * 2 * full[r] / n).otherwise(rate)
        again = ranged.where(F.col("range").isin(list(full)))
        added = again.where(_chosen(rate)).select("range", "h", "order", "rid").collect()
        scratch.drop(f"ranged{turn}")
        for r, x in full.items():
            got = sorted(tuple(a)[1:] for a in added if a["range"] == r)
            parts = int(np.ceil(x))
            for key in [got[i * len(got) // parts] for i in range(1, parts)] if got else []:
                start = (key[0], LEAST, LEAST)
                keys.append(start if start not in keys else key)  # within a group only where it spans boundaries
        keys = sorted(set(keys))

    before, offsets = [0, 0], []
    for r, b, n in sums:
        offsets.append((r, before[0], before[1]))
        before = [before[0] + b, before[1] + n]
    offsets = spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")  # a row for each range
    inside = Window.partitionBy("range").orderBy("h", "order", "rid")
    placed = ranged.withColumn("row", F.row_number().over(inside) - 1).withColumn("cum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    group = Window.partitionBy("range", "h")
    small = F.sum("size").over(group) * shards <= F.lit(WHOLE * total)
    placed = placed.withColumn("from", F.when(small, F.min("cum").over(group)).otherwise(F.col("cum"))).join(F.broadcast(offsets), "range")
    at = F.floor((F.col("from") + F.col("bytes_before")).cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")).cast("int")
    placed = scratch.keep(placed.select("doc_id", "size", "text_crc32", F.least(at, F.lit(shards - 1)).alias("shard"), (F.col("row") + F.col("rows_before")).alias("place")), "placed")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    start = F.get(F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL: dict[str, str] = {}
