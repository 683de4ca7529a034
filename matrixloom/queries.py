"""One query per operator over the given tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import DTYPES, convert, promotion
from .operators import names, partition
from .operators.matrix import CsrFrame, DenseFrame, EntryFrame, Matrix, canonical_rows, duplicate_coordinates, index_faults, renumber
from .operators.scratch import shared_folder
from .plans.output import OutputSpec
from .plans.plan import Plan, compile, planned, source_rows
from .plans.stats import request_stats
from .sources.container import Dataset, read_container, register, unflatten, write_container
from .sources.store import open_store, write

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- matrices over the tables ----------------------------------------------------------------


def embeddings(spark: SparkSession, sf: str) -> DenseFrame:
    frame = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("row"), F.col("embedding").alias("values"))
    return DenseFrame(frame, frame.agg(F.max("row")).first()[0] + 1, 64, DTYPES["f32"])


def entries(spark: SparkSession, sf: str, cols: int | None = None) -> DataFrame:
    line = table(spark, sf, "lineitem")
    col = F.col("l_partkey") if cols is None else F.pmod("l_partkey", F.lit(cols))
    return line.select(F.col("l_orderkey").alias("row"), col.cast("int").alias("col"), F.col("l_quantity").alias("value"))


def quantities(spark: SparkSession, sf: str, cols: int | None = None) -> EntryFrame:
    """Order x part quantities as entries."""
    coo = entries(spark, sf, cols)
    top = coo.agg(F.max("row"), F.max("col")).first()
    return EntryFrame(coo, top[0] + 1, cols or top[1] + 1, DTYPES["f64"])


def sizes(spark: SparkSession, sf: str) -> DenseFrame:
    part = table(spark, sf, "part")
    size = F.col("p_size")
    values = F.array((size - 25).cast("short"), size.cast("short"), (-size).cast("short"))
    return DenseFrame(part.select(F.col("p_partkey").alias("row"), values.alias("values")), part.agg(F.max("p_partkey")).first()[0] + 1, 3, DTYPES["i16"])


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf: str, name: str, matrix: Callable[[], Matrix], **knobs) -> str:
    """Folder of a matrix over a folder's tables, written on first use in a session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(spark, matrix(), path, **knobs).close()
        _STORED[key] = path
    return _STORED[key]


def source(spark: SparkSession, sf: str, name: str) -> Dataset:
    """A registered store: vectors, quantities of parts modulo 64 or 3 (sparse), sizes of parts."""
    build = {
        "vectors": lambda: embeddings(spark, sf),
        "quantities64": lambda: quantities(spark, sf, 64).to_csr(),
        "quantities3": lambda: quantities(spark, sf, 3).to_csr(),
        "sizes": lambda: sizes(spark, sf),
    }
    return register(spark, stored(spark, sf, name, build[name], block_policy="cells", block_cells=16))


def asked(spark: SparkSession, n: int, row) -> DataFrame:
    """A request of n rows; row is a column over pos."""
    return spark.range(n).select(F.col("id").alias("pos"), row(F.col("id")).alias("row"))


def cells(matrix) -> DataFrame:
    return matrix.coo().select(F.col("row").cast("long").alias("pos"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def wide(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("pos").cast("long").alias("pos"), F.posexplode("values").alias("col", "value")).withColumn("value", F.col("value").cast("double"))


EMB = "emb AS (SELECT vec_id AS row, CAST(i AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i))"
QTY = "qty AS (SELECT l_orderkey AS row, CAST(l_partkey AS INTEGER) AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
QTY64 = "qty64 AS (SELECT l_orderkey AS row, CAST(l_partkey % 64 AS INTEGER) AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
NE, NO = "(SELECT max(vec_id) + 1 FROM embeddings)", "(SELECT max(l_orderkey) + 1 FROM lineitem)"


# --- batch loading ---------------------------------------------------------------------------


@query(f"""
WITH {QTY64}, req AS (SELECT p AS pos, p % 2 AS source_id, CASE WHEN p % 2 = 0 THEN (p * 37) % {NE} ELSE (p * 7919) % {NO} END AS row FROM range({NO}) t(p)),
fm AS (SELECT CAST(c AS INTEGER) AS c, (c + 3) % 12 AS o FROM range(12) t(c) WHERE c % 3 <> 0)
SELECT CAST(pos AS BIGINT) AS pos, CAST(pos // 256 AS BIGINT) AS batch_id, CAST(outc.o AS INTEGER) AS col, CAST(CASE
  WHEN source_id = 0 THEN CASE WHEN outc.o < 10 THEN e.embedding[2 * outc.o + 1] ELSE -1 END
  WHEN fm.c IS NULL THEN -1 ELSE coalesce(q.value, 0) END AS DOUBLE) AS value
FROM req CROSS JOIN range(12) outc(o) LEFT JOIN embeddings e ON source_id = 0 AND e.vec_id = req.row
LEFT JOIN fm ON source_id = 1 AND fm.o = outc.o LEFT JOIN qty64 q ON source_id = 1 AND q.row = req.row AND q.col = fm.c""")
def flagship_batch_load(spark: SparkSession, sf: str) -> DataFrame:
    """Registered stores, a compiled plan: interleaved rows of a dense and a sparse source, columns mapped, gaps filled, in batches of 256."""
    dense = source(spark, sf, "vectors").with_feature_map([c // 2 if c % 2 == 0 and c < 20 else None for c in range(64)])
    sparse = source(spark, sf, "quantities64").with_feature_map([(c + 3) % 12 if c < 12 and c % 3 else None for c in range(64)])
    p = np.arange(sparse.n_rows)
    rows = np.where(p % 2 == 0, p * 37 % dense.n_rows, p * 7919 % sparse.n_rows)
    plan = compile([dense, sparse], np.stack([p % 2, rows], axis=1), output=OutputSpec(12, "f64", fill=-1), batch_size=256)
    return wide(plan.frame()).withColumn("batch_id", F.expr("pos div 256"))


@query(f"""
WITH q AS (SELECT l_orderkey AS row, l_partkey % 3 AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), np AS (SELECT max(p_partkey) + 1 AS n FROM part),
req AS (SELECT p AS pos, CASE WHEN p % 3 = 1 THEN 1 ELSE 0 END AS s, CASE WHEN p % 3 = 1 THEN (p * 7919) % {NO} ELSE (p * 31) % np.n END AS row FROM range({NO}) t(p), np)
SELECT CAST(pos AS BIGINT) AS pos, CAST(o AS INTEGER) AS col, CAST(CASE WHEN s = 0 THEN CASE o WHEN 0 THEN p_size - 25 WHEN 1 THEN p_size ELSE -p_size END ELSE coalesce(q.value, 0) END AS DOUBLE) AS value
FROM req CROSS JOIN range(3) c(o) LEFT JOIN part ON s = 0 AND p_partkey = req.row LEFT JOIN q ON s = 1 AND q.row = req.row AND q.col = c.o
WHERE s = 1 OR p_partkey IS NOT NULL""")
def multi_source_interleave(spark: SparkSession, sf: str) -> DataFrame:
    """The request is a table; nothing of it comes to the driver."""
    dense, sparse = source(spark, sf, "sizes"), source(spark, sf, "quantities3")
    pos = F.col("id")
    request = spark.range(sparse.n_rows).select(pos.alias("pos"), F.when(pos % 3 == 1, 1).otherwise(0).alias("source_id"), F.when(pos % 3 == 1, pos * 7919 % sparse.n_rows).otherwise(pos * 31 % dense.n_rows).alias("row"))
    return wide(planned([dense, sparse], request, output=OutputSpec(3, "f64")))


@query(f"""
SELECT CAST(p AS BIGINT) AS pos, CAST(o AS INTEGER) AS col, CAST(CASE WHEN o % 2 = 0 AND o < 20 THEN embedding[63 - o + 1] ELSE -9 END AS DOUBLE) AS value
FROM range({NE}) r(p) CROSS JOIN range(24) c(o) JOIN embeddings ON vec_id = (p * p) % {NE}""")
def dense_feature_map_fill(spark: SparkSession, sf: str) -> DataFrame:
    m = embeddings(spark, sf)
    to = tuple(63 - c if (63 - c) % 2 == 0 and 63 - c < 20 else None for c in range(64))
    return wide(source_rows(m, asked(spark, m.n_rows, lambda p: p * p % m.n_rows), to, OutputSpec(24, "f64", fill=-9)))


@query(f"""
WITH {QTY64}, fm AS (SELECT CAST(c AS INTEGER) AS c, 9 - c AS o FROM range(10) t(c) WHERE c % 4 <> 1)
SELECT CAST(p AS BIGINT) AS pos, CAST(outc.o AS INTEGER) AS col, CAST(CASE WHEN fm.c IS NULL THEN -9 ELSE coalesce(q.value, 0) END AS DOUBLE) AS value
FROM range({NO}) r(p) CROSS JOIN range(12) outc(o) LEFT JOIN fm ON fm.o = outc.o LEFT JOIN qty64 q ON q.row = (p * 13) % {NO} AND q.col = fm.c""")
def csr_feature_map_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Absent entries are 0, unmapped columns the fill, also in rows without entries."""
    m = source(spark, sf, "quantities64").matrix
    to = tuple(9 - c if c < 10 and c % 4 != 1 else None for c in range(64))
    return wide(source_rows(m, asked(spark, m.n_rows, lambda p: p * 13 % m.n_rows), to, OutputSpec(12, "f64", fill=-9)))


@query("SELECT o_orderkey AS pos, CAST(o_orderkey // 256 AS BIGINT) AS batch_id, CAST(o_orderkey % 256 AS BIGINT) AS place FROM orders")
def batch_assignment(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("o_orderkey")
    return table(spark, sf, "orders").select(pos.alias("pos"), partition.fixed_cells(pos, 256).alias("batch_id"), F.pmod(pos, F.lit(256)).cast("long").alias("place"))


RANKED = f"r AS (SELECT p AS pos, p // 128 AS batch, (p * 7) % (SELECT max(p_partkey) + 1 FROM part) AS row FROM range({NO}) t(p)), k AS (SELECT pos, batch, row FROM r JOIN part ON p_partkey = row)"


def _ranked(spark: SparkSession, sf: str) -> Plan:
    """A plan over part sizes with a row for every order."""
    data, n = source(spark, sf, "sizes"), source(spark, sf, "quantities3").n_rows
    return compile(data, np.arange(n) * 7 % data.n_rows, batch_size=128)


@query(f"WITH {RANKED} SELECT CAST(pos AS BIGINT) AS pos, CAST(batch % 3 AS INTEGER) AS rank, CAST(batch // 3 AS BIGINT) AS turn, CAST(p_size AS BIGINT) AS size FROM k JOIN part ON p_partkey = row")
def rank_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """What each of three ranks reads of a plan, and in which turn."""
    with _ranked(spark, sf).open_distributed(3) as session:
        parts = [session.frame(r).select("pos", F.lit(r).alias("rank"), F.expr("batch_id div 3").alias("turn"), F.col("values")[1].cast("long").alias("size")) for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {RANKED} SELECT CAST(a.rank AS INTEGER) AS rank, CAST(a.batches AS BIGINT) AS batches, count(k.pos) AS n_rows FROM (SELECT batch % 3 AS rank, count(DISTINCT batch) AS batches FROM r GROUP BY 1) a JOIN k ON k.batch % 3 = a.rank GROUP BY 1, 2")
def rank_batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many batches each rank's iterator announces, and the rows in them."""
    with _ranked(spark, sf).open_distributed(3) as session:
        parts = [session.frame(r).agg(F.count("*").alias("n_rows")).select(F.lit(r).alias("rank"), F.lit(len(session.rank(r))).cast("long").alias("batches"), "n_rows") for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH r AS (SELECT o_orderkey // 256 AS batch, o_custkey // 16 AS block FROM orders), refs AS (SELECT DISTINCT batch, block FROM r)
SELECT (SELECT count(*) FROM orders) AS input_rows, CAST((SELECT max(batch) + 1 FROM r) AS BIGINT) AS jobs, (SELECT count(*) FROM refs) AS block_jobs, (SELECT count(DISTINCT block) FROM refs) AS unique_blocks,
  (SELECT count(*) FROM refs) - (SELECT count(DISTINCT block) FROM refs) AS cache_reference_hits, (SELECT count(DISTINCT block) FROM refs) AS cache_reference_misses""")
def plan_stats_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A request of customer rows in order of orders: blocks of 16 rows, met once per batch."""
    request = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.lit(0).alias("source_id"), F.col("o_custkey").alias("row"))
    return request_stats(request, [16], 256)


@query(f"SELECT CAST(p AS BIGINT) AS pos, CAST(c AS INTEGER) AS col, CAST(embedding[c + 1] AS DOUBLE) AS value FROM range({NE}) t(p) JOIN embeddings ON vec_id = (p * 11) % {NE}, range(64) u(c)")
def plan_image(spark: SparkSession, sf: str) -> DataFrame:
    """A plan that went through its image and was bound to its source again."""
    data = source(spark, sf, "vectors")
    plan = compile(data, np.arange(data.n_rows) * 11 % data.n_rows, batch_size=100)
    return wide(Plan.loads(plan.dumps(), spark).bind().frame())


# --- rows ------------------------------------------------------------------------------------


@query(f"WITH {EMB} SELECT row - {NE} // 4 AS pos, col, value FROM emb WHERE row >= {NE} // 4 AND row < {NE} // 2")
def rows_range(spark: SparkSession, sf: str) -> DataFrame:
    m = embeddings(spark, sf)
    return cells(m.select(slice(m.n_rows // 4, m.n_rows // 2)))


@query(f"WITH {EMB} SELECT CAST(({NE} - 1 - row) // 7 AS BIGINT) AS pos, col, value FROM emb WHERE row > {NE} // 8 AND ({NE} - 1 - row) % 7 = 0")
def rows_strided_reverse(spark: SparkSession, sf: str) -> DataFrame:
    m = embeddings(spark, sf)
    return cells(m.select(slice(m.n_rows - 1, m.n_rows // 8, -7)))


@query(f"WITH {EMB} SELECT CAST(p AS BIGINT) AS pos, col, value FROM range({NE}) t(p) JOIN emb ON row = (p * p * 31) % {NE}")
def rows_gather_dup(spark: SparkSession, sf: str) -> DataFrame:
    m = embeddings(spark, sf)
    return cells(m.gather(asked(spark, m.n_rows, lambda p: p * p * 31 % m.n_rows), m.n_rows))


@query(f"WITH {EMB} SELECT CAST(0 AS BIGINT) AS pos, col, value FROM emb WHERE row = {NE} - 1")
def rows_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """One row by a negative index; Matrix.select keeps both axes."""
    return cells(embeddings(spark, sf).select(-1))


@query(f"WITH {QTY64} SELECT CAST(p AS BIGINT) AS pos, col, CAST(value AS DOUBLE) AS value FROM range({NO}) t(p) JOIN qty64 ON row = (p * p) % {NO}")
def csr_rows_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a stored sparse matrix by a table, with repetitions."""
    m = source(spark, sf, "quantities64").matrix
    return cells(m.gather(asked(spark, m.n_rows, lambda p: p * p % m.n_rows), m.n_rows))


@query(f"WITH {QTY64} SELECT CAST((row - 1) // 3 AS BIGINT) AS pos, CAST(40 - col AS INTEGER) AS col, CAST(value AS DOUBLE) AS value FROM qty64 WHERE row % 3 = 1 AND col <= 40 AND col > 10")
def csr_rows_cols(spark: SparkSession, sf: str) -> DataFrame:
    """Every third row and a range of columns backwards of a stored sparse matrix."""
    return cells(source(spark, sf, "quantities64").matrix.select(slice(1, None, 3), slice(40, 10, -1)))


@query(f"WITH {EMB}, k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings WHERE label % 3 = 1) SELECT CAST(pos AS BIGINT) AS pos, col, value FROM k JOIN emb ON row = vec_id")
def rows_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a mask that is a table's predicate, numbered anew."""
    m = embeddings(spark, sf)
    kept = renumber(table(spark, sf, "embeddings").where("label % 3 = 1").select(F.col("vec_id").cast("long").alias("row")))
    frame = m.frame.join(kept, "row").drop("row").withColumnRenamed("pos", "row").select("row", "values")
    return cells(DenseFrame(frame, m.n_rows, 64, m.dtype))


@query("SELECT CAST(vec_id // 64 AS BIGINT) AS batch_id, CAST(min(vec_id) AS BIGINT) AS first_row, count(*) AS n_rows, CAST(sum(len(embedding)) AS BIGINT) AS n_cells, 4 * CAST(sum(len(embedding)) AS BIGINT) AS n_bytes FROM embeddings GROUP BY 1")
def iter_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batches that iter_batches streams to the driver, as the executors pack them."""
    size = F.octet_length("data").cast("long")
    return embeddings(spark, sf).batches(64).select("batch_id", "first_row", "n_rows", (F.col("n_rows") * 64).alias("n_cells"), size.alias("n_bytes"))


@query("SELECT CAST(0 AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_cols, CAST(0 AS BIGINT) AS n_cells, 'f32' AS dtype")
def empty_selection(spark: SparkSession, sf: str) -> DataFrame:
    m = embeddings(spark, sf).select([], slice(3, 8))
    shape = [F.lit(v).cast("long").alias(n) for n, v in zip(("n_rows", "n_cols"), m.shape)]
    return m.coo().agg(F.count("*").alias("n_cells")).select(*shape, "n_cells", F.lit(m.dtype.name).alias("dtype"))


# --- columns ---------------------------------------------------------------------------------


@query(f"WITH {EMB}, c AS (SELECT * FROM (VALUES (0, 5), (1, 1), (2, 5), (3, 63)) t(o, c)) SELECT row AS pos, CAST(o AS INTEGER) AS col, value FROM emb JOIN c ON col = c.c")
def dense_cols_gather(spark: SparkSession, sf: str) -> DataFrame:
    return cells(embeddings(spark, sf).select(None, [5, 1, 5, 63]))


@query(f"WITH {QTY} SELECT row AS pos, CAST((col - 1) // 5 AS INTEGER) AS col, CAST(value AS DOUBLE) AS value FROM qty WHERE col % 5 = 1")
def csr_cols_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return cells(quantities(spark, sf).select(None, slice(1, None, 5)))


@query(f"WITH {QTY}, c AS (SELECT p AS o, (p * p) % 50 AS c FROM range(40) t(p)) SELECT row AS pos, CAST(o AS INTEGER) AS col, CAST(value AS DOUBLE) AS value FROM qty JOIN c ON col = c.c")
def csr_cols_dup(spark: SparkSession, sf: str) -> DataFrame:
    return cells(quantities(spark, sf).select(None, [p * p % 50 for p in range(40)]))


@query(f"WITH {QTY64} SELECT CAST(r AS BIGINT) AS pos, CAST(c AS INTEGER) AS col, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM range({NO}) a(r) CROSS JOIN range(8) b(c) LEFT JOIN qty64 ON row = r AND col = 20 + c")
def csr_to_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Eight columns of all rows, also of rows without entries."""
    return cells(quantities(spark, sf, 64).select(None, slice(20, 28)).to_dense())


# --- structure -------------------------------------------------------------------------------


@query(f"WITH {QTY}, n AS (SELECT row, count(*) AS n FROM qty GROUP BY 1) SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS value UNION ALL SELECT r + 1, CAST(sum(coalesce(n, 0)) OVER (ORDER BY r) AS BIGINT) FROM range({NO}) t(r) LEFT JOIN n ON row = r")
def csr_indptr(spark: SparkSession, sf: str) -> DataFrame:
    return quantities(spark, sf).indptr()


@query(f"WITH {QTY} SELECT row, CAST(row_number() OVER (PARTITION BY row ORDER BY col) - 1 AS INTEGER) AS k, col, CAST(value AS DOUBLE) AS value FROM qty")
def csr_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = canonical_rows(entries(spark, sf))
    return rows.select("row", F.posexplode(F.arrays_zip("indices", "values")).alias("k", "e")).select("row", "k", F.col("e.indices").alias("col"), F.col("e.values").alias("value"))


@query("SELECT l_orderkey AS row, CAST(l_partkey AS INTEGER) AS col, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def csr_duplicate_check(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_coordinates(entries(spark, sf))


@query("""
WITH e AS (SELECT l_orderkey AS row, l_partkey AS c, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem)
SELECT row, CAST(sum(CASE WHEN c >= nxt THEN 1 ELSE 0 END) + sum(CASE WHEN c >= 1000 THEN 1 ELSE 0 END) AS INTEGER) AS faults FROM e GROUP BY 1""")
def csr_index_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of raw column lists in line order, for a matrix of 1000 columns."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("int").alias("c")))).alias("e"))
    return line.select("row", index_faults(F.transform("e", lambda x: x["c"]), 1000).alias("faults"))


@query(f"""
WITH {QTY} SELECT 'dense' AS kind, CAST({NE} AS BIGINT) AS n_rows, CAST(64 AS BIGINT) AS n_cols, CAST(NULL AS BIGINT) AS nnz, 'f32' AS dtype, CAST(NULL AS VARCHAR) AS index_dtype
UNION ALL SELECT 'csr', CAST({NO} AS BIGINT), CAST(max(col) + 1 AS BIGINT), count(*), 'f64', CASE WHEN max(col) < 65536 THEN 'u16' ELSE 'u32' END FROM qty""")
def matrix_info(spark: SparkSession, sf: str) -> DataFrame:
    d, c = embeddings(spark, sf), quantities(spark, sf)
    kinds = "kind string, n_rows long, n_cols long, nnz long, dtype string, index_dtype string"
    return spark.createDataFrame([("dense", *d.shape, None, d.dtype.name, None), ("csr", *c.shape, c.nnz, c.dtype.name, c.index_dtype)], kinds)


@query("SELECT o_orderkey AS row, CAST(o_orderkey // 1000 AS BIGINT) AS chunk, CAST(o_orderkey % 1000 // 64 AS BIGINT) AS block FROM orders")
def partition_fixed_cells(spark: SparkSession, sf: str) -> DataFrame:
    row = F.col("o_orderkey")
    return table(spark, sf, "orders").select(row.alias("row"), partition.fixed_cells(row, 1000).alias("chunk"), partition.fixed_cells(F.pmod(row, F.lit(1000)), 64).alias("block"))


@query(f"""
WITH RECURSIVE {QTY}, c AS (SELECT row, count(*) * 8 AS cost FROM qty GROUP BY 1), cum AS (SELECT row, cost, sum(cost) OVER (ORDER BY row) AS done FROM c),
g AS (SELECT 0 AS grp, CAST(0 AS HUGEINT) AS before, (SELECT min(row) FROM cum) AS first
  UNION ALL SELECT grp + 1, (SELECT done - cost FROM cum WHERE row = nxt), nxt FROM (SELECT g.grp, (SELECT min(row) FROM cum WHERE done > g.before + 4096 AND row > g.first) AS nxt FROM g) WHERE nxt IS NOT NULL)
SELECT CAST(grp AS BIGINT) AS grp, min(row) AS first_row, max(row) AS last_row, CAST(sum(cost) AS BIGINT) AS bytes FROM (SELECT cum.row, cum.cost, (SELECT max(grp) FROM g WHERE g.first <= cum.row) AS grp FROM cum) GROUP BY 1""")
def partition_bytes_budget(spark: SparkSession, sf: str) -> DataFrame:
    m = quantities(spark, sf)
    costs = m.counts().select("row", (F.col("n") * 8).alias("cost"))
    return partition.bytes_budget(costs, 4096, m.n_rows).groupBy("grp").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.sum("cost").alias("bytes"))


@query("""
SELECT 'l_quantity' AS name, bool_and(l_quantity >= -1e-4 AND abs(l_quantity - round(l_quantity)) <= 1e-3) AS ok, CAST(max(round(l_quantity)) AS BIGINT) AS top, 'u16' AS dtype FROM lineitem
UNION ALL SELECT 'l_discount', bool_and(abs(l_discount - round(l_discount)) <= 1e-3), CAST(max(round(l_discount)) AS BIGINT), CAST(NULL AS VARCHAR) FROM lineitem""")
def integerize_counts(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    parts = [partition.integerize(line, c).select(F.lit(c).alias("name"), "ok", "top", "dtype") for c in ("l_quantity", "l_discount")]
    return parts[0].unionByName(parts[1])


@query("SELECT vec_id AS row, CAST(c // 16 AS INTEGER) AS axis0, CAST(c // 4 % 4 AS INTEGER) AS axis1, CAST(c % 4 AS INTEGER) AS axis2, CAST(embedding[c + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(c)")
def reshape_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of 64 that were 4 x 4 x 4, with the cells last, before they were flattened."""
    m = embeddings(spark, sf)
    return unflatten(m, {"shape": [4, 4, 4, m.n_rows], "cell_axis": -1}).withColumn("value", F.col("value").cast("double"))


# --- stores ----------------------------------------------------------------------------------


@query(f"WITH {QTY64} SELECT row AS pos, col, CAST(value AS DOUBLE) AS value FROM qty64")
def store_csr(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse matrix written in chunks of a byte budget and opened again."""
    path = stored(spark, sf, "chunks", lambda: quantities(spark, sf, 64).to_csr(), chunk_budget=1 << 16, codec={"algorithm": "blosc", "backend": "zstd", "level": 7})
    return cells(open_store(spark, path).matrix)


@query(f"WITH {EMB} SELECT row AS pos, col, value FROM emb WHERE row % 2 = 1")
def store_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Every second row of a dense store of 100 rows a chunk."""
    path = stored(spark, sf, "cut", lambda: embeddings(spark, sf), chunk_policy="cells", chunk_cells=100)
    return cells(open_store(spark, path).matrix.select(slice(1, None, 2))).withColumn("pos", F.col("pos") * 2 + 1)


CONTAINER = "SELECT p_partkey AS pos, p_name AS name FROM part"


def _container(spark: SparkSession, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf, "container")
    if key not in _STORED:
        part, path = table(spark, sf, "part"), f"{shared_folder(spark)}/container-{uuid.uuid4().hex}"
        low = part.agg(F.min("p_partkey")).first()[0]
        obs = part.select((F.col("p_partkey") - low).alias("pos"), F.col("p_name").alias("name"), "p_brand")
        var = spark.createDataFrame([(i, n) for i, n in enumerate(("shifted", "size", "negative"))], "pos long, name string")
        m = sizes(spark, sf)
        m = DenseFrame(m.frame.withColumn("row", F.col("row") - low), m.n_rows - low, 3, m.dtype)
        write_container(spark, path, obs=obs, var=var, matrices={"X": m, "layers/same": m}, uns={"low": low})
        _STORED[key] = path
    return _STORED[key]


@query("SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS pos, p_name AS name, p_brand, CAST(p_size AS BIGINT) AS size FROM part")
def container_read(spark: SparkSession, sf: str) -> DataFrame:
    """The observations of a container beside a column of one of its layers."""
    c = read_container(spark, _container(spark, sf), include=["layers"])
    return c.obs.join(c.matrices["layers/same"].matrix.select(None, [1]).frame, F.col("pos") == F.col("row")).select("pos", "name", "p_brand", F.col("values")[0].cast("long").alias("size"))


@query("SELECT o_orderkey AS pos, CAST(u.c AS INTEGER) AS col, CAST(CASE u.c WHEN 0 THEN p_size WHEN 1 THEN -1 ELSE p_size - 25 END AS DOUBLE) AS value FROM (SELECT o_orderkey, min(p_partkey) AS k FROM orders JOIN part a ON a.p_partkey = o_custkey GROUP BY 1) x JOIN (SELECT p_partkey, p_name FROM part) b ON b.p_partkey = k JOIN (SELECT p_name, min(p_partkey) AS f FROM part GROUP BY 1) n ON n.p_name = b.p_name JOIN part c ON c.p_partkey = f, range(3) u(c)")
def rows_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a container by names from a table, columns aligned by name: size, one that is not there, shifted."""
    data = register(spark, _container(spark, sf)).with_aligned_features(["size", "absent", "shifted"])
    orders = table(spark, sf, "orders").join(table(spark, sf, "part"), F.col("o_custkey") == F.col("p_partkey"))
    rows = data.rows_for(orders.select(F.col("o_orderkey").alias("pos"), F.col("p_name").alias("name")), missing="error")
    return wide(planned(data, rows.withColumn("source_id", F.lit(0)), output=OutputSpec(3, "f64", fill=-1)))


# --- names -----------------------------------------------------------------------------------

TARGET = "t AS (SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS pos, p_name AS name FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) ON l_partkey = p_partkey)"


def _targets(spark: SparkSession, sf: str, part: DataFrame) -> DataFrame:
    """Names of the parts of which 50 were sold at once, by falling key."""
    sold = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return renumber(part.join(sold, "p_partkey").select((-F.col("p_partkey")).alias("row"), F.col("p_name").alias("name"))).select("pos", "name")


@query(f"""
WITH {TARGET}, ft AS (SELECT name, min(pos) AS out_col FROM t GROUP BY 1), fs AS (SELECT p_name AS name, min(p_partkey) AS src FROM part GROUP BY 1)
SELECT p_partkey AS src_col, CAST(CASE WHEN p_partkey = src THEN out_col END AS BIGINT) AS out_col FROM part JOIN fs ON fs.name = p_name LEFT JOIN ft ON ft.name = p_name""")
def feature_map_by_name(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return names.feature_map(part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name")), _targets(spark, sf, part))


ASKED = "a AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN 'no-' || o_orderkey ELSE c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey)"


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf, "customer")
    orders = table(spark, sf, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
    asked = orders.select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("no-"), F.col("o_orderkey").cast("string"))).otherwise(F.col("c_name")).alias("name"), F.col("c_name").alias("known"))
    return customer.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name")), asked


@query(f"WITH {ASKED} SELECT a.pos, min(c_custkey) AS row FROM a JOIN customer ON c_name = name GROUP BY a.pos")
def locate_names_drop(spark: SparkSession, sf: str) -> DataFrame:
    return names.locate(*_asked(spark, sf), missing="drop")


@query("SELECT o_orderkey AS pos, min(b.c_custkey) AS row FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_name = a.c_name GROUP BY 1")
def locate_names_error(spark: SparkSession, sf: str) -> DataFrame:
    """All names are there, so none fails the job."""
    known, wanted = _asked(spark, sf)
    return names.locate(known, wanted.select("pos", F.col("known").alias("name")), missing="error")


@query(f"WITH {ASKED} SELECT pos, name FROM a WHERE name NOT IN (SELECT c_name FROM customer)")
def locate_names_missing(spark: SparkSession, sf: str) -> DataFrame:
    return names.absent(*_asked(spark, sf)).select("pos", "name")


# --- conversion ------------------------------------------------------------------------------


def _converted(spark: SparkSession, sf: str, value, src: str, to: dict[str, dict]) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("row"), *[convert(value, src, d.split("_")[0], **how).cast("double" if d[0] == "f" else "decimal(20,0)" if d[:3] == "u64" else "long").alias(d) for d, how in to.items()])


@query("SELECT p_partkey AS row, CAST(p_size - 25 AS BIGINT) AS i16, CAST(p_size - 25 AS BIGINT) AS i32, CAST(p_size - 25 AS BIGINT) AS i64 FROM part")
def promote_lossless(spark: SparkSession, sf: str) -> DataFrame:
    return _converted(spark, sf, (F.col("p_size") - 25).cast("short"), "i16", {"i16": {}, "i32": {}, "i64": {}})


@query("SELECT p_partkey AS row, CAST(p_size - 25 AS DOUBLE) AS f32, CAST(p_size - 25 AS DOUBLE) AS f64 FROM part")
def promote_exact_float(spark: SparkSession, sf: str) -> DataFrame:
    return _converted(spark, sf, (F.col("p_size") - 25).cast("short"), "i16", {"f32": {}, "f64": {}})


@query("SELECT p_partkey AS row, CAST(CAST(16777217 + p_partkey * 3 AS FLOAT) AS DOUBLE) AS f32 FROM part")
def promote_rounding(spark: SparkSession, sf: str) -> DataFrame:
    return _converted(spark, sf, (F.col("p_partkey") * 3 + 16777217).cast("int"), "i32", {"f32": {"allow_float_rounding": True}})


CHECKED = "SELECT p_partkey AS row, CAST(CASE WHEN p_size < 25 THEN {0} ELSE p_size - 25 END AS BIGINT) AS u16, CAST(CASE WHEN p_size < 25 THEN {1} ELSE p_size - 25 END AS BIGINT) AS u32, CAST(CASE WHEN p_size < 25 THEN {2} ELSE p_size - 25 END AS DECIMAL(20, 0)) AS u64 FROM part"


def _checked(spark: SparkSession, sf: str, **how) -> DataFrame:
    return _converted(spark, sf, (F.col("p_size") - 25).cast("short"), "i16", dict.fromkeys(("u16", "u32", "u64"), how))


@query(CHECKED.format(99, 99, 99))
def overflow_use_fill(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf, overflow="use_fill", fill=99)


@query(CHECKED.format(777, 777, 777))
def overflow_use_value(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf, overflow="use_value", overflow_value=777, fill=1)


@query(CHECKED.format("65536 + p_size - 25", "4294967296 + p_size - 25", "CAST(18446744073709551616 AS HUGEINT) + p_size - 25"))
def overflow_unchecked(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf, overflow="unchecked")


EDGES = [(a, b) for a in DTYPES for b in DTYPES if promotion(a, b)]


@query("SELECT p_partkey AS row, " + ", ".join(f"CAST(p_size AS DOUBLE) AS {a}_{b}" for a, b in EDGES) + " FROM part")
def promote_all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, which all types hold, along every edge of the promotion table."""
    value = lambda a: F.col("p_size").cast(DTYPES[a].spark)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row"), *[convert(value(a), a, b, allow_float_rounding=True).cast("double").alias(f"{a}_{b}") for a, b in EDGES])


@query("SELECT p_partkey AS row, CAST(p_size AS BIGINT) AS u16, CAST(p_size AS BIGINT) AS u32, CAST(p_size AS DECIMAL(20, 0)) AS u64 FROM part")
def overflow_error(spark: SparkSession, sf: str) -> DataFrame:
    """Values that fit go through the policy that fails on others."""
    return _converted(spark, sf, F.col("p_size").cast("short"), "i16", dict.fromkeys(("u16", "u32", "u64"), {"overflow": "error"}))
