"""Approximate nearest neighbours on shifted Hilbert curves.

1. Equal vectors are one index entry (its smallest ids stand for it), so a vector
   that very many rows share is searched once and found whole.
2. Each of CURVES curves projects the vectors onto AXES random orthonormal
   directions, shifts the cells by a random offset and orders all entries by their
   Hilbert key. The orders are range-partitioned sorts in Spark; an entry's rank
   is its place in its order.
3. A query looks at the entries within ``window`` ranks of it on every curve.
   Orders are cut into blocks of BLOCK ranks; a query goes to the blocks that
   its windows touch, each block returns its nearest entries by exact
   distance, and the curves' answers are merged and ranked. A block that many
   queries touch is repeated, once for each QUERIES of them, and a task compares
   slices of its queries, so neither a group nor its distances grow with the rows.
4. The window is fitted, not guessed: for a bounded sample of queries the true
   neighbours are found by comparing them with all entries, and the window is
   the least that holds RECALL of them on at least one curve. Means and
   scales of the projections come from a bounded sample of entries too;
   every row is indexed.

Distances are Euclidean, in double precision on the original vectors. Defined
results: rows without id, and vectors that are null, all zero, hold null or non-finite
components or are not of the most frequent length (ties: the longer) take no part; rows that repeat an
id and vector are one row; equal distances go to the smaller id; fewer candidates
than ``k`` give fewer rows; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import importable, map_batches, written

CURVES, AXES, KEY_BITS = 16, 8, 56
BLOCK = 4096
#: Queries that meet a copy of a block, and distances that a task holds at once (32 MB).
QUERIES, DISTANCES = 4096, 1 << 22
RECALL = 0.95
#: Entries that the projections' scales, and queries that the window, are fitted on.
FIT_ROWS, FIT_QUERIES = 4_000, 200


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of ints below 2**bits) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):  # undo the rotations of each level, coarse to fine
        low = (1 << b) - 1
        for i in range(axes):
            flip = (x[i] >> b & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, 0) ^ swap
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(cells.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections, scales and shifts of all curves, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 23):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        axes = min(AXES, dim)
        self.bits = min(16, KEY_BITS // axes)
        self.mean = sample.mean(axis=0)
        self.maps = np.stack([np.linalg.qr(rng.normal(size=(dim, axes)))[0] for _ in range(CURVES)])
        spread = np.stack([((sample - self.mean) @ m).std(axis=0) for m in self.maps])
        self.scale = 1 / (7 * np.where(spread > 0, spread, 1))
        self.shift = 0.5 + rng.uniform(0, 0.5, (CURVES, axes))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Key of each vector on each curve: (curves, vectors)."""
        out = []
        for m, scale, shift in zip(self.maps, self.scale, self.shift):
            unit = ((vectors - self.mean) @ m * scale + shift) / 1.5
            cells = np.clip(unit * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, self.bits))
        return np.stack(out)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and exact distances of the ``k`` nearest rows of each query, and a few that rounding might confuse with them."""
    rough = (rows * rows).sum(axis=1)[None] - 2 * queries @ rows.T
    m = min(len(rows), k + 8)
    at = np.argpartition(rough, m - 1, axis=1)[:, :m] if m < len(rows) else np.tile(np.arange(len(rows)), (len(queries), 1))
    exact = np.sqrt(((rows[at] - queries[:, None, :]) ** 2).sum(axis=2))
    order = np.argsort(exact, axis=1, kind="stable")[:, : min(k, at.shape[1])]
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(exact, order, axis=1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null").where(fine)
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vec") == (lengths[0].n if lengths else 0)).distinct()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(entry, ids, vec): one row a distinct vector, named by its smallest id, with its k + 1 smallest ids."""
    order = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids")).select("entry", "ids", "vec")


def ordered(spark: SparkSession, index: DataFrame, curves: Curves) -> DataFrame:
    """(curve, place, entry, ids, vec): every entry on every curve, with its place in the curve's order."""
    shared = spark.sparkContext.broadcast(curves)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = shared.value.keys(matrix(batch.column(2)))
        take = pa.array(np.tile(np.arange(batch.num_rows), CURVES))
        curve = np.repeat(np.arange(CURVES, dtype=np.int32), batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array(curve), pa.array(keys.reshape(-1)), *(c.take(take) for c in batch.columns)], names=["curve", "key", "entry", "ids", "vec"])

    keyed = map_batches(index.select("entry", "ids", "vec"), run, "curve int, key long, entry long, ids array<long>, vec array<double>")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.repartitionByRange(parts, "curve", "key", "entry").sortWithinPartitions("curve", "key", "entry")
    # The id of a row holds its partition and its place there; a count a partition makes places of them.
    rows = written(spark, keyed.withColumn("at", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("at", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for p, n in counts:
        base.append((p, total))
        total += n
    starts = spark.createDataFrame(base, "p long, base long")  # one row a partition
    placed = rows.join(F.broadcast(starts), part == F.col("p"))
    run_on = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)  # through all curves, each of which holds every entry
    return placed.select("curve", (run_on - F.col("curve") * F.lit(total // CURVES)).alias("place"), "entry", "ids", "vec")


def true_neighbours(spark: SparkSession, index: DataFrame, sample: list, k: int) -> DataFrame:
    """(query, entry): the k nearest other entries of each sampled query, by comparing it with all."""
    names = np.array([r.entry for r in sample], np.int64)
    shared = spark.sparkContext.broadcast((names, np.array([r.vec for r in sample], np.float64)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, vectors = shared.value
        at, d = nearest(vectors, matrix(batch.column(1)), k + 1)
        entry = batch.column(0).to_numpy()
        q = np.repeat(names, at.shape[1])
        e = entry[at.reshape(-1)]
        ok = q != e
        return pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(e[ok]), pa.array(d.reshape(-1)[ok])], names=["query", "entry", "d"])

    found = map_batches(index.select("entry", "vec"), run, "query long, entry long, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "entry"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select("query", "entry")


def fitted_window(spark: SparkSession, index: DataFrame, placed: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """Ranks to each side that hold ``recall`` of the sampled queries' true neighbours on some curve."""
    sample = queries.orderBy(F.xxhash64("entry"), "entry").limit(FIT_QUERIES).collect()
    if not sample:
        return 1
    pairs = written(spark, true_neighbours(spark, index, sample, k), "truth")
    small = F.broadcast(pairs)  # at most FIT_QUERIES * k rows
    two = placed.select("curve", F.col("place").alias("pq"), F.col("entry").alias("query")).join(small, "query")
    ends = written(spark, two.select("curve", "query", "entry", "pq"), "ends")
    met = placed.select("curve", "place", "entry").join(F.broadcast(ends), ["curve", "entry"])  # CURVES times as many
    gaps = [r.g for r in met.groupBy("query", "entry").agg(F.min(F.abs(F.col("place") - F.col("pq"))).alias("g")).collect()]
    return int(math.ceil(np.quantile(gaps, recall))) if gaps else 1


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest rows found for each row for which ``is_query`` (on ``id``) holds."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(spark, usable(df, id_col, vector_col), "vectors")
    index = written(spark, entries(rows, k), "entries")
    sample = index.orderBy(F.xxhash64("entry"), "entry").limit(FIT_ROWS).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    asked = rows.where(is_query).join(index.select("entry", "vec"), "vec").select("id", "entry")
    asked = written(spark, asked, "asked")
    placed = ordered(spark, index, Curves(np.array([r.vec for r in sample], np.float64)))
    mine = asked.select("entry").distinct()
    queries = index.select("entry", "vec").join(mine, "entry", "left_semi")
    window = fitted_window(spark, index, placed, queries, k, recall)

    def block(place: Column) -> Column:
        return F.floor(place / BLOCK).cast("long") * CURVES + F.col("curve")

    touched = F.sequence(block(F.greatest(F.col("place") - window, F.lit(0))), block(F.col("place") + window), F.lit(CURVES).cast("long"))
    sent = placed.join(mine, "entry", "left_semi").select(F.col("entry").alias("query"), F.col("vec").alias("q_vec"), F.explode(touched).alias("block"))
    copies = sent.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    copies = written(spark, copies, "copies")
    sent = sent.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("query"), "copies").cast("int"))
    blocks = placed.select(block(F.col("place")).alias("block"), "entry", "ids", "vec").join(copies, "block")
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    importable(spark)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        asks, rows, names = matrix(left["q_vec"]), matrix(right["vec"]), left["query"].to_numpy()
        step = max(1, DISTANCES // len(rows))
        parts = []
        for lo in range(0, len(asks), step):
            at, d = nearest(asks[lo : lo + step], rows, k + 1)
            take = pa.array(at.reshape(-1))
            q = np.repeat(names[lo : lo + step], at.shape[1])
            parts.append(pa.table({"query": pa.array(q), "entry": right["entry"].take(take), "ids": right["ids"].take(take), "score": pa.array(d.reshape(-1))}))
        return pa.concat_tables(parts)

    met = sent.select("block", "copy", "query", "q_vec").groupBy("block", "copy").cogroup(blocks.select("block", "copy", "entry", "ids", "vec").groupBy("block", "copy"))
    found = met.applyInArrow(answer, "query long, entry long, ids array<long>, score double")
    merged = found.groupBy("query", "entry").agg(F.first("ids").alias("ids"), F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))
    near = merged.withColumn("r", best).where(F.col("r") <= 2 * (k + 1))
    each = asked.join(near, asked.entry == F.col("query")).select(asked.id.alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    # An id with several vectors is met at its nearest.
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
