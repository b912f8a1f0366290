"""Approximate nearest neighbours (largest inner product) by cross-polytope hashing.

Vectors are put into bands of similar length (by the rounded base-2 logarithm
of their norm).  With ``M`` the largest norm of a band, appending
sqrt(M^2 - |x|^2) makes every vector of the band equally long, so the largest
inner product is the smallest angle, and dividing by M gives unit vectors.

A table's hash pads with zeros to a power of two, applies a fast
pseudo-rotation H D3 H D2 H D1 (random signs and Hadamard transforms) and takes
the nearest signed axis.  A query looks into the ``PROBES`` nearest signed axes
of every table and band.  Candidates are scored by exact inner products in
double precision; a block passes on its ``k`` best for each query, and the best
``k`` of all blocks are the result.

Equal vectors have equal scores, so they are one entry with their k + 1 least
ids, which is all that can be among a query's k nearest.  A (table, band,
axis) bucket is cut into blocks of about ``BLOCK`` entries by its counted size
and its queries into blocks of as many, so neither a large bucket nor a
popular one is held by one task; a block emits at most k rows a query.  The
queries that meet fewer than k candidates, as in a small table, are held
against all entries, in such blocks too.

Defined results: vectors that are null, empty, zero, of another length than
the most common one, or that hold null or non-finite components take no part;
rows that repeat a vec_id are candidates of their own; rows that repeat a
query's id are one query, scored by the nearest of its vectors; ties go to the smaller
vec_id; fewer candidates than k: all; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import cut, prepare

TABLES = 8
PROBES = 32
BLOCK = 4096
SEED = 20


def _signs(table: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, table]).choice([-1.0, 1.0], size=(3, dim))


def _hadamard(x: np.ndarray) -> np.ndarray:
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of the rows, padded to a power of two."""
    dim = 1 << (x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    for s in _signs(table, dim):
        x = _hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes) signed axes, 2 i for +e_i and 2 i + 1 for -e_i, nearest first."""
    both = np.stack((x, -x), axis=2).reshape(len(x), -1)
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _lifted(x: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Unit vectors with the extra component; queries (no ``longest``) have 0 there."""
    norm = np.sqrt((x * x).sum(axis=1))
    scale = norm if longest is None else longest
    extra = np.sqrt(np.maximum(scale * scale - norm * norm, 0.0))
    return np.concatenate((x, extra[:, None]), axis=1) / scale[:, None]


def _hash_entries(batches):
    for b in batches:
        unit = _lifted(_matrix(b.column("v")), b.column("longest").to_numpy())
        for t in range(TABLES):
            axis = nearest_axes(rotated(unit, t), 1)[:, 0]
            yield pa.record_batch([b.column("eid"), b.column("band"), pa.array(np.full(len(axis), t), pa.int32()),
                                   pa.array(axis, pa.int32())], names=["eid", "band", "t", "axis"])


def _hash_queries(batches):
    for b in batches:
        unit = _lifted(_matrix(b.column("v")), None)
        for t in range(TABLES):
            axes = nearest_axes(rotated(unit, t), PROBES)
            rows = pa.array(np.repeat(np.arange(len(unit)), axes.shape[1]))
            yield pa.record_batch([b.column("qid").take(rows), b.column("v").take(rows),
                                   pa.array(np.full(axes.size, t), pa.int32()), pa.array(axes.ravel(), pa.int32())],
                                  names=["qid", "v", "t", "axis"])


def _rerank(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, entries: pa.Table) -> pa.Table:
        out = {"query_id": [], "eid": [], "score": []}
        if queries.num_rows and entries.num_rows:
            q, x = _matrix(queries.column("v")), _matrix(entries.column("v"))
            qid, eid = queries.column("qid").to_numpy(), entries.column("eid").to_numpy()
            keep = min(k + 1, len(x))            # one more: the query's own entry may be among them
            for at in range(0, len(q), 256):
                rough = q[at:at + 256] @ x.T
                least = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
                tall = rough >= (least - 1e-9 * (np.abs(least) + 1.0))[:, None]
                r, c = np.nonzero(tall)
                out["query_id"].append(qid[at + r])
                out["eid"].append(eid[c])
                # summed in one order, so that equal vectors have equal scores
                out["score"].append((q[at + r] * x[c]).sum(axis=1))
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
        return pa.table({"query_id": cat(out["query_id"], pa.int64()), "eid": cat(out["eid"], pa.int64()),
                         "score": cat(out["score"], pa.float64())})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``vectors``, ``queries`` (vec_id, embedding) -> query_id, rank, vec_id,
    score: the k nearest vectors of every query but its own vec_id."""
    spark = vectors.sparkSession
    prepare(spark)
    # floats are carried as they are and widened where they are used
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    sound = lambda df, i: (df.select(F.col("vec_id").cast("long").alias(i), v.alias("v"))
                           .filter(F.col(i).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                                   & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
                                   & F.exists("v", lambda x: x != 0)))
    rows = sound(vectors, "vec_id")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    rows = rows.filter(F.size("v") == dim)
    asked = sound(queries, "qid").filter(F.size("v") == dim)

    # one entry for each different vector: its k + 1 least ids
    first = Window.partitionBy("v").orderBy("vec_id")
    ids = (rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
           .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    entries = ids.withColumn("norm", norm).withColumn("band", F.round(F.log2("norm")).cast("int")) \
                 .withColumn("eid", F.monotonically_increasing_id())     # fixed by the write
    entries = cut(entries, "ann-entries")
    bands = entries.groupBy("band").agg(F.max("norm").alias("longest"))
    hashed = entries.join(bands, "band").select("eid", "band", "v", "longest") \
        .mapInArrow(_hash_entries, "eid long, band int, t int, axis int")
    hashed = cut(hashed, "ann-tables")
    sizes = hashed.groupBy("t", "band", "axis").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (hashed.join(sizes, ["t", "band", "axis"])
              .withColumn("blk", F.pmod(F.xxhash64("eid"), F.col("blocks")).cast("int"))
              .join(entries.select("eid", "v"), "eid"))
    probes = asked.mapInArrow(_hash_queries, f"qid long, v {kind}, t int, axis int")
    probes = cut(probes, "ann-probes")
    by = ["t", "band", "axis", "blk", "q_blk"]
    asked_of = probes.groupBy("t", "axis").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))
    probes = (probes.join(asked_of, ["t", "axis"]).withColumn("q_blk", F.pmod(F.xxhash64("qid"), F.col("q_blocks")).cast("int"))
              .join(sizes, ["t", "axis"]).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(*[F.col(c).alias(f"p_{c}") for c in by], "qid", "v"))
    placed = (placed.join(asked_of, ["t", "axis"]).withColumn("q_blk", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
              .select(*by, "eid", "v"))
    near = (probes.groupBy(*[f"p_{c}" for c in by]).cogroup(placed.groupBy(*by))
            .applyInArrow(_rerank(k), "query_id long, eid long, score double"))
    found = cut(_best(near, entries, k), "ann-found")
    met = found.groupBy(F.col("query_id").alias("qid")).count()
    short = cut(asked.join(met, "qid", "left").filter(F.coalesce("count", F.lit(0)) < k).select("qid", "v"), "ann-short")
    n_short = short.count()
    if not n_short:
        return found
    blocks, q_blocks = -(-entries.count() // BLOCK), -(-n_short // BLOCK)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    left = short.select(part("qid", q_blocks).alias("p_q_blk"), every(blocks).alias("p_blk"), "qid", "v")
    right = entries.select(part("eid", blocks).alias("blk"), every(q_blocks).alias("q_blk"), "eid", "v")
    near = (left.groupBy("p_blk", "p_q_blk").cogroup(right.groupBy("blk", "q_blk"))
            .applyInArrow(_rerank(k), "query_id long, eid long, score double"))
    whole = short.select(F.col("qid").alias("query_id")).distinct()
    return found.join(whole, "query_id", "left_anti").unionByName(_best(near, entries, k))


def _best(near: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k best of each query.  The same pair has the same score in every table."""
    near = near.groupBy("query_id", "eid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = (near.join(entries.select("eid", "ids"), "eid").withColumn("vec_id", F.explode("ids"))
             .filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(best))
             .filter(F.col("rank") <= k))
    return found.select("query_id", "rank", "vec_id", "score")
