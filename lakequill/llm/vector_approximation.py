"""Exact top-k inner products by a vector-approximation file.

Vectors are dealt into stripes. Of a stripe the approximation file keeps a byte for each component, the cell (of CELLS a
dimension) it is in, and for each vector how far it is from the middle of its cells; exact vectors stay in a table of their own.

1. Each block of queries meets each stripe's cells, an eighth of the vectors. The product with the middles, give or take the least
   of two errors (by the widths of cells; by the distance from the middle), bounds every score. The k-th greatest lower
   bound of a query is a floor that the k-th score cannot be below; candidates are the vectors whose upper bound reaches it.
2. Exact vectors of candidates are read by an equi-join in the order of their upper bounds: FIRST_READ for each query, then, as the k-th
   exact score is known, all others whose bound still reaches it. So the k-th result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

CELLS = 64
#: Components of a stripe and of a block of queries, about: each block goes once to every stripe, so few large ones move fewer bytes.
STRIPE_SIZE = 1 << 22
QUERY_SIZE = 1 << 21
#: Stripes are smaller, down to this, where there are fewer than STRIPES_A_CORE for each core.
LEAST_STRIPE_ROWS = 1 << 11
STRIPES_A_CORE = 4
#: Products that are bounded at a time.
PRODUCTS = 1 << 20
#: Exact vectors read for each query before the k-th exact score is known, as a multiple of k.
FIRST_READ = 3
SCALE = 64


def _matrix(group: pa.Table) -> np.ndarray:
    """Vectors of a group, all of one length."""
    flat = pa.chunked_array(group.column("v").chunks).combine_chunks()
    flat = flat.values.slice(flat.offsets[0].as_py(), flat.offsets[-1].as_py() - flat.offsets[0].as_py()) if len(flat) else flat.values
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(group.num_rows, group.column("dim")[0].as_py())


def _smallest(values: np.ndarray) -> np.ndarray:
    """The values as the narrowest signed integers that hold them all."""
    return values.astype(np.result_type(np.min_scalar_type(min(values.min(initial=0), -1)), np.min_scalar_type(-1 - values.max(initial=0))))


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, lowest value and width of each dimension's cells, distance of each vector from the middle of its cells)."""
    low = vectors.min(axis=0)
    width = (vectors.max(axis=0) - low) // CELLS + 1
    cells = ((vectors - low) // width).astype(np.uint8)
    return cells, low, width, np.linalg.norm(vectors - (low + cells * width + (width - 1) / 2), axis=1)


def _stripes(rows: DataFrame) -> DataFrame:
    """The approximation file: one row for each (stripe, dim)."""

    def run(group: pa.Table) -> pa.Table:
        vectors = _matrix(group)
        parts = [group.column("id").to_numpy().astype(np.int64), *cells_of(vectors)]
        data = {name: pa.array([part.tobytes()], pa.binary()) for name, part in zip(("ids", "cells", "low", "width", "away"), parts, strict=True)}
        return pa.table({"stripe": group.column("stripe").slice(0, 1), "dim": group.column("dim").slice(0, 1), **data})

    return rows.groupBy("stripe", "dim").applyInArrow(run, "stripe long, dim int, ids binary, cells binary, low binary, width binary, away binary")


def _blocks(rows: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        data = {"qids": group.column("id").to_numpy().astype(np.int64), "queries": _smallest(_matrix(group))}
        return pa.table({"block": group.column("block").slice(0, 1), "dim": group.column("dim").slice(0, 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in data.items()}})

    return rows.groupBy("block", "dim").applyInArrow(run, "block long, dim int, qids binary, queries binary")


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and the vectors in these cells."""
    return _bounds(queries, _middles(cells, low, width), low, width, away)


def _middles(cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return low + cells * width + (width - 1) / 2


def _bounds(queries: np.ndarray, middles: np.ndarray, low: np.ndarray, width: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (width - 1) / 2
    q = queries.astype(np.float64)
    middle = q @ middles.T
    error = np.minimum((np.abs(q) @ half)[:, None], np.linalg.norm(q, axis=1)[:, None] * away[None, :])
    # Products in doubles are rounded: a part in 2**40 of the greatest sum, and a half, keeps the bounds outside.
    most = np.abs(q).max(initial=0) * float(np.abs(low).max(initial=0) + CELLS * width.max(initial=0)) * max(1, queries.shape[1])
    error = error * (1 + 1e-9) + most / 2**40 + 0.5
    return middle - error, middle + error


def _met(stripes: DataFrame, blocks: DataFrame, floors: DataFrame | None, k: int, n_stripes: int, n_blocks: int) -> DataFrame:
    """Without ``floors`` the k greatest lower bounds of each query in each stripe; else the (query_id, vec_id, upper) that reach the query's floor."""
    # Sizes are estimated before rows are repeated, so these joins must not be left to broadcasts through the driver.
    left = blocks if floors is None else blocks.join(floors.hint("merge"), ["block", "dim"])
    left = left.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_stripes - 1).cast("long"))))
    right = stripes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    columns = ["dim", "qids", "queries", *([] if floors is None else ["floors"]), "ids", "cells", "low", "width", "away"]
    met = left.join(right.hint("merge"), ["block", "stripe", "dim"]).select(*columns)

    floored = floors is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in columns}
                dim = row["dim"]
                qids, ids, low, width = (np.frombuffer(row[c], np.int64) for c in ("qids", "ids", "low", "width"))
                queries, cells = np.frombuffer(row["queries"], f"i{len(row['queries']) // max(1, len(qids) * dim)}" if dim else np.int64).reshape(len(qids), dim), np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
                least = {f["query_id"]: f["floor"] for f in row["floors"]} if floored else {}
                middles, away, step = _middles(cells, low, width), np.frombuffer(row["away"], np.float64), max(1, PRODUCTS // max(1, len(ids)))
                for start in range(0, len(qids), step):
                    part = qids[start : start + step]
                    lower, upper = _bounds(queries[start : start + step], middles, low, width, away)
                    own = part[:, None] == ids[None, :]
                    if not floored:
                        lower[own] = -np.inf
                        best = -np.sort(-lower, axis=1)[:, :k] if lower.shape[1] <= k else -np.sort(np.partition(-lower, k - 1, axis=1)[:, :k], axis=1)
                        q, at = np.nonzero(best > -np.inf)
                        yield pa.RecordBatch.from_arrays([pa.array(part[q]), pa.array(best[q, at])], ["query_id", "lower"])
                    else:
                        floor = np.array([least.get(x, -np.inf) for x in part.tolist()])
                        q, at = np.nonzero((upper >= floor[:, None]) & ~own)
                        yield pa.RecordBatch.from_arrays([pa.array(part[q]), pa.array(ids[at]), pa.array(upper[q, at])], ["query_id", "vec_id", "upper"])

    return met.mapInArrow(run, "query_id long, lower double" if not floored else "query_id long, vec_id long, upper double")


def _scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of pairs, their exact vectors read by equi-joins. Vectors of other lengths than the query's give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            first = a.offsets.to_numpy().astype(np.int64)
            x, y = (c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()].astype(np.int64) for c in (a, b))
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(x * y)))
            first = first - first[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums[first[1:]] - sums[first[:-1]])], ["query_id", "vec_id", "score"])

    one, other = (vectors.select(F.col("id").alias(i), F.col("v").alias(v), F.col("dim").alias(d)) for i, v, d in (("query_id", "q", "dq"), ("vec_id", "v", "dv")))
    met = pairs.select("query_id", "vec_id").join(other, "vec_id").join(one.join(pairs.select("query_id").distinct(), "query_id", "left_semi"), "query_id")
    return met.where("dq = dv").select("query_id", "vec_id", "q", "v").mapInArrow(run, "query_id long, vec_id long, score long").distinct()


def top_k(
    spark: SparkSession, vectors: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None,
) -> DataFrame:
    """The k best other vectors of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(64 * x); the score is their integer inner product. ``queries`` selects the rows that
    ask (a condition on ``id_col``). Rows without an id, null vectors and those with null or non-finite components take no
    part; vectors of another length than the query's are no candidates. Rows repeated in full count once;
    rows of one id are one query. Fewer than k candidates give all of them, an empty table nothing.
    """
    scratch = scratch or Scratch(spark, "vector-top-k")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{vector_col}`").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col("v").isNotNull() & fine)
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = rows.select(F.col(id_col).alias("id"), scaled.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct()
    rows = scratch.write(rows.withColumn("dim", F.size("v")), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max("dim").alias("dim")).first()
    dim = max(1, total["dim"] or 1)
    n_stripes = max(1, -(-total["n"] * dim // STRIPE_SIZE), min(-(-total["n"] // LEAST_STRIPE_ROWS), STRIPES_A_CORE * spark.sparkContext.defaultParallelism))
    n_blocks = -(-(total["q"] or 0) * dim // QUERY_SIZE) or 1
    dealt = F.xxhash64("id")
    stripes = scratch.write(_stripes(rows.withColumn("stripe", F.pmod(dealt, F.lit(n_stripes)))), "cells")
    asking = rows.where("asks").withColumn("block", F.pmod(dealt, F.lit(n_blocks)))
    blocks = scratch.write(_blocks(asking), "blocks")

    def best(scored: DataFrame, column: str, *ties: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc(column), *ties)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    lower = best(_met(stripes, blocks, None, k, n_stripes, n_blocks), "lower").groupBy("query_id").agg(F.min("lower").alias("floor"), F.count("*").alias("n"))
    # Fewer than k others: no floor.
    floor = lower.select("query_id", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))
    floors = asking.select(F.col("id").alias("query_id"), "block", "dim").distinct().join(floor, "query_id")
    floors = floors.groupBy("block", "dim").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))  # a block's queries
    found = scratch.write(_met(stripes, blocks, floors, k, n_stripes, n_blocks), "candidates")
    in_order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    first = found.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= FIRST_READ * k)
    read = scratch.write(_scores(first, rows), "scores")
    certain = best(read, "score", "vec_id").groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    certain = certain.select("query_id", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    rest = found.join(certain, "query_id", "left").where("kth is null or upper >= kth").join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    more = scratch.write(_scores(rest, rows), "scores")
    scratch.only(read, more)
    return best(read.unionByName(more).distinct(), "score", "vec_id").select("query_id", "rank", "vec_id", "score")
