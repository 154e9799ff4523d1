"""Approximate search for many queries at once: queries meet the vectors of the cells (or buckets, or parts) that they ask for.

queries: columns `query` (their id) and `q` (a vector). Results: (query, id, distance, rank), the k nearest by Euclidean distance,
then id. Only an index's training looks at a bounded sample; every vector is in the index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.operators.similar import IVF, PQ, HyperplaneIndex
from strataq.plans.lineage import cut

PART = 20_000  # vectors of a cell that one task holds
ASKED = 8_192  # queries that one task holds
CELLS = 2_000_000  # distances that a task computes at once


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (q ** 2).sum(1)[:, None] - 2 * q @ x.T + (x ** 2).sum(1)))


def _meet(score, keep: int):
    """A cogroup of queries and vectors -> (query, id, score, distance) of each query's `keep` best by score."""
    import pyarrow as pa

    names = ["query", "id", "score", "distance"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = min(keep, right.num_rows)
        out = [np.empty(left.num_rows * rows, kind) for kind in (np.int64, np.int64, float, float)]
        if left.num_rows and rows:
            query, ids, q, x = left["query"].to_numpy(), right["id"].to_numpy(), _matrix(left["q"]), _matrix(right["v"])
            block, to = max(1, CELLS // len(ids)), 0
            for at in range(0, len(q), block):
                part = q[at: at + block]
                d = _distances(part, x)
                s = d if score is None else score(part, right)
                for i in range(len(part)):
                    best = np.lexsort((ids, s[i]))[:keep] if len(ids) <= keep else np.argpartition(s[i], keep - 1)[:keep]
                    for c, v in zip(out, (query[at + i], ids[best], s[i, best], d[i, best])):
                        c[to: to + rows] = v
                    to += rows
        return pa.table([pa.array(c) for c in out], names=names)

    return run


_SCHEMA = "query long, id long, score double, distance double"


def _joined(queries: DataFrame, rows: DataFrame, keys: list[str], keep: int, score=None) -> DataFrame:
    """queries (query, q, *keys) against rows (id, v, *keys). A group of more than PART rows or ASKED queries is dealt to parts and blocks: its queries
    visit all parts, its rows all blocks, so what a task holds and returns is bounded."""
    parts = cut(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    blocks = cut(queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks")))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(parts, keys).join(blocks, keys).withColumn("part", one("id", "parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    queries = queries.join(parts, keys).join(blocks, keys).withColumn("block", one("query", "blocks")).withColumn("part", every("parts")).drop("parts", "blocks")
    group = [*keys, "part", "block"]
    return queries.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(_meet(score, keep), _SCHEMA)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return found.select("query", "id", "distance").distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def _slim(df: DataFrame, id_col: str, vec_col: str, *more) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)


def search_ivf(index: IVF, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Every query visits its nprobe nearest cells."""
    centres = index.centres

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                near = np.argsort(_distances(np.array(b.column(1).to_pylist(), float), centres), 1)[:, :nprobe].astype(np.int32)
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(near.ravel())], ["query", "q", "cell"])

    asked = queries.select(F.col("query").cast("long"), F.col("q").cast("array<double>")).mapInArrow(probe, "query long, q array<double>, cell int")
    return _top(_joined(asked, _slim(index.cells, index.id, index.vec, F.col("cell").cast("int").alias("cell")), ["cell"], k), k)


def search_hashed(index: HyperplaneIndex, queries: DataFrame, k: int) -> DataFrame:
    """Every query visits, in every table, its bucket and those one bit away."""
    planes = index.planes

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            q = np.array(b.column(1).to_pylist(), float)
            for t, p in enumerate(planes):
                code = ((q @ p.T) > 0) @ (1 << np.arange(len(p)))
                keys = np.stack([code, *(code ^ (1 << j) for j in range(len(p)))], 1).astype(np.int32)
                at = np.repeat(np.arange(len(q)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), t, np.int32)), pa.array(keys.ravel())],
                                                 ["query", "q", "table", "key"])

    asked = queries.select(F.col("query").cast("long"), F.col("q").cast("array<double>")).mapInArrow(probe, "query long, q array<double>, table int, key int")
    rows = _slim(index.hashed, index.id, index.vec, F.posexplode("keys").alias("table", "key"))
    return _top(_joined(asked, rows, ["table", "key"], k), k)


def search_pq(index: PQ, queries: DataFrame, k: int, rerank: int = 10) -> DataFrame:
    """Every query visits all codes, part by part; the k * rerank best by their distances to the codes are ranked exactly."""
    books = index.books

    def adc(q: np.ndarray, rows) -> np.ndarray:
        codes = np.asarray(rows["codes"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
        total, at = np.zeros((len(q), len(codes))), 0
        for i, c in enumerate(books):
            part = q[:, at: at + c.shape[1]]
            at += c.shape[1]
            total += (((part ** 2).sum(1)[:, None] - 2 * part @ c.T) + (c ** 2).sum(1))[:, codes[:, i]]
        return total

    asked = queries.select(F.col("query").cast("long"), F.col("q").cast("array<double>"), F.lit(0).alias("cell"))
    rows = _slim(index.codes, index.id, index.vec, "codes", F.lit(0).alias("cell"))
    found = _joined(asked, rows, ["cell"], k * rerank, adc)
    near = F.row_number().over(W.partitionBy("query").orderBy("score", "id"))
    return _top(found.withColumn("near", near).where(F.col("near") <= k * rerank), k)


def save_ivf(index: IVF, path: str) -> None:
    """Write the cells, one folder a cell, and their centres."""
    index.cells.write.partitionBy("cell").parquet(f"{path}/cells")
    spark = index.cells.sparkSession
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")


def open_ivf(spark, path: str, id_col: str, vec_col: str) -> IVF:
    """A stored index: a search reads the folders of the cells that it visits only."""
    index = IVF.__new__(IVF)
    index.id, index.vec, index.cells = id_col, vec_col, spark.read.parquet(f"{path}/cells")
    index.centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # nlist rows
    return index
