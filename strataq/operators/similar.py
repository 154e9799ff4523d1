"""Vector search: exact top-k, inverted cells (IVF), product quantisation, a hashed index; spatial search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import spatial as S
from strataq.functions import vector as V


def knn(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest by distance, then id. Filters come before the distance; the top-k is a TakeOrdered, without a full sort."""
    if where is not None:
        df = df.where(where)
    d = V.distance(metric, F.col(vec_col), V.literal(query))
    return df.where(F.size(vec_col) == len(query)).select(id_col, d.alias("distance")).orderBy("distance", id_col).limit(k)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        at = (((x ** 2).sum(1)[:, None] - 2 * x @ c.T) + (c ** 2).sum(1)).argmin(1)
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return c


def _sample(df: DataFrame, id_col: str, vec_col: str, rows: int) -> np.ndarray:
    """At most `rows` vectors, by a hash of the id: the bound of every training here."""
    got = df.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(rows).select(vec_col).collect()
    return np.array([r[0] for r in got], float)


class IVF:
    """k-means cells, learned on a bounded sample; a query reads the vectors of its nprobe nearest cells."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, nlist: int = 100, rounds: int = 20, train_rows: int = 20_000):
        self.id, self.vec = id_col, vec_col
        self.centres = _kmeans(_sample(df, id_col, vec_col, train_rows), nlist, rounds)
        near = [F.struct(V.distance("euclidean", F.col(vec_col), V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]
        self.cells = df.withColumn("cell", F.array_min(F.array(*near))["i"])

    def search(self, query: list[float], k: int, nprobe: int = 10, metric: str = "euclidean") -> DataFrame:
        d = ((self.centres - np.array(query)) ** 2).sum(1)
        probe = [int(i) for i in np.argsort(d)[:nprobe]]
        return knn(self.cells, self.id, self.vec, query, k, metric, F.col("cell").isin(probe))


class PQ:
    """Product quantisation: m codes a vector; distances come from a table of the query (ADC), then an exact re-rank."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, m: int = 8, ksub: int = 256, rounds: int = 25, train_rows: int = 5_000):
        self.id, self.vec, self.m = id_col, vec_col, m
        x = _sample(df, id_col, vec_col, train_rows)
        self.books = [_kmeans(part, ksub, rounds) for part in np.array_split(x, m, axis=1)]
        books = self.books

        def encode(batches):
            import pyarrow as pa

            for b in batches:
                v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, sum(c.shape[1] for c in books)))
                codes, at = [], 0
                for c in books:
                    part = v[:, at: at + c.shape[1]]
                    codes.append((((part ** 2).sum(1)[:, None] - 2 * part @ c.T) + (c ** 2).sum(1)).argmin(1))
                    at += c.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.stack(codes, 1).tolist() if b.num_rows else [], pa.list_(pa.int32()))], [id_col, vec_col, "codes"])

        kind = df.schema[id_col].dataType.simpleString(), df.schema[vec_col].dataType.simpleString()
        self.codes = df.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(encode, f"{id_col} {kind[0]}, {vec_col} {kind[1]}, codes array<int>")

    def search(self, query: list[float], k: int, rerank: int = 10) -> DataFrame:
        q, at, total = np.array(query), 0, F.lit(0.0)
        for i, c in enumerate(self.books):
            table = ((c - q[at: at + c.shape[1]]) ** 2).sum(1)
            at += c.shape[1]
            total = total + F.get(V.literal(table), F.get("codes", F.lit(i)))
        near = self.codes.withColumn("__adc", total).orderBy("__adc", self.id).limit(k * rerank)
        return knn(near, self.id, self.vec, query, k, "euclidean")


class HyperplaneIndex:
    """In place of a navigable graph, which is a sequential structure: hashed buckets by random hyperplanes, several tables; the
    candidates of the query's buckets (and of buckets one bit away) are ranked exactly."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, dims: int, tables: int = 8, bits: int = 6, seed: int = 7):
        self.id, self.vec = id_col, vec_col
        self.planes = np.random.default_rng(seed).standard_normal((tables, bits, dims))
        keys = []
        for t in self.planes:
            code = F.lit(0)
            for i, p in enumerate(t):
                code = code + F.when(V.dot(F.col(vec_col), V.literal(p)) > 0, 1 << i).otherwise(0)
            keys.append(code)
        self.hashed = df.withColumn("keys", F.array(*keys))

    def search(self, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
        cond = F.lit(False)
        for i, t in enumerate(self.planes):
            code = sum(1 << j for j, p in enumerate(t) if float(p @ np.array(query)) > 0)
            cond = cond | F.get("keys", F.lit(i)).isin([code, *[code ^ (1 << j) for j in range(len(t))]])
        return knn(self.hashed.where(cond), self.id, self.vec, query, k, metric)


class Spatial:
    def __init__(self, df: DataFrame, id_col: str, lat: str, lon: str):
        self.df, self.id, self.lat, self.lon = df, id_col, F.col(lat), F.col(lon)

    def _distance(self, at) -> Column:
        return S.haversine(self.lat, self.lon, at[0], at[1])

    def within_radius(self, at: tuple[float, float], metres: float) -> DataFrame:
        rows = self.df.where(S.radius_box(self.lat, self.lon, at, metres))
        return rows.withColumn("distance", self._distance(at)).where(F.col("distance") <= metres)

    def within_box(self, south, west, north, east) -> DataFrame:
        return self.df.where(S.box(self.lat, self.lon, south, west, north, east))

    def within_polygon(self, ring, holes=(), how: str = "ray") -> DataFrame:
        lats, lons = [p[0] for p in ring], [p[1] for p in ring]
        rows = self.df.where(S.box(self.lat, self.lon, min(lats), min(lons), max(lats), max(lons)))
        cond = {"ray": lambda: S.in_polygon(self.lat, self.lon, ring, holes), "winding": lambda: S.winding(self.lat, self.lon, ring) != 0,
                "convex": lambda: S.in_convex(self.lat, self.lon, ring)}[how]()
        return rows.where(cond)

    def nearest(self, at: tuple[float, float], k: int, max_metres: float | None = None) -> DataFrame:
        """Exact k nearest (of those within max_metres); sorting comes before the limit."""
        rows = self.within_radius(at, max_metres) if max_metres else self.df.withColumn("distance", self._distance(at))
        return rows.orderBy("distance", self.id).limit(k)
