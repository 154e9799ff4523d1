"""Operator 2: near-duplicate embeddings by a subspace pigeonhole join."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import bounded_batches, connected_components, load, lookup, materialize, tidied

COSINE = 0.98
DIMS = 8  # of a block, and of its grid at most
CHUNK = 8_000  # vectors of a cell that one task holds from either side
SEED = 20_240_501


def _halves(x: np.ndarray) -> np.ndarray:
    """Row sums by halving: the same additions for a row whatever the batch, so every task gets equal bits."""
    while x.shape[1] > 1:
        h = x.shape[1] // 2
        x = x[:, :h] + x[:, h: 2 * h] if x.shape[1] % 2 == 0 else np.concatenate([x[:, :h] + x[:, h: 2 * h], x[:, 2 * h:]], 1)
    return x[:, 0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is about 1 and squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def rotate(x: np.ndarray) -> np.ndarray:
    """Scaled vectors as unit vectors, turned by random signs, a permutation and a Hadamard transform (an orthogonal map of the padded space)."""
    d = 1 << max(3, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng(SEED)
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x / np.sqrt(_halves(x * x))[:, None]
    out = out[:, rng.permutation(d)] * rng.choice([-1.0, 1.0], d)
    h = 1
    while h < d:
        y = out.reshape(len(x), d // (2 * h), 2, h)
        out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), d)
        h *= 2
    return out / np.sqrt(d)


def _encode(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing."""
    small = x.astype("<f4")
    exact = (small == x).all(1)
    return [small[i].tobytes() if exact[i] else x[i].tobytes() for i in range(len(x))]


def _decode(col, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(float) for v in col])


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return (vectors.where(F.col(label_col).isNotNull() & v.isNotNull() & finite & some)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")))


def _blocks(d: int, dims: int) -> tuple[int, int]:
    """(number, size) of the blocks of rotated vectors of d components, a power of two of at least 8."""
    m = min(dims, d // 2)
    return d // m, m


def _grid(levels: int, m: int) -> list[int]:
    """Sides of the grid's cells along the first axes of a block, in reaches. A level halves the cells, about: one axis more, at
    four reaches, then, when a block has no more axes, two reaches along an axis."""
    levels = max(0, min(levels, 2 * m))
    return [2 if a < levels - m else 4 for a in range(min(levels, m))]


def _levels(n: int, chunk: int) -> int:
    return max(0, -(-n // chunk) - 1).bit_length()


def _cells(dims: int, cosine: float, chunk: int, with_vectors: bool = True):
    """Rows of (label, dim, block, cell, away, id, size, vector) from (id, label, v, size, of the label's vectors).

    A vector goes to its own cell of every block's grid, and along each axis to the cell below too if vectors there are
    within reach. So two vectors within reach along all axes meet in the cell that is the lower of theirs along every
    axis; there, along each axis one of them at least is at home. `away`: the axes, as bits, along which it is not.
    """
    limit = 2 - 2 * cosine + 1e-9

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(2).to_pylist()
            kind = [(len(v), _levels(n, chunk)) for v, n in zip(raw, b.column(4).to_pylist())]
            for dim, levels in sorted(set(kind)):
                at = np.array([i for i, k in enumerate(kind) if k == (dim, levels)])
                x = np.array([raw[i] for i in at])
                r = rotate(scaled(x))
                count, m = _blocks(r.shape[1], dims)
                reach = np.sqrt(limit * m / r.shape[1])
                labels, ids, sizes = (b.column(k).take(pa.array(at)) for k in (1, 0, 3))
                data = pa.array(_encode(x), pa.binary()) if with_vectors else None
                for block in range(count):
                    who, cell, away = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
                    for a, side in enumerate(_grid(levels, m)):
                        c = r[:, block * m + a]
                        home, low = (np.floor(v / (side * reach)).astype(np.int64) for v in (c, c - reach))
                        lower = np.flatnonzero((low < home)[who])
                        cell, below = cell * 1_000_003 + home[who], cell[lower] * 1_000_003 + low[who[lower]]  # wraps around: a hash
                        who, cell, away = np.r_[who, who[lower]], np.r_[cell, below], np.r_[away, away[lower] | 1 << a]
                    take, n = pa.array(who), len(who)
                    cols = [labels.take(take), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(cell)]
                    names = ["label", "dim", "block", "cell"]
                    if with_vectors:
                        cols += [pa.array(away), ids.take(take), sizes.take(take), data.take(take)]
                        names += ["away", "id", "size", "v"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


class _Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        u, v = self.root[p], self.root[q]
        apart = u != v
        if not apart.any():
            return
        pairs = np.unique(np.stack([u[apart], v[apart]]), axis=1)
        parent: dict[int, int] = {}

        def find(k):
            while (up := parent.get(k, k)) != k:
                parent[k] = parent.get(up, up)
                k = up
            return k

        for u, v in pairs.T.tolist():
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        to = np.arange(len(self.root))
        to[list(parent)] = [find(k) for k in list(parent)]
        self.root = to[self.root]


def _joined(dim: int, block: int, split: bool, part, away, ids, sizes, x, dims: int, cosine: float):
    """(id, links, smallest id reached) of one cell (or one pair of its parts).

    A candidate lies within the block's share of the distance; it is taken in the first block that lets it through and in
    one cell of it (see _cells), so a link is found once however many blocks and cells show it. Single-precision products
    find candidates with a margin; double precision decides on the block's distance and on the cosine.
    """
    limit = 2 - 2 * cosine + 1e-9
    order = np.argsort(ids, kind="stable")
    part, away, ids, sizes, x = part[order], away[order], ids[order], sizes[order], scaled(x[order])
    r = rotate(x)
    _, m = _blocks(r.shape[1], dims)
    budget = limit * m / r.shape[1]
    norm = np.sqrt(_halves(x * x))
    unit = x / norm[:, None]
    links, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    own = r[:, block * m: (block + 1) * m]

    def share(p, q, e):
        d = r[p, e * m] - r[q, e * m]
        s = d * d
        for k in range(1, m):
            d = r[p, e * m + k] - r[q, e * m + k]
            s = s + d * d
        return s

    line = np.argsort(own[:, m - 1], kind="stable")  # the grid takes this axis last
    axis, flat = own[line, m - 1], own[line].astype(np.float32)
    square = (flat * flat).sum(1)
    ends = np.searchsorted(axis, axis + np.sqrt(budget), side="right")
    for a in range(0, len(line), 512):
        b, top = min(a + 512, len(line)), int(ends[min(a + 512, len(line)) - 1])
        near = square[a:b, None] + square[None, a:top] - 2 * (flat[a:b] @ flat[a:top].T) <= np.float32(budget + 1e-5)
        left, right = np.nonzero(near)
        keep = right > left
        left, right = left[keep], right[keep]
        if not len(left):
            continue
        cos = None
        if len(left) > 4 * (b - a):  # dense: all cosines at once, those at the limit again as below
            cos = (unit[line[a:b]] @ unit[line[a:top]].T)[left, right]
        i, j = line[a + left], line[a + right]
        i, j = np.minimum(i, j), np.maximum(i, j)
        for s in range(0, len(i), 100_000):
            p, q = i[s: s + 100_000], j[s: s + 100_000]
            c = None if cos is None else cos[s: s + 100_000]
            ok = (away[p] & away[q]) == 0
            if split:
                ok &= part[p] != part[q]
            if c is not None:
                ok &= c >= cosine - 1e-9
            p, q, c = p[ok], q[ok], None if c is None else c[ok]
            ok = share(p, q, block) <= budget
            for e in range(block):  # an earlier block has it
                ok[ok] = share(p[ok], q[ok], e) > budget
            p, q, c = p[ok], q[ok], None if c is None else c[ok]
            unsure = np.ones(len(p), bool) if c is None else c < cosine + 1e-9
            u, v = p[unsure], q[unsure]
            sure = ~unsure
            sure[unsure] = _halves(x[u] * x[v]) / (norm[u] * norm[v]) >= cosine
            p, q = p[sure], q[sure]
            np.add.at(links, p, sizes[q])
            np.add.at(links, q, sizes[p])
            forest.join(p, q)
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], ids[forest.root[hit]]


def _joiner(dims: int, cosine: float):
    """Over rows sorted by cell and pair of parts: (id, links, to) of each cell."""
    names = ["id", "links", "to"]

    def out(rows):
        (label, dim, block, cell, first, second), (part, away, ids, sizes), v = rows
        n = len(ids)
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in (label, dim, block, cell, first, second)])
        starts = np.flatnonzero(new)
        found = []
        for s, e in zip(starts, np.r_[starts[1:], n]):
            if e - s > 1:
                d = int(dim[s])
                found.append(_joined(d, int(block[s]), first[s] != second[s], part[s:e], away[s:e], ids[s:e], sizes[s:e], _decode(v[s:e], d), dims, cosine))
        cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches):
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(0).to_numpy(zero_copy_only=False), *(b.column(k).to_numpy() for k in range(1, 6))]
            now = [key, [b.column(k).to_numpy() for k in range(6, 10)], b.column(10).to_pylist()]
            last = int(np.flatnonzero(~np.logical_and.reduce([k == k[-1] for k in key]))[-1]) + 1 if not all((k == k[-1]).all() for k in key) else 0
            if held and any(h[-1] != k[0] for h, k in zip(held[-1][0], key)):
                yield out(_merged(held))
                held = []
            if last:
                yield out(_merged([*held, [[k[:last] for k in now[0]], [c[:last] for c in now[1]], now[2][:last]]]))
                held = []
            held.append([[k[last:] for k in now[0]], [c[last:] for c in now[1]], now[2][last:]])
        if held:
            yield out(_merged(held))

    return run


def _merged(parts):
    if len(parts) == 1:
        return parts[0]
    return [[np.concatenate(c) for c in zip(*(p[k] for p in parts))] for k in (0, 1)] + [[v for p in parts for v in p[2]]]


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, dims: int = DIMS, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: id, n_links (other vectors of equal label with cosine >= `cosine`), component_id (smallest
    id reachable by links) and kept (id = component_id).

    Unit vectors of cosine c are 2-2c apart squared; cut into blocks of `dims` rotated components, one block is within its
    share (pigeonhole). A range join finds such pairs block by block: a grid on as many axes of the block as the label's
    vectors ask for (none for at most `chunk`, one more for each doubling) shares out the work, a sorted axis and one product
    of matrices a strip find pairs within the whole block's share, and the exact cosine decides. Equal vectors are one class
    first, so copies cost nothing; tasks return counts and forests, never pairs. A cell of more than `chunk` vectors is
    joined part by part, each pair of parts in a group of its own. The grid and the parts decide where pairs meet, not
    which.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label link with
    nothing: each is its own component. Very large and very small components are scaled first. Vectors of different lengths
    never link. Rows that repeat an id count as separate vectors for n_links, and share a component. Extra columns are
    ignored; an empty table gives an empty result. The id must be an integer or a string of one.
    """
    bounded_batches(vectors.sparkSession)
    every = vectors.select(F.col(id_col), F.col(vec_col), F.col(label_col))
    classes = materialize(_usable(every, id_col, vec_col, label_col).groupBy("label", "v")
                          .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")).where("id is not null"))
    of_label = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wide = lookup(classes, of_label, "label", "n", F.xxhash64("id"), check=True).select("id", "label", "v", "size", "n")
    key = ["label", "dim", "block", "cell"]
    places = "label string, dim int, block int, cell long"
    large = wide.mapInArrow(tidied(_cells(dims, cosine, chunk, False)), places).groupBy(F.xxhash64(*key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    large = materialize(large.where(F.col("n") > chunk).select("k", "n", F.ceil(F.col("n") / chunk).cast("int").alias("parts")))
    cells = wide.mapInArrow(tidied(_cells(dims, cosine, chunk)), places + ", away int, id long, size long, v binary").withColumn("k", F.xxhash64(*key))
    rows = lookup(cells, large, "k", "n", F.xxhash64("id"), check=True).withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))
    rows = rows.withColumn("pair", F.explode(pairs)).select(*key, F.col("pair.a").alias("first"), F.col("pair.b").alias("second"), "part", "away", "id", "size", "v")
    group = [*key, "first", "second"]
    found = materialize(rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidied(_joiner(dims, cosine)), "id long, links long, to long"))
    comps = connected_components(found.where("id <> to").select("id", "to")).withColumnRenamed("node", "id").withColumnRenamed("component", "root")
    per_class = found.groupBy("id").agg(F.sum("links").alias("links")).join(comps, "id", "left")
    table = (classes.select("label", "v", "id", "size").join(per_class, "id", "left")
             .select(F.sha2(F.concat_ws("|", "label", F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")), 256).alias("k"),
                     F.coalesce("root", "id").alias("root"), "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")))
    v = F.col("__v").cast("array<double>")
    flat = F.sha2(F.concat_ws("|", F.col("__l").cast("string"), F.array_join(F.transform(v, lambda x: (x + 0.0).cast("string")), ",")), 256)
    base = every.select(F.col(id_col), F.col(vec_col).alias("__v"), F.col(label_col).alias("__l"))
    ok = F.col("__l").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    narrow = base.select(id_col, F.when(ok, flat).alias("k"))
    out = lookup(narrow, table.select("k", "root", "size", "links"), "k", "size", F.xxhash64(id_col))
    root = F.coalesce(F.col("root"), F.col(id_col).cast("long"))
    return out.select(id_col, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
                      F.col(id_col).eqNullSafe(root).alias("kept"))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup(load(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
c(u, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.w, c.r FROM c JOIN l ON l.u = c.u),
m AS (SELECT u, min(r) AS r FROM c GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.r AS component_id, m.r = vec_id AS kept
FROM embeddings JOIN m ON m.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
