"""What the operators of this subpackage share: the shared folder, size-bounded filters,
skew-safe look-ups and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.plans.lineage import WATCHERS, delete, made, shared_folder
from strataq.plans.prefix import running_sum  # noqa: F401  used by the operators

WS = "[\\x20\\x09-\\x0D]"
NON_WS = "[^\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table made by materialize once nothing reads it any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/strataq-" in f:
            delete(df.sparkSession, f)


def settled(spark: SparkSession, make) -> DataFrame:
    """The frame that make() returns, as a table; all tables that were made on the way are deleted."""
    seen: list[str] = []
    WATCHERS.append(seen)
    try:
        out = materialize(make())
    finally:
        WATCHERS[:] = [w for w in WATCHERS if w is not seen]
    for path in seen[:-1]:
        delete(spark, path)
    return out


def unique_ids(rows: DataFrame, nulls_first: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(rows, back): rows with a unique long `id`. They have columns id and text, and perhaps others.

    Where no id is null or repeats, rows are returned as they are and back is None. Else every row is numbered in the order of
    id, then text hash (equal rows in any order), and back is (id, own): the numbers and the ids that they stand for.
    """
    if not rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        return rows, None
    by_id = F.col("id").asc_nulls_first() if nulls_first else F.col("id").asc_nulls_last()
    order = [by_id, F.xxhash64("text"), F.col("__m")]
    out = running_sum(rows.withColumns({"__m": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")}), order, "__one", "__n").drop("__m", "__one")
    out = materialize(out)
    return out.withColumn("id", F.col("__n")).drop("__n"), out.select(F.col("__n").alias("id"), F.col("id").alias("own"))


BATCH_ROWS = 4000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, if the session allows more: texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def tidied(run, *forget):
    """A mapInArrow function that ends by calling `forget` (module-level functions) and giving free memory back.

    Python workers outlive their tasks and serve later stages, where what a task has left behind would count.
    """
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---- membership filters of bounded size
FILTER_BITS = 1 << 23  # 1 MB where nothing is known of the number of keys
MAX_FILTER_BITS = 1 << 28  # 32 MB
BITS_A_KEY = 8


class BitFilter:
    """A one-hash Bloom filter as rows (slot, bits) of 4 KB each."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size


def bit_filter(keys: DataFrame, key: Column, n: int | None = None) -> BitFilter:
    """A filter of `key`, of BITS_A_KEY bits for each of its n entries, at most MAX_FILTER_BITS (32 MB), so it may be broadcast.

    n: the number of keys, or a bound of it, where it is known. The filter can only say "perhaps" or "no"; beyond 2^28 / 8 keys it passes more
    and more, and results stay whole because an exact step always follows. Null keys are not entered.
    """
    size = FILTER_BITS if n is None else max(FILTER_BITS, min(MAX_FILTER_BITS, 1 << max(n * BITS_A_KEY - 1, 1).bit_length()))
    h = F.pmod(F.xxhash64(key), F.lit(size))
    rows = (keys.where(key.isNotNull())
            .select(h.alias("h"))
            .select((F.col("h") / 32768).cast("int").alias("slot"), (F.col("h") % 32768).alias("p"))
            .groupBy("slot")
            .agg(F.bitmap_construct_agg("p").alias("bits")))
    return BitFilter(rows, size)


def with_membership(df: DataFrame, bits: BitFilter, key: Column, name: str) -> DataFrame:
    """Add boolean `name`: whether `key` may be in the filter. The filter is broadcast; its size is bounded, see bit_filter."""
    h = F.pmod(F.xxhash64(key), F.lit(bits.size))
    b = bits.rows.select(F.col("slot").alias("__slot"), F.col("bits").alias("__bits"))
    at = ((h % 32768) / 8).cast("int") + 1
    byte = F.conv(F.hex(F.substring(F.col("__bits"), at, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (h % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return (
        df.withColumn("__slot", (h / 32768).cast("int"))
        .join(F.broadcast(b), "__slot", "left")
        .withColumn(name, key.isNotNull() & F.coalesce(hit, F.lit(False)))
        .drop("__slot", "__bits")
    )


# ---- look-ups under skew
HEAVY = 1024  # rows of a look-up table that are broadcast


def lookup(df: DataFrame, table: DataFrame, key: str, weight: str, salt: Column, check: bool = False) -> DataFrame:
    """Left join df with table (unique in `key`), where a few keys, or null, may hold most rows of df.

    The HEAVY keys of largest `weight` are broadcast (their number is fixed). Rows that they serve, and rows whose key is
    null and so can have no match, take a random join key, so that no task gets a hot key. df keeps its rows: each gets
    its one match or nulls. With `check` the table is counted first, and broadcast as a whole if it has at most HEAVY
    rows, so that wide rows of df need no shuffle at all.
    """
    values = [c for c in table.columns if c != key]
    if check and table.limit(HEAVY + 1).count() <= HEAVY:
        small = table.select(F.col(key).alias("__hk"), *[F.col(v).alias(f"__v_{v}") for v in values])
        out = df.join(F.broadcast(small), F.col(key) == F.col("__hk"), "left")
        return out.select(*[F.col(c) for c in df.columns], *[F.col(f"__v_{v}").alias(v) for v in values])
    heavy = table.orderBy(F.desc(weight), key).limit(HEAVY).select(
        F.col(key).alias("__hk"), F.struct(*values).alias("__hv"))
    rest = table.select(F.concat(F.lit("="), F.col(key).cast("string")).alias("__jk"), F.struct(*values).alias("__rv"))
    out = (
        df.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
        .withColumn("__jk", F.when(F.col("__hk").isNotNull() | F.col(key).isNull(), F.concat(F.lit("~"), salt.cast("string")))
                    .otherwise(F.concat(F.lit("="), F.col(key).cast("string"))))
        .join(rest, "__jk", "left")
    )
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.coalesce(F.col(f"__hv.{v}"), F.col(f"__rv.{v}")).alias(v) for v in values])


def keep_decided(df: DataFrame, decided: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of df without those that `decided` (the columns `keys`, unique, and boolean kept) rejects.

    Only rows that a filter of bounded size lets through are shuffled; the others have no decision and stay where they
    are. decided should be a table: it is read more than once. keys: expressions over df, none null. Rows equal in all keys that are decided on stay once.
    """
    names = list(keys)
    out = df.columns
    bits = bit_filter(decided, F.xxhash64(*names), decided.count())
    flagged = with_membership(df.withColumns({f"__{k}": e for k, e in keys.items()}), bits, F.xxhash64(*[f"__{k}" for k in names]), "__maybe")
    rest = flagged.where("__maybe").join(decided.select(*[F.col(k).alias(f"__{k}") for k in names], F.col("kept").alias("__kept")), [f"__{k}" for k in names], "left")
    # rows that the filter let through without a decision are told apart, so that none of them goes
    rest = rest.where(F.coalesce("__kept", F.lit(True))).withColumn("__own", F.when(F.col("__kept").isNull(), F.monotonically_increasing_id()))
    rest = rest.dropDuplicates([*(f"__{k}" for k in names), "__own"])
    return flagged.where(~F.col("__maybe")).select(*out).union(rest.select(*out))


# ---- connected components
def _forest(batches):
    """Replace the edges of one partition by a forest with the same components (stars about the smallest id)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    items = [(x, r) for x in parent if (r := find(x)) != x]
    for i in range(0, len(items), 100_000):
        part = items[i: i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node id.

    edges: two long columns. Each round contracts every partition's edges to a forest, then runs one large-star
    and one small-star step on the rest; all of it is distributed and each round is checkpointed to the shared
    folder. Rounds shrink distances geometrically; it stops when a round changes nothing.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    cur = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    cur = materialize(cur.mapInArrow(tidied(_forest), "u long, v long"))
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        nxt = materialize(small)
        n, s = nxt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        remove(cur)
        cur = nxt
        if (n, s) == before:
            break
        before = (n, s)
    else:
        raise RuntimeError("connected components did not settle")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
