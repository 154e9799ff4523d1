"""Bitmaps, permuted keys, versions and diffs, relationships, uniqueness, DML, statistics, security."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# ---- bitmaps: equality, any-of, all-of as filters; as values: blocks of 32768 ids
def bitmap_any(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(F.col(col).isin(*values))


def bitmap_all(df: DataFrame, conditions: dict[str, list]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isin(*v) for c, v in conditions.items()]))


def bitmaps(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """(key, block, bits): for every value of key the ids that have it, as bitmaps of 4 KB."""
    return (df.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("i"))
            .groupBy("key", F.bitmap_bucket_number("i").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("i")).alias("bits")))


def bitmap_union(b: DataFrame) -> DataFrame:
    return b.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersect(b: DataFrame, keys: list) -> DataFrame:
    return (b.where(F.col("key").isin(*keys)).groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(keys)).drop("n"))


def bitmap_cardinality(b: DataFrame) -> DataFrame:
    return b.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


class Ids:
    """Set algebra on frames of ids (column id): what a compressed bitmap does, distributed."""

    def __init__(self, df: DataFrame):
        self.df = df.select("id").distinct()

    def __and__(self, o: Ids) -> Ids:
        return Ids(self.df.join(o.df, "id", "left_semi"))

    def __or__(self, o: Ids) -> Ids:
        return Ids(self.df.union(o.df))

    def __sub__(self, o: Ids) -> Ids:
        return Ids(self.df.join(o.df, "id", "left_anti"))

    def __xor__(self, o: Ids) -> Ids:
        both = self.df.withColumn("a", F.lit(1)).union(o.df.withColumn("a", F.lit(2))).groupBy("id").agg(F.sum("a").alias("a"))
        return Ids(both.where("a <> 3"))

    def complement(self, universe: DataFrame) -> Ids:
        return Ids(universe) - self

    def between(self, low: int, high: int) -> Ids:
        return Ids(self.df.where(F.col("id").between(low, high)))


# ---- permuted keys
def permuted(df: DataFrame, key: list[str], prefix: list = (), tie: str | None = None) -> DataFrame:
    """Rows whose first key columns equal `prefix`, in the key's order."""
    for c, v in zip(key, prefix):
        df = df.where(F.col(c) == v)
    return df.orderBy(*key, *([tie] if tie else []))


# ---- versions
def history(df: DataFrame, id_col: str, version: str, limit: int | None = None) -> DataFrame:
    if limit is None:
        return df.orderBy(id_col, F.desc(version))
    w = W.partitionBy(id_col).orderBy(F.desc(version))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def latest(df: DataFrame, id_col: str, version: str, deleted: str | None = None) -> DataFrame:
    """Newest version of each id by max_by, which combines before the shuffle; deletion markers hide the id."""
    rest = [c for c in df.columns if c not in (id_col, version)]
    out = df.groupBy(id_col).agg(F.max(F.struct(version, *rest)).alias("__v")).select(id_col, "__v.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def at_version(df: DataFrame, id_col: str, version: str, v, deleted: str | None = None) -> DataFrame:
    return latest(df.where(F.col(version) <= v), id_col, version, deleted)


def keep_last(df: DataFrame, id_col: str, version: str, n: int) -> DataFrame:
    return history(df, id_col, version, n)


def keep_for(df: DataFrame, id_col: str, ts: str, now, seconds: int) -> DataFrame:
    """Versions of the last `seconds`; the newest of each id stays in any case."""
    newest = F.max(ts).over(W.partitionBy(id_col))
    return df.withColumn("__n", newest).where((F.col(ts) >= F.lit(now) - F.make_dt_interval(secs=F.lit(seconds))) | (F.col(ts) == F.col("__n"))).drop("__n")


def diff(df: DataFrame, id_col: str, version: str, fields: list[str], against: str = "previous", unchanged: bool = False, same=None) -> DataFrame:
    """(id, version, field, old, new, change): each version's fields against the previous or the latest version.

    change is added, removed, modified or unchanged; `same` maps a field to its own comparison of (old, new).
    """
    w = W.partitionBy(id_col).orderBy(version)
    base = W.partitionBy(id_col).orderBy(version).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    items = []
    for f in fields:
        old = F.lag(f).over(w) if against == "previous" else F.last(f).over(base)
        items.append((f, old))
    rows = df.select(id_col, version, F.lag(F.lit(True)).over(w).alias("__has"), *fields, *[o.alias(f"__old_{f}") for f, o in items])
    parts = []
    for f in fields:
        o, n = F.col(f"__old_{f}"), F.col(f)
        eq = (same or {}).get(f, lambda a, b: a.eqNullSafe(b))(o, n)
        change = F.when(eq, "unchanged").when(o.isNull(), "added").when(n.isNull(), "removed").otherwise("modified")
        parts.append(F.struct(F.lit(f).alias("field"), o.cast("string").alias("old"), n.cast("string").alias("new"), change.alias("change")))
    out = rows.select(id_col, version, "__has", F.explode(F.array(*parts)).alias("d")).select(id_col, version, "__has", "d.*")
    if against == "previous":
        out = out.where("__has")
    return (out if unchanged else out.where("change <> 'unchanged'")).drop("__has")


# ---- relationships
def forward(df: DataFrame, fk: str, target: DataFrame, key: str, how: str = "left") -> DataFrame:
    return df.join(target, df[fk] == target[key], how)


def to_many(parent: DataFrame, key: str, child: DataFrame, fk: str, fields: list[str], name: str) -> DataFrame:
    """Children as a sorted array of structs; unmatched parents get an empty one."""
    lists = child.groupBy(fk).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parent.join(lists, parent[key] == lists[fk], "left").drop(lists[fk])
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def delete_with_rule(parent: DataFrame, key: str, gone: DataFrame, child: DataFrame, fk: str, rule: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after deleting the parents whose key is in `gone` (column key): cascade, nullify, deny or no_action."""
    left = parent.join(gone, key, "left_anti")
    hit = gone.select(F.col(key).alias(fk))
    if rule == "cascade":
        return left, child.join(hit, fk, "left_anti")
    if rule == "nullify":
        mark = hit.distinct().withColumn("__gone", F.lit(True))
        return left, child.join(mark, fk, "left").withColumn(fk, F.when(F.col("__gone"), None).otherwise(F.col(fk))).drop("__gone").select(*child.columns)
    if rule == "deny":
        if not child.join(hit, fk, "left_semi").isEmpty():
            raise ValueError("rows are still referred to")
        return left, child
    return left, child


def violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with nulls don't count."""
    for k in key:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---- DML on copy-on-write frames
def insert(df: DataFrame, rows: DataFrame, key: str | None = None, on_conflict: str = "error", set_: dict[str, Column] | None = None) -> DataFrame:
    """on_conflict: error, nothing, replace or update (set_ over columns of the old row and `new.*` as struct column new)."""
    rows = rows.select(*df.columns)
    if key is None:
        return df.unionByName(rows)
    if on_conflict == "error":
        if not rows.join(df, key, "left_semi").isEmpty():
            raise ValueError("duplicate key")
        return df.unionByName(rows)
    if on_conflict == "nothing":
        return df.unionByName(rows.join(df, key, "left_anti"))
    if on_conflict == "replace":
        return df.join(rows, key, "left_anti").unionByName(rows)
    new = rows.select(F.col(key).alias("__k"), F.struct(*rows.columns).alias("new"))
    hit = df.join(new, df[key] == F.col("__k"), "left")
    upd = hit.select(*[F.when(F.col("__k").isNotNull(), (set_ or {})[c]).otherwise(F.col(c)).alias(c) if c in (set_ or {}) else F.col(c) for c in df.columns])
    return upd.unionByName(rows.join(df, key, "left_anti"))


def update(df: DataFrame, cond: Column, set_: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return df.select(*[F.when(hit, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in df.columns])


def delete(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(~F.coalesce(cond, F.lit(False)))


def apply_changes(df: DataFrame, key: str, changes: DataFrame, seq: str = "seq", op: str = "op") -> DataFrame:
    """A unit of work: the last change of each key (insert, upsert, update, delete) decides. An update of a missing key is dropped."""
    rest = [c for c in changes.columns if c not in (key, seq)]
    last = changes.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("c"), F.max(F.col(op).isin("insert", "upsert")).alias("__new")).select(key, "c.*", "__new").drop(seq)
    have = df.select(F.col(key)).withColumn("__old", F.lit(True))
    last = last.join(have, key, "left").where((F.col(op) != "update") | F.col("__old") | F.col("__new")).drop("__old", "__new")
    return df.join(last, key, "left_anti").unionByName(last.where(F.col(op) != "delete").select(*df.columns))


# ---- statistics
def equi_depth(df: DataFrame, col: str, buckets: int) -> DataFrame:
    """(bucket, low, high, n): bounds by approximate percentiles, counts in one pass."""
    ps = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(col, ps, 10_000).alias("b"))
    at = F.size(F.filter("b", lambda x: x < F.col(col)))
    return (df.where(F.col(col).isNotNull()).select(col).join(F.broadcast(bounds)).groupBy(at.alias("bucket"))  # one row
            .agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count(F.lit(1)).alias("n")))


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    n = df.agg(F.count(col).alias("__n"))
    top = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
    return top.join(F.broadcast(n)).select("value", "n", (F.col("n") / F.col("__n")).alias("frequency"))  # one row


def reservoir(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows, the same at every run: the k least hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(k)


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_count"), F.count_distinct(F.col(c)).alias(f"{c}_distinct"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs)


def selectivity(df: DataFrame, cond: Column) -> DataFrame:
    return df.agg((F.sum(F.coalesce(cond, F.lit(False)).cast("long")) / F.count(F.lit(1))).alias("selectivity"))


def scrub(source: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a derived table lacks or has too much."""
    a = source.select(*key).join(derived.select(*key), key, "left_anti").withColumn("problem", F.lit("missing"))
    b = derived.select(*key).join(source.select(*key), key, "left_anti").withColumn("problem", F.lit("dangling"))
    return a.unionByName(b)


# ---- security
def secured(df: DataFrame, row_filter: Column | None = None, masked: dict[str, Column] | None = None, hidden: list[str] = ()) -> DataFrame:
    """A view that a reader may see: rows filtered first, then fields masked or left out."""
    if row_filter is not None:
        df = df.where(F.coalesce(row_filter, F.lit(False)))
    return df.select(*[(masked or {}).get(c, F.col(c)).alias(c) for c in df.columns if c not in hidden])
