"""Operator 7: SimHash near-deduplication by random bit sampling."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import bit_filter, bounded_batches, connected_components, load, lookup, materialize, tidied, unique_ids, with_membership

SHINGLE = 5  # words
SIMILARITY = (8, 10)  # Jaccard of shingle sets, as a fraction
TABLES, BITS = 48, 14
SAMPLED = -(-TABLES * BITS // 64) * 64  # coordinates that the tables sample from, no two tables the same one
CHECKED = 256  # other coordinates, on which distances are checked
SHORT = 64  # shingles of a set whose links are found by common shingles, not by coordinates
COMMON, COMMON_SETS = 1 << 16, 16  # shingles that most short sets hold are told by number: at most so many, each in more than so many sets
PAIRS = 20_000  # pairs of short sets that are compared at once
SHORT_DISTANCE = 96  # of CHECKED, for these: sets of 4 and 5 shingles differ in 48 on average, with a deviation of 6.2
DISTANCE = 64  # of CHECKED: 4.5 standard deviations above the mean at the similarity
BUCKET = 4096  # rows of a bucket, or of a part of it, that one task compares
AGREEMENT, LOST = 0.848, 0.01  # of a coordinate, of pairs at the similarity; of such pairs, what additional bits may cost a table
PIVOTS = 8  # texts of a component that each of its parts is compared with
COMPONENT = 500  # texts of a candidate component that one task holds from either side
_WORD = re.compile(r"\w+")
_KEYS = np.random.default_rng(77).integers(1, 2**63, (SAMPLED + CHECKED) // 64, dtype=np.uint64)
_STEPS = np.random.default_rng(78).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """The hashes of words, as bytes; a full one begins anew."""

    def __missing__(self, word: str) -> bytes:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_digest(word)
        return got


_HASHES = _Hashes()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` words, in lower case; of fewer words, one for all."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64)
    n = max(1, len(x) - size + 1)
    h = np.full(n, len(x) if len(x) < size else size, np.uint64)
    for k in range(min(size, len(x))):
        h += x[k: k + n] * _STEPS[k]
    h = np.sort(_mix(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def forget() -> None:
    _HASHES.clear()


def fingerprint(s: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set as packed bits: by coordinate, the majority of the shingles' hash bits."""
    counts = np.zeros(64 * len(_KEYS), np.int64)
    for at in range(0, len(s), 8192):
        part = s[at: at + 8192]
        bits = np.unpackbits(_mix(part[:, None] ^ _KEYS[None, :]).view(np.uint8), axis=1)
        lanes = bits.view(np.uint64)
        for k in range(0, len(part), 255):  # eight counters to a word
            counts += lanes[k: k + 255].sum(0).view(np.uint8)
    return np.packbits(2 * counts > len(s))


def prefix(s: np.ndarray, similarity=SIMILARITY) -> np.ndarray:
    """The first hashes of a set in any order that all sets share, as many as it takes for two sets that are similar enough to have one in common."""
    return s[: len(s) + 1 + -len(s) * similarity[0] // similarity[1]]


def _fingerprints(names):
    """(id, text, *carried) -> (id, *carried, sig, print, short): short is the set itself, if it has at most SHORT shingles."""
    def run(batches):
        for b in batches:
            sigs, prints, shorts = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                prints.append(fingerprint(s).tobytes() if len(s) else None)
                shorts.append(s.view(np.int64) if 0 < len(s) <= SHORT else None)
            made = [pa.array(sigs, pa.string()), pa.array(prints, pa.binary()), pa.array(shorts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(2, b.num_columns)), *made], ["id", *names, "sig", "print", "short"])

    return run


def _samples(tables: int, bits: int) -> np.ndarray:
    """Coordinates by table; as long as SAMPLED suffices, no two tables share one."""
    rng = np.random.default_rng(79)
    each = SAMPLED // bits
    return np.concatenate([rng.permutation(SAMPLED)[: each * bits].reshape(each, bits) for _ in range(-(-tables // each))])[:tables]


def _words(prints: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of packed fingerprints: all bytes, and the checked coordinates as words."""
    raw = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1)
    return raw, np.ascontiguousarray(raw[:, SAMPLED // 8:]).view(np.int64)


def _tables(tables: int, bits: int):
    samples = _samples(tables, bits)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw, words = _words(b.column(1))
            bit = np.unpackbits(raw, axis=1)
            rest = [pa.array(words[:, k]) for k in range(CHECKED // 64)]
            for t in range(tables):
                key = bit[:, samples[t]].astype(np.int64) @ powers + (t << 48)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), *rest], ["bucket", "id", "f0", "f1", "f2", "f3"])

    return run


def _windows(table: int, bits: int, extra: int, samples: np.ndarray) -> np.ndarray:
    """The additional coordinates by repetition: of those that the table itself does not sample, `extra` at a time, none twice
    before all have had a turn. As many repetitions as it takes for a pair that agrees on a coordinate with a probability
    of AGREEMENT to agree on all of one repetition's but for one in LOST."""
    rng = np.random.default_rng([80, table])
    others = np.setdiff1d(np.arange(SAMPLED), samples[table])
    repeats = 1 if extra == 0 else int(np.ceil(np.log(1 / LOST) / -np.log1p(-(AGREEMENT ** extra))))
    each = max(1, len(others) // max(extra, 1))
    out: list = []
    while len(out) < repeats:
        out += list(rng.permutation(others)[: each * extra].reshape(each, extra)) if extra <= len(others) else [rng.permutation(others)]
    return np.array(out[:repeats], np.int64).reshape(repeats, -1)


def _more_bits(tables: int, bits: int):
    """(bucket, id, extra, print) -> a row for every repetition, in a bucket told by the additional coordinates too."""
    samples = _samples(tables, bits)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bucket, extra = b.column(0).to_numpy(), b.column(2).to_numpy()
            raw, words = _words(b.column(3))
            bit = np.unpackbits(raw, axis=1)
            kind = np.stack([bucket >> 48, extra])
            for t, e in np.unique(kind, axis=1).T.tolist():
                at = np.flatnonzero((kind[0] == t) & (kind[1] == e))
                ids = b.column(1).take(pa.array(at))
                rest = [pa.array(words[at, k]) for k in range(CHECKED // 64)]
                for r, window in enumerate(_windows(t, bits, e, samples)):
                    key = _mix(bucket[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
                    for w in range(0, len(window), 48):
                        part = window[w: w + 48]
                        key = _mix(key ^ (bit[at][:, part].astype(np.uint64) @ (np.uint64(1) << np.arange(len(part), dtype=np.uint64))))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids, *rest], ["bucket", "id", "f0", "f1", "f2", "f3"])

    return run


def _short(common: np.ndarray, similarity):
    """A row for every hash of the sets' prefixes, with the set. common: hashes of many sets, the rarest first; they go last in every
    set, so that sets meet by what few others hold, not by a line that very many texts share."""
    order = np.argsort(common, kind="stable")
    known = common[order]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sets, (_, words) = b.column(2), _words(b.column(1))
            flat, owner = pc.list_flatten(sets).to_numpy(), pc.list_parent_indices(sets).to_numpy()
            rank = np.full(len(flat), -1)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, order[at], -1)
            by = np.lexsort((flat, rank, owner))
            starts = np.searchsorted(owner, np.arange(b.num_rows + 1))
            first = [prefix(by[i: j], similarity) for i, j in zip(starts[:-1], starts[1:])]
            take = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in first]))
            yield pa.RecordBatch.from_arrays([pa.array(flat[np.concatenate(first)]), b.column(0).take(take), *[pa.array(words[:, k]).take(take) for k in range(CHECKED // 64)], sets.take(take)],
                                             ["bucket", "id", "f0", "f1", "f2", "f3", "short"])

    return run


def _similar(codes: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity) -> np.ndarray:
    """Whether the sets i and j are similar enough, pair by pair; exact. codes: a row of distinct numbers a set, filled up with -1."""
    out = np.empty(len(i), bool)
    for s in range(0, len(i), PAIRS):
        e = slice(s, s + PAIRS)
        both = np.sort(np.concatenate([codes[i[e]], codes[j[e]]], 1), axis=1)
        same = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(1)
        out[e] = same * similarity[1] >= (size[i[e]] + size[j[e]] - same) * similarity[0]
    return out


def _near(distance: int, similarity=None):
    """Over rows sorted by bucket and pair of parts: a forest of the pairs within the distance; with a similarity, of those whose
    sets (the ninth column) have it."""
    def forest(rows):
        key, ids, prints, *sets = rows
        n = key.shape[1]
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        size = np.diff(np.r_[starts, n])
        # the largest buckets first: rows that are `step` apart are then compared without being gathered, in the rows of buckets that have any
        larger = np.argsort(-size, kind="stable")
        order = np.argsort(np.repeat(-size, size), kind="stable")
        size = size[larger]
        ends = np.repeat(np.cumsum(size), size)
        upto = np.r_[0, np.cumsum(size)]
        ids, prints = ids[order], np.ascontiguousarray(prints[:, order])
        ahead = len(prints) - (distance <= DISTANCE)  # words told of all pairs; few random ones are within a small distance even without the last
        if sets:
            wide, size_of = (x[order] for x in sets)
            codes = np.where(np.arange(SHORT) < size_of[:, None], np.unique(wide, return_inverse=True)[1].reshape(wide.shape), -1).astype(np.int32)
        names, who = np.unique(ids, return_inverse=True)
        root = np.arange(len(names))
        for step in range(1, int(size[0])):
            top = int(upto[np.searchsorted(-size, -step)])  # rows of buckets of more than `step`
            far = np.bitwise_count(prints[0, : top - step] ^ prints[0, step:top]).astype(np.uint16)
            for k in range(1, ahead):
                far += np.bitwise_count(prints[k, : top - step] ^ prints[k, step:top])
            near = np.flatnonzero(far <= distance)
            near = near[near + step < ends[near]]
            near = near[root[who[near]] != root[who[near + step]]]  # pairs that are linked already need no comparison
            if sets:
                least, most = np.minimum(size_of[near], size_of[near + step]), np.maximum(size_of[near], size_of[near + step])
                near = near[least * similarity[1] >= most * similarity[0]]
            if ahead < len(prints):
                near = near[sum(np.bitwise_count(x[near] ^ x[near + step]).astype(np.int64) for x in prints) <= distance]
            if sets:
                near = near[_similar(codes, size_of, near, near + step, similarity)]
            if len(near):
                parent: dict[int, int] = {}

                def find(x):
                    while (p := parent.get(x, x)) != x:
                        parent[x] = parent.get(p, p)
                        x = p
                    return x

                for u, v in zip(root[who[near]].tolist(), root[who[near + step]].tolist()):
                    u, v = find(u), find(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                to = np.arange(len(names))
                to[list(parent)] = [find(x) for x in list(parent)]
                root = to[root]
        out = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(names[root[out]])], ["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in range(3)])
            now = [key, b.column(3).to_numpy(), np.stack([b.column(k).to_numpy().view(np.uint64) for k in range(4, 8)])]
            if similarity:
                wide, owner = np.zeros((b.num_rows, SHORT), np.int64), pc.list_parent_indices(b.column(8)).to_numpy()
                wide[owner, np.arange(len(owner)) - np.searchsorted(owner, owner)] = pc.list_flatten(b.column(8)).to_numpy()
                now += [wide, pc.list_value_length(b.column(8)).to_numpy().astype(np.int64)]
            if held is not None:
                now = [np.concatenate(x, k) for x, k in zip(zip(held, now), (1, 0, 1, 0, 0))]
            cut = int(np.flatnonzero((now[0] == now[0][:, -1:]).all(0))[0])  # the last bucket may go on in the next batch
            if cut:
                yield forest([now[0][:, :cut], now[1][:cut], now[2][:, :cut], *(x[:cut] for x in now[3:])])
            held = [now[0][:, cut:], now[1][cut:], now[2][:, cut:], *(x[cut:] for x in now[3:])]
        if held is not None:
            yield forest(held)

    return run


_ROW = "bucket long, id long, f0 long, f1 long, f2 long, f3 long"


def _sampled(df: DataFrame, each: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(each)) == 0)


def _large(sample: DataFrame, each: int, bucket: int) -> DataFrame:
    """(bucket, n) of the buckets that seem to hold more than `bucket` rows, told from the ids of one class in `each`."""
    return materialize(sample.groupBy("bucket").agg((F.count(F.lit(1)) * each).alias("n")).where(F.col("n") > bucket))


def _split(rows: DataFrame, sample: DataFrame, prints: DataFrame, each: int, bucket: int, tables: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """rows and sample, with oversized buckets divided by additional coordinates, several times each (see _windows)."""
    large = _large(sample, each, bucket)
    if not large.limit(1).count():
        return rows, sample

    def divided(df: DataFrame) -> DataFrame:
        found = lookup(df, large, "bucket", "n", F.xxhash64("id"), check=True)
        extra = F.ceil(F.log2(F.col("n") / bucket)).cast("int").alias("extra")
        wide = found.where("n is not null").select("bucket", "id", extra).join(prints, "id").select("bucket", "id", "extra", "print")
        return found.where("n is null").drop("n").union(wide.mapInArrow(tidied(_more_bits(tables, bits)), _ROW))

    return divided(rows), divided(sample)


def _compared(rows: DataFrame, sample: DataFrame, each: int, bucket: int, distance: int, similarity=None) -> DataFrame:
    """(u, v): forests of the pairs of a bucket that _near finds. A bucket of more than `bucket` rows is compared part by
    part, each pair of parts in a group of its own: the parts decide where pairs are compared, not which."""
    columns = rows.columns[1:]
    parts = _large(sample, each, bucket).select("bucket", "n", F.ceil(F.col("n") / bucket).cast("int").alias("parts"))
    rows = lookup(rows, parts, "bucket", "n", F.xxhash64("id"), check=True).withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("bucket", F.col("pair.a").alias("first"), F.col("pair.b").alias("second"), *columns)
    return rows.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second").mapInArrow(tidied(_near(distance, similarity)), "u long, v long")


def candidate_edges(classes: DataFrame, tables: int = TABLES, bits: int = BITS, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """(u, v): within every bucket, a forest of the pairs whose checked coordinates differ in at most `distance`.

    classes: a table (id, print). Buckets of more than `bucket` rows get additional coordinates, one for each
    doubling, in as many repetitions as keep all but one in a hundred of the pairs at the similarity; so comparisons stay in
    proportion to rows. What is still oversized then (rows that agree on nearly all coordinates) is compared part by part.
    """
    each = max(1, bucket // 256)

    def rows(df):
        return df.select("id", "print").mapInArrow(tidied(_tables(tables, bits)), _ROW)

    some = _sampled(classes, each)
    return _compared(*_split(rows(classes), rows(some), classes.select("id", "print"), each, bucket, tables, bits), each, bucket, distance)


def short_links(classes: DataFrame, similarity=SIMILARITY, bucket: int = BUCKET, distance: int = SHORT_DISTANCE) -> DataFrame:
    """(u, v): forests of the pairs of sets of at most SHORT shingles that are similar enough, exactly.

    classes: a table (id, print, short). The sets are in the buckets of the hashes of their prefix, in an order that puts the
    most frequent ones last (at most COMMON of them, the rest by hash): a pair that is similar enough shares one in any order.
    It is checked at a distance that it keeps but for one in 10^11, then the sets are compared. Buckets are only ever
    divided part by part, so no pair is left out; hashes of one set are no bucket.
    """
    each = max(1, bucket // 256)
    sets = classes.where("short is not null").select("id", "print", "short")
    often = materialize(sets.select(F.explode("short").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    common = often.where(F.col("n") > COMMON_SETS).orderBy(F.desc("n"), "h").limit(COMMON).select("h").collect()  # COMMON numbers
    common = np.array([r[0] for r in reversed(common)], np.int64)
    bits = bit_filter(often, F.col("h"), often.count())

    def rows(df):
        made = df.mapInArrow(tidied(_short(common, similarity)), _ROW + ", short array<long>")
        return with_membership(made, bits, F.col("bucket"), "maybe").where("maybe").drop("maybe")

    return _compared(rows(sets), rows(_sampled(sets, each)), each, bucket, distance, similarity)


def linked(sets: list[np.ndarray], similarity=SIMILARITY) -> np.ndarray:
    """Boolean matrix: which sets have a Jaccard similarity of at least similarity[0] / similarity[1]; exact."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    keep = often[place] > 1
    _, column = np.unique(place[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.float64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    return common * similarity[1] >= union * similarity[0]


def spanning(ids: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its component) wherever these differ."""
    out, seen = [], np.zeros(len(ids), bool)
    for k in np.argsort(ids, kind="stable"):
        if seen[k]:
            continue
        member = np.zeros(len(ids), bool)
        member[k] = True
        front = member
        while front.any():
            front = link[front].any(0) & ~member
            member = member | front
        seen |= member
        out += [(int(ids[m]), int(ids[k])) for m in np.flatnonzero(member) if m != k]
    return out


def _verify(similarity):
    """Groups of (id, text, side) -> forest of the pairs that are similar enough and of which one has side 1."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("side", "descending")])
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        one = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, side = ids[one], side[one] == 1
        link = linked([shingles(t["text"][int(k)].as_py()) for k in one], similarity)
        if not side.all():
            link &= side[:, None] | side[None, :]
        out = spanning(ids, link)
        return pa.table([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    return run


def verified_edges(rows: DataFrame, members: DataFrame, similarity=SIMILARITY, component: int = COMPONENT) -> DataFrame:
    """(u, v): forests of the pairs of a candidate component whose shingle sets are similar enough.

    rows: (id, text); members: a table (node, component). Only the members' texts are moved. A component is dealt to parts of
    about `component` texts; a part's pairs are counted by one matrix product, together with PIVOTS texts that all parts of
    the component get. Texts that are linked by then need no comparison with each other. So of a component of several
    parts only those outside its largest class are compared with all others, part by part: nothing is left out, a group
    of very many near copies costs in proportion to its texts, and no task holds it all.
    """
    n = F.count(F.lit(1))
    text = with_membership(rows, bit_filter(members, F.col("node"), members.count()), F.col("id"), "maybe").where("maybe").drop("maybe")
    sizes = materialize(members.groupBy("component").agg(n.alias("n")).where(F.col("n") > component).withColumn("parts", F.ceil(F.col("n") / component).cast("int")))
    at = lookup(members.withColumnRenamed("node", "id"), sizes, "component", "n", F.xxhash64("id"), check=True).withColumn("parts", F.coalesce("parts", F.lit(1)))
    at = at.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    held = text.join(at, "id")
    pivot = F.pmod(F.xxhash64("id", F.lit(9)), F.col("n")) < PIVOTS
    everywhere = held.where(F.col("n").isNotNull() & pivot).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = ["component", "part", "id", "text", F.lit(1).alias("side")]
    found = held.select(*own).union(everywhere.select(*own)).groupBy("component", "part").applyInArrow(_verify(similarity), "u long, v long")
    if not sizes.limit(1).count():
        return found
    found = materialize(found)
    big = at.where("n is not null")
    roots = connected_components(found).withColumnRenamed("component", "root")
    big = materialize(big.join(roots, big["id"] == roots["node"], "left").select("id", "component", "parts", "part", F.coalesce("root", "id").alias("class")))
    largest = big.groupBy("component", "class").agg(n.alias("n")).groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.sum("n").alias("n"))
    rest = lookup(big, largest, "component", "n", F.xxhash64("id"), check=True).drop("n").where("class <> largest")
    shares = rest.groupBy("component").agg(F.ceil(n / component).cast("int").alias("shares"), n.alias("n"))
    shares = materialize(shares)
    rest = lookup(rest, shares, "component", "n", F.xxhash64("id"), check=True).withColumn("share", F.pmod(F.xxhash64("id", F.lit(8)), F.col("shares")).cast("int"))
    every = lookup(big, shares, "component", "n", F.xxhash64("id"), check=True).where("shares is not null")
    one = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "component", "share", "part", F.lit(1).alias("side"))
    other = every.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("id", "component", "share", "part", F.lit(0).alias("side"))
    return found.union(text.join(one.union(other), "id").groupBy("component", "share", "part").applyInArrow(_verify(similarity), "u long, v long"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity=SIMILARITY, tables: int = TABLES, bits: int = BITS,
                  bucket: int = BUCKET, distance: int = DISTANCE, component: int = COMPONENT, carry: dict | None = None) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), class_size, kept (of a class, exactly one row) and the
    columns of `carry` (expressions over the input row).

    Classes are the components of links: Jaccard of five-word shingle sets at least 0.8. Documents of equal shingle sets
    are one class at once. Fingerprints (928 coordinates) of sets of 52 shingles or more go to 48 tables keyed by 14 coordinates of their own,
    oversized buckets get additional ones; pairs in a bucket are checked on 256 other coordinates; the texts of candidate
    components are compared exactly. Sets of at most 64 shingles meet by common shingles (prefix filter, see short_links), so
    that pairs of them are missed with a probability below 10^-11. Of longer ones a link of similarity exactly 0.8 is a candidate with a
    probability of about 0.994, of 0.85 of about 0.999; everything after is exact, and nothing is capped.

    Words are lower-cased runs of \\w; a text of fewer than five words is one shingle; a text without words (null and empty
    ones too) is a class of its own. Very long texts are read whole. Rows that repeat an id, or have none, are documents of
    their own; the one that is kept is the first by id (null last), then text hash. A class whose ids are all null has a null
    class_id. Extra columns are ignored; an empty table gives an empty result. The id must be an integer or a string of one.
    """
    bounded_batches(docs.sparkSession)
    names = list(carry or {})
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[e.alias(f"__c_{k}") for k, e in (carry or {}).items()])
    base, back = unique_ids(base, nulls_first=False)
    extra = [f"__c_{k}" for k in names]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = ", ".join(["id long", *(f"`{c}` {kinds[c]}" for c in extra), "sig string, print binary, short array<long>"])
    prints = materialize(base.select("id", "text", *extra).mapInArrow(tidied(_fingerprints(extra), forget), schema))
    classes = materialize(prints.where("sig is not null").groupBy("sig")
                          .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("print").alias("print"), F.min("short").alias("short")))
    # a shorter set has no link with one of more than SHORT shingles; short_links finds all others of it
    tabled = classes.where(F.col("short").isNull() | (F.size("short") * similarity[1] >= (SHORT + 1) * similarity[0]))
    edges = candidate_edges(tabled.select("id", "print"), tables, bits, bucket, distance)
    members = materialize(connected_components(edges))
    kept = verified_edges(base.select("id", "text"), members, similarity, component)
    roots = connected_components(kept.union(short_links(classes, similarity, bucket, max(distance, SHORT_DISTANCE))))
    table = (classes.select("sig", "id", "copies").join(roots.withColumnRenamed("node", "id").withColumnRenamed("component", "root"), "id", "left")
             .select("sig", "copies", F.coalesce("root", "id").alias("root")))
    sized = table.groupBy("root").agg(F.sum("copies").alias("class_size"))
    table = table.join(sized, "root").select("sig", "root", "copies", "class_size")
    out = lookup(prints.select("id", *extra, "sig"), table, "sig", "copies", F.xxhash64("id"))
    out = out.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), *extra)
    out = out.withColumn("kept", F.col("id") == F.col("root")).withColumn("own", F.col("id"))
    if back is not None:  # numbers stand for rows
        own = back.select("id", F.col("own").alias("__own"))
        roots_of = back.select(F.col("id").alias("root"), F.col("own").alias("__root"))
        out = out.join(own, "id").join(roots_of, "root").withColumn("own", F.col("__own")).withColumn("root", F.col("__root"))
    return out.select(F.col("own").alias(id_col), F.col("root").alias("class_id"), "class_size", "kept", *[F.col(f"__c_{k}").alias(k) for k in names])


def op7_simhash(spark, sf_dir):
    return simhash_dedup(load(spark, sf_dir, "documents"))


SQL = None  # tested against brute force
