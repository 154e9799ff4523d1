"""Graph algorithms as loops of joins. edges: columns src, dst (and weight). Each round is cut to the shared folder.

Edges are read from their source once (Links) and stay where they are; what loops is the frontier or the node table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.errors import UnsupportedQueryError
from strataq.plans.lineage import Growing, bucket, cut

FEW = 100_000  # rows that are sent to every task


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


class Links:
    """Edges that loops join by one end, again and again. As long as few nodes ask, these are sent to all edges; from the first large
    frontier on, the edges lie in buckets by the end that is asked for, and only the nodes that ask are shuffled."""

    def __init__(self, edges: DataFrame):
        self.source, self.spark, self.kind = edges, edges.sparkSession, edges.schema["src"].dataType
        self.plain, self.buckets = None, {}

    def frame(self) -> DataFrame:
        """All edges, read from what was written."""
        if self.plain is None:
            self.plain = next(iter(self.buckets.values()), None)
            if self.plain is None:
                self.plain = cut(self.source)
        return self.plain

    def by(self, end: str) -> DataFrame:
        if end not in self.buckets:
            self.buckets[end] = bucket(self.source if self.plain is None else self.plain, end)
        return self.buckets[end]

    def join(self, front: DataFrame, end: str = "src") -> DataFrame:
        """The edges whose `end` is in the frontier's column of that name."""
        if end not in self.buckets and few(front):
            return self.frame().join(F.broadcast(front), end)
        return self.by(end).join(front.hint("shuffle_hash"), end)

    def one(self, node) -> DataFrame:
        return self.spark.createDataFrame([(node,)], ["id"]).select(F.col("id").cast(self.kind).alias("id"))


def links(edges: DataFrame | Links) -> Links:
    return edges if isinstance(edges, Links) else Links(edges)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def bfs(edges: DataFrame | Links, sources: DataFrame, max_depth: int = 1_000_000, way: str = "out", until=None) -> DataFrame:
    """(id, depth) of everything reachable from sources (column id), along edges (out), against them (in) or either way (any); with
    `until`, no deeper than that node. Each round joins the frontier only, and writes it once."""
    g = links(edges)
    ends = {"out": [("src", "dst")], "in": [("dst", "src")], "any": [("src", "dst"), ("dst", "src")]}[way]
    seen = Growing(sources.select("id").distinct(), "depth")
    front = seen.last
    while seen.parts <= max_depth:
        steps = [g.join(front.select(F.col("id").alias(a)), a).select(F.col(b).alias("id")) for a, b in ends]
        step = (steps[0] if len(steps) == 1 else steps[0].union(steps[1])).distinct()
        front = seen.add(step.join(seen.all().select("id"), "id", "left_anti"))
        if front.isEmpty() or until is not None and not front.where(F.col("id") == until).isEmpty():
            break
    return seen.all()


def traverse(edges: DataFrame, source, max_depth: int = 3, max_nodes: int = 10_000) -> tuple[DataFrame, bool]:
    """Neighbours up to a depth, nearest first; whether the node limit left any out."""
    g = links(edges)
    out = bfs(g, g.one(source), max_depth)
    return out.orderBy("depth", "id").limit(max_nodes), out.limit(max_nodes + 1).count() <= max_nodes


def shortest_paths(edges: DataFrame | Links, source, target, max_depth: int = 10, every: bool = False) -> DataFrame:
    """(path): the least, or all, shortest paths from source to target. Levels first, then paths along them only."""
    g = links(edges)
    levels = bfs(g, g.one(source), max_depth, until=target)
    hit = levels.where(F.col("id") == target).select("depth").first()
    if hit is None:
        return levels.select(F.array("id").alias("path")).limit(0)
    # back from the target along decreasing levels, so that only nodes on shortest paths are kept
    on, steps = g.one(target), []
    for d in range(hit[0] - 1, -1, -1):
        into = cut(g.join(on.select(F.col("id").alias("dst")), "dst").select("src", "dst").distinct())
        steps.append(cut(_meet(levels.where(F.col("depth") == d).select(F.col("id").alias("src")), into, "src").select("src", "dst")))
        on = steps[-1].select(F.col("src").alias("id")).distinct()
    paths = g.one(source).select(F.array("id").alias("path"), F.col("id").alias("end"))
    for s in reversed(steps):
        paths = paths.join(s, paths["end"] == s["src"]).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
    paths = paths.select("path").distinct()
    return paths if every else paths.orderBy("path").limit(1)


def _meet(rows: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """An inner join whose second side, a cut table, is sent to all rows where it is short."""
    return rows.join(F.broadcast(asked) if few(asked) else asked, on)


def dijkstra(edges: DataFrame | Links, source, max_rounds: int = 10_000) -> DataFrame:
    """(id, distance) from a source: relaxation of the nodes that improved, until none does. Weights must be finite and not negative."""
    g = links(edges)
    bad = g.frame().where((F.col("weight") < 0) | F.isnan("weight") | F.col("weight").isNull() | (F.abs("weight") == float("inf")))
    if not bad.isEmpty():
        raise UnsupportedQueryError("negative or non-finite weight")
    best = cut(g.one(source).select("id", F.lit(0.0).alias("distance")))
    front = best
    for _ in range(max_rounds):
        reach = g.join(front.select(F.col("id").alias("src"), "distance")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        front = cut(reach.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("id", F.col("new").alias("distance")))
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("id"), "id", "left_anti").unionByName(front), best)
    raise UnsupportedQueryError("no convergence")


def weighted_path(edges: DataFrame | Links, source, target) -> DataFrame:
    """(path, distance) of one least path: walk back along tight edges, smallest predecessor first. Only edges into the path's end are looked at."""
    g = links(edges)
    dist = dijkstra(g, source)
    paths = cut(dist.where(F.col("id") == target).select(F.array("id").alias("path"), F.col("id").alias("dst"), F.col("distance").alias("dd"), "distance"))
    for _ in range(10_000):
        open_ = paths.where(F.col("dst") != F.lit(source))
        if open_.isEmpty():
            return paths.select("path", "distance")
        into = cut(g.join(open_, "dst").select("src", "weight", "path", "dd", "distance"))
        tight = _meet(dist.select(F.col("id").alias("src"), F.col("distance").alias("ds")), into, "src").where(F.abs(F.col("ds") + F.col("weight") - F.col("dd")) <= 1e-9).where("ds < dd or weight = 0")
        prev = tight.groupBy("path", "distance").agg(F.min(F.struct("src", "ds")).alias("p"))
        paths = cut(prev.select(F.concat(F.array("p.src"), "path").alias("path"), F.col("p.src").alias("dst"), F.col("p.ds").alias("dd"), "distance"))
    raise UnsupportedQueryError("path too long")


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure (src, dst), semi-naive: only new pairs are extended, and written once. Pairs lie in buckets by src, edges by dst, so
    that of a round only what it proposes is shuffled."""
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = bucket(edges.select("src", "dst").distinct(), "dst")
    total = [bucket(e, "src")]
    back = e.select(F.col("src").alias("from"), F.col("dst").alias("src"))
    key = "spark.sql.requireAllClusterKeysForCoPartition"  # pairs that lie by src meet where they are
    old = spark.conf.get(key)
    while not total[-1].isEmpty():
        step = total[-1].join(back.hint("shuffle_hash"), "src").select(F.col("from").alias("src"), "dst").repartition(n, "src").distinct()
        for t in total:
            step = step.join(t, ["src", "dst"], "left_anti")
        spark.conf.set(key, "false")
        try:
            total.append(bucket(step, "src"))
        finally:
            spark.conf.set(key, old)
    out = total[0]
    for t in total[1:-1]:
        out = out.union(t)
    return out


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, personal=None) -> DataFrame:
    """(id, score). Dangling mass is spread evenly (personal: goes to the source). Parallel edges count. Stops at an L1 change below the tolerance."""
    n = nodes(edges)
    if personal is not None and n.where(F.col("id") == personal).isEmpty():
        raise UnsupportedQueryError("unknown source")
    count = n.count()
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    out = cut(edges.join(deg, "src").select("src", "dst", "deg"))
    tele = F.lit(1.0 / max(1, count)) if personal is None else (F.col("id") == personal).cast("double")
    state = cut(n.join(deg.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("deg").isNull().alias("dangling"), tele.alias("tele"), tele.alias("score")))
    for _ in range(rounds):
        gain = out.join(state.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("deg")).alias("gain"))
        lost = state.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))  # one row
        new = (state.join(gain, "id", "left").join(F.broadcast(lost))
               .withColumn("new", F.lit(1 - damping) * F.col("tele") + damping * (F.col("tele") * F.col("lost") + F.coalesce("gain", F.lit(0.0)))))
        new = cut(new.select("id", "dangling", "tele", F.col("new").alias("score"), F.abs(F.col("new") - F.col("score")).alias("d")))
        moved = new.agg(F.sum("d")).first()[0] or 0.0
        state = new
        if moved < tolerance:
            break
    return state.select("id", "score")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected, by the smallest id. Nodes whose label fell tell their neighbours, then the label of the label
    (halves distances), until none falls."""
    e = edges.select("src", "dst")
    g = Links(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null"))
    lab = cut(g.by("src").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")))
    front = lab.where("component <> id")
    while not front.isEmpty():
        near = g.join(front.select(F.col("id").alias("src"), "component")).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("m"))
        step = cut(lab.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component")))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(jump, "component", "left").select("id", "old", F.least(F.col("component"), F.coalesce("up", "component")).alias("component")), step)
        front = new.where("old <> component").select("id", "component")
        lab = new.select("id", "component")
    return lab


def scc(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components by smallest id. Forward and backward colouring, trimming what is done."""
    rest = cut(edges.select("src", "dst").where("src <> dst").distinct())
    alive = cut(nodes(edges))
    done = None
    while True:
        # trim nodes without an edge in or out: components of their own
        while True:
            inner = rest.select(F.col("src").alias("id")).distinct().join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            lone = cut(alive.join(inner, "id", "left_anti"))
            if lone.isEmpty():
                break
            part = lone.select("id", F.col("id").alias("component"))
            done = part if done is None else done.union(part)
            alive = cut(alive.join(lone, "id", "left_anti"))
            l1, l2 = lone.select(F.col("id").alias("src")), lone.select(F.col("id").alias("dst"))
            rest = cut(rest.join(l1, "src", "left_anti").join(l2, "dst", "left_anti").select("src", "dst"))
        if alive.isEmpty():
            return done
        colour = cut(alive.select("id", F.col("id").alias("c")))
        while True:  # forward: the smallest node that reaches each
            near = rest.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(near, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
            if new.where("old <> c").isEmpty():
                break
            colour = new.select("id", "c")
        c1, c2 = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = cut(rest.join(c1, "src").join(c2, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c")))
        back = cut(bfs(inside, colour.where("id = c").select("id")).select("id"))  # backward within a colour
        part = cut(colour.join(back, "id").select("id", F.col("c").alias("component")))
        done = part if done is None else done.union(part)
        alive = cut(alive.join(part, "id", "left_anti"))
        p1, p2 = part.select(F.col("id").alias("src")), part.select(F.col("id").alias("dst"))
        rest = cut(rest.join(p1, "src", "left_anti").join(p2, "dst", "left_anti").select("src", "dst"))
        if alive.isEmpty():
            return done


def condensation(edges: DataFrame) -> DataFrame:
    c = cut(scc(edges))
    a, b = c.select(F.col("id").alias("src"), F.col("component").alias("cs")), c.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    return edges.join(a, "src").join(b, "dst").where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def _peel(edges: DataFrame | Links) -> tuple[DataFrame, DataFrame]:
    """((id, distance, level), nodes left over): nodes are taken once all edges into them were, so every edge is followed once. level: edges, and distance:
    weight, of the longest way from a node without predecessors. Left over are nodes on cycles and behind them."""
    g = links(edges if isinstance(edges, Links) else edges.where("src is not null and dst is not null"))
    weight = F.col("weight").cast("double") if "weight" in g.source.columns else F.lit(1.0)
    waits = cut(g.by("src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("open")).withColumn("distance", F.lit(None).cast("double")))
    taken = Growing(g.by("src").select(F.col("src").alias("id")).distinct().join(waits.select("id"), "id", "left_anti").withColumn("distance", F.lit(0.0)), "level")
    free, old = taken.last, waits
    while not free.isEmpty():
        into = g.join(free.select(F.col("id").alias("src"), "distance")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k"), F.max(F.col("distance") + weight).alias("far"))
        old = cut(waits.join(into, "id", "left").select("id", (F.col("open") - F.coalesce("k", F.lit(0))).alias("open"), F.greatest("distance", "far").alias("distance")), old)
        free, waits = taken.add(old.where("open = 0").select("id", "distance")), old.where("open > 0")
    return taken.all(), waits.select("id")


def topological_levels(edges: DataFrame | Links) -> tuple[DataFrame, DataFrame]:
    """((id, level), nodes on cycles or behind them)."""
    done, left = _peel(edges)
    return done.select("id", "level"), left


def critical_path(edges: DataFrame) -> DataFrame:
    """(id, distance): the longest way from any source; weights default to 1. Cyclic graphs are refused."""
    done, left = _peel(edges)
    if not left.isEmpty():
        raise UnsupportedQueryError("cyclic")
    return done.select("id", "distance")


def dependencies(edges: DataFrame | Links, node, way: str = "out", until=None) -> DataFrame:
    """Everything that `node` reaches; dependents: everything that reaches it."""
    g = links(edges)
    return bfs(g, g.one(node), way=way, until=until).where("depth > 0").select("id")


def dependents(edges: DataFrame | Links, node) -> DataFrame:
    return dependencies(edges, node, "in")


def has_cycle(edges: DataFrame | Links) -> bool:
    return not topological_levels(edges)[1].isEmpty()


def would_create_cycle(edges: DataFrame | Links, src, dst) -> bool:
    return src == dst or not dependencies(edges, dst, until=src).where(F.col("id") == src).isEmpty()


LIST = 4096  # neighbours that one row holds, about


def find_cycles(edges: DataFrame, max_length: int = 10, limit: int | None = None) -> DataFrame:
    """Simple cycles of at most max_length edges, each from its smallest node; all of them unless a limit is given (see limited).
    The last two edges are found at once, as what the lists of the nodes behind a path's end and before its start have in common, so the longest
    paths are never written. Beyond three edges, only nodes of strong components take part."""
    e = cut(edges.select("src", "dst").distinct())
    if max_length > 3:
        c = cut(scc(e))
        a, b = c.select(F.col("id").alias("src"), F.col("component").alias("cs")), c.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
        e = cut(e.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst"), e)
    found = e.where("src = dst").select(F.array("src").alias("path"))
    paths = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    close = e.where("src > dst").select(F.col("src").alias("end"), F.col("dst").alias("start"))
    for k in range(1, max_length):
        found = found.union(paths.join(close, ["start", "end"]).select("path"))
        if k >= max_length - 2:
            break
        paths = cut(paths.join(e.withColumnRenamed("src", "end"), "end").where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
                    .select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    if max_length > 2:
        most = max(e.groupBy(end).count().agg(F.max("count")).first()[0] or 0 for end in ("src", "dst"))
        h = lambda c: F.pmod(F.xxhash64(c), F.lit(1 + most // LIST)).alias("h")
        before = e.where("src > dst").groupBy(F.col("dst").alias("start"), h("src")).agg(F.collect_list("src").alias("before"))
        behind = e.groupBy(F.col("src").alias("end"), h("dst")).agg(F.collect_list("dst").alias("behind"))
        last = F.explode(F.array_except(F.array_intersect("before", "behind"), "path")).alias("last")
        found = found.union(paths.join(before, "start").join(behind, ["end", "h"]).select("path", last).select(F.concat("path", F.array("last")).alias("path")))
    return found if limit is None else found.limit(limit)


def path_pattern(edges: DataFrame, sources: DataFrame | None, low: int, high: int, mode: str = "walk", label: str | None = None) -> DataFrame:
    """(path, length) of low..high edges from the sources; mode walk, trail (no edge twice), acyclic or simple (no node twice; simple may close)."""
    e = edges if label is None else edges.where(F.col("label") == label)
    e = e.select("src", "dst")
    start = (sources.select("id") if sources is not None else nodes(edges))
    paths = start.select(F.array("id").alias("path"), F.lit(0).alias("length"), F.lit(False).alias("closed"))
    out = paths if low == 0 else None
    for n in range(1, high + 1):
        step = paths.where("not closed").join(e, F.element_at("path", -1) == F.col("src"))
        if mode == "acyclic":
            step = step.where(~F.array_contains("path", F.col("dst")))
        elif mode == "simple":
            step = step.where(~F.array_contains(F.slice("path", 2, 1_000_000), F.col("dst")))
        elif mode == "trail":
            pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
            step = step.where(~F.exists(pairs, lambda x: F.coalesce((x["a"] == F.col("src")) & (x["b"] == F.col("dst")), F.lit(False))))
        closed = (F.col("dst") == F.col("path")[0]) if mode == "simple" else F.lit(False)
        paths = cut(step.select(F.concat("path", F.array("dst")).alias("path"), F.lit(n).alias("length"), closed.alias("closed")))
        if n >= low:
            out = paths if out is None else out.union(paths)
        if paths.isEmpty():
            break
    return out.select("path", "length")


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, label): synchronous, the most frequent label of the undirected distinct neighbours, the smallest of equals."""
    e = cut(both_ways(edges).where("src <> dst"))
    lab = cut(nodes(edges).select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = e.join(lab.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        win = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("id", (-F.col("b.l")).alias("new"))
        new = cut(lab.join(win, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        still = new.where("moved").isEmpty()
        lab = new.select("id", "label")
        if still:
            break
    return lab


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """in/(2m) - sum K^2/(8 m^2) over the undirected distinct edges, of which there are m; K: the degrees of a community."""
    e = both_ways(edges).where("src < dst")
    l1, l2 = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    j = e.join(l1, "src").join(l2, "dst")
    tot = j.agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("ls") == F.col("ld")).cast("long")).alias("inside"))
    deg = j.select(F.col("ls").alias("label")).union(j.select(F.col("ld").alias("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    sq = deg.agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return tot.join(F.broadcast(sq)).select((F.col("inside") / (2 * F.col("m")) - F.col("k2") / (8 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def local_community(edges: DataFrame | Links, node, hops: int = 3) -> DataFrame:
    g = links(edges)
    return bfs(g, g.one(node), hops, "any")


ALGORITHMS = {"pagerank": pagerank, "components": components, "scc": scc, "label_propagation": label_propagation, "dijkstra": dijkstra, "shortest_paths": shortest_paths,
              "topological_levels": topological_levels, "critical_path": critical_path, "find_cycles": find_cycles, "closure": closure, "local_community": local_community}


def run_algorithm(name: str, edges: DataFrame, **params):
    if name not in ALGORITHMS:
        raise UnsupportedQueryError(name)
    return ALGORITHMS[name](edges, **params)


def limited(df: DataFrame, most: int, reason: str = "maxResults") -> tuple[DataFrame, bool, str | None]:
    """(rows, complete, reason): a partial result says so."""
    complete = df.limit(most + 1).count() <= most
    return df.limit(most), complete, None if complete else reason
