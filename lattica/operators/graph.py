"""Graphs as edge tables (src, dst, w): channels, normalisation, centrality and distances.

Linear recursions (PageRank, propagation, leading eigenvectors) have two forms with equal steps and results.  Graphs
of up to ``DENSE_LIMIT`` nodes become one array-valued row and the whole recursion one expression, a single job; larger
ones are iterated as joins over the edge table, written to the checkpoint folder as they go.  Spectra, Fiedler vectors,
embeddings and communities come from ``eigen``, on edge tables of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import haversine
from lattica.operators import eigen, stats
from lattica.schema import DEFAULTS, DENSE_LIMIT


def accumulate(dyads: DataFrame) -> DataFrame:
    """Sum of values per directed pair, over all periods."""
    return dyads.groupBy("src", "dst").agg(F.sum("value").alias("w"))


def row_normalize(edges: DataFrame) -> DataFrame:
    """Weights divided by the sum of their source's; sources of sum 0 keep zeros."""
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", F.when(total != 0, F.col("w") / total).otherwise(F.lit(0.0)))


def mirrored(dyads: DataFrame, share: float = DEFAULTS.mirror) -> DataFrame:
    """Each claim also counts, at ``share``, in the other direction."""
    back = dyads.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("value") * share).alias("value"))
    return dyads.select("src", "dst", "value").unionByName(back)


def scaled_by(edges: DataFrame, sizes: DataFrame, default: float) -> DataFrame:
    """Weights divided by the source's size (entity, size), or by ``default`` where it has none."""
    return edges.join(sizes.select(F.col("entity").alias("src"), "size"), "src", "left").select(
        "src", "dst", (F.col("w") / F.coalesce("size", F.lit(default))).alias("w"))


def financial(dyads: DataFrame, sizes: DataFrame) -> DataFrame:
    return row_normalize(scaled_by(accumulate(mirrored(dyads)), sizes, 1e12))


def migration(dyads: DataFrame, sizes: DataFrame) -> DataFrame:
    return row_normalize(scaled_by(accumulate(dyads), sizes, 1e7))


def alliances(pacts: DataFrame, weights: DataFrame, other: float = 0.5) -> DataFrame:
    """Symmetric sum of weights by kind of pact (src, dst, kind)."""
    w = pacts.join(weights, "kind", "left").select("src", "dst", F.coalesce("weight", F.lit(other)).alias("value"))
    return accumulate(w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")))


def distances(points: DataFrame) -> DataFrame:
    """(src, dst, km) for all ordered pairs of points, as many rows as points squared; points are places, a small dimension."""
    a = points.select(F.col("entity").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select(F.col("entity").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, F.col("src") != F.col("dst")).select(
        "src", "dst", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def geographic(points: DataFrame, decay: float = DEFAULTS.distance_decay, near_km: float = DEFAULTS.contiguity_km) -> DataFrame:
    """Distance to the power -decay, doubled for near pairs, row-normalised; equal points get weight 0."""
    w = F.when(F.col("km") > 0, F.pow("km", F.lit(-decay)) * F.when(F.col("km") <= near_km, 2.0).otherwise(1.0)).otherwise(F.lit(0.0))
    return row_normalize(distances(points).select("src", "dst", w.alias("w")))


def contiguous(dist: DataFrame, bonus: float = 0.5) -> DataFrame:
    """1 / km plus a bonus for contiguity, from (src, dst, km, contiguity)."""
    return dist.select("src", "dst", (F.when(F.col("km") > 0, 1 / F.col("km")).otherwise(F.lit(0.0)) + bonus * F.col("contiguity")).alias("w"))


def gravity(points: DataFrame, sizes: DataFrame, decay: float = DEFAULTS.distance_decay, default: float = 1e9) -> DataFrame:
    """size_i * size_j / km^decay, row-normalised."""
    a, b = (sizes.select(F.col("entity").alias(c), F.col("size").alias(f"_{c}")) for c in ("src", "dst"))
    d = distances(points).join(a, "src", "left").join(b, "dst", "left")
    w = F.coalesce("_src", F.lit(default)) * F.coalesce("_dst", F.lit(default)) / F.pow("km", F.lit(decay))
    return row_normalize(d.select("src", "dst", F.when(F.col("km") > 0, w).otherwise(F.lit(0.0)).alias("w")))


def comembership(members: DataFrame) -> DataFrame:
    """Cosine of binary membership vectors (org, entity), row-normalised."""
    m = members.select("org", "entity").distinct()
    n = m.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    both = m.withColumnRenamed("entity", "src").join(m.withColumnRenamed("entity", "dst"), "org").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    w = both.join(n.select(F.col("entity").alias("src"), F.col("n").alias("ns")), "src").join(n.select(F.col("entity").alias("dst"), F.col("n").alias("nd")), "dst")
    return row_normalize(w.select("src", "dst", (F.col("c") / F.sqrt(F.col("ns") * F.col("nd"))).alias("w")))


def shared_organizations(members: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the sorted organisations that both entities are in."""
    of = lambda e: F.collect_set(F.when(F.col("entity") == e, F.col("org")))
    return members.agg(F.array_sort(F.array_intersect(of(a), of(b))).alias("shared"))


def correlation_channel(panel: DataFrame, least: int = 5) -> DataFrame:
    """max(0, correlation) of entity pairs over common periods, row-normalised: a stand-in for a missing financial channel."""
    r = stats.pairwise_correlation(panel, least)
    return row_normalize(r.select("src", "dst", F.greatest("r", F.lit(0.0)).alias("w")))


def first_available(*options: Callable[[], DataFrame]) -> DataFrame:
    """The first of several tables that has rows; the last one if none has."""
    for make in options[:-1]:
        df = make()
        if not df.isEmpty():
            return df
    return options[-1]()


def channels_with_fallbacks(trade: DataFrame, claims: DataFrame, migrants: DataFrame, sizes: DataFrame, population: DataFrame, points: DataFrame,
                            members: DataFrame, growth: DataFrame, weights: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(channel, src, dst, w) and the channels' weights from what is at hand.

    Without trade dyads the gravity model stands in, without claims the correlation of growth (or nothing); without
    migrants that channel's weight goes to trade and geography.
    """
    parts = {
        "trade": first_available(lambda: row_normalize(accumulate(trade)), lambda: gravity(points, sizes)),
        "geographic": geographic(points),
        "financial": first_available(lambda: financial(claims, sizes), lambda: correlation_channel(growth)),
        "political": comembership(members),
    }
    if not migrants.isEmpty():
        parts["migration"] = migration(migrants, population)
    rows = [df.select(F.lit(name).alias("channel"), "src", "dst", "w") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows), channel_weights(set(parts), weights)


def channel_weights(present: set[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of the channels at hand: a missing migration channel goes to trade (53 %) and geography (47 %)."""
    w = dict(weights or DEFAULTS.channel_weights)
    if "migration" not in present and "migration" in w:
        moved = w.pop("migration")
        w["trade"] = w.get("trade", 0) + 0.53 * moved
        w["geographic"] = w.get("geographic", 0) + 0.47 * moved
    return {k: v for k, v in w.items() if k in present}


def combine(channels: DataFrame, weights: DataFrame) -> DataFrame:
    """One graph from (channel, src, dst, w): each channel row-normalised, weighted, summed; no self-loops; normalised.

    Weights (channel, weight) that are more than 0.01 off a sum of 1 are scaled to it.
    """
    total = weights.agg(F.sum("weight").alias("_t"))
    scaled = weights.join(F.broadcast(total)).select("channel", F.when(F.abs(F.col("_t") - 1) > 0.01, F.col("weight") / F.col("_t")).otherwise(F.col("weight")).alias("weight"))
    sums = F.sum("w").over(Window.partitionBy("channel", "src"))
    each = channels.withColumn("w", F.when(sums != 0, F.col("w") / sums).otherwise(F.lit(0.0)))
    one = row_normalize(each.join(scaled, "channel").groupBy("src", "dst").agg(F.sum(F.col("w") * F.col("weight")).alias("w")))
    return row_normalize(one.where("src <> dst"))


def combine_raw(channels: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of channels that are divided by their grand sums, not row-normalised."""
    totals = channels.groupBy("channel").agg(F.sum("w").alias("_t"))
    each = channels.join(totals, "channel").join(weights, "channel").where("_t > 0")
    return each.groupBy("src", "dst").agg(F.sum(F.col("w") / F.col("_t") * F.col("weight")).alias("w")).where("src <> dst")


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest edges, ties by their ends."""
    return edges.orderBy(F.desc("w"), "src", "dst").limit(n)


def strong_pairs(edges: DataFrame, least: float) -> DataFrame:
    """Unordered pairs (src < dst) whose symmetrised weight is at least ``least``."""
    return symmetric(edges).where((F.col("src") < F.col("dst")) & (F.col("w") >= least))


def uniformity(centrality: DataFrame, column: str, least: float = 2.0) -> DataFrame:
    """(ratio, near_uniform): largest over smallest positive value, flagged below ``least``."""
    r = centrality.where(F.col(column) > 0).agg((F.max(column) / F.min(column)).alias("ratio"))
    return r.withColumn("near_uniform", F.col("ratio") < least)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("entity")).union(edges.select("dst")).distinct()


def density(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density): positive edges over n (n - 1)."""
    n = nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.where("w > 0 and src <> dst").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(m).withColumn("density", F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))


def degrees(edges: DataFrame) -> DataFrame:
    """(entity, out_strength, in_strength, out_degree, in_degree)."""
    half = edges.where("w > 0").select(F.col("src").alias("entity"), F.col("w").alias("o"), F.lit(0.0).alias("i")).union(
        edges.where("w > 0").select("dst", F.lit(0.0), "w"))
    return half.groupBy("entity").agg(
        F.sum("o").alias("out_strength"), F.sum("i").alias("in_strength"),
        F.sum((F.col("o") > 0).cast("int")).cast("long").alias("out_degree"), F.sum((F.col("i") > 0).cast("int")).cast("long").alias("in_degree"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(W + W^T) / 2 without self-loops."""
    half = edges.where("src <> dst").select("src", "dst", (F.col("w") / 2).alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(src, dst, l, l_sym, l_rw) entries of the three Laplacians; isolated nodes have zero rows."""
    s = symmetric(edges)
    d = s.groupBy(F.col("src").alias("entity")).agg(F.sum("w").alias("d"))
    off = s.join(d.select(F.col("entity").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("entity").alias("dst"), F.col("d").alias("dd")), "dst").where("w <> 0")
    off = off.select("src", "dst", (-F.col("w")).alias("l"), (-F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("l_sym"), (-F.col("w") / F.col("ds")).alias("l_rw"))
    own = nodes(edges).join(d, "entity", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    one = F.when(F.col("d") > 0, 1.0).otherwise(0.0)
    return off.unionByName(own.select(F.col("entity").alias("src"), F.col("entity").alias("dst"), F.col("d").alias("l"), one.alias("l_sym"), one.alias("l_rw")))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman modularity of (entity, community) on the symmetrised graph, in closed form per community."""
    s = symmetric(edges)
    a, b = (labels.select(F.col("entity").alias(c), F.col("community").alias(f"_{c}")) for c in ("src", "dst"))
    both = s.join(a, "src").join(b, "dst")
    per = both.groupBy(F.col("_src").alias("community")).agg(
        F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("w")).otherwise(F.lit(0.0))).alias("inside"), F.sum("w").alias("degree"))
    total = s.agg(F.sum("w").alias("_m2"))
    return per.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("_m2") - F.pow(F.col("degree") / F.col("_m2"), 2)).alias("modularity"))


def dense(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(names, w) in one row, or one per ``by``: the sorted node names and the matrix as array<array<double>>."""
    n = nodes(edges).count()
    if n > DENSE_LIMIT:
        raise ValueError(f"{n} nodes; use the edge-table form above {DENSE_LIMIT}")
    rows = edges.groupBy(*by, "src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("m"))
    maps = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("src", "m"))).alias("rows"))
    names = nodes(edges).agg(F.array_sort(F.collect_list("entity")).alias("names"))
    cell = lambda i, j: F.coalesce(F.col("rows")[i][j], F.lit(0.0))
    return maps.join(F.broadcast(names)).select(*by, "names", F.transform("names", lambda i: F.transform("names", lambda j: cell(i, j))).alias("w"))


def small_graph(edges: DataFrame) -> bool:
    return nodes(edges).count() <= DENSE_LIMIT


def exploded(one: DataFrame, value: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """(entity, name) rows from a dense row and an array in the order of its names."""
    return one.select(*by, F.explode(F.arrays_zip("names", value.alias("x"))).alias("z")).select(*by, F.col("z.names").alias("entity"), F.col("z.x").alias(name))


def mat_vec(w: Column, x: Column) -> Column:
    return F.transform(w, lambda row: F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def transposed(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda j: F.transform(w, lambda row: row[j]))


def moved(edges: DataFrame, x: DataFrame, outgoing: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(by, entity, d): W x, or W^T x if not outgoing, of (by, entity, x) as a join and a sum with map-side combining.

    ``by`` keys several vectors; edges may have those columns too, or be the same for all.
    """
    key, other = ("src", "dst") if outgoing else ("dst", "src")
    on = [c for c in by if c in edges.columns]
    return (edges.join(x.withColumnRenamed("entity", other), [*on, other])
            .groupBy(*by, F.col(key).alias("entity")).agg(F.sum(F.col("w") * F.col("x")).alias("d")))


def recursion(edges: DataFrame, start: DataFrame, base: DataFrame, factor: float, steps: int, outgoing: bool = True,
              by: Sequence[str] = (), scaled: bool = False, every: int = 5) -> DataFrame:
    """(by, entity, x) after ``steps`` of x <- factor * W x + base, from ``start`` (by, entity, x), for graphs of any size.

    ``base`` is (by, entity, value) and has every entity.  With ``scaled``, x is divided by its sum in each step.
    """
    x = start
    for k in range(steps):
        x = base.join(moved(edges, x, outgoing, by), [*by, "entity"], "left").select(*by, "entity", (F.col("value") + factor * F.coalesce("d", F.lit(0.0))).alias("x"))
        if scaled:
            total = x.groupBy(*by).agg(F.sum("x").alias("_t"))
            x = (x.join(total, list(by)) if by else x.join(F.broadcast(total))).select(*by, "entity", (F.col("x") / F.col("_t")).alias("x"))
        if scaled or k % every == every - 1:
            x = x.checkpoint()
    return x


def pagerank(edges: DataFrame, damping: float = DEFAULTS.damping, steps: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """(by, entity, pagerank): r <- damping * W^T r + (1 - damping) / n from 1 / n, scaled to a sum of 1 at each step.

    Weights should be row-normalised; what dangling nodes hold is lost and made up for by the scale.  ``by`` are
    columns of ``edges`` that key several graphs over the same nodes.
    """
    n = nodes(edges).count()
    if n <= DENSE_LIMIT:
        one = dense(edges, by).select(*by, "names", transposed(F.col("w")).alias("wt"))
        start = F.transform("names", lambda _: F.lit(1.0 / n))

        def step(r, _):
            new = F.transform(mat_vec(F.col("wt"), r), lambda v: v * damping + (1 - damping) / n)
            return F.transform(F.array(new), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, u: s + u)))[0]

        return exploded(one, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step), "pagerank", by)
    every = nodes(edges).join(edges.select(*by).distinct()) if by else nodes(edges)
    every = every.checkpoint()
    start, base = (every.select(*by, "entity", F.lit(v).alias(c)) for v, c in ((1.0 / n, "x"), ((1 - damping) / n, "value")))
    return recursion(edges, start, base, damping, steps, outgoing=False, by=by, scaled=True).withColumnRenamed("x", "pagerank")


def pagerank_until(edges: DataFrame, damping: float = DEFAULTS.damping, most: int = 200, tolerance: float = 1e-10, outgoing: bool = True) -> DataFrame:
    """(entity, pagerank) as ``pagerank``, until a step changes the ranks by less than ``tolerance`` (Euclidean) or ``most`` steps.

    The ranks before that last step are the result.  With ``outgoing`` rank flows along the edges, else against them.
    """
    n = nodes(edges).count()
    if n <= DENSE_LIMIT:
        one = dense(edges).select("names", (transposed(F.col("w")) if outgoing else F.col("w")).alias("wt"))

        def step(state, _):
            raw = F.transform(mat_vec(F.col("wt"), state["r"]), lambda v: v * damping + (1 - damping) / n)
            new = F.transform(F.array(raw), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, u: s + u)))[0]
            away = lambda x: F.sqrt(F.aggregate(F.zip_with(x, state["r"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
            moved_on = F.transform(F.array(new), lambda x: F.when(away(x) < tolerance, F.struct(state["r"].alias("r"), F.lit(True).alias("done"))).otherwise(F.struct(x.alias("r"), F.lit(False).alias("done"))))[0]
            return F.when(state["done"], state).otherwise(moved_on)

        start = F.struct(F.transform("names", lambda _: F.lit(1.0 / n)).alias("r"), F.lit(False).alias("done"))
        return exploded(one, F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda state: state["r"]), "pagerank")
    every = nodes(edges).checkpoint()
    x, base = (every.withColumn(c, F.lit(v)) for c, v in (("x", 1.0 / n), ("value", (1 - damping) / n)))
    for _ in range(most):
        new = recursion(edges, x, base, damping, 1, outgoing=not outgoing, scaled=True)
        away = new.join(x.withColumnRenamed("x", "_x"), "entity").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("_x"), 2)))).first()[0]
        if away < tolerance:
            break
        x = new
    return x.withColumnRenamed("x", "pagerank")


def eigenvector_centrality(edges: DataFrame, incoming: bool = False, steps: int = 100) -> DataFrame:
    """(entity, centrality): the leading eigenvector of W (or W^T) with a sum of 1, by power iteration.

    The iteration runs on W plus its mean row sum times the identity, which has the same eigenvectors and, for a graph
    that falls into two sides, one leading one.
    """
    n = nodes(edges).count()
    shift = (edges.agg(F.sum("w")).first()[0] or 0.0) / max(n, 1)
    if n <= DENSE_LIMIT:
        one = dense(edges)
        w = transposed(F.col("w")) if incoming else F.col("w")

        def step(v, _):
            new = F.zip_with(mat_vec(F.col("_w"), v), v, lambda a, b: a + b * shift)
            return F.transform(F.array(new), lambda x: F.transform(x, lambda u: u / F.aggregate(x, F.lit(1e-300), lambda s, y: s + y)))[0]

        start = F.transform("names", lambda _: F.lit(1.0 / n))
        return exploded(one.withColumn("_w", w), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step), "centrality")
    every = nodes(edges).checkpoint()
    loops = edges.select("src", "dst", "w").union(every.select("entity", F.col("entity"), F.lit(shift)))
    start, base = every.withColumn("x", F.lit(1.0 / n)), every.withColumn("value", F.lit(0.0))
    return recursion(loops, start, base, 1.0, steps, outgoing=not incoming, scaled=True).withColumnRenamed("x", "centrality")


def spectral_radius(edges: DataFrame, steps: int = 100) -> DataFrame:
    """(radius): the largest eigenvalue of a non-negative W, the Rayleigh-like quotient sum(W v) / sum(v) of its leading vector."""
    v = eigenvector_centrality(edges, steps=steps).withColumnRenamed("centrality", "x").checkpoint()
    return moved(edges, v).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("radius"))


def hops(edges: DataFrame, sources: DataFrame, each: bool = False) -> DataFrame:
    """(entity, hops) from the nearest source (entity), a frontier at a time until it is empty; entities out of reach are left out.

    With ``each``, (source, entity, hops) from every source by itself.
    """
    seen = sources.select(F.col("entity").alias("source") if each else F.lit("").alias("source"), "entity").distinct().withColumn("hops", F.lit(0)).checkpoint()
    frontier, links, k = seen, edges.where("w > 0").select("src", "dst"), 0
    while frontier.limit(1).count():
        k += 1
        ahead = links.join(frontier.select("source", F.col("entity").alias("src")), "src").select("source", F.col("dst").alias("entity")).distinct()
        frontier = ahead.join(seen, ["source", "entity"], "left_anti").withColumn("hops", F.lit(k)).checkpoint()
        seen = seen.union(frontier)
        if k % 10 == 0:
            seen = seen.checkpoint()
    return seen if each else seen.drop("source")


#: Sources whose searches run side by side.
SOURCE_BATCH = 2000


def betweenness(edges: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(entity, betweenness) on edges at or above a quantile of the positive weights, largest value 1.

    Breadth-first searches from a batch of sources advance together, a join of their frontiers with the edges per
    step; shares of shortest paths are then added up from the farthest step back.
    """
    cut = stats.quantile(edges.where("w > 0"), "w", quantile).first()[0]
    strong = edges.where((F.col("w") > 0) & (F.col("w") >= F.lit(cut)) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct().checkpoint()
    every = nodes(edges).checkpoint()
    batches, sums = max(1, -(-every.count() // SOURCE_BATCH)), None
    for batch in range(batches):
        own = every.where(F.pmod(F.xxhash64("entity"), F.lit(batches)) == batch)
        frontier = own.select(F.col("entity").alias("source"), "entity", F.lit(1.0).alias("paths")).checkpoint()
        seen, levels = frontier.select("source", "entity"), [frontier]
        while frontier.limit(1).count():
            ahead = strong.join(frontier.withColumnRenamed("entity", "src"), "src").groupBy("source", F.col("dst").alias("entity")).agg(F.sum("paths").alias("paths"))
            frontier = ahead.join(seen, ["source", "entity"], "left_anti").checkpoint()
            seen = seen.union(frontier.select("source", "entity")).checkpoint()
            levels.append(frontier)
        back = None
        for far, near in zip(levels[:0:-1], levels[-2::-1], strict=True):
            due = far.select("source", F.col("entity").alias("dst"), "paths") if back is None else far.join(back, ["source", "entity"], "left").select("source", F.col("entity").alias("dst"), "paths", "share")
            due = due.withColumn("due", (1 + (F.coalesce("share", F.lit(0.0)) if "share" in due.columns else F.lit(0.0))) / F.col("paths")).select("source", "dst", "due")
            back = (strong.join(due, "dst").join(near.select("source", F.col("entity").alias("src"), "paths"), ["source", "src"])
                    .groupBy("source", F.col("src").alias("entity")).agg(F.sum(F.col("paths") * F.col("due")).alias("share"))).checkpoint()
            part = back.where("source <> entity").select("entity", "share")
            sums = part if sums is None else sums.union(part)
    total = sums.groupBy("entity").agg(F.sum("share").alias("b")) if sums is not None else every.select("entity", F.lit(0.0).alias("b"))
    every = every.join(total, "entity", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    top = every.agg(F.max("b").alias("_m"))
    return every.join(F.broadcast(top)).select("entity", (F.col("b") / F.greatest("_m", F.lit(1e-10))).alias("betweenness"))


def spectrum(edges: DataFrame, most: int = 40, **how) -> DataFrame:
    """(k, re, im, magnitude) of the leading eigenvalues of W, by descending magnitude; all of them on graphs of up to ``most`` nodes."""
    values, _, _ = eigen.leading(edges, nodes(edges), most, False, **how)
    values = values + 0j
    rows = [(i + 1, float(v.real), float(v.imag), float(abs(v))) for i, v in enumerate(values)]  # ``most`` rows
    return edges.sparkSession.createDataFrame(rows, "k int, re double, im double, magnitude double")


def lowest_modes(edges: DataFrame, k: int, normal: bool = True, **how) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` smallest eigenvalues of the (normalised) Laplacian and the table (entity, x array) of their vectors."""
    l = laplacian(edges).select("src", "dst", F.col("l_sym" if normal else "l").alias("w")).checkpoint()
    bound = 2.0 if normal else 2 * (l.where("src = dst").agg(F.max("w")).first()[0] or 0.0)  # no value is above twice the largest degree
    values, vectors, _ = eigen.lowest(l, nodes(edges), k, bound, **how)
    return values, vectors


def fiedler(edges: DataFrame, **how) -> DataFrame:
    """(entity, value, side, lambda2, relaxation): second Laplacian eigenpair, its sign partition and 1 / lambda2."""
    values, vectors = lowest_modes(edges, 2, normal=False, **how)
    if len(values) < 2:
        return nodes(edges).select("entity", F.lit(0.0).alias("value"), F.lit("A").alias("side"), F.lit(0.0).alias("lambda2"), F.lit(float("inf")).alias("relaxation"))
    lam = float(values[1])
    v = eigen.turned(vectors.select("entity", F.slice("x", 2, 1).alias("x")), 1)
    return v.select("entity", F.col("x")[0].alias("value"), F.when(F.col("x")[0] >= 0, "A").otherwise("B").alias("side"),
                    F.lit(lam).alias("lambda2"), F.lit(1 / lam if lam > 1e-10 else float("inf")).alias("relaxation"))


def embedding(edges: DataFrame, size: int = 3, **how) -> DataFrame:
    """(entity, x array): eigenvectors 2.. of the normalised Laplacian, each with its largest entry positive."""
    values, vectors = lowest_modes(edges, size + 1, **how)
    return eigen.turned(vectors.select("entity", F.slice("x", 2, size).alias("x")), max(0, len(values) - 1))


def resilience(edges: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(entity, pagerank, betweenness, side, lambda2, relaxation, density): the network's measures side by side."""
    edges = edges.checkpoint()
    per = pagerank(edges).join(betweenness(edges, quantile), "entity").join(fiedler(edges).drop("value"), "entity")
    return per.join(F.broadcast(density(edges).select("density")))


def spectral_clusters(edges: DataFrame, k: int | None = None, tries: int = 20, seed: int = 42, **how) -> DataFrame:
    """(entity, community): k-means on row-normalised eigenvectors; k by the largest eigengap, 2 to 15.

    Communities are numbered by their smallest member.
    """
    n = nodes(edges).count()
    most = max(2, min(20, n // 5))
    values, vectors = lowest_modes(edges, k or min(n, most + 1), **how)
    groups = k or int(np.clip(np.argmax(np.diff(values[1 : most + 1])) + 2 if len(values) > 3 and most > 2 else 2, 2, 15))
    x = F.slice("x", 1, groups)
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = F.transform(x, lambda v: F.when(F.col("_s") > 1e-12, v / F.col("_s")).otherwise(v))
    return eigen.k_means(vectors.withColumn("_s", size).select("entity", unit.alias("x")), groups, tries, seed=seed)
