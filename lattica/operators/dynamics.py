"""Linear propagation x = alpha W x + (1 - alpha) s: steady states, trajectories, shocks and cascades.

Everything follows from the sensitivities L = sum of (alpha W)^k: a steady state is (1 - alpha) L s, and shocks add
up because x is linear in s.  Small graphs use one array expression, larger ones joins, with the same steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import dense, exploded, hops, mat_vec, moved, nodes, recursion, row_normalize, small_graph, spectral_radius
from lattica.operators.stats import quantile
from lattica.schema import DEFAULTS, SENSITIVITY_LIMIT

#: Terms of the Neumann series; at alpha 0.4 the rest is below 1e-15.
TERMS = 60


def stability(radius: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """(radius, alpha, effective, margin, stable) from the spectral radius (see ``graph.spectral_radius``)."""
    effective = F.col("radius") * alpha
    return radius.select("radius", F.lit(alpha).alias("alpha"), effective.alias("effective"), (1 - effective).alias("margin"), (effective < 1).alias("stable"))


def _vector(one: DataFrame, scores: DataFrame) -> DataFrame:
    """The dense row with ``s``, the scores in the order of its names (missing ones 0)."""
    held = scores.agg(F.map_from_entries(F.collect_list(F.struct("entity", "score"))).alias("_m"))
    return one.join(held).withColumn("s", F.transform("names", lambda n: F.coalesce(F.col("_m")[n], F.lit(0.0)))).drop("_m")


def _step(w: Column, x: Column, s: Column, alpha: float) -> Column:
    return F.zip_with(mat_vec(w, x), s, lambda a, b: a * alpha + b * (1 - alpha))


def _filled(edges: DataFrame, scores: DataFrame, name: str, share: float = 1.0) -> DataFrame:
    """(entity, name) for every node: its score times ``share``, 0 without one."""
    return nodes(edges).join(scores, "entity", "left").select("entity", (share * F.coalesce("score", F.lit(0.0))).alias(name))


def steady_state(edges: DataFrame, scores: DataFrame, alpha: float = DEFAULTS.alpha, terms: int = TERMS) -> DataFrame:
    """(entity, steady_state) of the recursion from x = s; alpha must be below 1."""
    if not 0 <= alpha < 1:
        raise ValueError("a steady state needs 0 <= alpha < 1")
    if small_graph(edges):
        one = _vector(dense(edges), scores)
        x = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.col("s"), lambda x, _: _step(F.col("w"), x, F.col("s"), alpha))
        return exploded(one, x, "steady_state")
    base = _filled(edges, scores, "value", 1 - alpha).checkpoint()
    return recursion(edges, _filled(edges, scores, "x"), base, alpha, terms).withColumnRenamed("x", "steady_state")


def simulate(edges: DataFrame, scores: DataFrame, start: DataFrame, alpha: float = DEFAULTS.alpha, steps: int = 50, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """(t, entity, x): the trajectory from ``start`` (entity, score), t = 0 included.

    ``noise`` is the standard deviation of a normal term that is added in every step, drawn from a hash of entity, t
    and ``seed``, so that it is the same wherever and however often a step is computed.
    """
    if small_graph(edges) and not noise:
        one = _vector(dense(edges), scores)
        first = start.agg(F.map_from_entries(F.collect_list(F.struct("entity", "score"))).alias("_m"))
        one = one.join(first).withColumn("x0", F.transform("names", lambda n: F.coalesce(F.col("_m")[n], F.lit(0.0))))
        path = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), F.array("x0"),
            lambda acc, _: F.concat(acc, F.array(_step(F.col("w"), F.element_at(acc, -1), F.col("s"), alpha))))
        return one.select("names", F.posexplode(path).alias("t", "x")).select("t", F.explode(F.arrays_zip("names", "x")).alias("z")).select(
            "t", F.col("z.names").alias("entity"), F.col("z.x").alias("x"))
    base, x = _filled(edges, scores, "value", 1 - alpha).checkpoint(), _filled(edges, start, "x").checkpoint()
    path = [x.withColumn("t", F.lit(0))]
    for t in range(1, steps + 1):
        x = recursion(edges, x, base, alpha, 1)
        if noise:
            x = x.withColumn("x", F.col("x") + noise * normal_draw("entity", F.lit(t), F.lit(seed)))
        x = x.checkpoint()
        path.append(x.withColumn("t", F.lit(t)))
    return reduce(DataFrame.union, path).select("t", "entity", "x")


def normal_draw(*keys) -> Column:
    """A standard normal value that follows from the keys (Box-Muller on two hashes)."""
    unit = lambda k: (F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))


def sensitivities(edges: DataFrame, alpha: float = DEFAULTS.alpha, terms: int = TERMS, grid: bool = False, cut: float = 1e-16) -> DataFrame:
    """(target, source, l): (1 - alpha) times the inverse of I - alpha W; pairs without an influence have no row unless ``grid``.

    On graphs of up to ``SENSITIVITY_LIMIT`` nodes one expression a source; on larger ones the shares of all sources
    are pushed along the edges, a join a term, until none is left.  Shares below ``cut`` are not pushed on: with weights
    that add up to 1 at most for an entity, that takes less than cut * terms from any value.
    """
    every = nodes(edges).checkpoint()
    if small_graph(edges) and every.count() <= SENSITIVITY_LIMIT:
        one = dense(edges).select("names", "w")
        unit = F.transform("names", lambda n, i: F.when(i == F.col("j"), 1.0).otherwise(0.0))
        per = one.select("names", "w", F.posexplode("names").alias("j", "source")).repartition(8, "j").withColumn("e", unit)
        x = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.col("e"), lambda x, _: F.zip_with(mat_vec(F.col("w"), x), F.col("e"), lambda a, b: a * alpha + b))
        total = per.select("source", F.explode(F.arrays_zip("names", x.alias("x"))).alias("z")).select("source", F.col("z.names").alias("entity"), F.col("z.x").alias("x")).where("x <> 0")
    else:
        x = total = every.select(F.col("entity").alias("source"), "entity", F.lit(1.0).alias("x")).checkpoint()
        for _ in range(terms):
            x = moved(edges, x, by=["source"]).select("source", "entity", (alpha * F.col("d")).alias("x")).where(F.abs("x") >= cut).checkpoint()
            if not x.limit(1).count():
                break
            total = total.union(x).groupBy("source", "entity").agg(F.sum("x").alias("x")).checkpoint()
    if grid:
        total = every.select(F.col("entity").alias("source")).join(every).join(total, ["source", "entity"], "left")
    return total.select(F.col("entity").alias("target"), "source", (F.coalesce("x", F.lit(0.0)) * (1 - alpha)).alias("l"))


def factor_shock(sens: DataFrame, base: DataFrame, shocks: DataFrame) -> DataFrame:
    """(scenario_id, entity, base, shocked, delta) for shocks (scenario_id, entity, delta) on the scores; every entity of ``base`` has a row."""
    moved = sens.join(shocks.select("scenario_id", F.col("entity").alias("source"), "delta"), "source").select("scenario_id", F.col("target").alias("entity"), (F.col("l") * F.col("delta")).alias("delta"))
    still = base.select("entity").join(shocks.select("scenario_id").distinct()).select("scenario_id", "entity", F.lit(0.0).alias("delta"))
    delta = moved.union(still).groupBy("scenario_id", "entity").agg(F.sum("delta").alias("delta"))
    return delta.join(base.select("entity", F.col("steady_state").alias("base")), "entity").select("scenario_id", "entity", "base", (F.col("base") + F.col("delta")).alias("shocked"), "delta")


def top_impacted(shocked: DataFrame, entity: str, n: int = 10) -> DataFrame:
    """The ``n`` largest changes apart from the shocked entity itself."""
    return shocked.where(F.col("entity") != entity).orderBy(F.desc(F.abs("delta")), "entity").limit(n)


def convergence_step(path: DataFrame, target: DataFrame, change: DataFrame, share: float = 0.01) -> DataFrame:
    """The first t at which the distance to the target is below ``share`` of the whole change; NULL if none is."""
    size = change.agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("_size"))
    away = path.join(target.select("entity", F.col("steady_state").alias("_x")), "entity").groupBy("t").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("_x"), 2))).alias("d"))
    return away.join(F.broadcast(size)).agg(F.min(F.when(F.col("d") < share * F.col("_size"), F.col("t"))).alias("step"))


def edge_shock(edges: DataFrame, shocks: DataFrame) -> DataFrame:
    """Edges of one scenario with (src, dst, multiplier) applied in both directions, normalised again."""
    both = shocks.select("src", "dst", "multiplier").unionByName(shocks.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "multiplier")).groupBy("src", "dst").agg(F.product("multiplier").alias("multiplier"))
    return row_normalize(edges.join(both, ["src", "dst"], "left").select("src", "dst", (F.col("w") * F.coalesce("multiplier", F.lit(1.0))).alias("w")))


def _shocked(edges: DataFrame, scores: DataFrame, factors: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    new = scores.join(factors.groupBy("entity").agg(F.sum("delta").alias("_d")), "entity", "left").select("entity", (F.col("score") + F.coalesce("_d", F.lit(0.0))).alias("score"))
    return (edges if links.isEmpty() else edge_shock(edges, links)), new


def compound_scenario(edges: DataFrame, scores: DataFrame, factors: DataFrame, links: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """(entity, base, shocked, delta) with all factor and edge shocks of one scenario applied together.

    With no factors this is an edge shock's effect on the steady state.
    """
    changed, new = _shocked(edges, scores, factors, links)
    before, after = steady_state(edges, scores, alpha), steady_state(changed, new, alpha)
    return before.withColumnRenamed("steady_state", "base").join(after.withColumnRenamed("steady_state", "shocked"), "entity").withColumn("delta", F.col("shocked") - F.col("base"))


def scenario_stability(edges: DataFrame, scores: DataFrame, factors: DataFrame, links: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """(radius_before, radius, effective, margin, stable, divergence_rate) of one scenario; the rate is NULL where it is stable."""
    changed, _ = _shocked(edges, scores, factors, links)
    after = stability(spectral_radius(changed.checkpoint()), alpha)
    return after.join(spectral_radius(edges).withColumnRenamed("radius", "radius_before")).select(
        "radius_before", "radius", "effective", "margin", "stable", F.when(~F.col("stable"), F.col("effective") - 1).alias("divergence_rate"))


def scenario_trajectory(edges: DataFrame, scores: DataFrame, factors: DataFrame, links: DataFrame, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """(t, entity, x): 50 steps from the old steady state if the scenario is stable, else the first 20 from the scores."""
    changed, new = _shocked(edges, scores, factors, links)
    changed = changed.checkpoint()
    if stability(spectral_radius(changed), alpha).first()["stable"]:
        return simulate(changed, new, steady_state(edges, scores, alpha).withColumnRenamed("steady_state", "score"), alpha, 50)
    return simulate(changed, new, new, alpha, 20)


def threshold(base: DataFrame, percentile: float = DEFAULTS.cascade_percentile) -> DataFrame:
    return quantile(base, "steady_state", percentile, "theta")


def crossings(sens: DataFrame, base: DataFrame, magnitude: float = DEFAULTS.risk_shock) -> DataFrame:
    """(source, target, before, after) of entities that a shock of ``magnitude`` on another one lifts above the 90 % point."""
    b = base.select(F.col("entity").alias("target"), F.col("steady_state").alias("before")).join(F.broadcast(threshold(base)))
    return sens.where("source <> target").join(b, "target").withColumn("after", F.col("before") + magnitude * F.col("l")).where("after > theta and before <= theta").select("source", "target", "before", "after")


def systemic_risk(sens: DataFrame, base: DataFrame, magnitude: float = DEFAULTS.risk_shock) -> DataFrame:
    """(entity, systemic_risk): how many others a shock on the entity lifts above the threshold."""
    n = crossings(sens, base, magnitude).groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return base.select("entity").join(n, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("systemic_risk"))


def contagion_threshold(sens: DataFrame, base: DataFrame, points: int = 50, most: float = 5.0) -> DataFrame:
    """(source, critical, crossed): smallest magnitude of the grid at which another entity crosses, and how many do at ``most``.

    Each crossing has a closed form, (theta - x_j) / l_ij, so no sweep is run.
    """
    b = base.select(F.col("entity").alias("target"), F.col("steady_state").alias("x")).join(F.broadcast(threshold(base))).where("x <= theta")
    at = sens.where("source <> target and l > 0").join(b, "target").select("source", ((F.col("theta") - F.col("x")) / F.col("l")).alias("m"))
    step = most / points
    grid = (F.floor(F.col("m") / step) + 1) * step
    return at.where(F.col("m") < most).groupBy("source").agg(F.min(grid).alias("critical"), F.count(F.lit(1)).alias("crossed"))


def domino(edges: DataFrame, base: DataFrame, sens: DataFrame, first: str, magnitude: float, share: float = 0.5, most: int = 20) -> DataFrame:
    """(step, entity, trigger): each newly fallen entity adds ``share`` of the shock on itself, until none falls.

    A fallen entity's trigger is the fallen neighbour with the largest weight towards it.  Entities above the
    threshold from the start fall at step 1.
    """
    theta = threshold(base).first()["theta"]
    x = base.select("entity", F.col("steady_state").alias("x"))
    shock = sens.where(F.col("source") == first).select(F.col("target").alias("entity"), (F.col("l") * magnitude).alias("d"))
    fallen = x.where(F.col("entity") == first).select("entity", F.lit(0).alias("step"), F.lit(None).cast("string").alias("trigger")).checkpoint()
    for k in range(1, most + 1):
        x = x.join(shock, "entity", "left").select("entity", (F.col("x") + F.coalesce("d", F.lit(0.0))).alias("x")).checkpoint()
        new = x.where(F.col("x") > theta).join(fallen, "entity", "left_anti").select("entity").checkpoint()
        if not new.limit(1).count():
            break
        near = edges.join(fallen.select(F.col("entity").alias("dst")), "dst").join(new.select(F.col("entity").alias("src")), "src").groupBy(F.col("src").alias("entity")).agg(F.max_by("dst", F.struct("w", "dst")).alias("trigger"))
        fallen = fallen.unionByName(new.join(near, "entity", "left").select("entity", F.lit(k).alias("step"), "trigger")).checkpoint()
        shock = sens.join(new.select(F.col("entity").alias("source")), "source").groupBy(F.col("target").alias("entity")).agg((F.sum("l") * magnitude * share).alias("d"))
    return fallen.select("step", "entity", "trigger")


def cascade_report(edges: DataFrame, base: DataFrame, sens: DataFrame, shocked: DataFrame, magnitude: float, theta: float | None = None) -> DataFrame:
    """(crossed, breadth, depth, amplification) of a shock of ``magnitude`` on every entity of ``shocked`` (entity).

    Breadth is the share of other entities that it lifts above the threshold (the 90 % point unless given); depth the
    most hops from a shocked entity to one of them over edges above the median positive weight, or the number of
    entities if one is out of reach; amplification the largest change of another entity per unit of the shock.
    """
    who, theta = shocked.select("entity").distinct().checkpoint(), threshold(base).first()["theta"] if theta is None else theta
    delta = sens.join(who.select(F.col("entity").alias("source")), "source").groupBy(F.col("target").alias("entity")).agg((F.sum("l") * magnitude).alias("delta"))
    others = base.join(who, "entity", "left_anti").join(delta, "entity", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    crossed = (F.col("steady_state") + F.col("delta") > theta) & (F.col("steady_state") <= theta)
    others = others.withColumn("crossed", crossed).checkpoint()
    middle = quantile(edges.where("w > 0"), "w", 0.5).first()[0]
    strong, n = edges.where(F.col("w") > F.lit(middle)), nodes(edges).count()
    reach = hops(strong, who, each=True).join(others.where("crossed").select("entity"), "entity").groupBy("entity").agg(F.max("hops").alias("far"), F.count(F.lit(1)).alias("met"))
    far = others.where("crossed").join(reach, "entity", "left").withColumn("far", F.when(F.coalesce("met", F.lit(0)) < who.count(), n).otherwise(F.col("far")))
    depth = far.agg(F.coalesce(F.max("far"), F.lit(0)).alias("depth"))
    sums = others.agg(F.count_if("crossed").alias("crossed"), F.count(F.lit(1)).alias("_n"), F.max(F.abs("delta")).alias("_d"))
    return sums.join(depth).select("crossed", (F.col("crossed") / F.greatest("_n", F.lit(1))).alias("breadth"), "depth", (F.coalesce("_d", F.lit(0.0)) / max(magnitude, 1e-10)).alias("amplification"))
