"""Statistical operators over long tables; dense algebra only on indicator-by-indicator matrices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import clip
from lattica.schema import DEFAULTS


def group_quantiles(df: DataFrame, by: Sequence[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """(by, wanted names): exact, linearly interpolated quantiles of every group, all at once; NULL values don't count.

    Equal values of a group are counted first.  The counts are dealt by ranges of (group, value), so that a group of
    any size is spread over tasks, and added up within a range; what a group has in earlier ranges, a row a range, is
    added to find the ranges, and in them the values, that the quantiles fall on.  No task holds a group.
    """
    keys, n, at = list(by), F.col("_n"), F.col("_at")
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()).checkpoint()
    group = Window.partitionBy(*keys)
    parts = dealt.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s")).select(
        *keys, "_p", F.sum("_s").over(group).alias("_n"), (F.sum("_s").over(group.orderBy("_p")) - F.col("_s")).alias("_before"))
    within = Window.partitionBy("_p", *keys).orderBy("_v")
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("_p", *keys)])
    placed = dealt.withColumn("_own", F.sum("_c").over(within) - F.col("_c")).alias("a").join(parts.alias("b"), same).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], "_v", "_c", "_n", (F.col("_own") + F.col("_before")).alias("_at"))
    picked = []
    for name, q in wanted.items():
        low = F.floor(q * (n - 1))
        on = lambda k: (at <= k) & (k < at + F.col("_c"))
        first, second = (F.max(F.when(on(k), F.col("_v"))) for k in (low, F.least(low + 1, n - 1)))
        picked.append((first + F.max(q * (n - 1) - low) * (second - first)).alias(name))
    return placed.groupBy(*keys).agg(*picked)


def winsorize(panel: DataFrame, low: float = DEFAULTS.winsor[0], high: float = DEFAULTS.winsor[1]) -> DataFrame:
    """Clip each indicator at exact, linearly interpolated quantiles; NULL stays NULL."""
    bounds = group_quantiles(panel, ["indicator"], "value", {"_lo": low, "_hi": high})
    return panel.join(bounds, "indicator", "left").withColumn("value", clip("value", F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def robust_z(panel: DataFrame, factor: float = DEFAULTS.mad_factor) -> DataFrame:
    """(x - median) / (factor * MAD) per indicator; with MAD 0 every row is 0, NULL ones too."""
    centred = panel.join(group_quantiles(panel, ["indicator"], "value", {"_m": 0.5}), "indicator", "left").withColumn("_away", F.abs(F.col("value") - F.col("_m")))
    spread = group_quantiles(centred, ["indicator"], "_away", {"_mad": 0.5})
    z = F.when(F.coalesce(F.col("_mad"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("_m")) / (factor * F.col("_mad")))
    return centred.join(spread, "indicator", "left").withColumn("value", z).drop("_m", "_mad", "_away")


def numbered(df: DataFrame, orders: Sequence[Column], name: str = "rank", size: Column | None = None) -> DataFrame:
    """``df`` with the running number of each row in the order ``orders``, 1..n; with ``size``, the sum of it over all rows before.

    Rows are dealt by ranges of the order and numbered within each; the sums of earlier ranges, a row a range, are
    added.  No task holds more than its range.
    """
    dealt = df.repartitionByRange(*orders).withColumn("_p", F.spark_partition_id()).checkpoint()
    amount = F.lit(1) if size is None else size
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_p").agg(F.sum(amount).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_p").orderBy(*orders)
    own = F.row_number().over(within) if size is None else F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(parts), "_p").withColumn(name, own + F.col("_before")).drop("_p", "_before")


def quantile(df: DataFrame, column: str, q: float, name: str = "q") -> DataFrame:
    """The exact, linearly interpolated quantile of the values that are not NULL, as one row (NULL without values).

    Values are numbered by ranges, so that no task holds them all, as an exact percentile would.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    n = values.count()
    low = int(q * (n - 1)) if n else 0
    pair = numbered(values, [F.col("_v")], "_k").where(F.col("_k").isin(low + 1, min(low + 2, n)))
    return pair.agg((F.min("_v") + (q * (n - 1) - low) * (F.max("_v") - F.min("_v"))).alias(name))


def ranked(df: DataFrame, score: str, key: str = "entity", name: str = "rank") -> DataFrame:
    """Unique ranks 1..n by descending score, ties by key."""
    return numbered(df, [F.desc_nulls_last(score), F.col(key)], name).withColumn(name, F.col(name).cast("int"))


def average_ranks(df: DataFrame, c: str, name: str) -> DataFrame:
    """``df`` with the rank of ``c``, ties averaged: distinct values are counted, numbered and joined back."""
    values = numbered(df.groupBy(c).agg(F.count(F.lit(1)).alias("_c")), [F.col(c)], "_below", F.col("_c"))
    return df.join(values.select(c, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name)), c)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman coefficients over complete pairs, and their number."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    both = average_ranks(average_ranks(pairs.checkpoint(), "x", "rx"), "y", "ry")
    return both.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def with_p_values(correlations: DataFrame) -> DataFrame:
    """Rows of (pearson, spearman, n, ...) with their two-sided p-values p_pearson and p_spearman."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p_value(a, b) for a, b in zip(r, n, strict=True)], dtype=float)

    return correlations.withColumn("p_pearson", p("pearson", "n")).withColumn("p_spearman", p("spearman", "n"))


def benchmark_check(scores: DataFrame, benchmark: DataFrame, least: float = 0.70, fewest: int = 10) -> DataFrame:
    """(pearson, spearman, n, passed): agreement of (entity, score) with (entity, value); too few pairs fail."""
    r = correlation(scores.join(benchmark, "entity"), "score", "value")
    strong = (F.abs("pearson") >= least) | (F.abs("spearman") >= least)
    return r.withColumn("passed", F.coalesce((F.col("n") >= fewest) & strong, F.lit(False)))


def gaps(values: DataFrame, k: str = "k", value: str = "magnitude") -> DataFrame:
    """(k, gap): the difference of each value to the next one in order."""
    return values.select(k, (F.col(value) - F.lead(value).over(Window.orderBy(k))).alias("gap")).where("gap is not null")


def cumulative_share(components: DataFrame) -> DataFrame:
    """(component, eigenvalue, share, cumulative) of the distinct components."""
    c = components.select("component", "eigenvalue").distinct()
    total = c.agg(F.sum("eigenvalue").alias("_t"))
    upto = F.sum("eigenvalue").over(Window.orderBy("component"))  # as many rows as indicators
    return c.join(F.broadcast(total)).select("component", "eigenvalue", (F.col("eigenvalue") / F.col("_t")).alias("share"), (upto / F.col("_t")).alias("cumulative"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by the t distribution with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    a, b = (n - 2) / 2, 0.5
    x = 1 - r * r  # = dof / (dof + t^2)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def pairwise_correlation(panel: DataFrame, least: int = 5) -> DataFrame:
    """Correlation of entity pairs over common periods: (src, dst, r, n), src <> dst; 0 below ``least`` periods or if undefined."""
    a = panel.where("value is not null").select("period", F.col("entity").alias("src"), F.col("value").alias("x"))
    b = panel.where("value is not null").select("period", F.col("entity").alias("dst"), F.col("value").alias("y"))
    r = a.join(b, "period").where("src <> dst").groupBy("src", "dst").agg(
        F.corr("x", "y").alias("_r"), F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))
    defined = (F.col("n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return r.select("src", "dst", F.when(defined, F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0)).alias("r"), "n")


def correlation_matrix(matrix: DataFrame) -> DataFrame:
    """Indicator-by-indicator correlations of (entity, indicator, value): (a, b, r), NULL cells replaced by the indicator's mean.

    An undefined correlation is 0, the diagonal 1.
    """
    mean = F.avg("value").over(Window.partitionBy("indicator"))
    full = matrix.withColumn("value", F.coalesce("value", mean)).where("value is not null")
    a = full.select("entity", F.col("indicator").alias("a"), F.col("value").alias("x"))
    b = full.select("entity", F.col("indicator").alias("b"), F.col("value").alias("y"))
    r = a.join(b, "entity").groupBy("a", "b").agg(
        F.covar_pop("x", "y").alias("_c"), F.stddev_pop("x").alias("_x"), F.stddev_pop("y").alias("_y"))
    value = F.when(F.col("a") == F.col("b"), F.lit(1.0)).when((F.col("_x") > 0) & (F.col("_y") > 0), F.col("_c") / (F.col("_x") * F.col("_y"))).otherwise(F.lit(0.0))
    return r.select("a", "b", value.alias("r"))


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with a sum of at least 0 (if it is 0, with a positive first non-zero entry)."""
    out = vectors.copy()
    for k in range(out.shape[1]):
        total = out[:, k].sum()
        lead = total if abs(total) > 1e-12 else next((v for v in out[:, k] if abs(v) > 1e-12), 1.0)
        if lead < 0:
            out[:, k] *= -1
    return out


def retained(values: np.ndarray, kaiser: float = DEFAULTS.kaiser, share: float = DEFAULTS.cumulative_variance) -> int:
    """Components kept: the larger of those above the Kaiser bound and those that reach the share of variance."""
    total = np.cumsum(values) / values.sum()
    return min(len(values), max(int((values > kaiser).sum()), int(np.searchsorted(total, share - 1e-12) + 1)))


def varimax(loadings: np.ndarray, sweeps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Varimax rotation: the planes of two factors are turned in their own best angle until none turns any more.

    In a plane with u = x^2 - y^2 and v = 2 x y, the variance of squared loadings is largest at a quarter of the angle
    of (sum(u^2 - v^2) - (sum(u)^2 - sum(v)^2) / n, 2 (sum(u v) - sum(u) sum(v) / n)).
    """
    a = loadings.copy()
    for _ in range(sweeps):
        most = 0.0
        for i, j in combinations(range(a.shape[1]), 2):
            u, v = a[:, i] ** 2 - a[:, j] ** 2, 2 * a[:, i] * a[:, j]
            across = 2 * ((u * v).sum() - u.sum() * v.sum() / len(a))
            along = (u**2 - v**2).sum() - (u.sum() ** 2 - v.sum() ** 2) / len(a)
            angle = np.arctan2(across, along) / 4
            most = max(most, abs(angle))
            a[:, [i, j]] = a[:, [i, j]] @ np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        if most < tolerance:
            break
    return a


def principal_components(correlations: DataFrame) -> DataFrame:
    """(component, indicator, eigenvalue, loading, kept) from (a, b, r); the matrix is indicators squared, one task."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="r").fillna(0.0)
        values, vectors = np.linalg.eigh(m.to_numpy())
        values, vectors = values[::-1], oriented(vectors[:, ::-1])
        k = retained(values)
        return pd.DataFrame([(c + 1, name, values[c], vectors[i, c], c < k) for c in range(len(values)) for i, name in enumerate(m.index)],
                            columns=["component", "indicator", "eigenvalue", "loading", "kept"])

    return correlations.groupBy().applyInPandas(lambda pdf: solve(pdf[["a", "b", "r"]]), "component int, indicator string, eigenvalue double, loading double, kept boolean")


def rotated_loadings(components: DataFrame) -> DataFrame:
    """Varimax-rotated loadings of the kept components, scaled by the root of their eigenvalues."""
    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="indicator", columns="component", values="loading")
        scale = pdf.groupby("component")["eigenvalue"].first().loc[m.columns].to_numpy()
        r = varimax(m.to_numpy() * np.sqrt(np.maximum(scale, 0)))
        return pd.DataFrame([(int(c), name, r[i, k]) for k, c in enumerate(m.columns) for i, name in enumerate(m.index)], columns=["component", "indicator", "loading"])

    kept = components.where("kept").select("component", "indicator", "eigenvalue", "loading")
    return kept.groupBy().applyInPandas(lambda pdf: turn(pdf[["component", "indicator", "eigenvalue", "loading"]]), "component int, indicator string, loading double")


def indicator_weights(components: DataFrame) -> DataFrame:
    """(indicator, weight): loadings of the kept components, weighted by their shares of the eigenvalues."""
    kept = components.where("kept")
    total = kept.select("component", "eigenvalue").distinct().agg(F.sum("eigenvalue").alias("_total"))
    return kept.join(F.broadcast(total)).groupBy("indicator").agg(F.sum(F.col("loading") * F.col("eigenvalue") / F.col("_total")).alias("weight"))


def composite_scores(matrix: DataFrame, components: DataFrame) -> DataFrame:
    """(entity, score): projections on the kept components, weighted by their eigenvalues; NULL cells count as the mean."""
    mean = F.avg("value").over(Window.partitionBy("indicator"))
    full = matrix.withColumn("value", F.coalesce("value", mean)).where("value is not null")
    return full.join(indicator_weights(components), "indicator").groupBy("entity").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def component_checks(correlations: DataFrame, components: DataFrame) -> DataFrame:
    """(component, residual, norm, overlap): the largest |R v - eigenvalue v|, |v|, and the largest |v . u| with another component."""
    v = components.select("component", F.col("indicator").alias("b"), "loading")
    rv = correlations.join(v, "b").groupBy("component", "a").agg(F.sum(F.col("r") * F.col("loading")).alias("rv"))
    each = rv.join(components.select("component", F.col("indicator").alias("a"), "eigenvalue", "loading"), ["component", "a"])
    off = each.groupBy("component").agg(F.max(F.abs(F.col("rv") - F.col("eigenvalue") * F.col("loading"))).alias("residual"), F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("norm"))
    u = v.select(F.col("component").alias("other"), "b", F.col("loading").alias("u"))
    dots = v.join(u, "b").where("component <> other").groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("u")).alias("dot"))
    return off.join(dots.groupBy("component").agg(F.max(F.abs("dot")).alias("overlap")), "component")


def drawn_entities(entities: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, entity, times): as many draws with replacement per replicate as there are entities.

    Every draw follows from a hash of its number and is made in a task; only the number of entities reaches the driver.
    """
    names = numbered(entities.distinct(), [F.col("entity")], "_k").checkpoint()
    n = names.count()
    slots = entities.sparkSession.range(n * replicates).select((F.col("id") / F.lit(n)).cast("int").alias("replicate"), (F.col("id") % n).alias("slot"))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", "slot")), 1, 12), 16, 10).cast("long")
    times = slots.withColumn("_k", code % n + 1).groupBy("replicate", "_k").agg(F.count(F.lit(1)).alias("times"))
    return times.join(names, "_k").select("replicate", "entity", "times")


def bootstrap_weights(full: DataFrame, components: DataFrame, drawn: DataFrame) -> DataFrame:
    """(replicate, indicator, weight) of the leading components of each replicate, turned to the reference by Procrustes.

    Correlations are weighted sums over the drawn entities; what a task solves is a matrix of indicators squared.
    """
    a = full.select("entity", F.col("indicator").alias("a"), F.col("value").alias("x"))
    b = full.select("entity", F.col("indicator").alias("b"), F.col("value").alias("y"))
    t, x, y = F.col("times"), F.col("x"), F.col("y")
    sums = a.join(b, "entity").join(drawn, "entity").groupBy("replicate", "a", "b").agg(
        F.sum(t).alias("n"), F.sum(t * x).alias("sx"), F.sum(t * y).alias("sy"), F.sum(t * x * x).alias("xx"), F.sum(t * y * y).alias("yy"), F.sum(t * x * y).alias("xy"))
    spread = lambda p, q: F.col(p) - F.col(q) * F.col(q) / F.col("n")
    free = (spread("xx", "sx") > 1e-12 * F.col("xx")) & (spread("yy", "sy") > 1e-12 * F.col("yy"))
    r = F.when(F.col("a") == F.col("b"), 1.0).when(free, (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("xx", "sx") * spread("yy", "sy"))).otherwise(0.0)
    ref = components.where("kept").toPandas().pivot(index="indicator", columns="component", values="loading").sort_index()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="r").reindex(index=ref.index, columns=ref.index).fillna(0.0)
        values, vectors = np.linalg.eigh(m.to_numpy())
        values, vectors = values[::-1][: ref.shape[1]], vectors[:, ::-1][:, : ref.shape[1]]
        u, _, w = np.linalg.svd(vectors.T @ ref.to_numpy())
        return pd.DataFrame({"replicate": pdf["replicate"].iloc[0], "indicator": ref.index, "weight": vectors @ (u @ w) @ (values / values.sum())})

    return sums.select("replicate", "a", "b", r.alias("r")).groupBy("replicate").applyInPandas(solve, "replicate int, indicator string, weight double")


def bootstrap_composites(matrix: DataFrame, components: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    """(entity, low, high): 5 % and 95 % points of composites whose basis is fitted on resampled entities; NULL cells count as the mean."""
    mean = F.avg("value").over(Window.partitionBy("indicator"))
    full = matrix.withColumn("value", F.coalesce("value", mean)).where("value is not null").select("entity", "indicator", "value").checkpoint()
    weights = bootstrap_weights(full, components, drawn_entities(full.select("entity"), replicates, seed))
    scores = full.join(weights, "indicator").groupBy("replicate", "entity").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    return scores.groupBy("entity").agg(F.percentile("score", 0.05).alias("low"), F.percentile("score", 0.95).alias("high"))


def historical_scores(panel: DataFrame, weights: DataFrame, bounds: tuple[float, float] = DEFAULTS.winsor) -> DataFrame:
    """(entity, period, score): every year scaled by itself (median for NULL, winsorized, robust z) and projected on fixed weights.

    ``weights`` is (indicator, weight), as ``indicator_weights`` gives it.
    """
    by = ["period", "indicator"]
    of = lambda df, column, **wanted: df.join(group_quantiles(df, by, column, wanted), by, "left")
    filled = of(panel, "value", _m=0.5).withColumn("value", F.coalesce("value", "_m", F.lit(0.0))).drop("_m").checkpoint()
    cut = of(filled, "value", _lo=bounds[0], _hi=bounds[1]).withColumn("value", clip("value", F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi").checkpoint()
    med = of(cut, "value", _m=0.5).withColumn("_away", F.abs(F.col("value") - F.col("_m"))).checkpoint()
    mad = of(med, "_away", _mad=0.5)
    z = mad.withColumn("value", F.when(F.col("_mad") > 1e-6, (F.col("value") - F.col("_m")) / (DEFAULTS.mad_factor * F.col("_mad"))).otherwise(F.lit(0.0)))
    return z.join(weights, "indicator").groupBy("entity", "period").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
