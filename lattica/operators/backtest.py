"""Calibration, resampled weights and historical episodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import pagerank
from lattica.operators.panel import next_available
from lattica.operators.stats import drawn_entities
from lattica.schema import DEFAULTS


def _terms(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(period, entity, d, e): W s - s, and the next available period's score minus s."""
    steps = next_available(scores)
    ws = edges.join(scores.select(F.col("entity").alias("dst"), "period", F.col("score").alias("_s")), "dst").groupBy("period", F.col("src").alias("entity")).agg(F.sum(F.col("w") * F.col("_s")).alias("ws"))
    ahead = scores.select("entity", F.col("period").alias("next_period"), F.col("score").alias("ahead"))
    return scores.join(steps, "period").join(ahead, ["entity", "next_period"]).join(ws, ["period", "entity"], "left").select(
        "period", "entity", (F.coalesce("ws", F.lit(0.0)) - F.col("score")).alias("d"), (F.col("ahead") - F.col("score")).alias("e"))


def alpha_grid(low: float = 0.05, high: float = 0.95, step: float = 0.01):
    n = round((high - low) / step)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.round(low + k * step, 10))


def calibration_curve(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(alpha, rmse): mean over period pairs of the one-step error, which is quadratic in alpha per pair."""
    sums = _terms(scores, edges).groupBy("period").agg(
        F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("e")).alias("de"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.count(F.lit(1)).alias("n"))
    each = sums.withColumn("alpha", F.explode(alpha_grid()))
    error = (F.col("alpha") * F.col("alpha") * F.col("dd") - 2 * F.col("alpha") * F.col("de") + F.col("ee")) / F.col("n")
    return each.groupBy("alpha").agg(F.avg(F.sqrt(F.greatest(error, F.lit(0.0)))).alias("rmse"))


def calibrate(scores: DataFrame, edges: DataFrame, digits: int | None = None) -> DataFrame:
    """(alpha, rmse, at_boundary); with fewer than three periods alpha is the default and rmse NULL.

    The alpha of the smallest rmse; of equal ones the smallest.  With ``digits``, errors are equal that agree when
    rounded to so many decimals.
    """
    if scores.select("period").distinct().count() < 3:
        return scores.sparkSession.range(1).select(F.lit(DEFAULTS.alpha).alias("alpha"), F.lit(None).cast("double").alias("rmse"), F.lit(False).alias("at_boundary"))
    rank = F.col("rmse") if digits is None else F.round("rmse", digits)
    best = calibration_curve(scores, edges).agg(F.min_by(F.struct("alpha", "rmse"), F.struct(rank, "alpha")).alias("b"))
    return best.select("b.alpha", "b.rmse", ((F.col("b.alpha") <= 0.05) | (F.col("b.alpha") >= 0.95)).alias("at_boundary"))


def bootstrap_alpha(scores: DataFrame, edges: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(low, median, high) of alpha over replicates that draw entities with replacement.

    A drawn entity counts as often as it was drawn; weights are those of the drawn subgraph, not normalised again.
    """
    drawn = drawn_entities(scores.select("entity"), replicates, seed).checkpoint()
    a = drawn.select("replicate", F.col("entity").alias("dst"), "times")
    ws = edges.join(scores.select(F.col("entity").alias("dst"), "period", F.col("score").alias("_s")), "dst").join(a, "dst").groupBy("replicate", "period", F.col("src").alias("entity")).agg(F.sum(F.col("w") * F.col("_s") * F.col("times")).alias("ws"))
    ahead = scores.select("entity", F.col("period").alias("next_period"), F.col("score").alias("ahead"))
    pairs = scores.join(next_available(scores), "period").join(ahead, ["entity", "next_period"]).join(drawn, "entity").join(ws, ["replicate", "period", "entity"], "left")
    d, e = F.coalesce("ws", F.lit(0.0)) - F.col("score"), F.col("ahead") - F.col("score")
    sums = pairs.groupBy("replicate", "period").agg(F.sum(d * d * F.col("times")).alias("dd"), F.sum(d * e * F.col("times")).alias("de"), F.sum(e * e * F.col("times")).alias("ee"), F.sum("times").alias("n"))
    each = sums.withColumn("alpha", F.explode(alpha_grid()))
    error = (F.col("alpha") * F.col("alpha") * F.col("dd") - 2 * F.col("alpha") * F.col("de") + F.col("ee")) / F.col("n")
    curve = each.groupBy("replicate", "alpha").agg(F.avg(F.sqrt(F.greatest(error, F.lit(0.0)))).alias("rmse"))
    best = curve.groupBy("replicate").agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("alpha"))
    return best.agg(F.percentile("alpha", 0.05).alias("low"), F.median("alpha").alias("median"), F.percentile("alpha", 0.95).alias("high"))


def dirichlet_draws(weights: dict[str, float], draws: int = 200, concentration: float = 50.0, seed: int = 42) -> list[tuple[int, str, float]]:
    """(draw, channel, weight): channel weights drawn around the given ones; a fixed number of rows."""
    names = sorted(weights)
    w = np.random.RandomState(seed).dirichlet([concentration * weights[n] for n in names], draws)
    return [(k, n, float(w[k, i])) for k in range(draws) for i, n in enumerate(names)]


def dirichlet_weights(spark, weights: dict[str, float], draws: int = 200, concentration: float = 50.0, seed: int = 42) -> DataFrame:
    return spark.createDataFrame(dirichlet_draws(weights, draws, concentration, seed), "draw int, channel string, weight double")


def drawn_graphs(channels: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, src, dst, w): the channels combined with each draw's weights; draws are a fixed number of rows."""
    total = channels.groupBy("channel", "src").agg(F.sum("w").alias("_t"))
    each = channels.join(total, ["channel", "src"]).select("channel", "src", "dst", F.when(F.col("_t") != 0, F.col("w") / F.col("_t")).otherwise(F.lit(0.0)).alias("w"))
    return each.join(F.broadcast(draws), "channel").where("src <> dst").groupBy("draw", "src", "dst").agg(F.sum(F.col("w") * F.col("weight")).alias("w"))


def pagerank_intervals(channels: DataFrame, draws: DataFrame, steps: int = 50) -> DataFrame:
    """(entity, low, high): 5 % and 95 % points of PageRank over drawn channel weights."""
    total = F.sum("w").over(Window.partitionBy("draw", "src"))
    graphs = drawn_graphs(channels, draws).withColumn("w", F.when(total != 0, F.col("w") / total).otherwise(F.lit(0.0))).checkpoint()
    ranks = pagerank(graphs, steps=steps, by=["draw"])
    return ranks.groupBy("entity").agg(F.percentile("pagerank", 0.05).alias("low"), F.percentile("pagerank", 0.95).alias("high"))


def weight_uncertainty(channels: DataFrame, draws: DataFrame) -> DataFrame:
    """(src, dst, low, high): 5 % and 95 % points of combined weights over drawn channel weights."""
    one = drawn_graphs(channels, draws)
    return one.groupBy("src", "dst").agg(F.percentile("w", 0.05).alias("low"), F.percentile("w", 0.95).alias("high"))


def episodes_table(spark, episodes: list[tuple[str, list[int], list[str], list[str]]]) -> DataFrame:
    return spark.createDataFrame(episodes, "name string, years array<int>, primary array<string>, secondary array<string>")


def validate_episodes(episodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Per episode, how often a listed entity's score rose over the calendar year before.

    The rate is over all listed (entity, year) pairs; PASS at 0.5 or more for the primary list, SKIP without one.
    """
    listed = F.concat(
        F.transform("primary", lambda e: F.named_struct(F.lit("role"), F.lit("primary"), F.lit("entity"), e)),
        F.transform("secondary", lambda e: F.named_struct(F.lit("role"), F.lit("secondary"), F.lit("entity"), e)))
    rows = episodes.select("name", F.explode("years").alias("period"), listed.alias("listed")).select("name", "period", F.explode("listed").alias("x"))
    rows = rows.select("name", "period", "x.role", "x.entity")
    prev = scores.select("entity", (F.col("period") + 1).alias("period"), F.col("score").alias("before"))
    rise = rows.join(scores, ["entity", "period"], "left").join(prev, ["entity", "period"], "left").withColumn("up", F.coalesce((F.col("score") > F.col("before")).cast("int"), F.lit(0)))
    count = lambda role: F.sum(F.when(F.col("role") == role, F.col("up")).otherwise(0)).cast("long")
    size = lambda role: F.sum((F.col("role") == role).cast("int")).cast("long")
    per = rise.groupBy("name").agg(count("primary").alias("primary_up"), size("primary").alias("primary_n"), count("secondary").alias("secondary_up"), size("secondary").alias("secondary_n"))
    out = episodes.select("name").join(per, "name", "left").na.fill(0)
    rate = F.when(F.col("primary_n") > 0, F.col("primary_up") / F.col("primary_n"))
    return out.withColumn("rate", rate).withColumn("status", F.when(rate.isNull(), "SKIP").when(rate >= 0.5, "PASS").otherwise("FAIL"))


def status_counts(rows: DataFrame, status: str = "status", wanted: tuple[str, ...] = ("PASS", "FAIL", "SKIP")) -> DataFrame:
    """One row with the number of rows of each status."""
    return rows.agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in wanted])
