"""Panel operators over fact rows (entity, period, indicator, value, source)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import deficit
from lattica.operators.stats import robust_z, winsorize
from lattica.schema import DEFAULTS
from lattica.sources.clean import within_universe

# The source classes of temporal filling.
GOVERNANCE = ("VDEM", "WB_WGI", "FREEDOM_HOUSE", "TI_CPI", "POLITY5", "FSI", "NDGAIN")
ECONOMIC = ("WB_WDI", "IMF_WEO", "SIPRI", "SIPRI_WB")


def deduplicate(panel: DataFrame) -> DataFrame:
    """One averaged row per entity, indicator and period; the source is the smallest one."""
    return panel.groupBy("entity", "indicator", "period").agg(F.avg("value").alias("value"), F.min("source").alias("source"))


def spine(panel: DataFrame, window: int = DEFAULTS.window) -> DataFrame:
    """Every (entity, indicator) at each of the last ``window`` periods of the data, NULL where nothing was seen.

    A group's source is that of its earliest row.
    """
    rows = deduplicate(panel)
    end = rows.agg(F.max("period").alias("_end"))
    keys = rows.groupBy("entity", "indicator").agg(F.min_by("source", "period").alias("source"))
    full = keys.join(F.broadcast(end)).withColumn("period", F.explode(F.sequence(F.col("_end") - (window - 1), F.col("_end")))).drop("_end")
    return full.join(rows.select("entity", "indicator", "period", "value"), ["entity", "indicator", "period"], "left")


def _series():
    return Window.partitionBy("entity", "indicator").orderBy("period")


def forward_filled(limit: int = DEFAULTS.forward_fill):
    """The value, or the last one seen at most ``limit`` periods before; needs a full spine."""
    return F.last("value", ignorenulls=True).over(_series().rowsBetween(-limit, 0))


def interpolated():
    """The value; else, one period after an observation, the linear value towards the next one (or the last one at the tail)."""
    before, after = _series().rowsBetween(Window.unboundedPreceding, -1), _series().rowsBetween(1, Window.unboundedFollowing)
    year = F.when(F.col("value").isNotNull(), F.col("period"))
    v0, t0 = F.last("value", ignorenulls=True).over(before), F.last(year, ignorenulls=True).over(before)
    v1, t1 = F.first("value", ignorenulls=True).over(after), F.first(year, ignorenulls=True).over(after)
    step = F.when(v1.isNull(), v0).otherwise(v0 + (v1 - v0) / (t1 - t0))
    return F.coalesce(F.col("value"), F.when(F.col("period") - t0 == 1, step))


def align_temporal(panel: DataFrame, window: int = DEFAULTS.window, forward_fill: int = DEFAULTS.forward_fill,
                   governance: Sequence[str] = GOVERNANCE, economic: Sequence[str] = ECONOMIC) -> DataFrame:
    """Spine, then filling by class of source: forward, interpolated, or none."""
    full = spine(panel, window)
    filled = F.when(F.col("source").isin(*governance), forward_filled(forward_fill)).when(F.col("source").isin(*economic), interpolated()).otherwise(F.col("value"))
    return full.withColumn("_filled", filled).select("entity", "indicator", "period", F.col("_filled").alias("value"), "source")


def orient(panel: DataFrame, registry: DataFrame, deficits: Sequence[str] = ()) -> DataFrame:
    """Turn indicators so that higher is worse: inverted ones change sign, ``deficits`` keep only the negative side."""
    marks = registry.select("indicator", "invert")
    return panel.join(marks, "indicator", "left").withColumn(
        "value", F.when(F.col("indicator").isin(*deficits), deficit("value")).when(F.col("invert"), -F.col("value")).otherwise(F.col("value")),
    ).drop("invert")


def missingness(panel: DataFrame, threshold: float = DEFAULTS.missing_threshold) -> DataFrame:
    """Report per (entity, indicator): periods, missing ones, rate, and whether the rate is above the threshold."""
    return panel.groupBy("entity", "indicator").agg(
        F.countDistinct("period").alias("n_periods"), F.sum(F.col("value").isNull().cast("int")).cast("long").alias("n_missing"),
    ).withColumn("missing_rate", F.col("n_missing") / F.col("n_periods")).withColumn("excluded", F.col("missing_rate") > threshold)


def drop_missing(panel: DataFrame, report: DataFrame) -> DataFrame:
    return panel.join(report.where("excluded").select("entity", "indicator"), ["entity", "indicator"], "left_anti")


def long_to_wide(panel: DataFrame, indicators: Sequence[str], period: int | None = None) -> DataFrame:
    """One row per entity with a mean per indicator; entities without any value are dropped."""
    rows = panel.where(F.col("value").isNotNull() & F.col("indicator").isin(*indicators))
    rows = rows if period is None else rows.where(F.col("period") == period)
    return rows.groupBy("entity").pivot("indicator", list(indicators)).agg(F.avg("value"))


def wide_to_long(wide: DataFrame, indicators: Sequence[str]) -> DataFrame:
    return wide.unpivot(["entity"], list(indicators), "indicator", "value")


def reindex(rows: DataFrame, members: DataFrame, indicators: DataFrame) -> DataFrame:
    """Every member with every indicator; what is missing is NULL."""
    grid = members.select("entity").distinct().crossJoin(indicators.select("indicator").distinct())
    return grid.join(rows, ["entity", "indicator"], "left")


def year_over_year(panel: DataFrame) -> DataFrame:
    """Each value with that of the calendar year before (an equi-join: years may be missing)."""
    prev = panel.select("entity", "indicator", (F.col("period") + 1).alias("period"), F.col("value").alias("previous"))
    return panel.join(prev, ["entity", "indicator", "period"])


def next_available(panel: DataFrame) -> DataFrame:
    """(period, next_period) over the distinct periods of the data."""
    years = panel.select("period").distinct()
    return years.select("period", F.lead("period").over(Window.orderBy("period")).alias("next_period")).where("next_period is not null")


def latest(panel: DataFrame) -> DataFrame:
    """(entity, indicator, value): the last non-NULL value of each series by period."""
    return panel.where("value is not null").groupBy("entity", "indicator").agg(F.max_by("value", "period").alias("value"))


def common_periods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Periods that both tables have."""
    return a.select("period").intersect(b.select("period"))


def with_names(df: DataFrame, names: DataFrame, key: str = "entity") -> DataFrame:
    """Adds name, which falls back to the key itself, and a label of both."""
    named = df.join(names.select(F.col("entity").alias(key), "name"), key, "left").withColumn("name", F.coalesce("name", key))
    return named.withColumn("label", F.concat_ws(" - ", key, "name"))


def layer(tables: dict[str, DataFrame], metric: str, value: str | None = None) -> DataFrame:
    """(entity, value) of the metric that a map shows, from the table of that name; its value column is ``value`` or the only other one."""
    if metric not in tables:
        raise KeyError(f"{metric} is none of {sorted(tables)}")
    df = tables[metric]
    value = value or next(c for c in df.columns if c != "entity")
    return df.select("entity", F.col(value).cast("double").alias("value"))


def feature_matrix(panel: DataFrame, registry: DataFrame, members: DataFrame, period: int, window: int = DEFAULTS.window,
                   threshold: float = DEFAULTS.missing_threshold, bounds: tuple[float, float] = DEFAULTS.winsor, impute: Callable[[DataFrame], DataFrame] | None = None,
                   deficits: Sequence[str] = ()) -> DataFrame:
    """(entity, indicator, value), one row for every member and indicator: the whole way from facts to features.

    Align and fill, orient, leave out pairs that miss too much, take one period, complete the grid, robust z, impute,
    winsorize, robust z again.  ``impute`` gives (entity, indicator, value) without NULLs, pooled over replicates if it
    makes several; without it a missing score is the indicator's median, 0.
    """
    rows = within_universe(panel, members)
    rows = orient(align_temporal(rows, window), registry, deficits).checkpoint()
    rows = drop_missing(rows, missingness(rows, threshold)).where((F.col("period") == period) & F.col("value").isNotNull())
    grid = reindex(rows.groupBy("entity", "indicator").agg(F.avg("value").alias("value")), members, registry)
    z = robust_z(grid).select("entity", "indicator", "value").checkpoint()
    done = z.withColumn("value", F.coalesce("value", F.lit(0.0))) if impute is None else impute(z)
    return robust_z(winsorize(done, *bounds)).select("entity", "indicator", "value")
