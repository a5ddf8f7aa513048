"""A quality report that is kept up by source: mergeable sketches of each source's indicators.

Counts, bounds and two sketches (of distinct values and of the order of values) are stored for every source and
indicator.  The report over all sources merges these rows and reads no data; a source that is new or replaced is
sketched by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches (logarithm of the registers, and items a level) and their stated errors: distinct counts within
#: three standard errors, ranks of quantiles within the share.
DISTINCT_BITS, ORDER_ITEMS = 14, 800
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2), 0.01


def quality_sketches(panel: DataFrame, by: Sequence[str] = ("source", "indicator")) -> DataFrame:
    """(by, n_rows, n_missing, least, most, distinct_sketch, order_sketch) of fact rows; NaN counts as missing."""
    value = F.when(~F.isnan("value"), F.col("value"))
    rows = panel.withColumn("value", value)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.hll_sketch_agg(F.when(F.col("value").isNotNull(), F.xxhash64("value")), F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double("value", F.lit(ORDER_ITEMS)).alias("order_sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = ("indicator",)) -> DataFrame:
    """The sketches of coarser groups: those of all sources, by default."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("distinct_sketch", F.lit(False)).alias("distinct_sketch"), F.kll_merge_agg_double("order_sketch", F.lit(ORDER_ITEMS)).alias("order_sketch"))


def report(sketches: DataFrame, by: Sequence[str] = ("indicator",), quantiles: Sequence[float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """(by, n_rows, n_missing, distinct_estimate, least, most, quantile_estimates, all_missing, constant) from sketches.

    Whether an indicator is empty or constant is exact; estimates are within ``DISTINCT_ERROR`` and ``RANK_ERROR``.
    """
    held = merged(sketches, by)
    some = F.col("n_rows") > F.col("n_missing")
    points = F.array(*[F.kll_sketch_get_quantile_double("order_sketch", F.lit(float(q))) for q in quantiles])
    return held.select(
        *by, "n_rows", "n_missing", F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"), "least", "most",
        F.when(some, points).alias("quantile_estimates"), (~some).alias("all_missing"), F.coalesce(F.col("least") == F.col("most"), F.lit(False)).alias("constant"))
