"""Chained imputation from Gram sums: no task holds a replicate's matrix.

The state is a table with a row per replicate and entity.  A regression needs the sums of products of the indicators
over the rows where its target is observed, indicators squared numbers a replicate, which Spark adds up for all
replicates at once; the ridge regression is solved from them on the driver, and the missing cells are drawn where the
rows are, from a hash of replicate, step, indicator and entity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.eigen import row_sums

#: Steps after which the table is written; those since are applied anew by every pass.
WRITTEN_EVERY = 5
#: Rows of a partition of the state, about.
PART_ROWS = 50_000
#: Rounds in which a regression settles the precision of its noise and of its weights.
EVIDENCE_ROUNDS = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for draws that follow from keys."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def normal_draws(entity: np.ndarray, *keys: int) -> np.ndarray:
    """A standard normal value for each entity's hash and the keys."""
    code = 0
    for k in keys:
        code = (code * 0x9E3779B97F4A7C15 + k + 1) % 2**64
    first = mixed(entity.view(np.uint64) + mixed(np.array([code], np.uint64)))
    unit = lambda x: ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.sqrt(-2 * np.log(unit(first))) * np.cos(2 * np.pi * unit(mixed(first + np.uint64(0x632BE59BD9B4E019))))


@dataclass
class Regression:
    """One target's regression on all other indicators, standardised; a prediction is a draw from its posterior."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    covariance: np.ndarray
    centre: float
    noise: float

    @classmethod
    def fitted(cls, gram: np.ndarray, target: int) -> Regression:
        """From the sums of products of (1, indicators) over rows where the target is observed."""
        n, sums = gram[0, 0], gram[0, 1:]
        others = np.arange(len(sums)) != target
        means = sums / n
        products = gram[1:, 1:] - n * np.outer(means, means)
        spread = np.sqrt(np.maximum(np.diag(products)[others] / n, 0)) + 1e-9
        a = products[np.ix_(others, others)] / np.outer(spread, spread)
        y, yy = products[others, target] / spread, products[target, target]
        noise, prior = max(yy / n, 1e-9), 1.0
        for _ in range(EVIDENCE_ROUNDS):
            covariance = np.linalg.inv(a / noise + prior * np.eye(len(a)))
            weights = covariance @ y / noise
            held = len(a) - prior * np.trace(covariance)
            noise = max((yy - 2 * weights @ y + weights @ a @ weights) / max(n - held, 1e-3), 1e-9)
            prior = max(held, 1e-6) / max(weights @ weights, 1e-9)
        return cls(means[others], spread, weights, covariance, means[target], noise)

    def drawn(self, others: np.ndarray, normal: np.ndarray) -> np.ndarray:
        b = (others - self.mean) / self.spread
        return self.centre + b @ self.weights + np.sqrt(self.noise + np.einsum("ij,jk,ik->i", b, self.covariance, b)) * normal


@dataclass
class Update:
    """What a step does to one indicator: a regression for each replicate, on differences from ``start``."""

    step: int
    target: int
    by_replicate: list[Regression]
    start: np.ndarray

    def apply(self, x: np.ndarray, gone: np.ndarray, replicate: np.ndarray, entity: np.ndarray, seed: int) -> None:
        hole = gone[:, self.target]
        others = np.arange(x.shape[1]) != self.target
        for r in np.unique(replicate[hole]).tolist():
            rows = np.flatnonzero(hole & (replicate == r))
            normal = normal_draws(entity[rows], seed, r, self.step, self.target)
            x[rows, self.target] = self.by_replicate[r].drawn(x[np.ix_(rows, others)] - self.start[others], normal) + self.start[self.target]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, which of them are imputed, replicates and hashed entities of a batch."""
    n = batch.num_rows
    cells = lambda c, t: np.asarray(batch.column(c).flatten()).astype(t).reshape(n, -1)
    return cells("x", float), cells("gone", bool), np.asarray(batch.column("imputation_id")), np.asarray(batch.column("code"))


def _applied(updates: list[Update], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, gone, replicate, entity = _arrays(batch)
            for u in updates:
                u.apply(x, gone, replicate, entity, seed)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield batch.set_column(batch.schema.get_field_index("x"), "x", lists)
    return run


def impute_chained(matrix: DataFrame, replicates: int = 10, steps: int = 50, seed: int = 42) -> DataFrame:
    """(imputation_id, entity, indicator, value): chained Bayesian ridge regressions with posterior draws.

    ``matrix`` is (entity, indicator, value); missing cells are NULL or have no row.  Observed cells never change.
    Cells start at their indicator's mean (0 for an indicator without values, which stays so); a step goes through the
    indicators by their number of missing cells.  Several rows of a cell count as their mean.
    """
    cells = matrix.groupBy("entity", "indicator").agg(F.avg("value").alias("value")).checkpoint()
    known = cells.groupBy("indicator").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).orderBy("indicator").collect()  # a row an indicator
    entities = cells.select("entity").distinct().count()
    spark, schema = matrix.sparkSession, "imputation_id int, entity string, indicator string, value double"
    if not known:
        return spark.createDataFrame([], schema)
    names, start = [r["indicator"] for r in known], np.array([r["mean"] or 0.0 for r in known])
    missing = np.array([entities - r["n"] for r in known])
    wide = cells.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("indicator", "value"))).alias("m"))  # a row has its indicators only
    value = [F.col("m")[n] for n in names]
    wide = wide.select("entity", F.xxhash64("entity").alias("code"), F.array(*[F.coalesce(v, F.lit(float(s))) for v, s in zip(value, start, strict=True)]).alias("x"),
                       F.array(*[v.isNull() for v in value]).alias("gone"))
    state = wide.withColumn("imputation_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    state = state.repartition(max(1, entities * replicates // PART_ROWS)).checkpoint()
    todo = [int(j) for j in np.argsort(missing, kind="stable") if 0 < missing[j] < entities]
    schema_of_state = state.schema
    pending: list[Update] = []
    if len(names) > 1:
        for step in range(steps):
            for j in todo:
                def sums(batch, j=j, pending=tuple(pending)):
                    x, gone, replicate, entity = _arrays(batch)
                    for u in pending:
                        u.apply(x, gone, replicate, entity, seed)
                    out = np.zeros((replicates, len(names) + 1, len(names) + 1))
                    for r in np.unique(replicate).tolist():
                        seen = x[(replicate == r) & ~gone[:, j]] - start
                        one = np.hstack([np.ones((len(seen), 1)), seen])
                        out[r] += one.T @ one
                    return out

                grams = row_sums(state, sums, (replicates, len(names) + 1, len(names) + 1))
                pending.append(Update(step, j, [Regression.fitted(g, j) for g in grams], start))
            if step % WRITTEN_EVERY == WRITTEN_EVERY - 1 or step == steps - 1:
                state, pending = state.mapInArrow(_applied(pending, seed), schema_of_state).checkpoint(), []
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("indicator"), F.col("x").alias("value"))
    return state.select("imputation_id", "entity", F.explode(pairs).alias("z")).select("imputation_id", "entity", F.col("z.indicator").alias("indicator"), F.col("z.value").alias("value"))


def pool(imputed: DataFrame) -> DataFrame:
    """(entity, indicator, value): the mean over the replicates."""
    return imputed.groupBy("entity", "indicator").agg(F.avg("value").alias("value"))
