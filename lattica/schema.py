"""Logical schemas and small driver-side helpers shared by all operators.

Missing values are NULL and nothing else; NaN is turned into NULL where data comes in.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


FACT = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("period", T.IntegerType()), T.StructField("indicator", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("source", T.StringType()),
])
DYAD = T.StructType([
    T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("period", T.IntegerType()),
    T.StructField("indicator", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("source", T.StringType()),
])
EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("w", T.DoubleType())])
SCORE = T.StructType([T.StructField("entity", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class Settings:
    """Constants of the analytics; the defaults are the published ones."""

    window: int = 15
    forward_fill: int = 2
    missing_threshold: float = 0.40
    winsor: tuple[float, float] = (0.01, 0.99)
    mad_factor: float = 1.4826
    kaiser: float = 1.0
    cumulative_variance: float = 0.80
    alpha: float = 0.40
    damping: float = 0.85
    distance_decay: float = 1.5
    contiguity_km: float = 100.0
    earth_radius_km: float = 6371.0
    mirror: float = 0.5
    cascade_percentile: float = 0.90
    risk_shock: float = 2.0
    channel_weights: dict[str, float] = field(default_factory=lambda: {
        "trade": 0.30, "financial": 0.25, "geographic": 0.15, "political": 0.15, "migration": 0.15})


DEFAULTS = Settings()


def read_settings(path: str) -> Settings:
    """Settings from a TOML or a JSON file (by its suffix): what it gives replaces the defaults.

    A name that is no setting, a value of another kind, and a share outside [0, 1] are errors.  ``channel_weights`` may
    name some channels only.
    """
    store, at = opened(path)
    with store.open_input_stream(at, compression=None) as f:
        text = f.read().decode()
    given = tomllib.loads(text) if path.endswith(".toml") else json.loads(text or "{}")
    known = {x.name: getattr(DEFAULTS, x.name) for x in fields(Settings)}
    out: dict = {}
    for name, value in given.items():
        if name not in known:
            raise KeyError(f"{name} is no setting")
        now = known[name]
        if isinstance(now, dict):
            strange = set(value) - set(now) if isinstance(value, dict) else {value}
            if strange:
                raise KeyError(f"{sorted(map(str, strange))} in {name}")
            out[name] = now | {k: float(v) for k, v in value.items()}
        elif isinstance(now, tuple):
            out[name] = tuple(float(v) for v in value)
            if len(out[name]) != len(now) or not 0 <= out[name][0] <= out[name][1] <= 1:
                raise ValueError(f"{name} are two shares in order")
        elif isinstance(value, bool) or not isinstance(value, int | float) or isinstance(now, int) and not isinstance(value, int):
            raise ValueError(f"{name} is {type(now).__name__}, not {value!r}")
        else:
            out[name] = type(now)(value)
    for name in ("missing_threshold", "alpha", "damping", "mirror", "cascade_percentile", "cumulative_variance"):
        if not 0 <= out.get(name, 0) <= 1:
            raise ValueError(f"{name} is a share")
    return replace(DEFAULTS, **out)


#: Entities up to which an adjacency matrix is held as one array-valued row; larger graphs use edge tables.
DENSE_LIMIT = 2000
#: Entities up to which every source gets a copy of the matrix; the copies are as many as entities.
SENSITIVITY_LIMIT = 200


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in all floating-point columns."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select([F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema])


def resolve_column(columns: Sequence[str], *tests: Callable[[str], bool]) -> str:
    """The first column whose lower-cased name passes the earliest test that any column passes."""
    for test in tests:
        for name in columns:
            if test(name.lower()):
                return name
    raise KeyError(f"no column of {list(columns)} matches")


def rename_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rename the one column that matches each alias list; two matches are an error."""
    for target, names in aliases.items():
        wanted = {n.lower() for n in names}
        found = [c for c in df.columns if c.lower() in wanted]
        if len(found) > 1:
            raise ValueError(f"{found} all stand for {target}")
        if found:
            df = df.withColumnRenamed(found[0], target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
