"""Source readers and their cleaning steps as DataFrame to DataFrame functions.

A connector of the usual kind is a file format plus some of these steps; each gives the fact or the dyad schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.scalars import code_key, leading_year, to_number
from lattica.schema import nan_to_null


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Every column as text: types are settled by the cleaning steps, not by inference."""
    return spark.read.csv(path if isinstance(path, str) else list(path), header=True, sep=sep)


def read_panels(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of Parquet tables of differing columns; missing ones are NULL."""
    frames = [nan_to_null(spark.read.parquet(p)) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_clean_zone(spark: SparkSession, folder: str, skip: Sequence[str] = ("indicator_", "imputed_")) -> DataFrame:
    """All Parquet tables of a folder (or a glob) but derived ones, told by the prefixes of their files' or folders' names."""
    df = spark.read.option("mergeSchema", True).parquet(folder).withColumn("_file", F.split(F.col("_metadata.file_path"), "/"))
    derived = F.exists(F.slice("_file", -2, 2), lambda name: reduce(Column.__or__, [name.startswith(p) for p in skip]))
    return nan_to_null(df.where(~derived).drop("_file"))


def wide_years_to_long(df: DataFrame, entity: str, indicator: str, source: str, strip: str = "") -> DataFrame:
    """Columns named by year (after removing ``strip``) to fact rows."""
    years = [c for c in df.columns if c.replace(strip, "").isdigit()]
    return df.unpivot([entity], years, "_year", "_value").select(
        code_key(entity).alias("entity"), F.regexp_replace("_year", strip or "^$", "").cast("int").alias("period"),
        F.lit(indicator).alias("indicator"), to_number("_value").alias("value"), F.lit(source).alias("source"))


def indicator_columns_to_long(df: DataFrame, entity: str, period: str, codes: dict[str, str], source: str) -> DataFrame:
    """One column per indicator to fact rows, renamed by ``codes``."""
    names = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    wide = df.select(code_key(entity).alias("entity"), F.col(period).cast("int").alias("period"), *[to_number(F.col(c).cast("string")).alias(c) for c in codes])
    return wide.unpivot(["entity", "period"], list(codes), "_code", "value").select(
        "entity", "period", names[F.col("_code")].alias("indicator"), "value", F.lit(source).alias("source"))


def sentinels_to_null(df: DataFrame, column: str, sentinels: Sequence[float]) -> DataFrame:
    return df.withColumn(column, F.when(~F.col(column).isin(*sentinels), F.col(column)))


def two_layouts_to_long(df: DataFrame, entity: str, indicator: str, source: str, strip: str, period: str, value: str) -> DataFrame:
    """Fact rows from either layout of a source: years as columns named ``strip`` + year, or long rows with a period and a value."""
    if any(c.startswith(strip) and c.removeprefix(strip).isdigit() for c in df.columns):
        return wide_years_to_long(df, entity, indicator, source, strip)
    return df.select(code_key(entity).alias("entity"), F.col(period).try_cast("int").alias("period"), F.lit(indicator).alias("indicator"),
                     to_number(F.col(value).cast("string")).alias("value"), F.lit(source).alias("source"))


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required names that the table lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def with_file_year(df: DataFrame, target: str = "period") -> DataFrame:
    """The year that each row's file is named after (the last four-digit number 19xx or 20xx in its name); needs a file source."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    years = F.regexp_extract_all(name, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))
    return df.withColumn(target, F.when(F.size(years) > 0, F.element_at(years, -1).cast("int")))


def json_rows(df: DataFrame, column: str, entity: str, period: str, value: str, indicator: str, source: str, since: int | None = None) -> DataFrame:
    """Fact rows from a column of JSON arrays of records; what can't be read is NULL, and rows before ``since`` are left out."""
    schema = f"array<struct<`{entity}`:string,`{period}`:string,`{value}`:string>>"
    rows = df.select(F.explode(F.from_json(column, schema)).alias("r")).select(
        code_key(F.col(f"r.`{entity}`")).alias("entity"), F.substring(F.col(f"r.`{period}`"), 1, 4).try_cast("int").alias("period"),
        F.lit(indicator).alias("indicator"), to_number(F.col(f"r.`{value}`")).alias("value"), F.lit(source).alias("source"))
    return rows if since is None else rows.where(F.col("period") >= since)


def classified(df: DataFrame, column: str, rules: Sequence[tuple[str, str]], target: str = "indicator") -> DataFrame:
    """The class of the first rule (pattern, class) whose pattern a text has, in any case; rows that no rule fits are left out."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        kind = F.when(F.col(column).rlike(f"(?i){pattern}"), name).otherwise(kind)
    return df.withColumn(target, kind).where(F.col(target).isNotNull())


def sliced(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows that have the wanted value in each of the dimensions that the table has; others are no condition."""
    for column, value in wanted.items():
        if column in df.columns:
            df = df.where(F.col(column) == value)
    return df


def plausible_codes(df: DataFrame, column: str, aggregate: str = "5", longest: int = 3, shortest: int = 2) -> DataFrame:
    """Rows whose code is neither an aggregate's (by its first character) nor of another length than codes have."""
    code = F.col(column)
    return df.where(~code.startswith(aggregate) & F.length(code).between(shortest, longest))


def dyad_columns_to_long(df: DataFrame, src: str, dst: str, columns: dict[str, str], source: str, period: int | str) -> DataFrame:
    """One column per indicator of a pair to dyad rows, renamed by ``columns``; ``period`` is a column or, for static tables, a year."""
    names = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    when = F.col(period).try_cast("int") if isinstance(period, str) else F.lit(period)
    wide = df.select(code_key(src).alias("src"), code_key(dst).alias("dst"), when.alias("period"), *[to_number(F.col(c).cast("string")).alias(c) for c in columns])
    return wide.unpivot(["src", "dst", "period"], list(columns), "_code", "value").where("src <> dst").select(
        "src", "dst", "period", names[F.col("_code")].alias("indicator"), "value", F.lit(source).alias("source"))


def dyad_years_to_long(df: DataFrame, src: str, dst: str, years: Sequence[int], first: int, indicator: str, source: str) -> DataFrame:
    """Dyad rows from year columns that are known by their position alone: column ``first`` is the first of ``years``."""
    columns = df.columns[first : first + len(years)]
    long = dyad_columns_to_long(df, src, dst, dict(zip(columns, map(str, years), strict=True)), source, 0)
    return long.select("src", "dst", F.col("indicator").cast("int").alias("period"), F.lit(indicator).alias("indicator"), "value", "source").where("value > 0")


def flags_to_kinds(df: DataFrame, src: str, dst: str, flags: dict[str, str], crosswalk: DataFrame) -> DataFrame:
    """(src, dst, kind) for every flag that is 1, with both codes translated by (code, entity); unknown codes are left out."""
    rows = df.select(F.col(src).alias("_a"), F.col(dst).alias("_b"), *[F.col(c).cast("int").alias(c) for c in flags]).unpivot(["_a", "_b"], list(flags), "_flag", "_on").where("_on = 1")
    names = F.create_map(*[F.lit(x) for kv in flags.items() for x in kv])
    for code, side in (("_a", "src"), ("_b", "dst")):
        rows = rows.join(crosswalk.select(F.col("code").alias(code), F.col("entity").alias(side)), code)
    return rows.select("src", "dst", names[F.col("_flag")].alias("kind")).distinct()


def event_counts(events: DataFrame, entity: str, period: str, kind: str, amount: str, source: str = "events") -> DataFrame:
    """Counts per event kind and the sum of an amount (unreadable: 0), from one pass, as fact rows."""
    grouped = events.groupBy(F.col(entity).cast("string").alias("entity"), F.col(period).cast("int").alias("period"), F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.coalesce(to_number(F.col(amount).cast("string")), F.lit(0.0))).alias("amount"))
    counts = grouped.select("entity", "period", F.concat(F.lit("events_"), "kind").alias("indicator"), F.col("n").alias("value"))
    total = grouped.groupBy("entity", "period").agg(F.sum("amount").alias("value")).select("entity", "period", F.lit("events_amount").alias("indicator"), "value")
    return counts.unionByName(total).withColumn("source", F.lit(source))


def split_locations(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """One row per part of a multi-valued text, trimmed; empty parts are dropped."""
    parts = F.filter(F.transform(F.split(column, sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(column, F.explode(parts))


def conflict_measures(df: DataFrame, location: str, period: str, intensity: str, source: str = "conflict") -> DataFrame:
    """Number of conflicts and highest intensity per place and period."""
    rows = split_locations(df, location).groupBy(code_key(location).alias("entity"), F.col(period).cast("int").alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("conflict_events"), F.max(F.col(intensity).cast("double")).alias("conflict_intensity"))
    return rows.unpivot(["entity", "period"], ["conflict_events", "conflict_intensity"], "indicator", "value").withColumn("source", F.lit(source))


def quarters_to_years(df: DataFrame, keys: Sequence[str], quarter: str, value: str) -> DataFrame:
    """Annual means of quarterly values; the period is text that begins with the year."""
    return df.withColumn("period", leading_year(quarter)).where("period is not null").groupBy(*keys, "period").agg(F.avg(value).alias("value"))


def universe(panel: DataFrame, indicator: str, size: int) -> DataFrame:
    """The ``size`` entities with the highest latest value: (entity, size, size_period), by size."""
    last = Window.partitionBy("entity").orderBy(F.desc("period"))
    latest = panel.where((F.col("indicator") == indicator) & F.col("value").isNotNull()).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return latest.orderBy(F.desc("value"), "entity").limit(size).select("entity", F.col("value").alias("size"), F.col("period").alias("size_period"))


def within_universe(panel: DataFrame, members: DataFrame) -> DataFrame:
    return panel.join(members.select("entity").distinct(), "entity", "left_semi")


def dyads_within(dyads: DataFrame, members: DataFrame) -> DataFrame:
    """Both ends in the universe, no self-loops, positive values."""
    ends = members.select("entity").distinct()
    return (
        dyads.where((F.col("src") != F.col("dst")) & (F.col("value") > 0))
        .join(ends.withColumnRenamed("entity", "src"), "src", "left_semi").join(ends.withColumnRenamed("entity", "dst"), "dst", "left_semi")
    )


def year_window(df: DataFrame, years: int, period: str = "period") -> DataFrame:
    """The last ``years`` periods, counted from the latest in the data."""
    end = df.agg(F.max(period).alias("_end"))
    return df.join(F.broadcast(end), F.col(period).between(F.col("_end") - (years - 1), F.col("_end"))).drop("_end")


def map_codes(df: DataFrame, column: str, lookups: Sequence[DataFrame], target: str = "entity") -> DataFrame:
    """Code to entity by the first of several (code, entity) tables that knows it; NULL if none does."""
    found = []
    for k, table in enumerate(lookups):
        df = df.join(table.select(F.col("code").alias(f"_c{k}"), F.col("entity").alias(f"_e{k}")), F.col(column) == F.col(f"_c{k}"), "left").drop(f"_c{k}")
        found.append(f"_e{k}")
    return df.withColumn(target, F.coalesce(*found)).drop(*found)


def fuzzy_codes(names: DataFrame, known: DataFrame, name: str = "name", most: int = 2) -> DataFrame:
    """Free-text name to code: exact after normalisation, else the closest known name within ``most`` edits.

    Names within k edits have one of k + 1 equal parts of the known name in common, at most k places away, so a pair
    is a candidate if it shares such a part and a length within k; ties go to the smaller code.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", " ")
    left = names.select(F.col(name).alias("name"), plain(F.col(name)).alias("key")).distinct()
    right = known.select(F.col("code"), plain(F.col("name")).alias("known"))
    size = F.length("known")
    cut = lambda n, k: F.floor(n * k / (most + 1)).cast("int")
    part = lambda k: F.struct(F.lit(k).alias("k"), size.alias("n"), F.substr("known", cut(size, k) + 1, cut(size, k + 1) - cut(size, k)).alias("part"))
    parts = right.select("code", "known", F.explode(F.array(*map(part, range(most + 1)))).alias("p")).select("code", "known", "p.*")
    own = left.withColumn("n", F.explode(F.sequence(F.greatest(F.length("key") - most, F.lit(0)), F.length("key") + most))).withColumn("k", F.explode(F.array(*map(F.lit, range(most + 1)))))
    start, end = (cut(F.col("n"), F.col("k") + d) for d in (0, 1))
    own = own.withColumn("at", F.explode(F.sequence(F.greatest(start - most, F.lit(0)), start + most))).withColumn("part", F.substr("key", F.col("at") + 1, end - start))
    near = (
        own.select("name", "key", "n", "k", "part").distinct().join(parts, ["n", "k", "part"])
        .withColumn("edits", F.levenshtein("key", "known")).where(F.col("edits") <= most)
        .groupBy("name").agg(F.min(F.struct("edits", "code")).alias("best"))
    )
    return left.select("name").join(near, "name", "left").select("name", "best.code", "best.edits")


def quality_report(panel: DataFrame) -> DataFrame:
    """Per indicator: rows, NULL rows, distinct values, and whether it is empty or constant."""
    return panel.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value").isNull().cast("int")).cast("long").alias("n_missing"),
        F.countDistinct("value").alias("n_distinct"),
    ).withColumn("all_missing", F.col("n_rows") == F.col("n_missing")).withColumn("constant", F.col("n_distinct") == 1)
