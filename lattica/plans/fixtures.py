"""The star schema as panel, dyads, memberships and points.

Entities are nations, periods order years; dyads go from the customer's nation to the supplier's.  What the star join
is summed up to is checkpointed, so that a query which reads it several times joins once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.graph import accumulate, row_normalize
from lattica.schema import table
from lattica.sources.archives import write_archives
from lattica.sources.storage import files, opened, shared_folder

#: Indicator, its source, and whether it is inverted.
REGISTRY = [
    ("revenue", "WB_WDI", False), ("n_orders", "ACLED", False), ("discount", "FSI", True), ("return_rate", "WB_WGI", True), ("urgent_share", "SIPRI", False),
]
INDICATORS = [r[0] for r in REGISTRY]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "indicator string, source string, invert boolean")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order line with both nations, the year and the measures."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity")), "c_nationkey")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst")), "s_nationkey")
        .select("entity", F.col("c_nationkey").alias("nk"), "dst", F.year("o_orderdate").alias("period"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), "l_discount", "l_tax", "l_returnflag", "l_partkey",
                "o_orderkey", "o_orderpriority", "o_orderdate")
    )


def panel(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Fact rows of five indicators; with ``gaps`` a value is NULL where (7 nation key + year) is a multiple of 5."""
    wide = sales(spark, sf_dir).groupBy("entity", "nk", "period").agg(
        (F.sum("rev") / 1e6).alias("revenue"), F.countDistinct("o_orderkey").cast("double").alias("n_orders"), (F.avg(F.col("l_discount") * F.col("rev")) / 100).alias("discount"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("return_rate"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share"))
    rows = wide.unpivot(["entity", "nk", "period"], INDICATORS, "indicator", "value")
    source = F.create_map(*[F.lit(x) for r in REGISTRY for x in r[:2]])[F.col("indicator")]
    value = F.when((F.col("nk") * 7 + F.col("period")) % 5 != 0, F.col("value")) if gaps else F.col("value")
    return rows.select("entity", F.col("period").cast("int").alias("period"), "indicator", value.alias("value"), source.alias("source")).checkpoint()


def dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).where("entity <> dst").groupBy(F.col("entity").alias("src"), "dst", "period").agg((F.sum("rev") / 1e6).alias("value")).checkpoint()


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_normalize(accumulate(dyads(spark, sf_dir))).checkpoint()


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("entity").agg((F.sum("rev") / 1e6).alias("size")).checkpoint()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, score): revenue over its mean."""
    s = sizes(spark, sf_dir)
    return s.join(F.broadcast(s.agg(F.avg("size").alias("_m")))).select("entity", (F.col("size") / F.col("_m")).alias("score"))


def yearly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, period, score): revenue over the mean of the year."""
    p = panel(spark, sf_dir).where("indicator = 'revenue'")
    return p.select("entity", "period", (F.col("value") / F.avg("value").over(Window.partitionBy("period"))).alias("score"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, indicator, value) averaged over the years, gaps left out."""
    return panel(spark, sf_dir, gaps=True).where("value is not null").groupBy("entity", "indicator").agg(F.avg("value").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place per nation, laid out by its key."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), ((k * 37) % 120 - 60).cast("double").alias("lat"), ((k * 71) % 360 - 180).cast("double").alias("lon"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(org, entity): brands of which a nation buys more than its mean share."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("org"))
    v = sales(spark, sf_dir).join(part, "l_partkey").groupBy("entity", "org").agg(F.sum("rev").alias("v"))
    return v.withColumn("_m", F.avg("v").over(Window.partitionBy("entity"))).where("v > _m").select("org", "entity")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, value): users' moves between consecutive event types."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("dst", F.lead("event_type").over(w)).where("dst is not null")
    return e.groupBy(F.col("event_type").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("value"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, src, dst, w) of three channels."""
    s = sales(spark, sf_dir).where("entity <> dst").groupBy(F.col("entity").alias("src"), "dst").agg(
        (F.sum("rev") / 1e6).alias("trade"), F.sum("l_tax").alias("financial"), F.count(F.lit(1)).cast("double").alias("political"))
    return s.unpivot(["src", "dst"], ["trade", "financial", "political"], "channel", "w").checkpoint()


def channel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("trade", 0.5), ("financial", 0.3), ("political", 0.2)], "channel string, weight double")


#: What the archives of orders hold: member, and the measure that is its indicator.
ARCHIVE_MEMBERS = {"resources/spend/spend.csv": "spend", "resources/orders/orders.csv": "orders", "resources/largest/largest.csv": "largest"}
ARCHIVE_YEARS = range(1995, 2002)


def order_archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder of ZIP archives, each with three wide CSV tables of some customers' orders by year."""
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    of = lambda y, v: F.when(F.col("y") == y, v)
    wide = orders.groupBy(F.concat(F.lit(" c"), "o_custkey").alias("code")).agg(*[m.alias(f"{n}{y}") for y in ARCHIVE_YEARS for n, m in (
        ("spend", F.sum(of(y, F.col("o_totalprice")))), ("orders", F.count(of(y, F.lit(1)))), ("largest", F.max(of(y, F.col("o_totalprice")))))])
    folder = scratch(spark, "archives")
    write_archives(wide, folder, "code", {m: {str(y): f"{n}{y}" for y in ARCHIVE_YEARS} for m, n in ARCHIVE_MEMBERS.items()}, 2000)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def nation_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, y, spend): what a nation's customers order in a year, in millions."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("name"), F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") / 1e6).alias("spend"))


def wide_file(spark: SparkSession, sf_dir: str) -> str:
    """A CSV folder with a column per year (YR1995 ...) and names in lower case with blanks around them."""
    folder = scratch(spark, "wide")
    code = F.concat(F.lit("  "), F.lower("name"), F.lit(" ")).alias("Country ISO code")
    cells = [F.max(F.when(F.col("y") == y, F.col("spend"))).alias(f"YR{y}") for y in ARCHIVE_YEARS]
    nation_spend(spark, sf_dir).groupBy(code).agg(*cells).write.csv(folder, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


def yearly_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files, one a year and named by it; the year is nowhere else."""
    folder, rows = scratch(spark, "yearly"), nation_spend(spark, sf_dir).checkpoint()
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    for y in ARCHIVE_YEARS:
        part = f"{folder}-parts/{y}"
        rows.where(F.col("y") == y).select(F.col("name").alias("Country"), F.col("spend").alias("Total"), F.lit("n/a").alias("Rank")).coalesce(1).write.csv(part, header=True)
        for k, f in enumerate(files(part, ".csv")):
            store.move(f.path, f"{root}/report_{k}-{y}.csv")
    return folder
