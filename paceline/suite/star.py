"""The star schema seen as race results.

An order is a result, its price the total time, its customer the athlete; order lines give the split
times. Money stands for minutes, so the numbers are large. Sums run over decimals and are exact; the odd
divisor keeps values off the halves that engines round differently.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.plans.derived import race_rankings, split_percentiles_of
from paceline.schema import STATIONS
from paceline.session import shared_folder
from paceline.sources.manifest import read_manifest
from paceline.sources.warehouse import read_table, write_table

LINES = range(1, 8)
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its known schema, so that no file is opened to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, narrow: the texts that follow from date and nation are made after the shuffles."""
    orders = table(spark, sf_dir, "orders")
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _named(spark: SparkSession, sf_dir: str, orders: DataFrame, *more: str) -> DataFrame:
    """The columns of a result from an order and its customer, and `more` that are there already."""
    # 25 nations and 5 regions at every scale.
    places = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    season = F.year("o_orderdate")
    event = F.concat_ws(" ", season.cast("string"), F.col("r_name"))
    return orders.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("result_id"),
        event.alias("event_id"),
        event.alias("event_name"),
        season.alias("season"),
        season.alias("year"),
        F.col("r_name").alias("location"),
        F.col("o_orderpriority").alias("division"),
        F.col("o_orderstatus").alias("gender"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("age_group"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").alias("athlete_id"),
        F.col("n_name").alias("nationality"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.col("o_totalprice").alias("total_time_min"),
        *more,
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, without split times."""
    return _named(spark, sf_dir, _orders(spark, sf_dir))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split times per order: runs from the prices of its lines, stations from the quantities.

    Sums run over whole hundredths (and ten-thousandths), so they are exact and a third as wide as decimals.
    """
    lines = table(spark, sf_dir, "lineitem")
    price = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("long")
    amount = (F.col("l_quantity").cast("decimal(12,2)") * 100).cast("long")
    discount = (F.col("l_discount").cast("decimal(4,2)") * 100).cast("long")

    def total(value: Column, units: float) -> Column:
        return F.sum(value).cast("double") / units

    def on(line: int, value: Column) -> Column:
        return total(F.when(F.col("l_linenumber") == line, value), 100.0)

    return lines.groupBy(F.col("l_orderkey").alias("result_id")).agg(
        (total(price, 100.0) / 997).alias("run_time_min"),
        total(amount, 100.0).alias("work_time_min"),
        (total(price * discount, 10000.0) / 997).alias("roxzone_time_min"),
        *[(on(n, price) / 997).alias(f"run{n}_time_min") for n in LINES],
        *[on(n, amount).alias(f"{STATIONS[n - 1][0]}_time_min") for n in LINES],
    )


def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their split times."""
    split = times(spark, sf_dir)
    joined = _orders(spark, sf_dir).join(split, F.col("o_orderkey") == F.col("result_id"), "left").drop("result_id")
    return _named(spark, sf_dir, joined, *[c for c in split.columns if c != "result_id"])


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table over the star schema.

    Reports read finished tables, as they would from a warehouse: the first use in an application
    builds the table and writes it to the shared folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warehouse-{zlib.crc32(sf_dir.encode()):08x}"
        write_table(BUILDERS[name](spark, sf_dir), root, name)
        _STORED[key] = root
    return read_table(spark, _STORED[key], name)


BUILDERS = {
    "race_results": wide_results,
    "race_rankings": lambda spark, sf_dir: race_rankings(stored(spark, sf_dir, "race_results")),
    "split_percentiles": lambda spark, sf_dir: split_percentiles_of(stored(spark, sf_dir, "race_results")),
    "athlete_index": lambda spark, sf_dir: index(spark, sf_dir),
}


def links(rows: DataFrame) -> DataFrame:
    return rows.select("athlete_id", "result_id")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The athlete index over customers."""
    rows = stored(spark, sf_dir, "race_results")
    return rows.groupBy("athlete_id", F.lower("name").alias("canonical_name"), "nationality").agg(
        F.count(F.lit(1)).cast("int").alias("race_count"), F.max("gender").alias("gender")
    ).withColumn("name_lc", F.col("canonical_name"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per season, location and month that saw an order."""
    rows = results(spark, sf_dir)
    month = F.substring("start_date", 1, 7)
    return rows.groupBy("season", "location", month.alias("month")).agg(
        F.max("start_date").alias("file_last_modified"), F.max("year").alias("year")
    ).select(
        "season",
        "location",
        F.concat(F.lit("s3://bucket/season="), "season", F.lit("/"), "location", F.lit("-"), "month").alias("path"),
        "year",
        "file_last_modified",
    )


_FILES: dict[tuple[str, str], str] = {}


def race_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Race files with raw columns and a manifest in CSV, as a bucket would hold them: base folder, manifest.

    The first use in an application writes them to the shared folder. A thousand of money is an hour here, so that
    durations are short enough for clock text.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/races-{zlib.crc32(sf_dir.encode()):08x}"
        rows = stored(spark, sf_dir, "race_results")

        def clock(column: str, scale: float) -> Column:
            seconds = F.floor(F.col(column) * scale)
            parts = (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
            return F.format_string("%02d:%02d:%02d", *[p.cast("long") for p in parts])

        raw = rows.select(
            "season", "location", "name", "gender", "division",
            clock("total_time_min", 0.04).alias("total_time"), clock("run_time_min", 10.0).alias("run_time"),
            clock("run1_time_min", 60.0).alias("run_1"), clock("run2_time_min", 60.0).alias("run_2"),
            clock("skiErg_time_min", 60.0).alias("work_1"),
        )
        raw.hint("rebalance", "season", "location").write.mode("overwrite").partitionBy("season", "location").parquet(f"{root}/files")
        entries = rows.groupBy("season", "location").agg(F.max("year").alias("year"), F.max("start_date").alias("file_last_modified"))
        path = F.concat(F.lit("s3://bucket/files/season="), "season", F.lit("/location="), F.replace("location", F.lit(" "), F.lit("%20")))
        listing = entries.select("season", "location", F.replace(path, F.lit("%20"), F.lit(" ")).alias("path"), "year", "file_last_modified")
        listing.write.mode("overwrite").csv(f"{root}/manifest", header=True)
        _FILES[key] = root
    return _FILES[key], read_manifest(spark, f"{_FILES[key]}/manifest")


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as duration text in the forms seen in race files, some of them broken."""
    events = table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "click", F.date_format("ts", "H:mm:ss"))
        .when(F.col("event_type") == "view", F.date_format("ts", "mm:ss"))
        .when(F.col("event_type") == "signup", F.date_format("ts", " H:m:s "))
        .when(F.col("event_type") == "error", F.concat(F.lit(":"), F.date_format("ts", "ss")))
        .otherwise(F.col("value").cast("decimal(10,2)").cast("string"))
    )
    return events.select("event_id", "event_type", "user_id", "value", "ts", text.alias("raw"))
