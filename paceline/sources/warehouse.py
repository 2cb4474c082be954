"""The results warehouse: Parquet tables, the large ones partitioned by season."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ["race_results", "race_rankings", "split_percentiles", "athletes", "athlete_results", "athlete_index", "build_info"]


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace a table. Every task writes its own part of each season, so no row is moved for it."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy("season") if "season" in df.columns else writer).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None, merge: bool = False) -> DataFrame:
    """A table of the warehouse.

    With a declared schema (`paceline.schema.RESULTS_SCHEMA`) no file is opened to learn one, and columns that a
    season lacks are null. `merge` opens every file instead, for tables whose columns are not known.
    """
    reader = spark.read.option("mergeSchema", merge)
    return (reader if schema is None else reader.schema(schema)).parquet(f"{root}/{name}")


def register(spark: SparkSession, root: str, names: list[str] | None = None, merge: bool = False) -> list[str]:
    """Make the tables known to SQL."""
    for name in names or TABLES:
        read_table(spark, root, name, merge=merge).createOrReplaceTempView(name)
    return [row.tableName for row in spark.sql("SHOW TABLES").collect()]


def query(spark: SparkSession, sql: str, args=None) -> DataFrame:
    """Parameterised SQL over the registered tables."""
    return spark.sql(sql, args=args)


def records(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows as JSON text, dates in ISO form, missing values kept."""
    rows = df if limit is None else df.limit(limit)
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
