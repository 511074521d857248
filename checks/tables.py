"""The driver tables seen as price observations (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR = 1995

# Unique within one station and day.
TIES = ["l_orderkey", "l_linenumber", "l_partkey"]

LINE_COLUMNS = ["l_suppkey", "l_linestatus", "l_shipdate", "l_extendedprice", *TIES]

# Fuel codes by part type; any other type gets code 6.
FUEL_CODES = {"STANDARD": 1, "SMALL": 2, "LARGE": 3, "MEDIUM": 4, "ECONOMY": 5}
OTHER_FUEL_CODE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gas_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as raw observations; prices are whole cents, one order key in 97
    has an invalid date."""
    items = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    station = F.col("l_suppkey")
    code = F.lit(None)
    for name, number in FUEL_CODES.items():
        code = F.when(F.col("p_type") == name, F.lit(number)).otherwise(code)
    spelled = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return joined.select(
        station.alias("id"),
        (F.lit(1000) * (F.col("s_nationkey") + 1) + station % 1000).alias("cp"),
        F.when(F.col("l_linestatus") == "O", "R").otherwise("A").alias("pop"),
        (F.lit(4100000) + (station * 7919) % 1000000).alias("lat"),
        (F.lit(-500000) + (station * 104729) % 1300000).alias("long"),
        F.when(F.col("l_orderkey") % 97 == 0, "n/a").otherwise(spelled).alias("date"),
        F.coalesce(code, F.lit(OTHER_FUEL_CODE)).alias("type"),
        F.col("p_type").alias("name"),
        F.round(F.col("l_extendedprice") * 100, 0).alias("prix"),
        *TIES,
    )
