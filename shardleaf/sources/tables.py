"""Reading the given tables, and change sets between two states of a collection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def change_set(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change`` with change added, removed or changed, for rows whose digest differs between two states."""
    a = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")
