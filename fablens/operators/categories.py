"""The category registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens import constants as C
from fablens.functions.classify import valid_category_name


def default_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in C.DEFAULT_CATEGORIES], "name string")


def category_set(stored: DataFrame, column: str = "category") -> DataFrame:
    """Default categories and all stored ones, sorted."""
    names = stored.select(F.col(column).alias("name")).filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return default_categories(stored.sparkSession).union(names).distinct().orderBy("name")


def add_categories(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Outcome per requested name: clean form, whether it is valid and whether it was newly created."""
    asked = names.select("name").distinct().withColumn("clean", valid_category_name(F.col("name")))
    known = registry.select(F.col("name").alias("clean")).distinct().withColumn("known", F.lit(True))
    joined = asked.join(known, "clean", "left")
    return joined.select(
        "name", "clean", F.col("clean").isNotNull().alias("valid"),
        (F.col("clean").isNotNull() & F.col("known").isNull()).alias("created"),
    )


def registry_after(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Registry with the valid new names added."""
    clean = names.select(valid_category_name(F.col("name")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return registry.select("name").union(clean.join(registry.select("name"), "name", "left_anti"))
