"""Loaders for the parquet tables of a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the path is handed to Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views for the SQL-text plans."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
