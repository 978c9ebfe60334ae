"""Named queries and, where SQL can say it, the same query as DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.scale import estimated_bytes

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


TEXT_TABLES = ("documents", "pages", "conversations")

#: A scan smaller than this is read as it is.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Text work on a file of few row groups uses all cores; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2)


@dataclass
class Tables:
    """The driver tables of one folder, read on demand."""
    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.path.rstrip('/')}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table


@dataclass
class Plan:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return self.build(Tables(spark, path))


PLANS: dict[str, Plan] = {}


def plan(key: str, sql: str | None = None):
    def keep(build):
        if key in PLANS:
            raise ValueError(f"duplicate query name {key}")
        PLANS[key] = Plan(key, build, sql)
        return build
    return keep
