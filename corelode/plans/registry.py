"""Registered queries and their SQL by name, and what all query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (query, SQL) by name.
ENTRIES: dict[str, tuple] = {}


def query(sql: str | None):
    def keep(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long: what both engines can agree on."""

    def column(c: str, kind: str):
        if kind == "double":
            return F.round(c, digits).alias(c)
        return F.col(c).cast("long").alias(c) if kind in ("int", "bigint", "smallint") else F.col(c)

    return df.select(*[column(c, t) for c, t in df.dtypes])
