"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, version: str | None, *ties: str) -> DataFrame:
    """One row per key: the latest ``version`` (nulls last), further ties by ``ties`` descending.

    Rows with a null key are kept as one group. Hot keys cannot arise from repeated
    rows alone: the sort per key is a window over that key's versions only.
    """
    order = [F.col(version).desc_nulls_last()] if version else []
    order += [F.col(t).desc_nulls_last() for t in ties] or [F.col(key)]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def hash_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """About ``n`` rows (10 % more), the same ones at every run; all rows where there are no more.

    Rows are taken by a threshold on the id's hash, so that no task and no driver ever sorts or
    gathers more than the sample; counting reads the id column only.
    """
    total = df.select(id_col).count()
    if total <= n:
        return df
    cut = max(1, int(1.1 * n / total * 2**40))
    return df.filter(F.pmod(F.xxhash64(id_col), F.lit(2**40)) < cut)
