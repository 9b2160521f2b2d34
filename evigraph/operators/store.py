"""Table writes: upserts, deletes, versioned reads. All are idempotent rewrites of whole partitions.

Every function on DataFrames is pure; ``write_*`` functions write through Spark's commit protocol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, fresh: DataFrame, key: str, *order: str) -> DataFrame:
    """Stored rows replaced or joined by fresh ones of the same key; among fresh ones the last in order wins."""
    both = stored.withColumn("_gen", F.lit(0)).unionByName(fresh.withColumn("_gen", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("_gen").desc(), *[F.col(c).desc() for c in order])
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_gen")


def delete_papers(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims of papers that are not in ``papers``."""
    return claims.join(papers.select("paper_id").distinct(), "paper_id", "left_anti")


def replace_claims(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """All claims of the papers in ``fresh`` replaced."""
    return delete_papers(stored, fresh).unionByName(fresh)


def versioned(papers: DataFrame, version: str) -> DataFrame:
    """Papers of one ingest version."""
    return papers.filter(F.col("ingest_version") == version)


def write_table(df: DataFrame, path: str, partition: str | None = None, buckets: int = 0, key: str = "paper_id") -> None:
    """Parquet, by partition column if given (only the partitions present are overwritten), clustered by key."""
    if buckets:
        df = df.repartition(buckets, key).sortWithinPartitions(key)
    w = df.write.mode("overwrite")
    if partition:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of the schema where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(hadoop) else spark.createDataFrame([], schema)
