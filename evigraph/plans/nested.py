"""Queries over nested protocol records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.nested import holder_rows, nest_holders, sentence_links, step_rows
from evigraph.sources import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence id of every chain step, linked to its claim or gap and record."""
    return sentence_links(nest_holders(read_table(spark, d, "protocol_records")))


def p2_holders(spark: SparkSession, d: str) -> DataFrame:
    """Every claim and gap with its section and number of steps."""
    return holder_rows(nest_holders(read_table(spark, d, "protocol_records"))).drop("raw_text")


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every chain step with its claim's or gap's keys."""
    return step_rows(nest_holders(read_table(spark, d, "protocol_records"))).withColumn("extracted_text", F.length("extracted_text"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_holders": p2_holders, "p2_steps": p2_steps}


def oracle_sql() -> dict:
    return {}
