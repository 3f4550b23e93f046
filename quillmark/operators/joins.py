"""Joins whose keys may be hot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: list[str] = (),
) -> DataFrame:
    """Join many ``facts`` rows to the one ``table`` row with the same key.

    Adaptive execution broadcasts the table if it turns out small, and cuts hot
    keys if it does not; nothing is measured while the plan is built. Where keys
    are known to be hot, ``spread_by`` cuts every key by a hash of those columns
    into as many parts as a shuffle has, and repeats the table for each.
    """
    if not spread_by:
        return facts.join(table, on, how)
    salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        facts.withColumn("_part", part)
        .join(table.withColumn("_part", parts), [*on, "_part"], how)
        .drop("_part")
    )
