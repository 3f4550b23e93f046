"""Numbers that last: groups keep theirs when further groups come."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmark.operators.rank import number_rows
from quillmark.schemas import SLOT
from quillmark.sources.steps import restore_steps, save_step


def _layout(groups: DataFrame, keys: list[str], out: str) -> StructType:
    return StructType([*(groups.schema[k] for k in keys), StructField(out, LongType())])


def number_new(
    groups: DataFrame, folder: str, step: int, keys: list[str] = SLOT, out: str = "identification"
) -> None:
    """Numbers the groups that no earlier step has, behind all of theirs, and writes them down.

    Within a step the numbers follow the order of the keys and have no gaps. Rows of
    a group may repeat, and nulls are keys like others. Old groups are read to be
    left out, but neither sorted nor numbered nor written again. A step that runs
    again gives the same numbers, as it reads only those before it; steps are run
    one after the other.
    """
    old = restore_steps(groups.sparkSession, folder, _layout(groups, keys, out), below=step)
    theirs = old.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    new = groups.select(*keys).distinct().join(theirs, same, "left_anti")
    start = old.agg(F.coalesce(F.max(out) + 1, F.lit(0))).scalar()
    numbered = number_rows(new, keys, out).withColumn(out, (F.col(out) + start).cast("long"))
    save_step(numbered.select(*keys, out), folder, step)


def lasting_numbers(
    spark: SparkSession, folder: str, schema: StructType, keys: list[str] = SLOT, out: str = "identification"
) -> DataFrame:
    """The keys and numbers of all steps; ``schema`` has the keys' types."""
    return restore_steps(spark, folder, StructType([*(schema[k] for k in keys), StructField(out, LongType())]))


def with_numbers(
    rows: DataFrame, numbers: DataFrame, keys: list[str] = SLOT, out: str = "identification"
) -> DataFrame:
    """Rows of numbered groups with their number; null keys match null keys."""
    theirs = numbers.select(*[F.col(k).alias(f"_{k}") for k in keys], out)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(theirs, same).drop(*[f"_{k}" for k in keys])
