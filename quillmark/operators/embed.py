"""Text to vector with an encoder the user supplies."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.stages import stage

Encode = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame, text: str, out: str, make_encoder: Callable[[], Encode], batch: int = 256
) -> DataFrame:
    """Adds the vector of a text column, in single precision.

    ``make_encoder`` runs once per task and is asked for at most ``batch`` texts
    at a time. An encoder costs far more than a shuffle, so every different text
    is encoded once, the vectors are written down, and the rows look theirs up
    by a hash of the text. A null text counts as empty.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            parts = [
                np.asarray(encode(list(texts.iloc[i : i + batch])), dtype="float32")
                for i in range(0, len(texts), batch)
            ]
            rows = [row for part in parts for row in part]
            yield pd.Series(rows, index=texts.index, dtype=object)

    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    different = df.select(key.alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    different = different.groupBy("_key").agg(F.min("_text").alias("_text"))
    known = stage(different.select("_key", vectors("_text").alias(out)), "vectors")
    return df.withColumn("_key", key).join(known, "_key").drop("_key")
