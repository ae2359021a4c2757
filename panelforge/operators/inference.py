"""Run a model over a table."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelforge.functions.demographics import is_default_image

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Model = Callable[[pd.DataFrame], pd.DataFrame]
BATCH_ROWS = 10


def model_input(profiles: DataFrame) -> DataFrame:
    """User records as the model wants them, with the flag for a missing picture."""
    return profiles.select(
        F.col("uid").alias("id_str"),
        "profile_image_url_https",
        "description",
        "name",
        "screen_name",
        is_default_image(F.col("profile_image_url_https")).alias("default_profile_image"),
    )


def predict(
    df: DataFrame,
    load_model: Callable[[], Model],
    schema: str,
    batch_rows: int = BATCH_ROWS,
    n_partitions: int | None = None,
) -> DataFrame:
    """Rows the model returns for chunks of at most ``batch_rows`` input rows; loaded once per task.

    The model returns its own ids, so no row relies on its place in a chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for frame in frames:
            chunks = [model(frame.iloc[at : at + batch_rows]) for at in range(0, len(frame), batch_rows)]
            yield chunks[0] if len(chunks) == 1 else pd.concat(chunks)

    placed = df if n_partitions is None else df.repartition(n_partitions)
    return placed.mapInPandas(run, schema)
