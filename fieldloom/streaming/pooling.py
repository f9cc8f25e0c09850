"""The mergeable pooling state on a stream: n, sums and sums of squares per region, year and timestep."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.pooling import sum_cube


def streamed_cube(rows: DataFrame, width: int) -> DataFrame:
    """The sum cube of a streaming frame of embedding rows, for output modes complete and update; its state has one row a cell."""
    if not rows.isStreaming:
        raise ValueError("expected a streaming frame")
    return sum_cube(rows, width)
