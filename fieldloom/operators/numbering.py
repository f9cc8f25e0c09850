"""Row numbers in a total order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_dir


def numbered(df: DataFrame, order: list[str | Column], name: str = "place", start: int = 0) -> DataFrame:
    """``df`` with each row's place in ``order``, from ``start``. Rows are range-partitioned and sorted by all tasks; a row's place is its place in
    its partition after the numbers of rows of the partitions before, one number a partition. Rows that are equal in ``order`` come
    in any order."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    path = scratch_dir(df.sparkSession)
    marked = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id())
    marked.write.parquet(path)
    rows = df.sparkSession.read.schema(marked.schema).parquet(path)
    part = F.shiftright("_id", 33)
    before, shifts = start, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each partition
        shifts.append((r["part"], before))
        before += r["n"]
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    if not shifts:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_id")
    shift = F.element_at(F.create_map(*[F.lit(x).cast("long") for s in shifts for x in s]), part)
    return rows.withColumn(name, place + shift).drop("_id")
