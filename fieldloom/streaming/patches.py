"""Complete patches from a stream of embedding rows: keyed state that emits a patch once all its timesteps have arrived."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PATCH = "county_id string, year int, patch_id string, steps int, embedding array<double>"
STATE = "emitted boolean, seen long, vectors binary"


def _arrived(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, steps: int, keep_ms: int):
    """The state of a patch: a bit per timestep and the vectors in order of the timesteps seen; after it was emitted, only that."""
    if state.hasTimedOut:
        state.remove()
        return
    emitted, seen, data = state.get if state.exists else (False, 0, b"")
    held, newest = {}, 0
    if seen:
        have = [t for t in range(steps) if seen >> t & 1]
        held = dict(zip(have, np.frombuffer(bytes(data)).reshape(len(have), -1)))
    for pdf in batches:
        pdf = pdf[pdf["at"] > state.getCurrentWatermarkMs()]  # others are late
        newest = max([newest, *pdf["at"]])
        for step, vector in zip(pdf["timestep"], pdf["embedding"]):
            if not emitted and 0 <= step < steps and step not in held:  # repeats of a timestep are dropped
                held[int(step)] = np.asarray(vector, float)
    if not emitted and len(held) == steps:
        emitted = True
        yield pd.DataFrame([(*key, steps, np.concatenate([held[t] for t in range(steps)]))], columns=["county_id", "year", "patch_id", "steps", "embedding"])
    if emitted:
        held = {}
    state.update((emitted, sum(1 << t for t in held), b"".join(held[t].tobytes() for t in sorted(held))))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)


def streamed_patches(rows: DataFrame, steps: int, *, late: str = "1 hour", keep_ms: int = 24 * 3_600_000) -> DataFrame:
    """One row per patch with timesteps 0 .. ``steps`` - 1, as soon as the last has arrived, with their vectors one after another; for output mode
    append. ``rows``: county_id, year, patch_id, timestep, embedding, event_time.

    Of repeated timesteps the first counts, and an emitted patch isn't emitted again; other timesteps, and rows with a null key or
    vector, take no part. Rows later than ``late`` behind the watermark are dropped. A patch's state holds its vectors until it is
    emitted, a mark after that, and goes ``keep_ms`` of event time after its last row, complete or not."""
    if not rows.isStreaming:
        raise ValueError("expected a streaming frame")
    real = rows.where("county_id is not null and year is not null and patch_id is not null and timestep is not null and embedding is not null and event_time is not null")

    def arrived(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _arrived(key, batches, state, steps, keep_ms)

    timed = real.select("county_id", F.col("year").cast("int").alias("year"), "patch_id", F.col("timestep").cast("int").alias("timestep"), F.col("embedding").cast("array<double>").alias("embedding"), F.unix_millis("event_time").alias("at"), "event_time").withWatermark("event_time", late)
    return timed.groupBy("county_id", "year", "patch_id").applyInPandasWithState(arrived, PATCH, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(rows: DataFrame, folder: str, out: str, checkpoint: str, query, *, files_at_once: int = 1) -> DataFrame:
    """Runs ``query`` over the files of ``folder`` as a stream, ``files_at_once`` a batch, to the end, and returns what it wrote to ``out``."""
    spark = rows.sparkSession
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    made = query(stream)
    made.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
