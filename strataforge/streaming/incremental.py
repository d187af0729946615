"""Streams: unseen rows only, changed content only, live entries, running outcome counts.

State is bounded by a watermark or a time to live; every query takes a checkpoint folder in the shared directory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unseen(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """First row of each key within the delay; keys are forgotten after it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def outcome_counts(stream: DataFrame, at: str, delay: str, window: str, level: str, outcome: str) -> DataFrame:
    """Outcomes per window and level; late rows count until the delay is over."""
    g = stream.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), level)
    return g.agg(F.count_if(F.col(outcome) == "accepted").alias("accepted"), F.count_if(F.col(outcome) == "rejected").alias("rejected"), F.count("*").alias("total")).select(F.col("w.start").alias("start"), level, "accepted", "rejected", "total")


def append_changed(key: str, digest: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose digest differs from the last one written for their key.

    A batch that is retried finds its own rows written under its number and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), digest).alias("_r")).select(key, "_r.*").withColumn("_batch", F.lit(number))
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.parquet(path).filter(F.col("_batch") < number).groupBy(key).agg(F.max_by(digest, "_batch").alias("_last"))
            done = spark.read.parquet(path).filter(F.col("_batch") == number).select(key)
            rows = rows.join(old, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_last"))).drop("_last").join(done, key, "left_anti")
        rows.write.mode("append").parquet(path)

    return write


def live_entries(stream: DataFrame, key: str, value: str, at: str, ttl_seconds: int) -> DataFrame:
    """(key, value, state): entries as they come (new, changed, same) and as they expire, a time to live after the last."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (old,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [old], "state": ["expired"]})
            return
        rows = pd.concat(list(frames)).sort_values(at)
        last = rows.iloc[-1]
        was = state.get[0] if state.exists else None
        kind = "new" if not state.exists else "same" if was == last[value] else "changed"
        state.update((last[value],))
        state.setTimeoutTimestamp(max(int(last[at].timestamp() * 1000) + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], value: [last[value]], "state": [kind]})

    types = dict(stream.dtypes)
    out = f"{key} {types[key]}, {value} {types[value]}, state string"
    return stream.withWatermark(at, "0 seconds").groupBy(key).applyInPandasWithState(step, out, f"{value} {types[value]}", "append", GroupStateTimeout.EventTimeTimeout)
