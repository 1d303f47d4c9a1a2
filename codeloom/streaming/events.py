"""File events: leading-edge debounce, as a batch query and as a stream, and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom import storage

LIMIT = 2.0


def debounce(events: DataFrame, key: str, limit: float = LIMIT, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events at least ``limit`` seconds after the one before of the same key; the first always.

    Suppressed events count as the one before, too: a steady run emits its first event alone.
    """
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("before_").cast("timestamp"))
    return events.withColumn("before_", before).where(F.col("before_").isNull() | (gap >= int(limit * 1_000_000))).drop("before_")


def sessions(events: DataFrame, key: str, limit: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``key, began, ended, n``: runs of events with gaps of at most ``limit`` seconds."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    marked = events.withColumn("fresh_", F.coalesce(gap > int(limit * 1_000_000), F.lit(True)).cast("int"))
    numbered = marked.withColumn("run_", F.sum("fresh_").over(w))
    return numbered.groupBy(key, "run_").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("run_")


def debounce_stream(events: DataFrame, key: str = "user_id", limit: float = LIMIT, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same over a stream: state is the time of each key's last event, suppressed ones included.

    Events of a key are put in order within a batch. One that comes later than a newer event of its key was
    handled is measured from that newer one and so suppressed.
    """
    step = int(limit * 1_000_000_000)

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(parts), ignore_index=True).sort_values(["at_ns", tie], kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for at in every["at_ns"]:
            keep.append(last is None or at - last >= step)
            last = at if last is None else max(last, at)
        state.update((int(last),))
        yield every.loc[keep, [key, tie]]

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    flat = events.select(key, tie, (F.unix_micros(F.col(ts).cast("timestamp")) * 1000).alias("at_ns"))
    return flat.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}", "last bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table of the shared folder; the table."""
    spark = stream.sparkSession
    path = storage.fresh_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", storage.fresh_path(spark, name + "-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
