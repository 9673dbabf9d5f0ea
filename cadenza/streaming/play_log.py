"""The play log as a stream: counts in windows, and a rate limit with its refusal rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def play_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of events that arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_plays(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and kind; a window is final when the watermark has passed it."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def rate_limited(events: DataFrame, most: int = 5, seconds: int = 3600) -> DataFrame:
    """Whether each event of a user is allowed: at most ``most`` allowed ones in the last ``seconds``.

    Refused attempts are not recorded, so a plain window count would be wrong.  The
    state of a user is at most ``most`` times.
    """
    out = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("allowed", T.BooleanType())])
    held = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType()))])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        allowed = []
        for now in rows.ts.map(lambda t: t.timestamp()):
            times = [t for t in times if t > now - seconds]
            allowed.append(len(times) < most)
            if allowed[-1]:
                times.append(now)
        state.update((times,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows.event_id, "allowed": allowed})

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, out, held, "append", "NoTimeout")
