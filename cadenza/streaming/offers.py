"""Streams with state that ends: duplicates, sessions, and offers that come back.

Each stream has a batch form with the same result, for what has already happened.  State is kept
for as long as the watermark allows and no longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What puts an offer off, and what settles it.
PUT_OFF, SETTLED = "view", "purchase"


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once: repeated ids are dropped as long as they come within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """user_id, start, end (of the last event), n: a user's events without a pause of ``gap``; late ones beyond the watermark do not count."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    out = grouped.agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "end", "n")


def returned(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """user_id, due: offers put off that nothing has settled or put off again before they are due.

    Of events at one time the one with the greater id counts last; null times and users are left out.
    """
    kinds = events.filter(F.col("event_type").isin(PUT_OFF, SETTLED) & F.col("ts").isNotNull() & F.col("user_id").isNotNull())
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    due = F.col("ts") + F.make_interval(secs=F.lit(seconds))
    return kinds.withColumn("after", after).withColumn("due", due).filter((F.col("event_type") == PUT_OFF) & (F.col("after").isNull() | (F.col("after") >= F.col("due")))).select("user_id", "due")


def returned_stream(events: DataFrame, seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """The same as a stream: a user's events wait until the watermark has passed them, then are taken in order.

    The state is what the user has within the delay, and the time at which an offer comes back.  The
    timer stands at the earliest time that anything can happen; with nothing left to wait for the state goes.
    """
    kinds = events.filter(F.col("event_type").isin(PUT_OFF, SETTLED) & F.col("ts").isNotNull() & F.col("user_id").isNotNull())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, due = ([list(x) for x in zip(*state.get[:3])], state.get[3]) if state.exists else ([], None)
        watermark = state.getCurrentWatermarkMs()
        for rows in batches:
            for at, number, kind in zip(rows.ts, rows.event_id, rows.event_type):
                ms = at.value // 1000 if at.value > 10**17 else at.value
                if ms // 1000 >= watermark:
                    waiting.append([int(ms), int(number), kind])
        waiting.sort()
        out = []
        # microseconds; what lies before the watermark can no longer change
        while waiting and waiting[0][0] < watermark * 1000:
            at, _, kind = waiting.pop(0)
            if due is not None and due <= at:
                out.append(due)
            due = at + seconds * 1_000_000 if kind == PUT_OFF else None
        if due is not None and due < watermark * 1000 and (not waiting or due <= waiting[0][0]):
            out.append(due)
            due = None
        if waiting or due is not None:
            state.update(([w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], due))
            state.setTimeoutTimestamp(max(watermark + 1, min([w[0] // 1000 + 1 for w in waiting[:1]] + ([due // 1000 + 1] if due is not None else []))))
        else:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "due": pd.to_datetime(pd.Series(out, dtype="int64"), unit="us")})

    rows = kinds.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts").groupBy("user_id")
    held = "at array<long>, number array<long>, kind array<string>, due long"
    return rows.applyInPandasWithState(step, "user_id long, due timestamp", held, "append", "EventTimeTimeout")
