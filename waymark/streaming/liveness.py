"""Whether sources are alive: Fresh while their sequence changes, Stale when it has not for a while, Disconnected without frames.

In batch, gaps between frames tell it by windows. In a stream, each source's state holds what was seen last and one
event-time timer is set for the moment at which it would change, so silence itself is told as the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

FRESH, STALE, DISCONNECTED = "Fresh", "Stale", "Disconnected"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def liveness(frames: DataFrame, stale_us: int, gone_us: int, until_us: int | None = None) -> DataFrame:
    """(vehicle, at_us, state): changes of state of frames (vehicle, at_us, seq, sequence), up to `until_us` or the last frame of all.

    A frame is new if its sequence differs from the one before. `gone_us` is longer than `stale_us`. What would change
    just when a frame comes does not.
    """
    c = F.col
    by = Window.partitionBy("vehicle").orderBy("at_us", "seq")
    new = ~c("sequence").eqNullSafe(F.lag("sequence").over(by)) | F.lag("at_us").over(by).isNull()
    rows = frames.select("vehicle", "at_us", "seq", "sequence").withColumns({"new": new, "before": F.lag("at_us").over(by), "after": F.lead("at_us").over(by)})
    rows = rows.withColumn("next_new", F.first(F.when(c("new"), c("at_us")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    end = F.lit(until_us).alias("until") if until_us is not None else F.max("at_us").alias("until")
    rows = rows.join(F.broadcast(frames.agg(end) if until_us is None else frames.sparkSession.range(1).select(end)))
    change = lambda holds, at, state: F.when(holds & (at <= c("until")), F.struct(at.alias("at_us"), F.lit(state).alias("state")))
    dies = lambda at, following: following.isNull() | (following > at)
    stale, gone = c("at_us") + stale_us, c("at_us") + gone_us
    changes = F.array(
        change(c("new"), c("at_us"), FRESH), change(~c("new") & (c("before") + gone_us < c("at_us")), c("at_us"), STALE), change(c("new") & dies(stale, c("next_new")), stale, STALE), change(dies(gone, c("after")), gone, DISCONNECTED)
    )
    told = rows.select("vehicle", "seq", F.explode(F.array_compact(changes)).alias("c")).select("vehicle", "seq", "c.*")
    order = Window.partitionBy("vehicle").orderBy("at_us", "seq")
    return told.withColumn("was", F.lag("state").over(order)).where(c("was").isNull() | (c("was") != c("state"))).select("vehicle", "at_us", "state")


class _Source(StatefulProcessor):
    """One source's last sequence, when it changed, when a frame was seen, and the state told last."""

    def __init__(self, stale_us: int, gone_us: int):
        self.stale_us, self.gone_us = stale_us, gone_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("last", "sequence long, new_us long, seen_us long, status string")

    def _silent(self, state: list, now: int, out: list) -> None:
        """What silence before `now` changes."""
        for status, began, after, then in ((FRESH, 1, self.stale_us, STALE), (STALE, 2, self.gone_us, DISCONNECTED)):
            if state[3] == status and state[began] + after < now:
                state[3] = then
                out.append((state[began] + after, then))

    def _keep(self, key: tuple, state: list, out: list) -> Iterator[pd.DataFrame]:
        self.kept.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[3] != DISCONNECTED:
            at = state[1] + self.stale_us if state[3] == FRESH else state[2] + self.gone_us
            self.handle.registerTimer(at // 1000 + 1)
        yield pd.DataFrame({"vehicle": [key[0]] * len(out), "at_us": [x[0] for x in out], "state": [x[1] for x in out]}).astype({"vehicle": "int64", "at_us": "int64", "state": "object"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        state = list(self.kept.get()) if self.kept.exists() else None
        frames = pd.concat(list(rows)).sort_values(["at_us", "seq"], kind="stable")
        for at, sequence in zip(frames["at_us"].tolist(), frames["sequence"].tolist()):
            if state is not None:
                self._silent(state, at, out)
            if state is None or sequence != state[0]:
                if state is None or state[3] != FRESH:
                    out.append((at, FRESH))
                state = [int(sequence), at, at, FRESH]
                continue
            if state[3] == DISCONNECTED:
                state[3] = STALE
                out.append((at, STALE))
            state[2] = at
        yield from self._keep(key, state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        state = list(self.kept.get())
        self._silent(state, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        yield from self._keep(key, state, out)

    def close(self) -> None:
        pass


def liveness_stream(frames: DataFrame, stale_us: int, gone_us: int) -> DataFrame:
    """The same over a stream of frames with a watermark; silence is told once the watermark has passed it.

    Needs the state store that keeps timers (spark.sql.streaming.stateStore.providerClass is ROCKS_DB). A null sequence is none: give each frame one.
    """
    return frames.groupBy("vehicle").transformWithStateInPandas(statefulProcessor=_Source(stale_us, gone_us), outputStructType="vehicle long, at_us long, state string", outputMode="Append", timeMode="EventTime")
