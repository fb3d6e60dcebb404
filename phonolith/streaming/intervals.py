"""Sound intervals as streams: level per receiver and window, and running quiet time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phonolith.functions import acoustics as ac


def windowed_levels(intervals: DataFrame, width_s: int = 3600, late: str = "2 hours") -> DataFrame:
    """LAeq of each receiver and window of an interval stream; works on a table as well.

    An interval is split at window edges. Time that no interval covers stays missing: observed_s says how much was
    heard. Windows are given out once the watermark has passed them; intervals later than that are dropped by Spark.
    """
    windows = F.sequence(F.floor(F.col("start_s") / width_s).cast("long"), F.floor((F.col("end_s") - 1) / width_s).cast("long"))
    cut = intervals.withColumn("w", F.explode(windows))
    s = F.least("end_s", (F.col("w") + 1) * width_s) - F.greatest("start_s", F.col("w") * width_s)
    own = cut.select("receiver_id", F.timestamp_seconds(F.col("w") * width_s).alias("at"), s.alias("s"), "level_db").withWatermark("at", late)
    out = own.groupBy("receiver_id", F.window("at", f"{width_s} seconds")).agg(F.sum("s").alias("observed_s"), F.sum(F.col("s") * ac.db_to_energy(F.col("level_db"))).alias("energy"))
    return out.select("receiver_id", F.col("window.start").alias("from_ts"), "observed_s", ac.energy_to_db(F.col("energy") / F.col("observed_s")).alias("laeq_db"))


_STATE = "run_s long, last_end long, longest long"
_OUT = "receiver_id long, longest_quiet_s long, upto_s long"


def quiet_runs(intervals: DataFrame, quiet_db: float = 40.0) -> DataFrame:
    """Longest run below quiet_db of each receiver so far, updated as intervals arrive in order of time.

    State is three numbers a receiver. An interval that begins before the last one's end is late and is left out.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, last, longest = state.get if state.exists else (0, -(2**62), 0)
        rows = pd.concat(list(batches)).sort_values(["start_s", "end_s"])
        for start, end, level in zip(rows.start_s, rows.end_s, rows.level_db, strict=True):
            if start < last:
                continue
            run = (run if start == last else 0) + (end - start) if level < quiet_db else 0
            last, longest = end, max(longest, run)
        state.update((int(run), int(last), int(longest)))
        yield pd.DataFrame({"receiver_id": [key[0]], "longest_quiet_s": [int(longest)], "upto_s": [int(last)]})

    return intervals.groupBy("receiver_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


#: Receivers whose ids agree in all but so many last bits share a group, so that what a group costs is paid once for up to 256 of them.
BLOCK_BITS = 8


class QuietTime(StatefulProcessor):
    """State of a block of receivers, for each: the quiet run it is in, the end of what was heard, the longest run. It ends `idle_s` after that end.

    A block has one timer, for the earliest of its receivers' ends; it is set anew with every batch, so state is held for
    receivers that are still heard and no others.
    """

    def __init__(self, quiet_db: float, idle_s: int):
        self.quiet_db, self.idle_ms = quiet_db, idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getMapState("heard", "receiver_id long", "run_s long, last_end long, longest long")

    def _said(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        """rows of id, kind, start, end, longest; receivers without an id are a block of their own."""
        ids, kinds, starts, ends, longest = zip(*rows, strict=True)
        ids = [None] * len(ids) if key[0] is None else ids
        return pd.DataFrame({"receiver_id": pd.array(ids, "Int64"), "kind": kinds, "start_s": pd.array(starts, "Int64"), "end_s": ends, "longest_quiet_s": longest})

    def _set_timer(self, held: dict[int, tuple]) -> None:
        due = min(last for _, last, _ in held.values()) * 1000 + self.idle_ms if held else None
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {int(k[0]): tuple(map(int, v)) for k, v in self.heard.iterator()}
        own = pd.concat(list(rows))
        own = own.assign(receiver_id=own.receiver_id.fillna(0).astype("int64")).sort_values(["receiver_id", "start_s", "end_s"])
        late, seen = [], set()
        for receiver, start, end, level in zip(*[own[c].tolist() for c in ("receiver_id", "start_s", "end_s", "level_db")], strict=True):
            run, last, longest = held.get(receiver, (0, None, 0))
            if last is not None and start < last:
                late.append((receiver, start, end))
                continue
            run = (run if start == last else 0) + (end - start) if level < self.quiet_db else 0
            held[receiver] = run, end, max(longest, run)
            seen.add(receiver)
        for receiver in seen:
            self.heard.updateValue((receiver,), held[receiver])
        self._set_timer(held)
        out = [(receiver, "late", start, end, held[receiver][2]) for receiver, start, end in late]
        yield self._said(key, out + [(receiver, "heard", None, *held[receiver][1:]) for receiver in sorted(seen | {r for r, _, _ in late})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - self.idle_ms
        held = {int(k[0]): tuple(map(int, v)) for k, v in self.heard.iterator()}
        ended = sorted(r for r, (_, last, _) in held.items() if last * 1000 <= upto)
        out = [(r, "ended", None, *held.pop(r)[1:]) for r in ended]
        for r in ended:
            self.heard.removeKey((r,))
        self._set_timer(held)
        if out:
            yield self._said(key, out)

    def close(self) -> None:
        pass


def quiet_time(intervals: DataFrame, quiet_db: float = 40.0, late: str = "1 hour", idle_s: int = 86400) -> DataFrame:
    """receiver_id, kind, start_s, end_s, longest_quiet_s of an interval stream, one row a receiver and batch and more.

    heard: the longest run below quiet_db so far, up to end_s; late: an interval that begins before the end of what was
    heard, which changes nothing; ended: nothing was heard for idle_s, the receiver's state is gone, and what it sends next
    begins anew. Intervals that begin before the watermark are dropped and counted by Spark. Needs the RocksDB state store.
    """
    block = F.shiftright("receiver_id", BLOCK_BITS).alias("block")
    own = intervals.select(block, "receiver_id", "start_s", "end_s", "level_db", F.timestamp_seconds("start_s").alias("at")).withWatermark("at", late)
    schema = "receiver_id long, kind string, start_s long, end_s long, longest_quiet_s long"
    return own.groupBy("block").transformWithStateInPandas(QuietTime(quiet_db, idle_s), schema, "Update", "EventTime")
