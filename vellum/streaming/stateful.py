"""Keyed state that expires, as stateful processors with timers.  The batch forms are in ``operators.expiring``.

They need the state store that keeps its rows on disk (``use_store``).  Events carry
microseconds, ``us``, and a number, ``seq``; within a trigger they are put in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.operators.expiring import COOL_SECONDS, RUN
from vellum.sources.files import progress_files

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["us", "seq"])


class Counter(StatefulProcessor):
    """A counter that lives ``seconds`` from its first event on; a timer takes it away when its time is over."""

    def __init__(self, seconds: int):
        self.life = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", "start_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, n = self.state.get() or (None, 0)
        out = []
        for us, seq in _in_order(rows)[["us", "seq"]].itertuples(index=False):
            if start is None or us >= start + self.life:
                start, n = us, 0
                self.handle.registerTimer((start + self.life) // 1000 + 1)
            n += 1
            out.append((key[0], seq, us, start, n))
        self.state.update((int(start), int(n)))
        yield pd.DataFrame(out, columns=["user_id", "seq", "us", "start_us", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.state.get()
        if now and (now[0] + self.life) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame({"user_id": [], "seq": [], "us": [], "start_us": [], "n": []}, dtype="int64")

    def close(self) -> None:
        pass


def expiring_counts(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(user_id, seq, us, start_us, n) of a stream (user_id, ts, seq, us): the count that each event brings its user's counter to."""
    rows = events.select("user_id", "ts", "seq", "us").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Counter(seconds), "user_id long, seq long, us long, start_us long, n long", "Append", "EventTime")


class Breaker(StatefulProcessor):
    """Closed, open or probing.  A timer turns open into probing; the next event then closes the breaker or opens it anew."""

    def __init__(self, run: int, seconds: int):
        self.run, self.cool = run, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "state string, fails int, since_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, fails, since = self.state.get() or ("closed", 0, 0)
        out = []
        for us, seq, ok in _in_order(rows)[["us", "seq", "ok"]].itertuples(index=False):
            if state != "closed" and us < since + self.cool:
                continue  # not let through
            if state == "closed":
                fails = 0 if ok else fails + 1
                change = "opened" if fails == self.run else None
            else:
                change = "recovered" if ok else "reopened"
            if change:
                out.append((*key, seq, us, change))
                state, fails, since = ("closed", 0, 0) if change == "recovered" else ("open", 0, us)
                if state == "open":
                    self.handle.registerTimer(-(-(since + self.cool) // 1000))
        self.state.update((state, int(fails), int(since)))
        yield pd.DataFrame(out, columns=["user_id", "model", "seq", "us", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, fails, since = self.state.get() or ("closed", 0, 0)
        due = state == "open" and -(-(since + self.cool) // 1000) == expiredTimerInfo.getExpiryTimeInMs()
        if due:
            self.state.update(("probing", fails, since))
        yield pd.DataFrame([(*key, -1, since + self.cool, "probing")] if due else [], columns=["user_id", "model", "seq", "us", "change"])

    def close(self) -> None:
        pass


def breakers(events: DataFrame, run: int = RUN, seconds: int = COOL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(user_id, model, seq, us, change) of a stream (user_id, model, ts, seq, us, ok): opened, reopened, recovered, and probing (seq -1) where the time is over before the next event."""
    rows = events.select("user_id", "model", "ts", "seq", "us", "ok").withWatermark("ts", late)
    return rows.groupBy("user_id", "model").transformWithStateInPandas(Breaker(run, seconds), "user_id long, model string, seq long, us long, change string", "Append", "EventTime")


class Latest(StatefulProcessor):
    """Passes a version only if it is newer than all before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "changed_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values("changed_us").drop_duplicates("changed_us", keep="last")
        before = self.newest.get()
        found = found[found["changed_us"] > (before[0] if before else -1)]
        if len(found):
            self.newest.update((int(found["changed_us"].iloc[-1]),))
        yield found[["path", "changed_us", "json"]].tail(1)

    def close(self) -> None:
        pass


VERSIONS = "path string, changed_us long, json string"


def log_versions(spark: SparkSession, workspace: str, log: str) -> None:
    """Appends the progress files of a workspace as they are now to a log of versions, which ``changed_progress`` reads as a stream."""
    now = progress_files(spark, workspace)
    now.select("path", F.unix_micros("changed").alias("changed_us"), "json").write.mode("append").parquet(log)


def changed_progress(spark: SparkSession, log: str) -> DataFrame:
    """(path, changed_us, json) whenever a progress file has changed: per trigger the newest version; the same or an older one gives nothing."""
    seen = spark.readStream.schema(VERSIONS).parquet(log)
    return seen.groupBy("path").transformWithStateInPandas(Latest(), VERSIONS, "Append", "None")
