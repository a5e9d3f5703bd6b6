"""Abuse lockout over an attempt stream.

Rules per user, in time order: while locked every attempt is rejected and not recorded; once the
lock is over the record is cleared; failures older than the window are forgotten; at
``max_attempts`` remembered failures the user is locked and this attempt is rejected even if it
was correct; otherwise a failure is remembered and a success clears the record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textguard.operators.ordered import Running, by_ranges, scan, seconds


@dataclass(frozen=True)
class LockoutRules:
    max_attempts: int = 5
    window_seconds: float = 3600.0
    lockout_seconds: float = 900.0


@dataclass
class UserState:
    failures: list[float]
    locked_until: float | None = None


def step(state: UserState, now: float, ok: bool, rules: LockoutRules) -> str:
    """Advance the state by one attempt; returns accepted, failed or rejected."""
    if state.locked_until is not None:
        if now < state.locked_until:
            return "rejected"
        state.locked_until, state.failures = None, []
    recent = [t for t in state.failures if t > now - rules.window_seconds]
    if len(recent) >= rules.max_attempts:
        state.locked_until, state.failures = now + rules.lockout_seconds, []
        return "rejected"
    if ok:
        state.failures = []
        return "accepted"
    state.failures = [*state.failures, now]
    return "failed"


def lockout(
    attempts: DataFrame,
    rules: LockoutRules = LockoutRules(),
    user: str = "user_id",
    ts: str = "ts",
    ok: str = "ok",
    tie: str = "event_id",
) -> DataFrame:
    """Batch form: (tie, user, ts, ok, outcome).

    A pause as long as the window and the lock forgets everything, so a user's attempts fall into
    independent sessions, which are spread over the cluster. Inside a session attempts stream
    through a fold whose state is a handful of times; no session is held in memory.
    """
    pause = max(rules.window_seconds, rules.lockout_seconds)
    rows = attempts.select(
        F.col(tie).alias("tie"),
        F.col(user).alias("user"),
        F.col(ts).alias("ts"),
        F.col(ok).cast("boolean").alias("ok"),
        seconds(ts).alias("sec"),
    )
    order = ["sec", "tie"]
    rows = scan(by_ranges(rows, order, ["user"]), {"before": Running(F.col("sec"), "last", inclusive=False)}, order, ["user"])
    begins = F.col("before").isNull() | (F.col("sec") - F.col("before") >= pause)
    rows = scan(rows, {"session": Running(F.when(begins, F.col("sec")), "last")}, order, ["user"])
    sessions = rows.repartition("user", "session").sortWithinPartitions("user", "session", "sec", "tie")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, UserState([])
        for batch in batches:
            outcome = []
            for u, s, sec, good in zip(batch["user"], batch["session"], batch["sec"], batch["ok"]):
                if (u, s) != current:
                    current, state = (u, s), UserState([])
                outcome.append(step(state, sec, bool(good), rules))
                state.failures = state.failures[-rules.max_attempts :]
            yield batch[["tie", "user", "ts", "ok"]].assign(outcome=outcome)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = sessions.select("tie", "user", "ts", "ok", "session", "sec").mapInPandas(
        fold, f"tie {types['tie']}, user {types['user']}, ts {types['ts']}, ok boolean, outcome string"
    )
    return out.select(F.col("tie").alias(tie), F.col("user").alias(user), F.col("ts").alias(ts), F.col("ok").alias(ok), "outcome")


class Judge(StatefulProcessor):
    """Keeps a user's attempts until the watermark has passed them, then judges them in the order of (time, id).

    An attempt waits in a map state keyed by time and id; one timer per user stands at its earliest waiting
    attempt. Rows go into the state chunk by chunk, so a user's micro-batch is never together in memory; what a
    timer judges is the attempts of one step of the watermark.
    """

    def __init__(self, rules: LockoutRules, tie_type: str):
        self.rules, self.tie_type = rules, tie_type

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", f"micros long, tie {self.tie_type}, copy int", "ok boolean")
        self.record = handle.getValueState("record", "failures array<double>, locked_until double, last long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for chunk in rows:
            for micros, tie, ok in zip(chunk["micros"].tolist(), chunk["tie"].tolist(), chunk["ok"].tolist()):
                copy = 0
                while self.waiting.containsKey((micros, tie, copy)):  # an equal attempt is an attempt of its own
                    copy += 1
                self.waiting.updateValue((micros, tie, copy), (bool(ok),))
                first = micros if first is None else min(first, micros)
        if first is not None:
            self._wake(first, timerValues)
        yield from ()

    def _wake(self, micros: int, timer_values) -> None:
        """One timer per user, at the earliest attempt that waits; the watermark never goes back."""
        at = max(micros // 1000, timer_values.getCurrentWatermarkInMs()) + 1
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= at:
            return
        for other in timers:
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], None
        for place, value in self.waiting.iterator():
            if place[0] <= passed:
                due.append((place, value[0]))
            else:
                rest = place[0] if rest is None else min(rest, place[0])
        record = self.record.get() if self.record.exists() else None
        state = UserState(list(record[0]), record[1]) if record else UserState([])
        last = record[2] if record else 0
        judged = []
        for place, ok in sorted(due):
            judged.append((place[1], key[0], place[0], ok, step(state, place[0] / 1e6, ok, self.rules)))
            state.failures = state.failures[-self.rules.max_attempts :]
            last = place[0]
            self.waiting.removeKey(place)
        pause = int(max(self.rules.window_seconds, self.rules.lockout_seconds) * 1e6)
        if last + pause <= passed:
            self.record.clear()  # nothing that is remembered can matter any more
        else:
            self.record.update((state.failures, state.locked_until, last))
        following = rest if rest is not None else (last + pause if self.record.exists() else None)
        if following is not None:
            self.handle.registerTimer(max(following // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        if judged:
            yield pd.DataFrame(judged, columns=["tie", "user", "micros", "ok", "outcome"])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lockout_stream(
    attempts: DataFrame,
    rules: LockoutRules = LockoutRules(),
    user: str = "user_id",
    ts: str = "ts",
    ok: str = "ok",
    tie: str = "event_id",
    delay: str = "10 minutes",
) -> DataFrame:
    """Streaming form that gives the batch answer for any arrival order inside the watermark.

    An attempt is judged when the watermark passes it, so its outcome comes ``delay`` behind the stream; attempts
    later than that, or without a time, are dropped. The state is the waiting attempts and a handful of times per user,
    cleared after a pause in event time. The session's state store is set to RocksDB, which this needs.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    moment = F.col(ts).cast("timestamp")
    rows = attempts.select(
        F.col(user).alias("user"), moment.alias("ts"), F.unix_micros(moment).alias("micros"), F.col(ok).cast("boolean").alias("ok"), F.col(tie).alias("tie")
    ).where("ts IS NOT NULL").withWatermark("ts", delay)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.groupBy("user").transformWithStateInPandas(
        Judge(rules, types["tie"]), f"tie {types['tie']}, user {types['user']}, micros long, ok boolean, outcome string", "append", "EventTime"
    )
    return out.select(F.col("tie").alias(tie), F.col("user").alias(user), F.timestamp_micros("micros").alias(ts), F.col("ok").alias(ok), "outcome")
