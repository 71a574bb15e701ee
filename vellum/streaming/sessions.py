"""Login sessions as a stream: one live session a user, under either of two policies.

The state of a user is the live session and when it began; it is removed when the
session expires, by an event-time timer. The batch twins are ``single_sessions``
and ``blocked_logins`` of ``operators.accounts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A new login ends the live session, or is refused while there is one.
REPLACE, BLOCK = "replace", "block"
_OUT = "user_id long, session long, outcome string, by long, ts timestamp"
_NAMES = ["user_id", "session", "outcome", "by", "ts"]


class LiveSession(StatefulProcessor):
    """Outcomes of a user's sessions: ``accepted``, ``refused``, ``ended`` (by the next one) and ``expired``."""

    def __init__(self, policy: str, seconds: int):
        self.policy, self.micros = policy, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "session long, at long")

    def _begin(self, session: int, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.live.update((session, at))
        self.handle.registerTimer((at + self.micros) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out = []
        logins = sorted((int(ts.value // 1000), int(s)) for b in rows for s, ts in zip(b["session"], b["ts"], strict=True))
        for at, session in logins:
            old = self.live.get() if self.live.exists() else None
            if old and at - old[1] >= self.micros:  # its timer has yet to come
                out.append((key[0], old[0], "expired", None, old[1] + self.micros))
                old = None
            if old and self.policy == BLOCK:
                out.append((key[0], session, "refused", old[0], at))
                continue
            if old:
                out.append((key[0], old[0], "ended", session, at))
            out.append((key[0], session, "accepted", None, at))
            self._begin(session, at)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out = []
        if self.live.exists():
            session, at = self.live.get()
            if (at + self.micros) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], session, "expired", None, at + self.micros))
                self.live.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES).astype({"user_id": "int64", "session": "int64", "by": "Int64"})
    out["ts"] = pd.to_datetime(out["ts"], unit="us")
    return out


def live_sessions(logins: DataFrame, policy: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """``user_id, session, outcome, by, ts`` of ``logins(user_id, session, ts)``; a session lives for ``seconds`` unless it is ended.

    ``by`` is the session that ended one, or that one was refused for. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    if policy not in (REPLACE, BLOCK):
        raise ValueError(f"no such policy: {policy}")
    own = logins.withWatermark("ts", late).groupBy("user_id")
    return own.transformWithStateInPandas(LiveSession(policy, seconds), _OUT, "Append", "EventTime")
