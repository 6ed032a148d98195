"""Sessions by silence as a stateful stream operator."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Moments as microseconds.
SCHEMA = "visitor string, session_no long, started long, ended long, n_events long"
#: Events of a visitor that are taken together.
EVENTS_AT_ONCE = 10_000


def joined(spans: np.ndarray, gap: int) -> np.ndarray:
    """Rows (start, end, events), united where the silence between them is at most ``gap``."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] - ends[:-1] > gap]))
    return np.stack([spans[first, 0], np.maximum.reduceat(spans[:, 1], first), np.add.reduceat(spans[:, 2], first)], axis=1)


class SilenceSessions(StatefulProcessor):
    """Keeps the open sessions of each visitor, in microseconds, and a timer at the first moment one can close.

    Events may come in any order within the watermark and may unite sessions. A session closes when the watermark is more
    than ``gap`` past its end: whatever could prolong it would be late. Closed sessions are numbered in order of time.

    Most visitors have few events, so the calls to the state store are what takes time: the open sessions lie in one value,
    with the number of those closed, and the timer follows from them and need not be looked up.
    """

    def __init__(self, gap_seconds: int):
        self.gap = int(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "closed long, open binary")

    def _known(self) -> tuple[int, np.ndarray]:
        closed, spans = self.state.get() or (0, b"")
        return closed, np.frombuffer(spans, "<i8").reshape(-1, 3)

    def _timer(self, spans: np.ndarray) -> int | None:
        return int(spans[:, 1].min() + self.gap) // 1000 + 1 if len(spans) else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed, before = self._known()
        spans = before
        while at := [row["at"] for row in islice(rows, EVENTS_AT_ONCE)]:
            moments = np.array(at, np.int64)
            spans = joined(np.concatenate([spans, np.stack([moments, moments, np.ones_like(moments)], axis=1)]), self.gap)
        self.state.update((closed, spans.astype("<i8").tobytes()))
        old, new = self._timer(before), self._timer(spans)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        closed, spans = self._known()
        over = now - spans[:, 1] > self.gap
        ready, spans = spans[over], spans[~over]
        self.state.update((closed + len(ready), spans.tobytes()))
        if len(spans):
            self.handle.registerTimer(self._timer(spans))
        for number, (start, end, n) in enumerate(ready.tolist(), closed + 1):
            yield Row(visitor=key[0], session_no=number, started=start, ended=end, n_events=n)

    def close(self) -> None:
        pass
