"""Screening and escalation of streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.schema import WEIGHTS
from ..operators.session import HISTORY, LEAST, WINDOW
from ..operators.verdict import Screening


def verdicts(turns: DataFrame, screening: Screening, text: str = "text") -> DataFrame:
    """The verdict of each row of a stream: the batch plan as it is, without state."""
    return screening.run(turns, text).select(*turns.columns, "blocked", "severity", "block_detector")


def score(recent: list[tuple[int, int]], length: int) -> float:
    """Escalation of the last turns (blocked, weight), as ``session.escalation``."""
    if length < LEAST:
        return 0.0
    mid = len(recent) // 2
    halves = recent[:mid], recent[mid:]
    (b1, b2), (s1, s2) = ([f(h) for h in halves] for f in (lambda h: sum(x[0] for x in h), lambda h: max([0, *(x[1] for x in h)])))
    out = 0.7 * max(0, b2 - b1) / max(1, b1 + b2) + 0.3 * max(0, s2 - s1) / 10
    if len(halves[1]) > 1 and b2 / len(halves[1]) > 0.7 and b1 == 0:
        out = min(1.0, out + 0.3)
    return min(1.0, max(0.0, out))


def escalations(screened: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, turn, escalation) of a screened stream (session, turn, blocked, severity).

    State holds the last turns of each session. Turns of one trigger are put in order; a turn at or
    before the last one seen is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, blocked, weights = state.get if state.exists else (None, 0, [], [])
        recent: deque = deque(zip(blocked, weights, strict=True), WINDOW)
        rows = []
        for r in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            turn = int(getattr(r, order))
            if last is not None and turn <= last:
                continue
            last, count = turn, min(count + 1, HISTORY)
            recent.append((int(r.blocked), WEIGHTS.get(r.severity, 0)))
            rows.append((key[0], turn, score(list(recent), count)))
        state.update((last, count, [x[0] for x in recent], [x[1] for x in recent]))
        if rows:
            yield pd.DataFrame(rows, columns=[session, order, "escalation"])

    return screened.groupBy(session).applyInPandasWithState(step, f"{session} long, {order} long, escalation double", "last long, count int, blocked array<int>, weights array<int>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there now, into a Parquet table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
