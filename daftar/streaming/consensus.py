"""Agreement of frames as a keyed stateful stream; the same answers as ``operators.consensus``.

State is the votes of a session: a count, a summed confidence and a first frame for each
date, bounded by the dates of the calendar.  A batch's frames are taken in the order of
``frame``.  A frame whose ``reset`` is true clears its session's votes before it counts, if the
stream has that column.  A time-out after which a session's state is dropped is an addition of ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from daftar.config import DEFAULT

OUT = "session long, frame long, formatted string, count long, total_confidence double, agreed string"
STATE = "dates array<string>, counts array<long>, sums array<double>, firsts array<long>, agreed string"


def consensus_stream(frames: DataFrame, required: int = DEFAULT.required_votes, timeout_ms: int | None = None) -> DataFrame:
    """A row for each session in each batch: the leading date so far and the first date that was agreed."""

    has_reset = "reset" in frames.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        dates, counts, sums, firsts, agreed = state.get if state.exists else ([], [], [], [], None)
        votes = {d: [n, s, f] for d, n, s, f in zip(dates, counts, sums, firsts, strict=True)}
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        resets = rows.reset.fillna(False).astype(bool) if has_reset else np.zeros(len(rows), bool)
        for frame, date, confidence, reset in zip(rows.frame, rows.formatted, rows.confidence, resets, strict=True):
            if reset:
                votes, agreed = {}, None
            if date is None or pd.isna(date):
                continue
            vote = votes.setdefault(date, [0, 0.0, int(frame)])
            vote[0] += 1
            vote[1] += 0.0 if pd.isna(confidence) else float(confidence)
            if agreed is None and vote[0] >= required:
                agreed = date
        state.update((list(votes), *([v[i] for v in votes.values()] for i in range(3)), agreed))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        best = max(votes, key=lambda d: (votes[d][0], -votes[d][2]), default=None)
        n, total, _ = votes.get(best, (0, 0.0, 0))
        yield pd.DataFrame({"session": [key[0]], "frame": [int(rows.frame.max())], "formatted": [best], "count": [n], "total_confidence": [total], "agreed": [agreed]})

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("session").applyInPandasWithState(step, OUT, STATE, "update", timeout)
