"""Sessions of frames that end when they agree, as a stream with state.

State of an open session is a map from each date seen to its votes, so it grows with the dates of the calendar and not
with the frames, and one date's votes are read and written without the others.  Frames of a batch come in parts; of each date only a
count, a sum and the few first frames are kept, so a session of any length needs little memory and its frames no sort.  Batches
count in the order in which they come, frames of one batch in the order of ``frame``.

A session that agrees is told at once and its votes go; a mark stays so that late frames don't open it again, and the
mark has a time to live.  A timer, set anew by every batch of the session, ends one that has been idle: it is told with an error.
The timer and the time to live are additions of ours; without ``idle_ms`` a session waits for ever.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daftar.config import DEFAULT

OUT = "session long, frame long, agreed string, error string, leading string, count long"
NAMES = [c.split()[0] for c in OUT.split(", ")]
VOTES = "count long, total double, first long"
TALLIES = "session long, last long, votes array<struct<formatted:string,count:long,total:double,frames:array<long>>>"
#: Frames that a task tallies at once; a session is in few of the rows made of its task's frames.
TALLIED = 500_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = "no agreement"


class Agreement(StatefulProcessor):
    """Votes of one session, given its frames in pandas; see the module."""

    def __init__(self, required: int, idle_ms: int | None, mark_ms: int | None):
        self.required, self.idle_ms, self.mark_ms = required, idle_ms, mark_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.votes = handle.getMapState("votes", "formatted string", VOTES)
        self.last = handle.getValueState("last", "frame long")
        self.ended = handle.getValueState("ended", "frame long", self.mark_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = self.ended.exists()
        seen: dict[str, list] = {}  # count, sum of confidence, the first frames
        old_last = None if ended else self.last.get()
        last = old_last[0] if old_last else None
        for part in rows:
            if ended:
                continue
            top, votes = self._read(part)
            last = top if last is None else max(last, top)
            for date, own in votes.items():
                vote = seen.setdefault(date, [0, 0.0, []])
                vote[0] += own[0]
                vote[1] += own[1]
                vote[2] = heapq.nsmallest(self.required, [*vote[2], *own[2]])
        if ended:
            return
        stored = old_last is not None and self.votes.exists()  # a session without a last frame has no votes
        agreed: tuple[int, str] | None = None
        for date, vote in seen.items():
            old = self.votes.getValue((date,)) if stored and self.votes.containsKey((date,)) else (0, 0.0, None)
            due = self.required - old[0]
            if vote[0] >= due:
                agreed = min(agreed, (vote[2][due - 1], date)) if agreed else (vote[2][due - 1], date)
            vote[:] = [old[0] + vote[0], old[1] + vote[1], vote[2][0] if old[2] is None else old[2]]
        if agreed:
            yield self._said(key[0], agreed[0], agreed[1], None, agreed[1], self.required)
            self._end(agreed[0], old_last is not None)
            return
        for date, vote in seen.items():
            self.votes.updateValue((date,), tuple(vote))
        self.last.update((last,))
        if self.idle_ms is not None:
            self._drop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        best = max(((v[0], -v[2], d[0], v) for d, v in self.votes.iterator()), default=None) if self.votes.exists() else None
        last = self.last.get()[0]
        yield self._said(key[0], last, None, NONE, best[2] if best else None, best[0] if best else 0)
        self._end(last)

    def _read(self, part: pd.DataFrame) -> tuple[int, dict[str, tuple[int, float, list[int]]]]:
        """The last frame of a part and its votes."""
        return int(part.frame.max()), self._votes(part)

    def _said(self, *values):
        """A row of ``OUT``."""
        return pd.DataFrame([values], columns=NAMES)

    def _votes(self, part: pd.DataFrame) -> dict[str, tuple[int, float, list[int]]]:
        """Of each date of a part its count, its sum of confidence and its first frames; most sessions are a few rows, so plain loops."""
        by: dict[str, tuple[list[int], list[float]]] = {}
        for date, frame, sure in zip(part.formatted.tolist(), part.frame.tolist(), part.confidence.tolist(), strict=True):
            if isinstance(date, str):
                frames, confidences = by.setdefault(date, ([], []))
                frames.append(int(frame))
                confidences.append(sure if sure is not None and sure == sure else 0.0)
        return {date: (len(frames), float(sum(confidences)), heapq.nsmallest(self.required, frames)) for date, (frames, confidences) in by.items()}

    def _end(self, frame: int, stored: bool = True) -> None:
        """The votes go, if any were stored, and a mark stays."""
        if stored:
            self.votes.clear()
            self.last.clear()
        if self.idle_ms is not None:
            self._drop_timers()
        self.ended.update((frame,))

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def close(self) -> None:
        pass


class TalliedAgreement(Agreement):
    """The same, given rows of ``TALLIES``: neither frames nor what is said are tables of pandas, which cost more than the votes."""

    def _read(self, part: Row) -> tuple[int, dict[str, tuple[int, float, list[int]]]]:
        return part.last, {v["formatted"]: (v["count"], v["total"], v["frames"]) for v in part.votes}

    def _said(self, *values):
        return Row(**dict(zip(NAMES, values, strict=True)))


def tally(frames: pa.Table, required: int) -> pa.RecordBatch:
    """A row of ``TALLIES`` for each session of some (session, frame, formatted, confidence)."""
    session, date = (frames[c].combine_chunks().dictionary_encode() for c in ("session", "formatted"))
    s, d = (c.indices.fill_null(-1).to_numpy() for c in (session, date))
    none = np.iinfo(np.int64).min
    frame, sure = frames["frame"].fill_null(none).to_numpy(), frames["confidence"].fill_null(0.0).to_numpy()
    order = np.lexsort((frame, d, s))
    s, d, frame, sure = s[order], d[order], frame[order], np.where(np.isnan(sure), 0.0, sure)[order]
    turn = np.diff(s, prepend=-2) != 0
    first = np.flatnonzero(turn)  # where a session begins, and where a date of one does
    vote = np.flatnonzero(turn | (np.diff(d, prepend=-2) != 0))
    count, total = np.diff(vote, append=len(s)), np.add.reduceat(sure, vote)
    dated = d[vote] >= 0
    vote, count, total = vote[dated], count[dated], total[dated]
    few = np.minimum(count, required)
    ends = np.concatenate([[0], np.cumsum(few)])
    last, firsts = np.maximum.reduceat(frame, first), frame[np.repeat(vote - ends[:-1], few) + np.arange(ends[-1])]
    if none in last or none in firsts:
        raise ValueError("a frame has no number")
    lists = lambda ends, of: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of)
    columns = [date.dictionary.take(pa.array(d[vote])).cast(pa.string()), pa.array(count), pa.array(total), lists(ends, pa.array(firsts))]
    votes = lists([*np.searchsorted(vote, first), len(vote)], pa.StructArray.from_arrays(columns, ["formatted", "count", "total", "frames"]))
    key = session.dictionary.take(pa.array(s[first], mask=s[first] < 0))
    return pa.RecordBatch.from_arrays([key, pa.array(last), votes], ["session", "last", "votes"])


def tallies(required: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``tally`` for ``mapInArrow``, over ``TALLIED`` frames of a task at once, so that a session is in few rows."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TALLIED:
                yield tally(pa.Table.from_batches(held), required)
                held, n = [], 0
        if n:
            yield tally(pa.Table.from_batches(held), required)

    return run


def prepare(spark: SparkSession) -> None:
    """State with maps and timers needs this store; set it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def sessions(frames: DataFrame, required: int = DEFAULT.required_votes, idle_ms: int | None = None, mark_ms: int | None = None) -> DataFrame:
    """A row for each session that ends: the frame at which it agreed and on what, or that it never did.

    ``frames`` is a stream of (session, frame, formatted, confidence).  With ``idle_ms`` or ``mark_ms`` the query runs batches
    as time goes by, so it must be stopped; without them it ends when its input does, if it is triggered so.
    """
    mode = "none" if idle_ms is None and mark_ms is None else "processingTime"
    numbers = (F.col(c).cast(kind).alias(c) for c, kind in (("session", "long"), ("frame", "long"), ("confidence", "double")))
    rows = frames.select("formatted", *numbers).repartition("session").mapInArrow(tallies(required), TALLIES)
    return rows.groupBy("session").transformWithState(TalliedAgreement(required, idle_ms, mark_ms), OUT, "append", mode)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(session, frame)``: sessions that a stopped stream has left open, with their last frame, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return state.select(F.col("key.session").alias("session"), F.col("value.frame").alias("frame"))
