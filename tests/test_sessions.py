"""Sessions as a stream with state: order, restarts, hot sessions, timers and marks."""

import os
import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row

from daftar.operators import consensus as C
from daftar.stages import settings
from daftar.streaming import live, sessions

SCHEMA = "session long, frame long, formatted string, confidence double"


@pytest.fixture(autouse=True)
def store(spark):
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": sessions.ROCKS}):
        yield


def _drop(spark, rows, folder, n):
    """The rows as the n-th file of a folder, later than the files before it."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{n:03}.parquet"
    pd.DataFrame(rows, columns=["session", "frame", "formatted", "confidence"]).astype({"formatted": "object", "confidence": "float64"}).to_parquet(path)
    os.utime(path, (1_000_000_000 + n, 1_000_000_000 + n))


def _start(spark, at, one=None, processor=None, trigger=None, **times):
    frames = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    if processor is None:
        ended = sessions.sessions(frames, **times)
    else:
        ended = frames.groupBy("session").transformWithStateInPandas(processor, sessions.OUT, "append", "none")
    out = ended.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state")
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    return out.foreachBatch(one or write).trigger(**(trigger or {"availableNow": True})).start()


def _found(spark, at):
    return sorted(tuple(r) for r in live.session_results(live.results(spark, f"{at}/out", sessions.OUT), sessions.open_sessions(spark, f"{at}/state")).collect())


def _rows(rng, n=300):
    dates = [None, "1375/01/01", "1376/02/02", "1377/03/03", "1378/04/04", "1379/05/05"]
    return [(rng.randrange(25), i, rng.choice(dates), rng.choice([None, 70.0])) for i in range(n)]


def test_batches_equal_the_batch_query_and_survive_a_crash(spark, tmp_path):
    rows = _rows(random.Random(1))
    for n in range(6):
        part = rows[n * 50 : n * 50 + 50]
        random.Random(n).shuffle(part)
        _drop(spark, part, f"{tmp_path}/in", n)

    def crash(found, n):
        found.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        if n == 3:
            raise RuntimeError("cut off after writing")

    with pytest.raises(Exception, match="cut off"):
        _start(spark, tmp_path, crash).awaitTermination()
    _start(spark, tmp_path).awaitTermination()
    want = sorted(tuple(r) for r in C.consensus_result(spark.createDataFrame(rows, SCHEMA)).collect())
    assert _found(spark, tmp_path) == want
    again = live.results(spark, f"{tmp_path}/out", sessions.OUT).groupBy("session").count().where("count > 1")
    assert again.count() == 0  # a session is told once, also with frames after its end


def _watched():
    """Agreement that fails if it is ever given many frames at once; made here so that workers get it whole."""

    class Watched(sessions.Agreement):
        def handleInputRows(self, key, rows, timerValues):
            def parts():
                for part in rows:
                    assert len(part) <= 20_000
                    yield part

            yield from super().handleInputRows(key, parts(), timerValues)

    return Watched(2, None, None)


def test_a_session_of_a_million_frames_comes_in_parts(spark, tmp_path):
    n = 1_000_000
    frame = "case when id = 0 or id % 2 = 1 then null else concat('1', 300 + id % 90, '/01/01') end"
    hot = spark.range(n).selectExpr("7L as session", "id as frame", f"if(id < {n} - 4, null, {frame}) as formatted", "80.0D as confidence")
    same = hot.selectExpr("8L as session", "frame", f"if(frame in (17, {n} - 3), '1380/01/01', null) as formatted", "confidence")
    hot.union(same).coalesce(1).write.parquet(f"{tmp_path}/in")
    _start(spark, tmp_path, processor=_watched()).awaitTermination()
    assert _found(spark, tmp_path) == [(7, n - 1, None, "no agreement"), (8, n - 3, "1380/01/01", None)]


class _State:
    """A state variable that counts the calls made to it, each of which is a round trip to the JVM."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def _call(self, out=None):
        self.calls.append(out)
        return out

    def exists(self):
        return self._call(bool(self.held))

    def get(self):
        return self._call(self.held.get(()))

    def update(self, v):
        self._call(self.held.update({(): v}))

    def containsKey(self, k):
        return self._call(k in self.held)

    def getValue(self, k):
        return self._call(self.held[k])

    def updateValue(self, k, v):
        self._call(self.held.update({k: v}))

    def clear(self):
        self._call(self.held.clear())


def test_a_session_makes_few_calls_to_its_state():
    calls, one = [], sessions.Agreement(2, None, None)
    one.votes, one.last, one.ended = _State(calls), _State(calls), _State(calls)

    def feed(*rows):
        calls.clear()
        parts = [pd.DataFrame([r], columns=["frame", "formatted", "confidence"]).astype({"formatted": "object", "confidence": "float64"}) for r in rows]
        return [tuple(r) for out in one.handleInputRows((1,), iter(parts), None) for r in out[["frame", "agreed"]].to_numpy()], len(calls)

    assert feed((4, "1375/01/01", 70.0), (3, None, 70.0), (5, "1376/01/01", None)) == ([], 5)
    assert one.last.held == {(): (5,)} and one.votes.held == {("1375/01/01",): (1, 70.0, 4), ("1376/01/01",): (1, 0.0, 5)}
    assert feed((9, "1376/01/01", 70.0))[0] == [(9, "1376/01/01")] and not one.votes.held and not one.last.held
    assert feed((10, "1376/01/01", 70.0), (11, "1376/01/01", 70.0)) == ([], 1)
    one.ended.held.clear()
    assert feed((7, "1375/01/01", 70.0), (6, "1376/01/01", 70.0), (8, "1375/01/01", 70.0)) == ([(8, "1375/01/01")], 3)


def _stateless(kind, required):
    one = kind(required, None, None)
    one.votes, one.last, one.ended = _State([]), _State([]), _State([])
    return one


def test_a_session_is_one_row_of_tallies(monkeypatch):
    """However many its frames are; and tallies end it as its frames would, in one part or in several, batch by batch."""
    rng, kinds = random.Random(5), {"session": "Int64", "frame": "int64", "formatted": "object", "confidence": "float64"}
    dates = [None, "1375/01/01", "1376/02/02", "1377/03/03", "1378/04/04"]
    table = lambda rows: pa.Table.from_pandas(pd.DataFrame(rows, columns=list(kinds)).astype(kinds), preserve_index=False)
    for required in (1, 2, 3, 40):
        batches = [[(rng.choice([None, *range(9)]), 1000 * n + rng.randrange(900), rng.choice(dates), rng.choice([None, 70.0, 0.5])) for _ in range(60)] for n in range(4)]
        whole = list(sessions.tallies(required)(iter(table(batches[0]).to_batches(7))))
        assert [b.num_rows for b in whole] == [len({r[0] for r in batches[0]})]
        monkeypatch.setattr(sessions, "TALLIED", 25)
        for session in (None, *range(9)):
            framed, tallied, parted = (_stateless(k, required) for k in (sessions.Agreement, sessions.TalliedAgreement, sessions.TalliedAgreement))
            for rows in batches:
                own = [r for r in rows if r[0] == session]
                if not own:
                    continue
                want = [tuple(r) for out in framed.handleInputRows((session,), iter([pd.DataFrame(own, columns=list(kinds)).astype(kinds)]), None) for r in out.astype(object).to_numpy()]
                for one, told in ((tallied, [sessions.tally(table(rows), required)]), (parted, sessions.tallies(required)(iter(table(rows).to_batches(7))))):
                    given = [Row(**r) for b in told for r in b.to_pylist() if r["session"] == session]
                    assert [tuple(r) for r in one.handleInputRows((session,), iter(given), None)] == want
                    assert one.votes.held == framed.votes.held and one.last.held == framed.last.held and one.ended.held == framed.ended.held
        monkeypatch.undo()
    with pytest.raises(ValueError, match="no number"):
        sessions.tally(pa.table({"session": [1], "frame": pa.array([None], pa.int64()), "formatted": ["1375/01/01"], "confidence": [1.0]}), 2)


def _wait(ready, seconds=60):
    until = time.time() + seconds
    while not ready():
        assert time.time() < until, "it didn't come"
        time.sleep(0.5)


def test_idle_sessions_end_and_marks_expire(spark, tmp_path):
    seen = []
    _drop(spark, [(1, 0, "1375/01/01", 70.0), (1, 1, "1376/01/01", 70.0), (1, 2, "1376/01/02", None), (2, 0, "1380/01/01", 70.0), (2, 1, "1380/01/01", 70.0)], f"{tmp_path}/in", 0)
    job = _start(spark, tmp_path, lambda rows, n: seen.extend(rows.collect()), trigger={"processingTime": "500 milliseconds"}, idle_ms=1500, mark_ms=6000)
    try:
        _wait(lambda: len(seen) == 2)
        _drop(spark, [(2, 5, "1381/01/01", 70.0), (2, 6, "1381/01/01", 70.0)], f"{tmp_path}/in", 1)
        _wait(lambda: job.lastProgress and sum(p.numInputRows for p in job.recentProgress) >= 7)
        assert len(seen) == 2  # the mark still stands
        time.sleep(8)
        _drop(spark, [(2, 9, "1382/01/01", 70.0), (2, 8, "1382/01/01", 70.0)], f"{tmp_path}/in", 2)
        _wait(lambda: len(seen) == 3)
    finally:
        job.stop()
    told = {(r.session, r.frame): (r.agreed, r.error, r.leading, r["count"]) for r in seen}
    assert told == {(2, 1): ("1380/01/01", None, "1380/01/01", 2), (1, 2): (None, "no agreement", "1375/01/01", 1), (2, 9): ("1382/01/01", None, "1382/01/01", 2)}
