"""Date text, selection rules and agreement on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from daftar.functions.text import parse_date, repair_structure
from daftar.operators import consensus as C
from daftar.operators import selection as S

READS = "card_id long, read_id long, year int, month int, day int, formatted string, confidence double, date_prob double, y_min double, roi_w int"


def reads(spark, *rows):
    made = [(1, i, y, 1, 1, f"{y}/01/01", c, 0.9, top, w) for i, (y, c, top, w) in enumerate(rows)]
    return spark.createDataFrame(made, READS)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("۱۳۷۵/۰۵/۱۲", "1375/05/12"), ("١٣٧٥-٥-١٢", "1375/05/12"), ("13750512", "1375/05/12"), ("12.05.1375", "1375/05/12"),
        ("//1375|05|12//", "1375/05/12"), ("1375/5/2 تولد", "1375/05/02"), ("1408/12/30", "1408/12/30"), ("1399/12/30", "1399/12/30"),
        ("1400/12/30", None), ("1375/13/01", None), ("1289/01/01", None), ("1411/01/01", None), ("1375/07/31", None), ("", None), (None, None),
    ],
)
def test_parse(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(parse_date(F.col("raw")).alias("d"), repair_structure(F.col("raw")).alias("s")).first()
    assert (row.d.formatted if row.d else None) == want


def result(spark, *rows, **more):
    return S.finalise(reads(spark, *rows), **more).first()


def test_early_year_beats_a_surer_late_one(spark):
    assert result(spark, (1404, 99.0, 0.5, 200), (1360, 70.0, 0.5, 200)).best == "1360/01/01"


def test_full_strip_beats_a_surer_fragment(spark):
    assert result(spark, (1370, 99.0, 0.5, 100), (1360, 70.0, 0.5, 200)).best == "1360/01/01"


def test_confidence_not_year_decides(spark):
    assert result(spark, (1370, 90.0, 0.5, 200), (1360, 70.0, 0.5, 200)).best == "1370/01/01"


def test_close_upper_row_takes_over_even_if_narrow(spark):
    assert result(spark, (1370, 80.0, 0.5, 200), (1360, 95.0, 0.4, 100)).best == "1360/01/01"
    assert result(spark, (1370, 80.0, 0.5, 200), (1360, 64.0, 0.4, 200)).best == "1370/01/01"


def test_lone_late_row_is_expiry_not_birth(spark):
    r = result(spark, (1405, 90.0, 0.8, 200))
    assert (r.best, r.birth, r.expiry, r.method) == (None, None, "1405/01/01", "single-expiry")
    r = result(spark, (1405, 90.0, 0.8, 200), tight=F.lit(True))
    assert (r.best, r.birth, r.expiry, r.method) == ("1405/01/01", None, "1405/01/01", "single-crop")


def test_fields_and_swap(spark):
    r = result(spark, (1360, 90.0, 0.8, 200), (1402, 80.0, 0.3, 200))
    assert (r.birth, r.expiry, r.swapped, r.method) == ("1360/01/01", "1360/01/01", False, "y-sort")
    r = result(spark, (1360, 90.0, 0.3, 200), (1402, 80.0, 0.8, 200))
    assert (r.birth, r.expiry, r.swapped) == ("1360/01/01", "1402/01/01", False)


def test_votes_keep_the_first_of_equal_reads(spark):
    v = S.vote(reads(spark, (1360, 70.0, 0.5, 200), (1360, 70.0, 0.6, 300), (1360, 60.0, 0.1, 150))).first()
    assert (v.votes, v.y_min, v.total_confidence) == (3, 0.5, 200.0)


def test_lower_rows_are_suppressed(spark):
    kept = S.suppress_lower_rows(reads(spark, (1360, 70.0, 0.5, 200), (1402, 70.0, 0.52, 200), (1403, 70.0, 0.53, 200)))
    assert {r.year for r in kept.collect()} == {1360, 1402}



FRAMES = "session long, frame long, formatted string, confidence double"


def test_first_agreement_and_ties(spark):
    f = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (1, 3, None, 3.0), (1, 4, "b", 4.0), (1, 5, "a", 5.0), (2, 1, "a", 1.0)], FRAMES)
    assert {(r.session, r.frame, r.agreed) for r in C.first_agreement(f).collect()} == {(1, 4, "b")}
    assert {(r.session, r.formatted, r.agreed) for r in C.status(f).collect()} == {(1, "a", "a"), (2, "a", None)}
    assert {(r.session, r.agreed, r.error) for r in C.consensus_result(f).collect()} == {(1, "b", None), (2, None, "no agreement")}


def test_stream_agrees_with_batch(spark, tmp_path):
    from daftar.streaming.consensus import consensus_stream

    rows = [(1, 1, "a", 1.0), (1, 2, "b", 2.0), (1, 4, "b", 4.0), (2, 1, None, 1.0), (1, 5, "a", 5.0)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = consensus_stream(stream).writeStream.format("memory").queryName("agreed").outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select session, max_by(agreed, frame) as agreed, max_by(formatted, frame) as formatted from agreed group by session")
    batch = C.status(spark.createDataFrame(rows, FRAMES))
    assert {(r.session, r.formatted) for r in last.collect() if r.formatted} == {(r.session, r.formatted) for r in batch.collect()}
    assert {(r.session, r.agreed) for r in last.collect() if r.agreed} == {(1, "b")}
