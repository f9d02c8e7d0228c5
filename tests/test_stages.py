"""Tables between jobs: where they go, and that they go away."""

from types import SimpleNamespace

import pytest

from daftar.stages import Scratch, settings, shared_dir


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="share"):
        shared_dir(session)


def test_tables_are_read_back_and_dropped(spark):
    scratch = Scratch(spark, "test")
    first, second = scratch.write(spark.range(5)), scratch.write(spark.range(3).repartition(2), 2)
    assert (first.count(), second.count()) == (5, 3)
    scratch.drop_all_but(second)
    assert second.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.root}/1").count()


def test_settings_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with settings(spark, {key: "7"}):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before


def test_large_rows_are_written_and_read_few_at_once(spark):
    """Parquet's reader takes thousands of rows of a row group at once, which for cards were gigabytes."""
    import glob

    import pyarrow.parquet as pq

    table = Scratch(spark, "large").write(spark.range(0, 100, 1, 2).selectExpr("id", "repeat('x', 1000) AS px"), 16, 16)
    sizes = [f.row_group(i).num_rows for path in glob.glob(f"{table._daftar_path}/*.parquet") for f in [pq.ParquetFile(path).metadata] for i in range(f.num_row_groups)]
    assert sum(sizes) == 100 and max(sizes) <= 16
    assert sorted(r.id for r in table.collect()) == list(range(100))
