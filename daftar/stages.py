"""Tables written between jobs, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a folder of our own; on a
    cluster that's an error, as executors wouldn't see such a folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="daftar-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: Bytes of large rows that Python is given at once.  Both processes hold a few copies of a batch, the JVM's outside its heap.
BATCH_BYTES = 8 << 20


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Jobs run inside have these settings of the session; afterwards they are as before."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Scratch:
    """Written tables of one run; ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, batch: int | None = None, group: int | None = None) -> DataFrame:
        """Cut the lineage: write the rows and return a DataFrame that reads them.

        The job's shuffle files go when it ends, as later jobs read the table.  ``batch``: rows that
        Python is given at once, where rows are large, and then no more than ``BATCH_BYTES`` of them (a larger row is a
        batch alone); else the session's settings.  ``group``: rows that are written, and read again, at once, where the written
        rows are large; Parquet's reader would hold some thousands of them.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        if batch is not None:
            values["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
            values["spark.sql.execution.arrow.maxBytesPerBatch"] = str(BATCH_BYTES)
        writer = df.write.option("compression", "zstd")
        if group is not None:
            writer = writer.option("parquet.block.row.count.limit", group).option("parquet.page.row.count.limit", group)
        with settings(self.spark, values):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._daftar_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            self._delete(getattr(t, "_daftar_path", None))

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete every table of the run that isn't among those given."""
        kept = {getattr(t, "_daftar_path", None) for t in tables}
        for i in range(1, self.count + 1):
            if f"{self.root}/{i}" not in kept:
                self._delete(f"{self.root}/{i}")

    def _delete(self, path: str | None) -> None:
        if path:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
