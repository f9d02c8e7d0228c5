"""Every query against its SQL in DuckDB, and the rules that SQL doesn't show."""

import os

import duckdb
import pytest

from daftar.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def shown(v):
    if v is None:
        return "null"
    return f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect()) == want


#: Two images whose best thresholds tie, but for the last bits of their variances.
TIED = [
    [125, 133, 129, 132, 131, 122, 125, 130, 122, 127, 129, 134, 127, 128, 137, 132, 124, 126, 131, 126, 129, 131, 131, 130, 131, 125, 121, 128, 130, 128, 127, 128, 126, 128, 131, 130, 125, 127, 130, 125, 129, 126, 126, 130, 124, 126, 124, 125, 127, 123, 130, 128, 132, 127, 131, 132, 126, 129, 125, 128, 128, 132, 131, 122],
    [141, 150, 97, 90, 129, 106, 145, 124, 125, 136, 130, 156, 119, 130, 94, 116, 143, 91, 129, 164, 112, 135, 126, 153, 149, 160, 151, 104, 105, 102, 153, 153, 129, 125, 126, 130, 120, 130, 125, 161, 132, 110, 131, 89, 125, 95, 149, 126, 166, 102, 139, 114, 99, 126, 129, 134, 106, 158, 161, 123, 94, 121, 165, 102],
]


@pytest.mark.parametrize("name", ["count_holes", "otsu_threshold"])
def test_same_rows_as_sql_where_thresholds_tie(spark, tmp_path, name):
    rows = [(i, [(v - 127.5) / 255 for v in px], i) for i, px in enumerate(TIED)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert len(want) == 2 and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
