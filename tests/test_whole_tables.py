"""Registered queries over whole tables against DuckDB, and joins of operators
on hot keys."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import batch, resolve
from tidemark.plans import catalogue, store_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n[:3] in ("q05", "q06", "q22", "q28", "q43", "q46") or n[1:3] >= "51"])
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("customer", "events", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert set(got.columns) == set(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_store_queries_are_registered():
    assert store_queries.query is catalogue.query and "q51_store_bulk_write" in entry.queries()


def test_as_of_join_on_a_hot_key(spark):
    step = 1 << 18  # several chunks of sequence numbers
    versions = [("hot", s * step, int(s % 7 != 0), f"v{s}") for s in range(1, 60)] + [("b", 5, 1, "x")]
    probes = [(k, at, p) for p, (k, at) in enumerate([*(("hot", s * step // 3) for s in range(200)), ("b", 4), ("b", 5), ("none", 9)])]
    got = resolve.as_of_join(spark.createDataFrame(versions, "key string, seq long, op int, value string"), spark.createDataFrame(probes, "key string, snapshot long, probe long"))
    rows = {r.probe: (r.value, r.seq) for r in got.collect()}
    for key, at, probe in probes:
        last = max((v[1:] for v in versions if v[0] == key and v[1] <= at), default=(0, 0, None))
        assert rows[probe] == ((last[2], last[0]) if last[1] else (None, None))


def test_append_shifts_by_each_pair(spark):
    schema = "pair long, ord long"
    got = batch.append(spark.createDataFrame([(0, 0), (0, 1), (1, 0)], schema), spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 0)], schema), "pair")
    assert sorted(map(tuple, got.collect())) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]
