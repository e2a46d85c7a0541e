import duckdb
import pandas
import pytest

from loomquery.queries import ORACLE_SQL, QUERIES, TABLES


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pandas.isna(v) else round(v, 6) if isinstance(v, float) else v for v in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_matches_its_sql(spark, sf_dir, db, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize(("name", "keys"), [("sort_single", ["s_acctbal", "s_suppkey"]), ("sort_multi", ["p_brand", "p_size", "p_partkey"])])
def test_sorted_results_are_in_order(spark, sf_dir, name, keys):
    rows = [tuple(r[k] for k in keys) for r in QUERIES[name](spark, sf_dir).collect()]
    assert rows == sorted(rows) and len(rows) > 5
