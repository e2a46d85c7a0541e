import pytest
from pyspark.sql import types as T

from loomquery.catalog import Catalog, CatalogError
from loomquery.engine import Engine
from loomquery.operators.snapshots import SnapshotStore, WriteConflict
from loomquery.sources import text_files
from loomquery.streaming import requests as streams


@pytest.fixture
def engine(spark, tmp_path):
    catalog = Catalog(spark)
    path = tmp_path / "seats.txt"
    path.write_text("# booking\nTABLE|seats|id:INT|flight:INT|seat:STRING|status:STRING\n\nseats|1|7|1A|open\nseats|2|7|1B|open\nseats|3|8|1A|held\n")
    text_files.read_tables(spark, str(path), catalog)
    return Engine(spark, catalog, SnapshotStore(spark, f"file://{tmp_path}/store"))


def seats(engine):
    return sorted(tuple(r) for r in engine.execute("{*} FROM seats").rows.collect())


def test_changes_make_snapshots(engine):
    assert engine.execute("UPDATE seats SET status = held WHERE seat = 1A").count == 2
    assert engine.execute("INSERT INTO seats VALUES (4, 8, 1B, open)").count == 1
    assert engine.execute("INSERT seats|5|8|1C|two words").count == 1
    assert engine.execute("DELETE FROM seats WHERE id = 2").count == 1
    assert seats(engine) == [(1, 7, "1A", "held"), (3, 8, "1A", "held"), (4, 8, "1B", "open"), (5, 8, "1C", "two words")]
    assert engine.store.current("seats") == 5
    assert engine.store.read("seats", 1).count() == 3


def test_transactions_and_savepoints(engine):
    before = seats(engine)
    engine.execute("BEGIN; DELETE FROM seats WHERE id = 1; SAVEPOINT s; DELETE FROM seats WHERE id = 2")
    assert len(seats(engine)) == 1
    engine.execute("ROLLBACK TO s")
    assert len(seats(engine)) == 2
    engine.execute("ABORT")
    assert seats(engine) == before
    engine.execute("BEGIN; UPDATE seats SET status = sold, flight = 9 WHERE id = 1; COMMIT; CHECKPOINT; IMAGE COPY")
    assert seats(engine)[0] == (1, 9, "1A", "sold")
    with pytest.raises(CatalogError):
        engine.execute("COMMIT")
    with pytest.raises(ValueError):
        engine.execute("BEGIN; ROLLBACK TO nowhere")


def test_lost_updates_are_refused(engine, spark):
    other = Engine(spark, engine.catalog, engine.store)
    engine.execute("UPDATE seats SET status = open WHERE id = 3")
    engine.execute("BEGIN; UPDATE seats SET status = sold WHERE id = 1")
    other.execute("DELETE FROM seats WHERE id = 2")
    with pytest.raises(WriteConflict):
        engine.execute("COMMIT")
    assert engine.store.read("seats").count() == 2 and engine.store.read("seats").filter("status = 'sold'").isEmpty()


def test_image_copy_is_restored(engine):
    before = seats(engine)
    engine.execute("IMAGE COPY; DELETE FROM seats WHERE id = 1; UPDATE seats SET status = gone WHERE id = 2")
    assert seats(engine) != before
    assert engine.restore_image() == ["seats"] and seats(engine) == before
    engine.execute("INSERT INTO seats VALUES (4, 8, 'x;y', open)")
    assert (4, 8, "x;y", "open") in seats(engine)


def test_explain_analyze_and_sample(engine):
    engine.execute("ANALYZE seats")
    lines = engine.execute("EXPLAIN PROJECT {a.id} FROM seats AS a JOIN seats AS b ON {a.flight} = {b.flight} WHERE {b.status} = held").lines
    assert [x.strip().split()[0] for x in lines] == ["Join", "Scan", "Scan"]
    count, some = engine.execute("PROJECT {a.id}, {b.id} FROM seats AS a JOIN seats AS b ON {a.flight} = {b.flight}").sample(2)
    assert count == 5 and len(some) == 2
    total = engine.execute("PROJECT SUM{id} FROM seats GROUP BY {flight}").rows.collect()
    assert sorted(tuple(r) for r in total) == [(7, 3), (8, 3)]


def test_faults(engine):
    for text in ("INSERT INTO seats VALUES (1, 2)", "INSERT INTO seats VALUES (x, 8, 1B, open)", "UPDATE seats SET nothing = 1 WHERE id = 1", "DELETE FROM nothing WHERE id = 1"):
        with pytest.raises(CatalogError):
            engine.execute(text)
    with pytest.raises(CatalogError):
        engine.catalog.create("seats", [("id", "INT")])
    with pytest.raises(CatalogError):
        engine.catalog.create("other", [("id", "BLOB")])


def test_text_files(spark, tmp_path):
    path = tmp_path / "pairs.txt"
    path.write_text("1 20\n  2\t30 \n\n")
    assert sorted(tuple(r) for r in text_files.read_pairs(spark, str(path)).collect()) == [(1, 20), (2, 30)]
    path.write_text("one doc\n\nother doc\n")
    assert [r["text"] for r in text_files.read_documents(spark, str(path)).orderBy("doc_id").collect()] == ["one doc", "", "other doc"]
    catalog = Catalog(spark)
    catalog.create("t", [("id", "INT"), ("name", "STRING")])
    path.write_text("t|1|a\nt|2\n")
    with pytest.raises(CatalogError):
        text_files.read_tables(spark, str(path), catalog)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    text_files.write_tables(df, "t", str(tmp_path / "out"))
    again = Catalog(spark)
    again.create("t", [("id", "INT"), ("name", "STRING")])
    assert text_files.read_tables(spark, str(tmp_path / "out"), again) == ["t"]
    assert sorted(tuple(r) for r in again.table("t").rows().collect()) == [(1, "a"), (2, "unknown")]
    text_files.write_columns(df, str(tmp_path / "columns"))
    assert spark.read.parquet(str(tmp_path / "columns")).count() == 2


def test_streamed_requests_pass_once(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.union(events.limit(200)).repartition(3).write.parquet(folder)
    stream = streams.read_events(spark, folder, T.StructType(events.schema.fields))
    streams.run_to_end(streams.first_requests(stream, ["event_id"], "ts", "3650 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.count() and got.select("event_id").distinct().count() == events.count()
