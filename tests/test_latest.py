import shutil

import pytest

from lexiforge.streaming import keystrokes, latest

SCHEMA = "k string, seq bigint, v string"
BATCHES = [
    [("a", 1, "a1"), ("a", 3, "a3"), ("b", 5, "b5"), (None, 1, "n1"), ("c", None, "none")],
    [("a", 2, "stale"), ("b", 4, "stale"), ("c", 1, "c1"), ("a", 3, "a3")],
    [("a", 9, "a9"), ("b", 5, "b5"), (None, 2, None)],
]


@pytest.fixture
def stream(spark, tmp_path):
    before = {name: spark.conf.get(name) for name in latest.SETTINGS}
    for name, value in latest.SETTINGS.items():
        spark.conf.set(name, value)

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(**more):
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = latest.publish(latest.newest(events, "k", "seq", "v", **more), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
        assert q.awaitTermination(60)

    yield add, run
    for name, value in before.items():
        spark.conf.set(name, value)


def stands(spark, folder):
    return sorted(map(tuple, latest.published(spark, str(folder), "k", "seq", "v").collect()), key=str)


def test_stale_rows_are_dropped_over_restarts(spark, stream, tmp_path):
    add, run = stream
    for rows in BATCHES:
        add(rows)
        run()
    written = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "seq", "v").collect()]
    assert sorted(written, key=str) == sorted([("a", 3, "a3"), ("b", 5, "b5"), (None, 1, "n1"), ("c", 1, "c1"), ("a", 9, "a9"), (None, 2, None)], key=str)
    batch = keystrokes.latest(spark.createDataFrame([r for rows in BATCHES for r in rows if r[1] is not None], SCHEMA), "k", "seq", "v")
    assert stands(spark, tmp_path / "out") == sorted(map(tuple, batch.collect()), key=str)


def test_a_batch_that_was_not_committed_runs_again_once(spark, stream, tmp_path):
    add, run = stream
    for rows in BATCHES[:2]:
        add(rows)
        run()
    before = stands(spark, tmp_path / "out")
    n = spark.read.parquet(str(tmp_path / "out")).count()
    # As after a failure between the sink's write and the commit of the batch.
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "epoch=1")
    run()
    assert stands(spark, tmp_path / "out") == before and spark.read.parquet(str(tmp_path / "out")).count() == n


def test_what_stands_survives_expired_state(spark, stream, tmp_path):
    add, run = stream
    add([("a", 5, "new")])
    run(idle_ms=1)
    add([("a", 4, "stale")])
    run(idle_ms=1)
    assert stands(spark, tmp_path / "out") == [("a", 5, "new")]
