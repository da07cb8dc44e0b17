"""The live state of stages with late, repeated and missing events, and over a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from repograph.operators import runs
from repograph.sources import derived, tables
from repograph.sources.versions import VersionedTable
from repograph.streaming import status
from repograph.streaming.status import follow, watched_stages

EVENTS = "repo_id string, stage string, event string, timestamp timestamp, seq long"
START = datetime(2024, 1, 1, 12)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_stages_stall_end_and_go_on_after_a_restart(spark, tmp_path):
    log, root, checkpoint = str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "c")

    def arrive(*rows):
        tables.append_events(spark.createDataFrame([("r", s, f"stage_{e}", at(m), q) for s, e, m, q in rows], EVENTS).coalesce(1), log)
        follow(watched_stages(spark, log, timedelta(hours=1)), root, checkpoint).awaitTermination()
        return {r.stage: (r.status, r.at) for r in VersionedTable(spark, root).read().collect()}

    assert arrive(("a", "started", 0, 1), ("b", "started", 5, 2)) == {"a": ("started", at(0)), "b": ("started", at(5))}
    # Out of order, and the same event again: the newest by time and number counts.
    assert arrive(("a", "completed", 9, 5), ("a", "started", 2, 3), ("b", "started", 5, 2))["a"] == ("completed", at(9))
    versions = VersionedTable(spark, root).versions()
    # Another query goes on from the checkpoint; nothing new changes nothing.
    follow(watched_stages(spark, log, timedelta(hours=1)), root, checkpoint).awaitTermination()
    assert {r.stage for r in VersionedTable(spark, root).read().where("status = 'completed'").collect()} == {"a"} and len(VersionedTable(spark, root).versions()) <= len(versions) + 1
    # Event time goes on: b has been silent for more than an hour.
    arrive(("c", "started", 90, 9))
    found = arrive(("c", "failed", 95, 10))
    assert found == {"a": ("completed", at(9)), "b": ("stalled", at(5)), "c": ("failed", at(95))}
    # An event from before the watermark is left out; b takes up its work later.
    found = arrive(("a", "failed", 1, 99), ("b", "completed", 96, 11))
    assert found["a"] == ("completed", at(9)) and found["b"] == ("completed", at(96))


def test_watched_stages_equal_batch(spark, tmp_path):
    events = derived.run_events(spark, "/root/testdata/sf0.001")
    for part in range(3):
        tables.append_events(events.where(F.col("seq") % 3 == part).coalesce(1), str(tmp_path / "log"))
    follow(watched_stages(spark, str(tmp_path / "log"), timedelta(days=3650), "3650 days", 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    live = VersionedTable(spark, str(tmp_path / "t")).read().select("repo_id", "stage", "status")
    batch = runs.stage_status(events).select("repo_id", "stage", "status")
    assert live.exceptAll(batch).isEmpty() and batch.exceptAll(live).isEmpty()


def test_a_batch_is_worked_out_once_and_python_called_by_bucket(spark, tmp_path, monkeypatch):
    """Each stage of many is one row, and the groups of a batch are buckets, not stages."""
    made = spark.range(6000).selectExpr("concat('r', id % 3000) AS repo_id", "concat('s', id % 2) AS stage", "IF(id < 3000, 'stage_started', 'stage_failed') AS event", "timestamp_seconds(1700000000 + id) AS timestamp", "id AS seq")
    tables.append_events(made.coalesce(2), str(tmp_path / "log"))
    monkeypatch.setattr(status, "BUCKETS", 5)
    query = follow(watched_stages(spark, str(tmp_path / "log"), timedelta(days=3650), "3650 days"), str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) <= 5
    live = VersionedTable(spark, str(tmp_path / "t")).read().select("repo_id", "stage", "status")
    batch = runs.stage_status(made).select("repo_id", "stage", "status")
    assert live.count() == 3000 and live.exceptAll(batch).isEmpty() and batch.exceptAll(live).isEmpty()
