"""The live state of stages from a folder of run events."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repograph.operators.graph import kept
from repograph.operators.runs import EVENT, STATE, state_of
from repograph.sources.versions import VersionConflict, VersionedTable

STATUS = "repo_id string, stage string, status string, at timestamp"
#: Stages are watched in so many groups: one call of Python for each stage would take most of the time.
BUCKETS = 4096
KNOWN = "repo_id array<string>, stage array<string>, ms array<bigint>, seq array<bigint>, event array<string>, due array<bigint>"


def stage_status_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame of repo_id, stage and status as events arrive; its state is one row for each stage of a repo and stays."""
    events = spark.readStream.schema(EVENT).json(folder)
    known = events.where("stage is not null").where(F.col("event").isin(*STATE))
    last = known.groupBy("repo_id", "stage").agg(F.max_by("event", F.struct("timestamp", "seq")).alias("event"))
    return last.select("repo_id", "stage", state_of(F.col("event")).alias("status"))


def watched_stages(spark: SparkSession, folder: str, stall: timedelta = timedelta(hours=1), late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """A streaming frame of repo_id, stage, status and at (event time): a row whenever a stage's last event changes, and one with ``stalled`` when a stage has started
    and event time has gone on by ``stall`` without a word of it.

    The event with the largest timestamp and seq counts, in whatever order they come; repeated events change nothing. Events later than ``late`` behind the newest are
    left out. The state of a stage that has ended, or stalled, is dropped when event time has gone on by ``stall``. files: log files read in a batch at most.
    The state of all stages of a bucket is one row of arrays, with the time at which each is due.
    """
    reader = spark.readStream.schema(EVENT)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    events = reader.json(folder).where("stage is not null and timestamp is not null").where(F.col("event").isin(*STATE))
    events = events.withWatermark("timestamp", late).select("repo_id", "stage", "timestamp", F.coalesce("seq", F.lit(-1)).alias("seq"), "event")
    wait = int(stall.total_seconds() * 1000)

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(r, s): (ms, seq, event, due) for r, s, ms, seq, event, due in zip(*state.get, strict=True)} if state.exists else {}
        now, said, met = state.getCurrentWatermarkMs(), {}, set()
        for part in () if state.hasTimedOut else parts:
            times = part["timestamp"].astype("datetime64[ms]").astype("int64").tolist()
            for repo, stage, ms, seq, event in zip(part["repo_id"].tolist(), part["stage"].tolist(), times, part["seq"].tolist(), part["event"].tolist(), strict=True):
                own = repo, stage
                last = known.get(own)
                met.add(own)
                if last is None or (ms, seq) > last[:2]:
                    known[own] = ms, seq, event, 0
                    said[own] = STATE[event], ms
        for own in met:
            ms, seq, event, _ = known[own]
            known[own] = ms, seq, event, max(ms + wait, now + 1)
        for own in [own for own, (*_, due) in known.items() if due < now and own not in met]:
            ms, _, event, _ = known.pop(own)
            if event == "stage_started":
                said[own] = "stalled", ms
        if known:
            state.update(tuple(map(list, zip(*((*own, *last) for own, last in known.items()), strict=True))))
            state.setTimeoutTimestamp(max(min(due for *_, due in known.values()), now))
        elif state.exists:
            state.remove()
        if said:
            at = pd.to_datetime([ms for _, ms in said.values()], unit="ms")
            yield pd.DataFrame({"repo_id": [r for r, _ in said], "stage": [s for _, s in said], "status": [status for status, _ in said.values()], "at": at})

    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("repo_id", "stage"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(each, STATUS, KNOWN, "update", GroupStateTimeout.EventTimeTimeout)


def follow(stages: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep a table at rest (id, repo_id, stage, status, at) of the last status of each stage of watched_stages, all that has arrived by now.

    A batch is one merge by key, so a batch that is played again after a failure gives the same rows. It is written first, as a merge reads it twice.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("repo_id", "stage").agg(F.max_by("status", F.struct("at", F.col("status") == "stalled")).alias("status"), F.max("at").alias("at"))
        rows = last.select(F.concat_ws("/", "repo_id", "stage").alias("id"), "repo_id", "stage", "status", "at")
        rows = kept(rows)
        table = VersionedTable(batch.sparkSession, root)
        if not table.exists():
            try:
                VersionedTable.create(batch.sparkSession.createDataFrame([], rows.schema), root, "id", 16)
            except VersionConflict:
                pass
        table.merge(rows)

    return stages.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
