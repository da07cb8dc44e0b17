"""Run events of builds: the state of stages, progress, where to resume, and the status of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repograph.functions import dims

EVENT = "repo_id string, pipeline_id string, timestamp timestamp, seq long, level string, event string, stage string, duration double, error string, metadata map<string,string>"
STATE = {"stage_started": "started", "stage_completed": "completed", "stage_failed": "failed"}


def stage_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dims.STAGES, "stage string, ord int, weight double")


def state_of(event: Column) -> Column:
    return F.when(event == "stage_started", "started").when(event == "stage_completed", "completed").when(event == "stage_failed", "failed")


def stage_status(events: DataFrame) -> DataFrame:
    """repo_id, stage, status and last_ts: the last event of a stage wins."""
    known = events.where("stage is not null").where(F.col("event").isin(*STATE))
    last = known.groupBy("repo_id", "stage").agg(F.max_by("event", F.struct("timestamp", "seq")).alias("event"), F.max("timestamp").alias("last_ts"))
    return last.select("repo_id", "stage", state_of(F.col("event")).alias("status"), "last_ts")


def completed_stages(events: DataFrame) -> DataFrame:
    """repo_id, stage and rank of completed stages in the order of their completion."""
    done = stage_status(events).where("status = 'completed'")
    return done.select("repo_id", "stage", F.row_number().over(Window.partitionBy("repo_id").orderBy("last_ts", "stage")).alias("rank"))


def resume_stage(events: DataFrame) -> DataFrame:
    """repo_id and stage: the first stage that is not completed; null when the pipeline or all stages are."""
    finished = events.groupBy("repo_id").agg(F.bool_or(F.col("event") == "pipeline_completed").alias("_over"))
    # Five rows.
    each = finished.join(F.broadcast(stage_dim(events.sparkSession)), F.lit(True)).join(stage_status(events), ["repo_id", "stage"], "left")
    open_ = (F.coalesce("status", F.lit("absent")) != "completed") & ~F.col("_over")
    return each.groupBy("repo_id").agg(F.min_by(F.when(open_, F.col("stage")), F.when(open_, F.col("ord"))).alias("stage"))


def stage_durations(events: DataFrame) -> DataFrame:
    """repo_id, stage and seconds from the last start before the last end to that end; null without both."""
    ends = events.where("event in ('stage_completed', 'stage_failed')").groupBy("repo_id", "stage").agg(F.max("timestamp").alias("_end"))
    starts = events.where("event = 'stage_started'").select("repo_id", "stage", "timestamp").join(ends, ["repo_id", "stage"]).where("timestamp <= _end")
    last = starts.groupBy("repo_id", "stage").agg(F.max("timestamp").alias("_start"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("_start"), F.col("_end")) / 1e6
    return ends.join(last, ["repo_id", "stage"], "left").select("repo_id", "stage", F.round(seconds, 3).alias("seconds"))


def weighted_progress(events: DataFrame) -> DataFrame:
    """repo_id and percent: the weights of completed stages among all weights."""
    total = sum(w for _, _, w in dims.STAGES)
    done = stage_status(events).join(F.broadcast(stage_dim(events.sparkSession)), "stage")
    return done.groupBy("repo_id").agg(F.round(F.sum(F.when(F.col("status") == "completed", F.col("weight")).otherwise(0.0)) / total * 100, 2).alias("percent"))


def status_upsert(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """The registry after updates(repo_id, initial_status, repo_name, repo_path, seq): the last row of a repo wins, nulls keep what was there."""
    old = registry.withColumn("seq", F.lit(None).cast("long"))
    both = old.unionByName(updates.withColumn("seq", F.col("seq").cast("long")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("seq", F.lit(-1)))), ).alias(c)
    return both.groupBy("repo_id").agg(*(last(c) for c in ("initial_status", "repo_name", "repo_path")))


def status_with_running(registry: DataFrame, running: DataFrame, asked: DataFrame) -> DataFrame:
    """repo_id and status of asked(repo_id), from the registry and the repos that are running."""
    both = asked.join(registry, "repo_id", "left").join(running.select("repo_id", F.lit(True).alias("_runs")), "repo_id", "left")
    s = F.col("initial_status")
    status = F.when(s.isNull(), "NotInitialized").when(s.isin("Completed", "Failed"), s).when((s == "Pending") & F.col("_runs"), "Running").when(s == "Pending", "Pending").otherwise("Unknown")
    return both.select("repo_id", status.alias("status"))
