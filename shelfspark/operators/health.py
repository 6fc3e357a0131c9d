"""Service state, overall status, outcome windows and the task gauge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import SERVICES
from shelfspark.operators.scan import running_sums


def outcome_status(success: Column) -> Column:
    return F.when(success, "healthy").otherwise("unhealthy")


def state_aggregates() -> list[Column]:
    """Latest state per service; detail and latency keep their last non-null value."""
    at = F.struct("ts", "seq")

    def last_known(name):
        return F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)

    return [
        F.max_by("status", at).alias("status"),
        last_known("detail"),
        F.max("ts").alias("last_check"),
        F.max(F.when(F.col("status") == "healthy", F.col("ts"))).alias("last_success"),
        last_known("latency_ms"),
    ]


def service_state(events: DataFrame, services=SERVICES) -> DataFrame:
    """One row per known service, unknown until seen; events of other services are dropped."""
    latest = events.where(F.col("service").isin(*services)).groupBy("service").agg(
        *state_aggregates()
    )
    return complete_services(latest, services)


def complete_services(latest: DataFrame, services=SERVICES) -> DataFrame:
    """Add the services not seen yet."""
    spark = latest.sparkSession
    listed = spark.range(1).select(
        F.explode(F.array(*(F.lit(name) for name in services))).alias("service")
    )
    return listed.join(latest, "service", "left").select(
        "service",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("detail", F.lit("")).alias("detail"),
        "last_check",
        "last_success",
        "latency_ms",
    )


def overall(state: DataFrame) -> DataFrame:
    """Degraded if any service is unhealthy; disabled and unknown ones do not count."""
    bad = F.coalesce(F.bool_or(F.col("status") == "unhealthy"), F.lit(False))
    return state.agg(F.when(bad, "degraded").otherwise("ok").alias("status"))


def outcome_windows(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Outcomes, failure rate and mean latency per service and probe period."""
    failed = F.col("status") == "unhealthy"
    return events.groupBy("service", F.window("ts", f"{seconds} seconds").alias("period")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("failures"),
        F.avg(failed.cast("double")).alias("failure_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    )


def uptime(start: Column, now: Column) -> Column:
    """Seconds since the start, one decimal."""
    return F.round((F.unix_micros(now) - F.unix_micros(start)) / 1_000_000, 1)


def task_gauge(task_events: DataFrame, max_workers: int = 4) -> DataFrame:
    """Pending and active tasks after each event (event_seq, op of submit, start, finish), with
    how many can be active at once."""
    op = F.col("op")
    steps = task_events.withColumns(
        {
            "_pending": F.when(op == "submit", 1).when(op == "start", -1).otherwise(0),
            "_active": F.when(op == "start", 1).when(op == "finish", -1).otherwise(0),
        }
    )
    summed = running_sums(steps, ["event_seq"], {"pending": "_pending", "active": "_active"})
    return summed.drop("_pending", "_active").withColumn("max_workers", F.lit(max_workers))
