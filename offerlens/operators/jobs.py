"""The collection-job table: what is new, what runs next, what is stuck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import (
    EXHAUSTED_NOTE, JOB_PASS_PERCENT, JOB_STATUSES, JOB_TYPES, JOB_WARN_PERCENT, STALE_JOB_MINUTES, STALE_NOTE,
)
from offerlens.functions.keys import minutes_before


def new_jobs(found: DataFrame, jobs: DataFrame, job_type: str = "detail_scrape") -> DataFrame:
    """URLs to enqueue: those without an open job of the type, each once, with the
    smallest item key. A copy in the same batch counts as open."""
    open_urls = jobs.filter((F.col("job_type") == job_type) & F.col("status").isin("pending", "running")).select("target_url")
    once = found.groupBy("target_url").agg(F.min("product_uid").alias("product_uid"))
    return once.join(open_urls, "target_url", "left_anti").select(
        F.lit(job_type).alias("job_type"), "target_url", "product_uid", F.lit("pending").alias("status")
    )


def runnable(jobs: DataFrame, as_of: Column, job_type: str = "detail_scrape") -> DataFrame:
    due = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= as_of)
    return jobs.filter(
        (F.col("job_type") == job_type) & (F.col("status") == "pending") & due & (F.col("attempts") < F.col("max_attempts"))
    )


def next_batch(jobs: DataFrame, as_of: Column, n: int = 500, job_type: str = "detail_scrape") -> DataFrame:
    """The n oldest runnable jobs as they look once taken."""
    return (
        runnable(jobs, as_of, job_type)
        .orderBy("created_at", "id")
        .limit(n)
        .withColumn("status", F.lit("running"))
        .withColumn("started_at", as_of)
        .withColumn("attempts", F.col("attempts") + 1)
    )


def take_batch(jobs: DataFrame, as_of: Column, n: int = 500, job_type: str = "detail_scrape") -> DataFrame:
    """The whole table after the next batch was taken."""
    taken = next_batch(jobs, as_of, n, job_type).select("id", F.lit(True).alias("_taken"))
    hit = F.coalesce(F.col("_taken"), F.lit(False))
    return (
        jobs.join(taken, "id", "left")
        .withColumn("started_at", F.when(hit, as_of).otherwise(F.col("started_at")))
        .withColumn("attempts", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")))
        .withColumn("status", F.when(hit, F.lit("running")).otherwise(F.col("status")))
        .select(*jobs.columns)
    )


def repair_stale(jobs: DataFrame, as_of: Column, minutes: int = STALE_JOB_MINUTES) -> DataFrame:
    """Jobs running too long go back to pending; open jobs out of attempts fail."""
    held = F.coalesce(F.col("locked_at"), F.col("started_at"))
    more = F.col("attempts") < F.col("max_attempts")
    stale = (F.col("status") == "running") & (held < minutes_before(as_of, minutes)) & more
    spent = F.col("status").isin("pending", "running") & ~more
    note = F.coalesce(F.col("error_message"), F.lit(""))
    stale, spent = (F.coalesce(c, F.lit(False)) for c in (stale, spent))
    changed = {
        "status": F.when(stale, F.lit("pending")).when(spent, F.lit("failed")).otherwise(F.col("status")),
        "locked_by": F.when(~stale, F.col("locked_by")),
        "locked_at": F.when(~stale, F.col("locked_at")),
        "error_message": F.when(stale, F.concat(note, F.lit(STALE_NOTE)))
        .when(spent, F.concat(note, F.lit(EXHAUSTED_NOTE)))
        .otherwise(F.col("error_message")),
    }
    return jobs.withColumns({c: e for c, e in changed.items() if c in jobs.columns})


def job_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by type and status with the success rate and its verdict, one row per
    known type."""
    types = jobs.sparkSession.createDataFrame([(t,) for t in JOB_TYPES], "job_type string")
    counts = jobs.groupBy("job_type").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES], F.count("*").alias("total")
    )
    rows = types.join(counts, "job_type", "left").na.fill(0)
    rate = F.when(F.col("total") > 0, F.col("done") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    verdict = (
        F.when(F.col("total") == 0, F.lit("WARN"))
        .when(rate > JOB_PASS_PERCENT, F.lit("PASS"))
        .when(rate > JOB_WARN_PERCENT, F.lit("WARN"))
        .otherwise(F.lit("FAIL"))
    )
    return rows.select("job_type", *JOB_STATUSES, "total", rate.alias("success_percent"), verdict.alias("verdict"))


def daily_job_stats(jobs: DataFrame) -> DataFrame:
    """Rows of the daily statistics table."""
    took = F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return jobs.groupBy(F.to_date("created_at").alias("stat_date"), "job_type").agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "done").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("fail_count"),
        F.count_if(F.col("status") == "skipped").alias("skip_count"),
        F.floor(F.sum(took) / F.count(took)).cast("bigint").alias("avg_duration_ms"),
    )


def listed_targets(targets: DataFrame, target_type: str | None = None, active_only: bool = True) -> DataFrame:
    if target_type:
        targets = targets.filter(F.col("target_type") == target_type)
    if active_only:
        targets = targets.filter(F.col("is_active"))
    return targets.orderBy(F.col("priority").desc(), F.col("created_at").asc(), F.col("id").asc())
