"""Work queues, quotas and rate limits as transitions of whole tables; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(jobs: DataFrame, now: Column, batch: int = 4, cap: int = 4) -> DataFrame:
    """The jobs that one worker gets: due and queued, first in first out, each tenant within its cap.

    jobs: id, client_id, status, priority, run_after, created_at.
    """
    order = ["priority", "run_after", "created_at", "id"]
    running = jobs.where("status = 'running'").groupBy("client_id").agg(F.count("*").alias("running"))
    due = jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now))
    ranked = due.withColumn("_rn", F.row_number().over(Window.partitionBy("client_id").orderBy(*order))).where(F.col("_rn") <= cap)
    free = ranked.join(running, "client_id", "left").where(F.col("_rn") <= F.greatest(F.lit(cap) - F.coalesce("running", F.lit(0)), F.lit(0)))
    window = free.orderBy(*order).limit(max(4 * batch, 50))
    return window.orderBy(*order).limit(batch).drop("_rn", "running")


def backoff(attempts: Column, base: float = 30, cap: float = 3600, jitter: Column | None = None) -> Column:
    """Seconds to wait: doubled for each attempt up to the cap, times 0.5 to 1.5 (jitter 0 to 1, 0.5 if not given)."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempts)) * (0.5 + (F.lit(0.5) if jitter is None else jitter))


def reap(jobs: DataFrame, now: Column, rescue_minutes: int = 15) -> DataFrame:
    """Running jobs whose lease ran out: back to the queue with a wait, or dead after their last attempt."""
    lost = (F.col("status") == "running") & F.coalesce(F.col("lease_expires_at") < now, F.col("updated_at") < now - F.make_interval(mins=F.lit(rescue_minutes)))
    again = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumns({
        "status": F.when(lost & again, "queued").when(lost, "dead").otherwise(F.col("status")),
        "wait_seconds": F.when(lost & again, backoff(F.col("attempts"))),
        "reaped": lost,
    })


def stats(jobs: DataFrame, now: Column) -> DataFrame:
    """(kind, status, n, oldest_seconds)."""
    return jobs.groupBy("kind", "status").agg(F.count("*").alias("n"), F.max(now.cast("timestamp").cast("long") - F.col("created_at").cast("timestamp").cast("long")).alias("oldest_seconds"))


def quota(jobs: DataFrame, policies: DataFrame, now: Column, fleet_active: int = 25, fleet_daily: int = 0) -> DataFrame:
    """(client_id, active, today, verdict, retry_after): a tenant's own daily limit of 0 blocks, the fleet's means no limit."""
    use = jobs.groupBy("client_id").agg(F.count_if(F.col("status").isin("queued", "running")).alias("active"), F.count_if(F.col("created_at") >= F.date_trunc("day", now)).alias("today"))
    both = use.join(policies, "client_id", "left")
    active_full = F.col("active") >= F.coalesce("max_active_jobs", F.lit(fleet_active))
    daily_full = F.when(F.col("daily_ingest_limit").isNotNull(), F.col("today") >= F.col("daily_ingest_limit")).otherwise(F.lit(fleet_daily > 0) & (F.col("today") >= fleet_daily))
    verdict = F.when(active_full, "too_many_active").when(daily_full, "daily_limit").otherwise("ok")
    return both.select("client_id", "active", "today", verdict.alias("verdict"), F.when(active_full, 30).when(daily_full, 3600).cast("int").alias("retry_after"))


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, n, allowed): requests (key, at in seconds) that a bucket lets through, as a fold over each key's times.

    The bucket starts full and the first request measures from time 0.
    """
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(0.0).alias("last"), F.lit(0).cast("long").alias("allowed"))

    def step(acc: Column, at: Column) -> Column:
        tokens = F.least(F.lit(float(burst)), acc["tokens"] + F.greatest(F.lit(0.0), at - acc["last"]) * rate)
        ok = tokens >= 1
        return F.struct(F.when(ok, tokens - 1).otherwise(tokens).alias("tokens"), at.alias("last"), (acc["allowed"] + ok.cast("long")).alias("allowed"))

    times = requests.groupBy("key").agg(F.array_sort(F.collect_list(F.col("at").cast("double"))).alias("t"))
    return times.select("key", F.size("t").cast("long").alias("n"), F.aggregate("t", start, step, lambda acc: acc["allowed"]).alias("allowed"))


def enqueue(jobs: DataFrame, requests: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """``jobs`` with one queued job for each new request; a tenant's idempotency key that exists already makes none.

    requests: id, client_id, kind, priority, idempotency_key. Of new requests with one key the
    smallest id stands; requests without a key all do. Nulls in jobs stand for what a new job has not.
    """
    key = ["client_id", "idempotency_key"]
    keyed = requests.where("idempotency_key is not null").groupBy(*key).agg(F.min_by(F.struct("id", "kind", "priority"), "id").alias("r")).select("r.*", *key)
    fresh = keyed.join(jobs.select(*key).distinct(), key, "left_anti").unionByName(requests.where("idempotency_key is null").select("id", "kind", "priority", *key))
    made = fresh.withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "created_at": now, "updated_at": now, "run_after": now})
    return jobs.unionByName(made.select(*[made[f.name].cast(f.dataType) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema]))


def transition(jobs: DataFrame, calls: DataFrame, now: Column, lease_seconds: int = 300, base: float = 30, cap: float = 3600, jitter: Column | None = None) -> DataFrame:
    """``jobs`` after one call for each job, with ``applied``: whether a call was made and took effect.

    calls: call_no, id, action, worker, client_id, status, error. Workers' actions take effect
    only on a running job that the worker holds: ``heartbeat`` renews the lease, ``complete``
    ends with ``status``, ``release`` gives the job back uncharged, ``retry_later`` waits with
    backoff. Tenants' actions take effect on their own jobs: ``retry`` of a dead one,
    ``cancel`` of a queued one. Of several calls for a job the first is taken. One shuffle by id.
    """
    first = calls.groupBy("id").agg(F.min_by(F.struct("action", "worker", F.col("client_id").alias("caller"), F.col("status").alias("to"), F.col("error").alias("why")), "call_no").alias("_c"))
    both = jobs.join(first, "id", "left")
    held = (F.col("status") == "running") & (F.col("locked_by") == F.col("_c.worker"))
    own = F.col("client_id") == F.col("_c.caller")
    action = F.col("_c.action")
    on = lambda name, where: F.coalesce((action == name) & where, F.lit(False))
    beat, done, back, later = (on(a, held) for a in ("heartbeat", "complete", "release", "retry_later"))
    again, cancel = on("retry", own & (F.col("status") == "dead")), on("cancel", own & (F.col("status") == "queued"))
    wait = F.make_dt_interval(secs=backoff(F.col("attempts"), base, cap, jitter).cast("decimal(18,6)"))
    freed = done | back | later | again
    keep = lambda c: F.col(c)
    changed = {
        "status": F.when(done, F.col("_c.to")).when(back | later | again, "queued").when(cancel, "canceled").otherwise(keep("status")),
        "locked_by": F.when(freed, F.lit(None)).otherwise(keep("locked_by")),
        "lease_expires_at": F.when(beat, now + F.make_dt_interval(secs=F.lit(lease_seconds))).when(~freed, keep("lease_expires_at")),
        "run_after": F.when(back | again, now).when(later, now + wait).otherwise(keep("run_after")),
        "attempts": F.when(back, F.greatest(keep("attempts") - 1, F.lit(0))).when(again, F.lit(0)).otherwise(keep("attempts")),
        "error": F.when(done, F.coalesce("_c.why", "error")).when(later, F.col("_c.why")).when(~again, keep("error")),
        "finished_at": F.when(done | cancel, now).when(~again, keep("finished_at")),
        "updated_at": F.when(freed | cancel, now).otherwise(keep("updated_at")),
        "applied": beat | freed | cancel,
    }
    return both.select(*[changed.pop(c).cast(jobs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in jobs.columns], changed["applied"].alias("applied"))
