"""Latest-state tables of replicas, jobs and swarms, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators.joins import latest

FAILED = ("failed", "exited")
HIDDEN = ("FAILED", "STOPPED", "UNKNOWN")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the newest by ``order``."""
    rows = new if old is None else old.unionByName(new)
    key = F.struct(*keys)
    best = latest(rows.withColumn("_key", key), "_key", *order)
    return best.select(*rows.columns)


def patched(jobs: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates (one row a key) change only their non-null columns."""
    rest = [c for c in updates.columns if c != key]
    u = updates.withColumnsRenamed({c: f"_{c}" for c in updates.columns})
    out = jobs.join(u, F.col(key) == F.col(f"_{key}"), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in rest else F.col(c) for c in jobs.columns])


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def failed(state: Column = None, reason: Column = None) -> Column:
    state = F.col("state") if state is None else state
    reason = F.col("fail_reason") if reason is None else reason
    return state.isin(*FAILED) | (F.coalesce(reason, F.lit("")) != "")


def replica_summary(replicas: DataFrame) -> DataFrame:
    """Per swarm: total, running, http_ready, failed, fail_reasons (map), example_fail_reason.

    Reasons count over failed replicas; the example is the most frequent, ties to the smallest replica.
    """
    down = F.col("state").isin(*FAILED)
    counts = replicas.groupBy("swarm_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "running").alias("running"),
        F.count_if("http_ready").alias("http_ready"), F.count_if(down).alias("failed"),
    )
    reasons = replicas.where(down & (F.coalesce("fail_reason", F.lit("")) != "")).groupBy("swarm_id", "fail_reason").agg(F.count("*").alias("n"), F.min("replica_id").alias("first"))
    reasons = reasons.groupBy("swarm_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("fail_reason", "n")))).alias("fail_reasons"),
        F.max_by("fail_reason", F.struct("n", -F.col("first"))).alias("example_fail_reason"),
    )
    return counts.join(reasons, "swarm_id", "left")


def replica_failures(replicas: DataFrame) -> DataFrame:
    return replicas.where(failed())


def readiness(summary: DataFrame, phase: Column) -> DataFrame:
    """ready: phase RUNNING, all replicas ready, none failed; all_failed: something failed and nothing runs."""
    ready = (phase == "RUNNING") & F.coalesce((F.col("http_ready") == F.col("total")) & (F.col("failed") == 0), F.lit(True))
    dead = (F.col("total") > 0) & (F.col("running") == 0) & (F.col("http_ready") == 0) & (F.col("failed") > 0)
    return summary.withColumn("ready", ready).withColumn("all_failed", dead)


def capacity(nodes: DataFrame, tensor_parallel: int, workers: int) -> DataFrame:
    """GPUs and nodes that are alive, and whether they suffice."""
    got = nodes.where("state = 'ALIVE'").agg(F.coalesce(F.sum("gpus"), F.lit(0)).alias("gpus"), F.count("*").alias("nodes"))
    return got.withColumn("enough", (F.col("gpus") >= tensor_parallel * workers) & (F.col("nodes") >= workers))


def newest(rows: DataFrame, limit: int, *ties: str, time: str = "creation_dt") -> DataFrame:
    return rows.orderBy(F.desc(time), *ties).limit(limit)


def list_jobs(jobs: DataFrame, deployment: str | None = None, statuses: list[str] | None = None, limit: int = 50) -> DataFrame:
    if deployment is not None:
        jobs = jobs.where(F.col("deployment_name") == deployment)
    if statuses:
        jobs = jobs.where(F.col("status").isin(*statuses))
    return newest(jobs, limit, "job_id")


def job_by_external_id(jobs: DataFrame, external_id: str, deployment: str | None = None) -> DataFrame:
    """The job last updated; without a deployment, an id that several jobs have is an error."""
    found = jobs.where(F.col("external_id") == external_id)
    if deployment is not None:
        found = found.where(F.col("deployment_name") == deployment)
    found = found.orderBy(F.desc("update_dt"), F.desc("creation_dt"), "job_id").limit(2)
    if deployment is None and found.count() > 1:
        raise ValueError(f"several jobs have the external id {external_id}")
    return found.limit(1)


def jobs_by_external_id(jobs: DataFrame) -> DataFrame:
    """Of each external id and deployment the job last updated, with ``ambiguous``: whether other deployments have the id too."""
    order = F.struct("update_dt", "creation_dt", (-F.col("job_id")).alias("first"))
    best = jobs.groupBy("external_id", "deployment_name").agg(F.max_by(F.struct("job_id", "update_dt"), order).alias("job"))
    several = best.groupBy("external_id").agg((F.count("*") > 1).alias("ambiguous"))
    return best.join(several, "external_id").select("external_id", "deployment_name", "job.job_id", "job.update_dt", "ambiguous")


def last_swarm(swarms: DataFrame, base: str | None = None) -> DataFrame:
    """The swarm created last, of those whose names begin with ``base-`` if it is given; ties by name. No row where there is none."""
    some = swarms if base is None else swarms.where(F.col("deployment_name").startswith(f"{base}-"))
    return newest(some, 1, "deployment_name").select("deployment_name")


def all_swarms(swarms: DataFrame) -> DataFrame:
    """name, swarm, platform, endpoint of all swarms by rising swarm; the last two are read from the JSON texts ``cfg`` and ``serving_handle``."""
    return swarms.select(
        F.col("deployment_name").alias("name"), "swarm", F.get_json_object("cfg", "$.backend.type").alias("platform"), F.get_json_object("serving_handle", "$.url").alias("endpoint")
    ).orderBy("swarm")


def replicas_of(replicas: DataFrame, swarm: str) -> DataFrame:
    """A swarm's replicas by rising id."""
    return replicas.where(F.col("swarm_id") == swarm).orderBy("replica_id")


def visible(swarms: DataFrame) -> DataFrame:
    return swarms.where(~F.col("phase").isin(*HIDDEN))


def prune_candidates(swarms: DataFrame) -> DataFrame:
    """Names of swarms that are hidden or could not be probed."""
    return swarms.where(F.col("phase").isin(*HIDDEN) | F.col("probe_error").isNotNull()).select("deployment_name").distinct().orderBy("deployment_name")


def status_json(swarms: DataFrame, summary: DataFrame, replicas: DataFrame) -> DataFrame:
    """deployment_name, json: the status payload, its keys in a fixed order, replicas by id."""
    items = replicas.withColumn("url", F.concat(F.lit("http://"), "node", F.lit(":"), F.col("port").cast("string")))
    fields = [c for c in items.columns if c != "swarm_id"]
    items = items.groupBy("swarm_id").agg(F.sort_array(F.collect_list(F.struct("replica_id", *[c for c in fields if c != "replica_id"]))).alias("items"))
    s = summary.select("swarm_id", F.struct("total", "running", "http_ready", "failed", "fail_reasons", "example_fail_reason").alias("summary"))
    rows = swarms.join(s.withColumnRenamed("swarm_id", "_s"), F.expr("deployment_name = _s"), "left").join(items, F.expr("deployment_name = swarm_id"), "left")
    ready = (F.col("phase") == "RUNNING") & F.coalesce((F.col("summary.http_ready") == F.col("summary.total")) & (F.col("summary.failed") == 0), F.lit(True))
    payload = F.struct(
        F.lit(1).alias("schema_version"), F.col("deployment_name").alias("name"), "backend", "phase", F.col("phase").alias("state"), ready.alias("ready"),
        "endpoint", "started_at", "expires_at", F.struct("summary", "items").alias("replicas"),
    )
    return rows.select("deployment_name", F.to_json(payload, {"ignoreNullFields": "false"}).alias("json"))
