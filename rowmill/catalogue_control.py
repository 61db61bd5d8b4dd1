"""Queries on control tables: failure reasons, restarts, deadlines, resources, messages. They join those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.__main__ import main
from rowmill.catalogue import REPLICAS, Length, WordCount, _replicas, query, t, work_folder
from rowmill.functions import control as C
from rowmill.functions import metrics as M
from rowmill.operators import ids, joins, state
from rowmill.operators.checkpoint import Checkpoint
from rowmill.plans.run import run, run_sharded
from rowmill.sources import files, memory
from rowmill.streaming import health


@query("""SELECT vec_id, CASE WHEN coalesce(len(embedding), 0) = 0 THEN CAST('inf' AS DOUBLE)
  ELSE round(exp(-list_avg(list_transform(list_sort(embedding)[1:50], lambda x: CAST(x AS DOUBLE)))), 6) END AS ppl FROM embeddings""")
def bottom_perplexity(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(M.bottom_perplexity("embedding"), 6).alias("ppl"))


@query("SELECT vec_id, CAST(coalesce(len(list_filter(embedding, lambda x: x < 0)), 0) AS BIGINT) AS n_tokens FROM embeddings")
def token_logprobs(spark, d):
    content = F.transform("embedding", lambda x: F.struct(F.when(x < 0, x).alias("logprob")))
    return t(spark, d, "embeddings").select("vec_id", F.size(M.token_logprobs(content)).cast("long").alias("n_tokens"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 137 WHEN o_orderkey % 3 = 1 THEN 1 END AS code,
  CASE WHEN o_orderkey % 5 = 0 THEN 'SIGKILL' END AS sig, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END AS attempt,
  CASE WHEN o_orderkey % 7 = 0 THEN 'x Cannot provide a placement group y' WHEN o_orderkey % 7 = 1 THEN repeat('z', 3000) END AS tail FROM orders),
r AS (SELECT o_orderkey, coalesce(tail LIKE '%Cannot provide a placement group%', false) AS full_, concat_ws(' | ', CASE WHEN tail LIKE '%Cannot provide a placement group%' THEN 'ray_pg_insufficient_capacity' END,
  'exit_code=' || code, CASE WHEN code = 137 THEN '(likely OOM / SIGKILL)' END, 'signal=' || sig, 'restart_attempt=' || attempt || '/3', 'log_tail:' || chr(10) || tail) AS s FROM p)
SELECT o_orderkey, CASE WHEN s = '' THEN 'unknown failure' WHEN length(s) > 2048 THEN left(s, 2045) || '...' ELSE s END AS reason, NOT full_ AS retryable FROM r""")
def failure_reasons(spark, d):
    k = F.col("o_orderkey")
    tail = F.when(k % 7 == 0, "x Cannot provide a placement group y").when(k % 7 == 1, F.repeat(F.lit("z"), 3000))
    reason, again = M.fail_reason(F.when(k % 3 == 0, 137).when(k % 3 == 1, 1), F.when(k % 5 == 0, "SIGKILL"), F.when(k % 2 == 0, k % 4), F.lit(3), tail)
    return t(spark, d, "orders").select("o_orderkey", reason.alias("reason"), again.alias("retryable"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ray_pg_insufficient_capacity' ELSE 'unhealthy_timeout' END AS reason, event_type <> 'error' AS retryable FROM events")
def log_verdicts(spark, d):
    tail = F.when(F.col("event_type") == "error", f"... {M.NO_CAPACITY} ...").when(F.col("event_type") == "view", "fine")
    reason, again = C.log_verdict(tail, M.NO_CAPACITY)
    return t(spark, d, "events").select("event_id", reason.alias("reason"), again.alias("retryable"))


@query("""WITH p AS (SELECT o_orderkey, ['never', 'on-failure', 'always'][CAST(o_orderkey % 3 + 1 AS BIGINT)] AS policy, [0, 1, 190][CAST(o_orderkey // 3 % 3 + 1 AS BIGINT)] AS code, o_orderkey // 9 % 5 AS n FROM orders)
SELECT o_orderkey, NOT (code = 190 OR policy = 'never' OR policy = 'on-failure' AND code = 0 OR n >= 3) AS again FROM p""")
def restart_policy(spark, d):
    k = F.col("o_orderkey")
    policy = F.element_at(F.array(F.lit("never"), F.lit("on-failure"), F.lit("always")), (k % 3 + 1).cast("int"))
    code = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(190)), F.expr("cast(o_orderkey div 3 % 3 + 1 as int)"))
    return t(spark, d, "orders").select("o_orderkey", M.should_restart(policy, code, F.expr("o_orderkey div 9 % 5"), F.lit(3)).alias("again"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'PENDING' END AS status FROM orders")
def status_coercion(spark, d):
    raw = F.when(F.col("o_orderstatus") == "O", " running ").when(F.col("o_orderstatus") == "F", "Failed").otherwise("odd")
    return t(spark, d, "orders").select("o_orderkey", M.coerce_status(raw).alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'seed,top_p' ELSE 'top_p' END AS sent FROM orders")
def request_settings(spark, d):
    seed = F.when(F.col("o_orderkey") % 2 == 0, "seed").otherwise("_seed")
    m = F.create_map(F.lit("top_p"), F.lit("0.9"), F.lit("model"), F.lit("m"), F.lit("timeout"), F.lit("6"), seed, F.lit("1"))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(C.sent_settings(m))), ",").alias("sent"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(date_trunc('second', o_orderdate) + to_seconds(CAST(CASE o_orderkey % 4 WHEN 0 THEN 1800 WHEN 1 THEN 93784 ELSE 3661 END AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') END AS expires FROM orders""")
def deadlines(spark, d):
    k = F.col("o_orderkey") % 4
    limit = M.time_limit_seconds(F.when(k == 0, "30").when(k == 1, "1-02:03:04").when(k == 2, "1:01:01").otherwise("soon"))
    return t(spark, d, "orders").select("o_orderkey", C.expires_at("o_orderdate", limit).alias("expires"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM orders")
def hosted_status(spark, d):
    raw = F.when(F.col("o_orderstatus") == "O", "Ready").when(F.col("o_orderstatus") == "F", "Stopping").otherwise("Completed")
    return t(spark, d, "orders").select("o_orderkey", C.endpoint_status(raw).alias("status"))


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS r, [1, 2, 4, 8][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS g FROM orders),
n AS (SELECT *, CASE WHEN g <= 4 THEN least(4 // g, r) END AS on_node FROM p),
m AS (SELECT *, CASE WHEN on_node IS NULL THEN ceil(r * g / 4.0) ELSE ceil(r / CAST(on_node AS DOUBLE)) END AS nodes FROM n)
SELECT o_orderkey, CAST(on_node AS BIGINT) AS on_node, CAST(nodes AS BIGINT) AS nodes, CAST(coalesce(greatest(1, 32 // on_node), 32) AS BIGINT) AS cpus, g > 4 AND nodes > 1 AS spans FROM m""")
def resource_layout(spark, d):
    gpus = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    made = C.layout(F.col("o_orderkey") % 9 + 1, gpus, F.lit(4))
    return t(spark, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(made, ("on_node", "nodes", "cpus", "spans"), strict=True)])


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS r, o_orderkey // 5 % 9 AS g FROM orders)
SELECT o_orderkey, CASE WHEN r < 1 OR g < 1 THEN 'counts must be at least 1' WHEN g > 4 AND g % 4 <> 0 AND ceil(r * g / 4.0) > 1 THEN 'a replica that spans nodes must fill them' END AS error FROM p""")
def resource_errors(spark, d):
    replicas, gpus = F.col("o_orderkey") % 5, F.expr("o_orderkey div 5 % 9")
    return t(spark, d, "orders").select("o_orderkey", C.layout_error(replicas, gpus, F.lit(4)).alias("error"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'UNKNOWN' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN CASE WHEN value > 50 THEN 'RUNNING' ELSE 'INITIALIZING' END ELSE 'PENDING' END AS phase FROM events")
def hosted_phase(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "error", "Stopped").when(kind == "click", "Ready").when(kind != "view", "Updating")
    return t(spark, d, "events").select("event_id", M.hosted_phase(raw, F.col("value") > 50).alias("phase"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS keys FROM events GROUP BY 1")
def output_keys(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.array_join(C.key_union(F.create_map("event_type", "value")), ",").alias("keys"))


@query("SELECT p_partkey, replace(replace(p_name || '_%', '%', chr(92) || '%'), '_', chr(92) || '_') AS pattern FROM part")
def like_patterns(spark, d):
    return t(spark, d, "part").select("p_partkey", C.escaped_like(F.concat("p_name", F.lit("_%"))).alias("pattern"))


@query(f"""WITH {REPLICAS} SELECT swarm_id, count(*) = count(*) FILTER (http_ready) AND count(*) FILTER (state IN ('failed', 'exited')) = 0 AS ready,
count(*) FILTER (state = 'running') = 0 AND count(*) FILTER (http_ready) = 0 AND count(*) FILTER (state IN ('failed', 'exited')) > 0 AS all_failed FROM s GROUP BY 1""")
def swarm_readiness(spark, d):
    return state.readiness(state.replica_summary(_replicas(spark, d)), F.lit("RUNNING")).select("swarm_id", "ready", "all_failed")


def _external_jobs(spark, d):
    orders = t(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").cast("string").alias("external_id"), F.concat(F.lit("dep-"), "o_orderstatus").alias("deployment_name"), F.col("o_orderdate").alias("update_dt"), F.col("o_orderdate").alias("creation_dt"))


@query("SELECT o_orderkey AS job_id, o_orderdate AS update_dt FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def job_of_external_id(spark, d):
    jobs = _external_jobs(spark, d).withColumn("deployment_name", F.lit("dep"))
    first = str(t(spark, d, "orders").agg(F.min("o_custkey")).first()[0])
    return state.job_by_external_id(jobs, first, "dep").select("job_id", "update_dt")


@query("""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS external_id, 'dep-' || o_orderstatus AS deployment_name, o_orderkey AS job_id, o_orderdate AS update_dt FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1) SELECT *, count(*) OVER (PARTITION BY external_id) > 1 AS ambiguous FROM b""")
def jobs_of_external_ids(spark, d):
    return state.jobs_by_external_id(_external_jobs(spark, d))


@query("SELECT * FROM lineitem WHERE l_orderkey % 100 = 99")
def pruned_resume(spark, d):
    """The last hundredth of a resume: only ids are shuffled."""
    lines = t(spark, d, "lineitem")
    return joins.pending_narrow(lines, lines.where("l_orderkey % 100 < 99"), "l_orderkey")


@query("""SELECT event_id, 's' || user_id % 5 AS swarm_id, CAST(CASE event_id % 13 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE user_id END AS INTEGER) AS replica_id, CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'None' ELSE event_type END AS state,
event_id % 8 IN (0, 2, 4, 6) AS http_ready, CASE WHEN event_id % 4 <> 1 THEN 9000 END AS port FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 17 NOT IN (0, 1)""")
def valid_messages(spark, d):
    """Every 7th message is not JSON, every 11th has no usable replica id, some have no swarm; the kinds of JSON values vary."""
    e = F.col("event_id")
    one_of = lambda n, *texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (e % n + 1).cast("int"))
    user = F.col("user_id").cast("string")
    replica = F.when(e % 11 == 0, F.lit('"none"')).when(e % 13 == 1, "2.7").when(e % 13 == 2, "true").when(e % 2 == 0, user).otherwise(F.concat(F.lit('" '), user, F.lit('"')))
    swarm = F.when(e % 17 == 0, F.lit('""')).when(e % 17 == 1, "null").otherwise(F.concat(F.lit('"s'), (F.col("user_id") % 5).cast("string"), F.lit('"')))
    ready = one_of(8, '"false"', "[]", '"0"', "0.0", "true", "{}", "-1", "null")
    state = F.when(e % 3 == 1, F.lit(', "state": null')).when(e % 3 == 2, F.concat(F.lit(', "state": "'), "event_type", F.lit('"'))).otherwise("")
    port = F.when(e % 4 == 1, '"x"').when(e % 4 == 2, '"9000"').when(e % 4 == 3, "9000.9").otherwise("9000")
    body = F.concat(F.lit('{"swarm_id": '), swarm, F.lit(', "replica_id": '), replica, F.lit(', "http_ready": '), ready, F.lit(', "port": '), port, state, F.lit("}"))
    messages = t(spark, d, "events").select("event_id", F.when(e % 7 == 0, "{broken").otherwise(body).alias("value"))
    return health.normalized(messages).select("event_id", "swarm_id", "replica_id", "state", "http_ready", "port")


@query("SELECT 'same' AS input, true AS accepted UNION ALL SELECT unnest(['one text changed', 'every row twice', 'one row twice', 'one row gone', 'ids exchanged']), false")
def input_fingerprint(spark, d):
    """A stored fingerprint accepts the same rows in any order of files and no others."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    least = docs.agg(F.min("doc_id")).first()[0]
    changed = docs.withColumn("text", F.when(F.col("doc_id") == least, "other").otherwise(F.col("text")))
    stored = ids.fingerprint(docs, "doc_id", "text")
    one, swapped = docs.where(F.col("doc_id") == least), docs.withColumn("doc_id", F.col("doc_id") + 1)
    cases = [("same", docs.repartition(5)), ("one text changed", changed), ("every row twice", docs.union(docs)), ("one row twice", docs.union(one).union(one)), ("one row gone", docs.where(F.col("doc_id") != least)), ("ids exchanged", swapped)]
    return spark.createDataFrame([(n, ids.fingerprint(df, "doc_id", "text") == stored) for n, df in cases], "input string, accepted boolean")


@query("SELECT *, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // CAST(ceil(count(*) OVER () / 4.0) AS BIGINT) AS BIGINT) AS shard FROM part")
def equal_chunks(spark, d):
    return ids.ceil_chunks(t(spark, d, "part"), "p_partkey", 4).withColumn("shard", F.col("shard").cast("long"))


@query(f"WITH {REPLICAS} SELECT swarm_id, fail_reason, count(*) AS n FROM s WHERE state IN ('failed', 'exited') AND fail_reason <> '' GROUP BY 1, 2")
def fail_reason_counts(spark, d):
    """The histogram of a summary, one row a reason, by falling count and then by reason."""
    made = state.replica_summary(_replicas(spark, d)).select("swarm_id", F.explode("fail_reasons").alias("fail_reason", "n"))
    return made.orderBy("swarm_id", F.desc("n"), "fail_reason")


@query("SELECT d.*, CAST(length(text) AS BIGINT) AS result FROM documents d")
def sharded_run(spark, d):
    """Four shards by id, of which a first run with three shards did a part."""
    docs, folder = t(spark, d, "documents"), work_folder(spark)
    run_sharded(docs.where("doc_id % 2 = 0"), Length(input_column="text"), "doc_id", checkpoint=folder, nshards=3)
    return run_sharded(docs, Length(input_column="text"), "doc_id", checkpoint=folder, nshards=4)


@query("SELECT d.*, CAST(length(text) AS BIGINT) AS result, CAST(ntile(4) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents d")
def sharded_output(spark, d):
    folder = work_folder(spark)
    run_sharded(t(spark, d, "documents"), Length(input_column="text"), "doc_id", checkpoint=f"{folder}/c", nshards=4, shard_mode="index", output=f"{folder}/out")
    return files.read_dataset(spark, f"{folder}/out")


@query("SELECT c.*, CAST(length(c_name) AS BIGINT) AS result FROM (SELECT row_number() OVER (ORDER BY c_custkey) + 99 AS row_nr, * FROM customer) c")
def pandas_input(spark, d):
    """A pandas table whose index is the id."""
    table = t(spark, d, "customer").orderBy("c_custkey").toPandas()
    table.index = table.index + 100
    return run(table.rename_axis("row_nr"), Length(input_column="c_name"), spark=spark)


@query("SELECT d.*, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_signs FROM documents d")
def flushed_run(spark, d):
    """Waves of 200 rows a task; the input is the one that the checkpoint was begun with, and is checked."""
    docs, folder = t(spark, d, "documents"), work_folder(spark)
    job = WordCount(input_column="text")
    run(docs, job, "doc_id", checkpoint=folder, flush_every=200, strict=True)
    return run(docs.repartition(3), job, "doc_id", checkpoint=folder, strict=True)


@query("SELECT doc_id, 1 AS times, CAST(length(text) AS BIGINT) AS result, 2 AS in_output FROM documents")
def once_per_id(spark, d):
    """Rows that repeat an id are transformed once, and all get its output; ``times`` counts what the checkpoint holds."""
    docs, folder = t(spark, d, "documents").select("doc_id", "text"), work_folder(spark)
    job = Length(input_column="text")
    out = run(docs.union(docs), job, "doc_id", checkpoint=folder, once=True)
    held = Checkpoint(spark, folder, "doc_id", T.StructType([docs.schema["doc_id"], T.StructField("result", T.LongType())])).rows()
    held = held.groupBy("doc_id").agg(F.count("*").cast("int").alias("times"), F.max("result").alias("result"))
    return held.join(out.groupBy("doc_id").agg(F.count("*").cast("int").alias("in_output")), "doc_id")


@query("SELECT * FROM (SELECT d.*, CAST(length(text) AS BIGINT) AS result FROM documents d)")
def command_line(spark, d):
    """A run from the command line over a pattern, and a second one that knows the input by its bytes and finds all its rows done."""
    folder = work_folder(spark)
    files.write_named_shards(t(spark, d, "documents"), f"{folder}/in", 3, "doc_id")
    for _ in range(2):
        main([f"{folder}/in/data-{{0..2}}.parquet", f"{folder}/out", "--job", "rowmill.catalogue:Length", "--input-column", "text", "--id", "doc_id", "--checkpoints", f"{folder}/c"])
    return files.read_dataset(spark, f"{folder}/out")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT o_orderkey AS by_price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders) SELECT o_orderkey, o_totalprice, by_price FROM a JOIN b USING (n)""")
def side_by_side(spark, d):
    orders = t(spark, d, "orders")
    ranked = orders.select(F.col("o_orderkey").alias("by_price"), F.col("o_totalprice").alias("price"))
    return joins.side_by_side(orders.select("o_orderkey", "o_totalprice"), ranked, ("o_orderkey",), ("price", "by_price")).drop("price")


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS type FROM (DESCRIBE customer)")
def table_columns(spark, d):
    return spark.createDataFrame(list(memory.columns_of(t(spark, d, "customer")).items()), "name string, type string")


def _swarms(spark, d):
    kind = F.when(F.col("c_custkey") % 2 == 0, '{"backend": {"type": "slurm"}}').otherwise('{"backend": {}}')
    return t(spark, d, "customer").select(
        F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")).alias("deployment_name"), F.col("c_custkey").alias("swarm"), kind.alias("cfg"),
        F.concat(F.lit('{"url": "http://h'), F.col("c_nationkey").cast("string"), F.lit('"}')).alias("serving_handle"), (F.col("c_custkey") % 100).alias("creation_dt"),
        F.when(F.col("c_nationkey") % 3 == 0, "STOPPED").otherwise("RUNNING").alias("phase"),
    )


@query("SELECT c_mktsegment || '-' || c_custkey AS name, c_custkey AS swarm, CASE WHEN c_custkey % 2 = 0 THEN 'slurm' END AS platform, 'http://h' || c_nationkey AS endpoint FROM customer")
def swarm_list(spark, d):
    return state.all_swarms(_swarms(spark, d))


@query("SELECT c_mktsegment || '-' || c_custkey AS deployment_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey % 100 DESC, 1 LIMIT 1")
def swarm_last(spark, d):
    return state.last_swarm(_swarms(spark, d), "BUILDING")


@query("SELECT c_mktsegment || '-' || c_custkey AS deployment_name FROM customer WHERE c_nationkey % 3 <> 0")
def swarm_visible(spark, d):
    return state.visible(_swarms(spark, d)).select("deployment_name")


@query(f"WITH {REPLICAS} SELECT replica_id, state, event_id FROM s WHERE swarm_id = 'swarm-3'")
def swarm_replicas(spark, d):
    return state.replicas_of(_replicas(spark, d), "swarm-3").select("replica_id", "state", "event_id")


@query("SELECT p_partkey, left(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-'), 9) || '-' || 'r' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name FROM part")
def generated_names(spark, d):
    return t(spark, d, "part").select("p_partkey", M.generated_name("p_type", 20, F.concat(F.lit("R"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).alias("name"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'PENDING' END AS status, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jobs_with_swarms(spark, d):
    """Jobs and the table their key points to."""
    raw = F.when(F.col("o_orderstatus") == "O", " running ").when(F.col("o_orderstatus") == "F", "Failed").otherwise("pending")
    jobs = t(spark, d, "orders").select("o_orderkey", M.coerce_status(raw, None).alias("status"), F.col("o_custkey").alias("c_custkey"))
    return jobs.join(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "status", "c_name")
