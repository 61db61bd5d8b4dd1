"""One query per operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions import metrics as M
from rowmill.operators import buckets, ids, jobs, joins, state
from rowmill.operators.checkpoint import Checkpoint
from rowmill.operators.transform import RowJob, map_rows
from rowmill.plans.run import OutputMode, joined, run
from rowmill.sources import blocks, files, logs, stores
from rowmill.sources.scratch import scratch
from rowmill.streaming import health

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return files.read_dataset(spark, f"{d}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the place that all executors share."""
    return scratch(spark, "query")


class WordCount(RowJob):
    """Number of words between blanks, and the length."""

    schema = "n_words long, n_signs long"

    def transform_items(self, items):
        return [(len((x or "").split(" ")), len(x or "")) for x in items]


class Length(RowJob):
    schema = "result long"

    def transform_items(self, items):
        return [len(x or "") for x in items]


class LengthDict(RowJob):
    schema = "a long, b string"

    async def transform_items(self, items):
        return [{"b": (x or "")[:3], "a": len(x or "")} for x in items]


@query("SELECT d.*, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_signs FROM documents d")
def resumed_run(spark, d):
    """The flagship: a third of the rows is done in an earlier run, the rest in a resumed one."""
    docs, folder = t(spark, d, "documents"), work_folder(spark)
    run(docs.where("doc_id % 3 = 0"), WordCount(input_column="text"), "doc_id", checkpoint=folder)
    return run(docs, WordCount(input_column="text"), "doc_id", checkpoint=folder)


@query("SELECT * FROM documents")
def scan_parquet(spark, d):
    return t(spark, d, "documents")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def scan_pattern(spark, d):
    a = files.read_dataset(spark, f"{d}/natio[n].parquet").select("n_nationkey", "n_name")
    b = files.read_dataset(spark, f"{d}/regio?.parquet").select("r_regionkey", "r_name")
    return a.union(b)


@query("SELECT * FROM customer")
def csv_round_trip(spark, d):
    path, rows = work_folder(spark) + "/x.csv", t(spark, d, "customer")
    files.write_dataset(rows, path)
    return files.read_dataset(spark, path, inferSchema=False).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


@query("SELECT * FROM customer")
def jsonl_round_trip(spark, d):
    path, rows = work_folder(spark) + "/x.jsonl", t(spark, d, "customer")
    files.write_dataset(rows, path)
    return files.read_dataset(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


@query("SELECT * FROM customer")
def single_file(spark, d):
    path = work_folder(spark) + "/x.parquet"
    files.write_dataset(t(spark, d, "customer"), path, single=True)
    return files.read_dataset(spark, path)


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT * EXCLUDE (rn, n), CAST(floor(rn / ceil(n / 4.0)) AS INTEGER) AS shard FROM r")
def sharded_write(spark, d):
    path = work_folder(spark)
    files.write_dataset(t(spark, d, "orders"), path, 4, "o_orderkey")
    return files.read_dataset(spark, path)


@query("SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def limit_in_order(spark, d):
    return files.first_rows(t(spark, d, "lineitem"), 1000, "l_orderkey", "l_linenumber")


@query("SELECT * FROM events LIMIT 500")
def limit_in_file_order(spark, d):
    """The table is one file, of which DuckDB also returns the first rows."""
    return files.read_dataset(spark, f"{d}/events.parquet", limit=500)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def limit_first_rows(spark, d):
    return files.first_rows(t(spark, d, "documents").select("doc_id", "lang"), 50, "doc_id")


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_id, * FROM lineitem")
def ensure_row_id(spark, d):
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return ids.ensure_id(t(spark, d, "lineitem"), default="row_id", order=order)[0]


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)")
def resume_anti_join(spark, d):
    return joins.pending(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")


@query("SELECT * FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def stray_semi_join(spark, d):
    return joins.known(t(spark, d, "labels"), t(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT * FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def stray_anti_join(spark, d):
    return joins.stray(t(spark, d, "labels"), t(spark, d, "documents").where("lang = 'en'"), "doc_id")


def _labelled(spark, d, mode):
    return joined(t(spark, d, "documents").select("doc_id", "text", "lang"), t(spark, d, "labels"), "doc_id", "text", mode)


@query("SELECT d.doc_id, text, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def append_mode(spark, d):
    return _labelled(spark, d, OutputMode.APPEND)


@query("SELECT d.doc_id, text, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def io_only_mode(spark, d):
    return _labelled(spark, d, OutputMode.IO_ONLY)


@query("SELECT doc_id, quality, toxic FROM labels")
def replace_mode(spark, d):
    return _labelled(spark, d, OutputMode.REPLACE)


@query("SELECT d.doc_id, text, d.lang AS lang_x, upper(d.lang) AS lang_y FROM documents d")
def append_collision_suffix(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", "lang")
    return joined(docs, docs.select("doc_id", F.upper("lang").alias("lang")), "doc_id", "text", OutputMode.APPEND)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def last_write_wins(spark, d):
    rows = t(spark, d, "labels").select("doc_id", "quality")
    store = Checkpoint(spark, work_folder(spark), "doc_id", rows.schema)
    store.append(rows)
    store.append(rows.where("doc_id % 2 = 0").withColumn("quality", F.expr("cast(1 - quality as int)")))
    store.compact()
    return store.latest()


@query("WITH g AS (SELECT o_orderkey % 1000 AS k, o_orderkey % 7 AS shard, o_orderkey, o_totalprice FROM orders) SELECT k, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shard DESC, o_orderkey DESC) AS rn FROM g) WHERE rn = 1")
def cross_shard_merge(spark, d):
    rows = t(spark, d, "orders").select(F.expr("o_orderkey % 1000 as k"), F.expr("o_orderkey % 7 as shard"), "o_orderkey", "o_totalprice")
    return joins.latest(rows, "k", "shard", "o_orderkey").select("k", "o_totalprice")


@query("SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT CAST(c_custkey AS INTEGER), NULL, c_mktsegment FROM customer")
def union_by_name(spark, d):
    a = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return joins.union_parts([a, t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_mktsegment").alias("segment"))])


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def done_ids_union(spark, d):
    return t(spark, d, "documents").where("lang = 'en'").select("doc_id").union(t(spark, d, "labels").select("doc_id")).distinct()


@query("""WITH a AS (SELECT CAST(o_orderkey AS UHUGEINT) AS v FROM orders),
b AS (SELECT (xor(v, v // 1073741824) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM a),
c AS (SELECT (xor(v, v // 134217728) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM b),
e AS (SELECT xor(v, v // 2147483648) AS v FROM c) SELECT CAST(v % 5 AS INTEGER) AS shard, count(*) AS n FROM e GROUP BY 1""")
def shard_by_id_counts(spark, d):
    return t(spark, d, "orders").groupBy(ids.shard_of("o_orderkey", 5, compatible=True).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, 0 AS split_ids, 0 AS out_of_range FROM orders")
def shard_by_id_native(spark, d):
    """Every row has one shard, and rows of one id have the same."""
    rows = t(spark, d, "orders").select("o_orderkey", ids.shard_of("o_orderkey", 5).alias("shard"))
    by = rows.union(rows.repartition(3)).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b"))
    return by.agg(F.expr("cast(sum(n) / 2 as bigint)").alias("n"), F.count("*").alias("ids"), F.count_if(F.expr("a <> b")).alias("split_ids"), F.count_if(F.expr("a < 0 or b > 4")).alias("out_of_range"))


@query("SELECT *, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS shard FROM orders")
def shard_by_index(spark, d):
    return ids.index_shards(t(spark, d, "orders"), "o_orderkey", 7)


@query("SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / len(embedding)), 6) AS perplexity, round(exp(list_sum(list_transform(list_sort(list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))))[1:50], lambda x: -x)) / least(50, len(embedding))), 6) AS bottom FROM embeddings")
def perplexity(spark, d):
    logs = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("l"))
    return logs.select("vec_id", F.round(M.perplexity("l"), 6).alias("perplexity"), F.round(M.bottom_perplexity("l"), 6).alias("bottom"))


@query("SELECT n_nationkey, CAST('inf' AS DOUBLE) AS perplexity FROM nation")
def perplexity_empty(spark, d):
    return t(spark, d, "nation").select("n_nationkey", M.perplexity(F.array().cast("array<double>")).alias("perplexity"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", M.content_hash("text").alias("sha"), M.content_hash("text", "md5").alias("md"))


@query("SELECT n_nationkey, array_to_string(list_transform(range(0, n_nationkey + 1, 4), lambda s: array_to_string(range(s, least(s + 4, n_nationkey + 1)), ',')), ';') AS slices FROM nation")
def device_slices(spark, d):
    n = F.col("n_nationkey") + 1
    return t(spark, d, "nation").select("n_nationkey", F.array_join(M.device_slices(n, F.lit(4)), ";").alias("slices"))


LIMITS = ["90", "10:30", "01:02:03", "2-03", "2-03:04", "1-02:03:04", "x", ""]


@query("SELECT n_nationkey, ([5400, 630, 3723, 183600, 183840, 93784, NULL, NULL])[n_nationkey % 8 + 1]::BIGINT AS seconds FROM nation")
def time_limit_seconds(spark, d):
    text = F.element_at(F.array(*[F.lit(x) for x in LIMITS]), (F.col("n_nationkey") % 8 + 1).cast("int"))
    return t(spark, d, "nation").select("n_nationkey", M.time_limit_seconds(text).alias("seconds"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, d):
    return t(spark, d, "part").select("p_partkey", M.slug("p_type").alias("slug"))


STATES = ["PENDING", "running", "COMPLETED ", "CANCELLED by 12", "TIMEOUT", "CONFIGURING", "NODE_FAIL", "OUT_OF_MEMORY", "COMPLETING", "", "odd", "RUNNING+", "PREEMPTED"]


@query("SELECT n_nationkey, (['PENDING','RUNNING','SUCCEEDED','CANCELLED','FAILED','PENDING','FAILED','FAILED','RUNNING','PENDING','FAILED','RUNNING','CANCELLED'])[n_nationkey % 13 + 1] AS status FROM nation")
def scheduler_state(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in STATES]), (F.col("n_nationkey") % 13 + 1).cast("int"))
    return t(spark, d, "nation").select("n_nationkey", M.job_status(raw).alias("status"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS job, CASE WHEN o_orderkey % 2 = 0 THEN '7.x' END AS step FROM orders")
def split_step_id(spark, d):
    raw = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".7.x").otherwise(""))
    job, step = M.step_of(raw)
    return t(spark, d, "orders").select("o_orderkey", job.alias("job"), step.alias("step"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def json_extract_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("missing"))


def _conversations(spark, d):
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"), F.lit(None).cast("string").alias("reasoning_content"))).alias("messages"))


def _flat(df, column):
    return df.select("conv_id", F.posexplode(column).alias("at", "m")).select("conv_id", "at", "m.role", "m.content")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS at, role, text AS content FROM conversations")
def messages_from_conversations(spark, d):
    return _flat(_conversations(spark, d), "messages")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 2 AS INTEGER) AS at, role, 'echo:' || text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) > 1")
def translation_echo(spark, d):
    return _flat(map_rows(_conversations(spark, d), jobs.TranslationJob(client=jobs.EchoClient()), "conv_id"), "results")


@query("""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
a AS (SELECT *, role IN ('user', 'tool') AS asked, coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY i) , -2) AS before_ FROM t WHERE role IN ('user', 'tool')),
m AS (  -- each asked turn adds the turns since two after the asked turn before it, and then its reply
  SELECT a.conv_id, a.i AS step, 0 AS part, t.i AS k, t.role, t.text AS content FROM a JOIN t ON t.conv_id = a.conv_id AND t.i >= greatest(a.before_ + 2, 0) AND t.i <= a.i
  UNION ALL SELECT conv_id, i, 1, i, 'assistant', 'echo:' || coalesce(text_, '') FROM (
    SELECT a.*, CASE WHEN a.before_ + 2 > a.i THEN 'echo:' || coalesce((SELECT b.text FROM t b WHERE b.conv_id = a.conv_id AND b.i = a.before_), '') ELSE a.text END AS text_ FROM a))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY step, part, k) - 1 AS INTEGER) AS at, role, content FROM m""")
def multi_turn_echo(spark, d):
    asked = _conversations(spark, d).where(F.exists("messages", lambda m: m["role"].isin("user", "tool")))
    return _flat(map_rows(asked, jobs.MultiTurnJob(client=jobs.EchoClient()), "conv_id"), "running_messages")


@query("SELECT doc_id, 'echo1:' || text AS result_1, 'echo2:' || text AS result_2, 'echo3:' || text AS result_3 FROM documents")
def multi_choice_echo(spark, d):
    return map_rows(t(spark, d, "documents"), jobs.ChoicesJob(client=jobs.EchoClient(), input_column="text"), "doc_id")


@query("SELECT doc_id, 'echo:' || text AS completion FROM documents")
def completion_echo(spark, d):
    return map_rows(t(spark, d, "documents"), jobs.CompletionJob(client=jobs.EchoClient(), input_column="text"), "doc_id")


@query("""WITH l AS (SELECT doc_id, text, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: -length(w) / 8.0::DOUBLE) AS l FROM documents)
SELECT doc_id, 'echo:' || text AS text, round(exp(-list_sum(l) / len(l)), 6) AS perplexity, round(exp(-list_sum(list_sort(l)[1:50]) / least(50, len(l))), 6) AS bottom50_perplexity FROM l""")
def perplexity_job(spark, d):
    out = map_rows(t(spark, d, "documents"), jobs.PerplexityJob(client=jobs.EchoClient(), input_column="text"), "doc_id")
    return out.withColumn("perplexity", F.round("perplexity", 6)).withColumn("bottom50_perplexity", F.round("bottom50_perplexity", 6))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS result FROM documents")
def map_rows_scalar(spark, d):
    return map_rows(t(spark, d, "documents"), Length(input_column="text"), "doc_id")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS a, left(text, 3) AS b FROM documents")
def map_rows_dict(spark, d):
    return map_rows(t(spark, d, "documents"), LengthDict(input_column="text"), "doc_id")


REPLICAS = """r AS (SELECT 'swarm-' || user_id % 5 AS swarm_id, CAST(user_id // 5 AS INTEGER) AS replica_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'unhealthy' WHEN 'signup' THEN 'starting' ELSE 'exited' END AS state,
event_type = 'click' AS http_ready, CASE WHEN event_type = 'error' THEN 'reason ' || event_id % 3 END AS fail_reason, ts, event_id FROM events),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY swarm_id, replica_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _replica_events(spark, d):
    kind = F.col("event_type")
    named = F.when(kind == "error", "failed").when(kind == "click", "running").when(kind == "view", "unhealthy").when(kind == "signup", "starting").otherwise("exited")
    return t(spark, d, "events").select(
        F.concat(F.lit("swarm-"), (F.col("user_id") % 5).cast("string")).alias("swarm_id"), F.expr("cast(user_id div 5 as int)").alias("replica_id"), named.alias("state"),
        (kind == "click").alias("http_ready"), F.when(kind == "error", F.concat(F.lit("reason "), (F.col("event_id") % 3).cast("string"))).alias("fail_reason"), "ts", "event_id",
    )


def _replicas(spark, d):
    return state.upsert(None, _replica_events(spark, d), ["swarm_id", "replica_id"], "ts", "event_id")


@query(f"WITH {REPLICAS} SELECT swarm_id, replica_id, state, event_id FROM s")
def latest_state_upsert(spark, d):
    return _replicas(spark, d).select("swarm_id", "replica_id", "state", "event_id")


@query(f"""WITH {REPLICAS} SELECT swarm_id, count(*) AS total, count(*) FILTER (state = 'running') AS running, count(*) FILTER (http_ready) AS http_ready, count(*) FILTER (state IN ('failed', 'exited')) AS failed FROM s GROUP BY 1""")
def replica_summary(spark, d):
    return state.replica_summary(_replicas(spark, d)).select("swarm_id", "total", "running", "http_ready", "failed")


@query(f"""WITH {REPLICAS}, c AS (SELECT swarm_id, fail_reason, count(*) AS n, min(replica_id) AS first FROM s WHERE state IN ('failed', 'exited') AND fail_reason <> '' GROUP BY 1, 2)
SELECT swarm_id, fail_reason AS example_fail_reason FROM c QUALIFY row_number() OVER (PARTITION BY swarm_id ORDER BY n DESC, first) = 1""")
def fail_reason_top1(spark, d):
    return state.replica_summary(_replicas(spark, d)).where("example_fail_reason is not null").select("swarm_id", "example_fail_reason")


@query(f"WITH {REPLICAS} SELECT swarm_id, replica_id, state, fail_reason FROM s WHERE state IN ('failed', 'exited') OR coalesce(fail_reason, '') <> ''")
def replica_failures(spark, d):
    return state.replica_failures(_replicas(spark, d)).select("swarm_id", "replica_id", "state", "fail_reason")


@query(f"""WITH {REPLICAS}, q AS (SELECT *, state IN ('failed', 'exited') AS down FROM s),
c AS (SELECT swarm_id, fail_reason, count(*) AS n, min(replica_id) AS first FROM q WHERE down AND fail_reason <> '' GROUP BY 1, 2),
f AS (SELECT swarm_id, string_agg('"' || fail_reason || '":' || n, ',' ORDER BY fail_reason) AS reasons, arg_max(fail_reason, n * 1000000 - first) AS example FROM c GROUP BY 1),
g AS (SELECT swarm_id, count(*) AS total, count(*) FILTER (state = 'running') AS running, count(*) FILTER (http_ready) AS ready, count(*) FILTER (down) AS failed,
  string_agg('{{"replica_id":' || replica_id || ',"state":"' || state || '","http_ready":' || http_ready || ',"fail_reason":' || coalesce('"' || fail_reason || '"', 'null') || ',"node":"n1","port":8000,"url":"http://n1:8000"}}', ',' ORDER BY replica_id) AS items FROM q GROUP BY 1)
SELECT g.swarm_id AS deployment_name, '{{"schema_version":1,"name":"' || g.swarm_id || '","backend":"slurm","phase":"RUNNING","state":"RUNNING","ready":' || (ready = total AND failed = 0) || ',"endpoint":"http://lb","started_at":null,"expires_at":null,"replicas":{{"summary":{{"total":' || total
  || ',"running":' || running || ',"http_ready":' || ready || ',"failed":' || failed || ',"fail_reasons":' || coalesce('{{' || reasons || '}}', 'null') || ',"example_fail_reason":' || coalesce('"' || example || '"', 'null') || '}},"items":[' || items || ']}}}}' AS json FROM g LEFT JOIN f USING (swarm_id)""")
def status_json(spark, d):
    replicas = _replicas(spark, d).withColumn("node", F.lit("n1")).withColumn("port", F.lit(8000)).drop("ts", "event_id")
    summary = state.replica_summary(replicas)
    swarms = summary.select(F.col("swarm_id").alias("deployment_name"), F.lit("slurm").alias("backend"), F.lit("RUNNING").alias("phase"), F.lit("http://lb").alias("endpoint"), F.lit(None).cast("string").alias("started_at"), F.lit(None).cast("string").alias("expires_at"))
    return state.status_json(swarms, summary, replicas)


def _jobs(spark, d):
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("dep-"), (F.col("o_custkey") % 7).cast("string")).alias("deployment_name"),
        F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("PENDING").alias("status"), F.col("o_orderdate").alias("creation_dt"),
    )


JOBS = "j AS (SELECT o_orderkey AS job_id, 'dep-' || o_custkey % 7 AS deployment_name, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status, o_orderdate AS creation_dt FROM orders)"


@query(f"WITH {JOBS} SELECT job_id, deployment_name, status FROM j ORDER BY creation_dt DESC, job_id LIMIT 50")
def jobs_newest(spark, d):
    return state.list_jobs(_jobs(spark, d)).select("job_id", "deployment_name", "status")


@query(f"WITH {JOBS} SELECT job_id, deployment_name, status FROM j WHERE deployment_name = 'dep-3' AND status IN ('RUNNING', 'PENDING') ORDER BY creation_dt DESC, job_id LIMIT 20")
def jobs_by_status(spark, d):
    return state.list_jobs(_jobs(spark, d), "dep-3", ["RUNNING", "PENDING"], 20).select("job_id", "deployment_name", "status")


@query("SELECT c_custkey, c_mktsegment || '-' || c_custkey AS name FROM customer WHERE c_mktsegment || '-' || c_custkey LIKE 'BUILDING-%'")
def names_by_prefix(spark, d):
    names = t(spark, d, "customer").select("c_custkey", F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")).alias("name"))
    return names.where(M.like_prefix("name", "BUILDING"))


@query("""WITH p AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM p)
SELECT event_id, CAST(CASE WHEN ok THEN 0 ELSE sum(1 - CAST(ok AS INTEGER)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) END AS BIGINT) AS failures FROM i""")
def consecutive_failures(spark, d):
    probes = t(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return health.failure_runs(probes, ["user_id"], ["ts", "event_id"]).select("event_id", F.col("failures").cast("long").alias("failures"))


@query("WITH p AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT event_id, event_type FROM p WHERE b IS DISTINCT FROM event_type")
def change_suppression(spark, d):
    return health.changes(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


@query(f"WITH {REPLICAS} SELECT swarm_id, replica_id, state, http_ready FROM s")
def streaming_upsert(spark, d):
    """Messages as JSON files, read as a stream, normalised, and kept as the latest state of each replica."""
    folder = work_folder(spark)
    events = _replica_events(spark, d)
    events.select("ts", "event_id", F.to_json(F.struct("swarm_id", "replica_id", "state", "http_ready", "fail_reason")).alias("value")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, event_id long, value string" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "ts timestamp, event_id long, value string").parquet(f"{folder}/in")
    health.maintain(health.normalized(stream), f"{folder}/out", ["swarm_id", "replica_id"], f"{folder}/offsets", ("ts", "event_id")).awaitTermination()
    return health.snapshot(spark, f"{folder}/out", "swarm_id string, replica_id int, state string, http_ready boolean")


@query("""WITH p AS (SELECT 'swarm-' || user_id % 5 AS swarm_id, CAST(user_id // 5 AS INTEGER) AS replica_id, CAST(event_id AS DOUBLE) AS at_, event_type <> 'error' AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY swarm_id, replica_id ORDER BY at_) AS g FROM p),
f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY swarm_id, replica_id, g ORDER BY at_) AS INTEGER) AS failures FROM i),
s AS (SELECT *, min(CASE WHEN failures >= 2 THEN at_ END) OVER (PARTITION BY swarm_id, replica_id, g) AS since FROM f)
SELECT swarm_id, replica_id, at_ AS "at", CASE WHEN failures < 2 THEN 'running' WHEN at_ - since >= 500 THEN 'failed' ELSE 'unhealthy' END AS state, failures FROM s""")
def health_states(spark, d):
    """The health state machine as a stream over probes."""
    folder = work_folder(spark)
    t(spark, d, "events").select(F.concat(F.lit("swarm-"), (F.col("user_id") % 5).cast("string")).alias("swarm_id"), F.expr("cast(user_id div 5 as int)").alias("replica_id"), F.col("event_id").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("swarm_id string, replica_id int, at double, ok boolean").parquet(f"{folder}/in")
    health.health(stream, health.Care(threshold=2, patience=500.0)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("swarm_id string, replica_id int, at double, state string, failures int").parquet(f"{folder}/out")


SILENCE, BACKOFF, RESTARTS = 150.25, 7.25, 3


@query(f"""WITH RECURSIVE p AS (SELECT 'swarm-' || user_id % 5 AS swarm_id, CAST(user_id // 5 AS INTEGER) AS replica_id, CAST(event_id + 1 AS DOUBLE) AS t, event_type = 'error' AS bad,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (  -- a replica's probes one after the other; started, silent: when a timer went off before this one
  SELECT swarm_id, replica_id, i, t, CASE WHEN bad THEN 'restarting' ELSE 'running' END AS state, false AS over, CASE WHEN bad THEN t + {BACKOFF} END AS resume, CAST(bad AS INTEGER) AS n, t AS last,
    CAST(NULL AS DOUBLE) AS started, CAST(NULL AS DOUBLE) AS silent, 0 AS before FROM p WHERE i = 1
  UNION ALL SELECT swarm_id, replica_id, i, t, CASE WHEN waits THEN NULL WHEN ended THEN 'failed' WHEN bad AND n >= {RESTARTS} THEN 'failed' WHEN bad THEN 'restarting' ELSE 'running' END,
    ended OR (NOT waits AND bad AND n >= {RESTARTS}), CASE WHEN waits THEN resume WHEN NOT ended AND bad AND n < {RESTARTS} THEN t + {BACKOFF} END,
    CASE WHEN NOT waits AND NOT ended AND bad AND n < {RESTARTS} THEN n + 1 ELSE n END, CASE WHEN waits THEN last ELSE t END, started, silent, n
  FROM (SELECT *, over OR silent IS NOT NULL AS ended FROM (SELECT *, CASE WHEN NOT over AND NOT waits AND coalesce(started, last) + {SILENCE} < t THEN coalesce(started, last) + {SILENCE} END AS silent FROM (
    SELECT e.swarm_id, e.replica_id, e.i, e.t, e.bad, s.over, s.resume, s.n, s.last, coalesce(s.resume >= e.t, false) AS waits, CASE WHEN s.resume < e.t THEN s.resume END AS started
    FROM s JOIN p e ON e.swarm_id = s.swarm_id AND e.replica_id = s.replica_id AND e.i = s.i + 1)))),
z AS (SELECT *, CASE WHEN resume < w THEN resume END AS starts FROM (SELECT *, (SELECT max(t) FROM p) AS w FROM s QUALIFY row_number() OVER (PARTITION BY swarm_id, replica_id ORDER BY i DESC) = 1) WHERE NOT over)
SELECT swarm_id, replica_id, t AS "at", state, 0 AS failures, n AS restarts FROM s WHERE state IS NOT NULL
UNION ALL SELECT swarm_id, replica_id, started, 'starting', 0, before FROM s WHERE started IS NOT NULL
UNION ALL SELECT swarm_id, replica_id, silent, 'failed', 0, before FROM s WHERE silent IS NOT NULL
UNION ALL SELECT swarm_id, replica_id, starts, 'starting', 0, n FROM z WHERE starts IS NOT NULL
UNION ALL SELECT swarm_id, replica_id, coalesce(starts, last) + {SILENCE}, 'failed', 0, n FROM z WHERE (resume IS NULL OR starts IS NOT NULL) AND coalesce(starts, last) + {SILENCE} < w""")
def replica_timers(spark, d):
    """Silence, restarts and the pause before them as timers in the state of a stream; an error is the end of a process."""
    folder = work_folder(spark)
    bad = F.col("event_type") == "error"
    probes = t(spark, d, "events").select(
        F.concat(F.lit("swarm-"), (F.col("user_id") % 5).cast("string")).alias("swarm_id"), F.expr("cast(user_id div 5 as int)").alias("replica_id"),
        (F.col("event_id") + 1).cast("double").alias("at"), (~bad).alias("ok"), F.when(bad, 1).alias("exit_code"),
    )
    probes.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("swarm_id string, replica_id int, at double, ok boolean, exit_code int").parquet(f"{folder}/in")
    out = health.watched(stream, health.Care(silence=SILENCE, backoff=BACKOFF, restarts=RESTARTS, policy="always"))
    sink = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/offsets")
    sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("swarm_id string, replica_id int, at double, state string, failures int, restarts int").parquet(f"{folder}/out")


CHANGES = """old AS (SELECT o_orderkey AS job_id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS job_id, 'again' AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 4 = 0),
patch AS (SELECT o_orderkey + 2 AS job_id FROM orders WHERE o_orderkey % 7 = 0), gone AS (SELECT o_orderkey + 5 AS job_id FROM orders WHERE o_orderkey % 10 = 0),
u AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE job_id NOT IN (SELECT job_id FROM new)),
q AS (SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM patch) THEN 'patched' ELSE status END AS status, price FROM u)"""


def _changed_jobs(spark, d):
    """A keyed table after an upsert, a patch and a deletion, and what each of them says it did."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = buckets.BucketTable(spark, work_folder(spark), ["job_id"], buckets=16)
    table.upsert(orders.where("job_id % 3 <> 0"))
    upserted = table.upsert(orders.where("job_id % 4 = 0").select("job_id", F.lit("again").alias("status"), (F.col("price") + 1).alias("price")))
    patched = table.patch(orders.where("job_id % 7 = 0").select((F.col("job_id") + 2).alias("job_id"), F.lit("patched").alias("status"), F.lit(None).cast("double").alias("price")))
    deleted = table.delete(orders.where("job_id % 10 = 0").select((F.col("job_id") + 5).alias("job_id")))
    return table, {"upsert": upserted, "patch": patched, "delete": deleted}


@query(f"WITH {CHANGES} SELECT job_id, status, price, true AS stamped FROM q WHERE job_id NOT IN (SELECT job_id FROM gone)")
def merged_jobs(spark, d):
    table, _ = _changed_jobs(spark, d)
    return table.read().select("job_id", "status", "price", F.col("update_dt").isNotNull().alias("stamped"))


@query(f"""WITH {CHANGES} SELECT 'upsert' AS what, count(*) FILTER (job_id NOT IN (SELECT job_id FROM old)) AS inserted, count(*) FILTER (job_id IN (SELECT job_id FROM old)) AS changed, 0 AS deleted, 0 AS missing FROM new
UNION ALL SELECT 'patch', 0, count(*) FILTER (job_id IN (SELECT job_id FROM u)), 0, count(*) FILTER (job_id NOT IN (SELECT job_id FROM u)) FROM patch
UNION ALL SELECT 'delete', 0, 0, count(*) FILTER (job_id IN (SELECT job_id FROM u)), count(*) FILTER (job_id NOT IN (SELECT job_id FROM u)) FROM gone""")
def merge_counts(spark, d):
    _, counts = _changed_jobs(spark, d)
    return spark.createDataFrame([(k, c.inserted, c.changed, c.deleted, c.missing) for k, c in counts.items()], "what string, inserted long, changed long, deleted long, missing long")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) SELECT * EXCLUDE (rn) FROM r WHERE rn IN (0, 5, 17, 1200)")
def positional_slice(spark, d):
    return ids.at_positions(t(spark, d, "orders"), [0, 5, 17, 1200], "o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return ids.duplicates(t(spark, d, "orders").select("o_custkey"), "o_custkey")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT * EXCLUDE (rn, n), 'data-' || lpad(CAST(CAST(floor(rn / ceil(n / 12.0)) AS INTEGER) AS VARCHAR), 2, '0') || '.parquet' AS file FROM r")
def named_shards(spark, d):
    folder = work_folder(spark)
    files.write_named_shards(t(spark, d, "orders"), folder, 12, "o_orderkey")
    return files.read_dataset(spark, folder + "/data-{00..11}.parquet").withColumn("file", F.substring_index(F.input_file_name(), "/", -1))


@query("SELECT 'event-' || event_type || '.txt' AS name, count(*) * 8 AS length, sha256(string_agg('e' || lpad(CAST(event_id % 100000 AS VARCHAR), 6, '0') || chr(10), '' ORDER BY event_id)) AS digest FROM events GROUP BY event_type")
def file_digests(spark, d):
    """A file of lines for each type of event, and what it is known by."""
    path = work_folder(spark)
    lines = t(spark, d, "events").select("event_type", F.format_string("e%06d", F.col("event_id") % 100000).alias("value"), "event_id")
    lines.coalesce(1).sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    found = blocks.content_digest(spark, path).where("path like '%.txt'")
    return found.select(F.concat(F.lit("event-"), F.regexp_extract("path", "event_type=([^/]+)/", 1), F.lit(".txt")).alias("name"), "length", "digest")


def _logs(spark, d):
    """A log for each type of event: its events' ids in order."""
    path = work_folder(spark)
    lines = t(spark, d, "events").select("event_type", F.concat(F.lit("event "), F.col("event_id")).alias("value"), "event_id")
    lines.coalesce(1).sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    return path


LOGS = "l AS (SELECT event_type AS log, 'event ' || event_id AS line, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"WITH {LOGS} SELECT log, nth - greatest(0, n - 10) AS \"at\", line FROM l WHERE nth > n - 10")
def log_tail(spark, d):
    rows = logs.log_tail(spark, _logs(spark, d))
    return rows.select(F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("log"), F.col("at").cast("long").alias("at"), "line")


@query(f"WITH {LOGS}, o AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY log ORDER BY nth) - length(line) - 1 AS BIGINT) AS \"at\" FROM l) SELECT log, \"at\", line FROM o WHERE nth > 7")
def log_drain(spark, d):
    """A stream drains logs of seven lines; then they have grown, and a second run goes on at its offsets."""
    folder, whole = work_folder(spark), _logs(spark, d)
    cls, fs = stores.hadoop(spark, folder)
    lines = spark.read.text(whole).select("event_type", "value", F.expr("cast(substr(value, 7) as long) as nth"))
    few = lines.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy("nth"))).where("rank <= 7")
    few.coalesce(1).sortWithinPartitions("event_type", "nth").select("event_type", "value").write.partitionBy("event_type").text(f"{folder}/few")
    for out, source in (("first", f"{folder}/few"), ("second", whole)):
        for part in stores.names(spark, f"{source}/event_type=*/part-*"):
            log = f"{folder}/logs/{part.split('/')[-2]}/log.txt"
            fs.mkdirs(cls(log).getParent())
            fs.delete(cls(log), False)
            fs.rename(cls(part), cls(log))
        stream = logs.log_stream(spark, f"{folder}/logs").writeStream.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True)
        stream.foreachBatch(lambda rows, n, out=out: rows.write.mode("append").parquet(f"{folder}/{out}")).start().awaitTermination()
    rows = spark.read.schema("file string, at long, line string").parquet(f"{folder}/second")
    return rows.select(F.regexp_extract("file", "event_type=([^/]+)/", 1).alias("log"), "at", "line")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'PENDING' ELSE 'INITIALIZING' END AS phase FROM orders")
def serving_phase(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 1, "TIMEOUT").when(k == 2, "CONFIGURING").otherwise("RUNNING")
    return t(spark, d, "orders").select("o_orderkey", M.serving_phase(raw, k == 0, F.lit(True)).alias("phase"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'http://' || s_name || ':' || (8000 + s_nationkey) END AS url FROM supplier")
def replica_url(spark, d):
    node = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name"))
    return t(spark, d, "supplier").select("s_suppkey", M.replica_url(node, F.col("s_nationkey") + 8000).alias("url"))


@query("SELECT CAST(coalesce(sum(s_nationkey) FILTER (s_acctbal > 0), 0) AS BIGINT) AS gpus, count(*) FILTER (s_acctbal > 0) AS nodes, coalesce(sum(s_nationkey) FILTER (s_acctbal > 0), 0) >= 8 AND count(*) FILTER (s_acctbal > 0) >= 2 AS enough FROM supplier")
def cluster_capacity(spark, d):
    nodes = t(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 0, "ALIVE").otherwise("DEAD").alias("state"), F.col("s_nationkey").alias("gpus"))
    return state.capacity(nodes, 4, 2)


@query("SELECT DISTINCT 'dep-' || o_custkey AS deployment_name FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 11 = 0")
def prune_candidates(spark, d):
    swarms = t(spark, d, "orders").select(F.concat(F.lit("dep-"), F.col("o_custkey").cast("string")).alias("deployment_name"), F.when(F.col("o_orderstatus") == "P", "STOPPED").otherwise("RUNNING").alias("phase"), F.when(F.col("o_orderkey") % 11 == 0, "timeout").alias("probe_error"))
    return state.prune_candidates(swarms)


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status, o_orderpriority AS name FROM orders WHERE o_orderkey % 10 <> 0")
def partial_update_and_delete(spark, d):
    jobs_ = t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("name"))
    updates = jobs_.where("job_id % 3 = 0").select("job_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("name"))
    return state.without(state.patched(jobs_, updates, "job_id"), jobs_.where("job_id % 10 = 0"), "job_id")
