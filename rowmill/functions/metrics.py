"""Column functions: perplexity, hashes, device slices, time limits, names, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_logprobs(content: str | Column) -> Column:
    """The non-null ``logprob`` fields of an array of structs; a null array gives an empty one."""
    return F.coalesce(F.filter(F.transform(_col(content), lambda x: x["logprob"]), lambda x: x.isNotNull()), F.array().cast("array<double>"))


def perplexity(logprobs: str | Column) -> Column:
    """exp of the negative mean; infinity for an empty or null array."""
    a = _col(logprobs).cast("array<double>")
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.exp(-total / F.size(a))).otherwise(F.lit(float("inf")))


def bottom_perplexity(logprobs: str | Column, k: int = 50) -> Column:
    return perplexity(F.slice(F.array_sort(_col(logprobs).cast("array<double>")), 1, k))


def content_hash(text: str | Column, algorithm: str = "sha256") -> Column:
    made = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in made:
        raise ValueError(f"unknown hash {algorithm}")
    return made[algorithm](_col(text))


def device_slices(n: Column, k: Column) -> Column:
    """0..n-1 in runs of k, joined by commas; the last run may be short."""
    runs = F.transform(F.sequence(F.lit(0), n - 1, k), lambda s: F.array_join(F.transform(F.sequence(s, F.least(s + k, n) - 1), lambda x: x.cast("string")), ","))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def time_limit_seconds(text: str | Column) -> Column:
    """m, m:s, h:m:s, d-h, d-h:m and d-h:m:s as seconds; null for anything else."""
    t = F.trim(_col(text))
    number = lambda pattern, i: F.coalesce(F.regexp_extract(t, pattern, i).try_cast("long"), F.lit(0))
    days, clock, pair, minutes = r"^(\d+)-(\d+)(?::(\d+))?(?::(\d+))?$", r"^(\d+):(\d+):(\d+)$", r"^(\d+):(\d+)$", r"^(\d+)$"
    return (
        F.when(t.rlike(days), number(days, 1) * 86400 + number(days, 2) * 3600 + number(days, 3) * 60 + number(days, 4))
        .when(t.rlike(clock), number(clock, 1) * 3600 + number(clock, 2) * 60 + number(clock, 3))
        .when(t.rlike(pair), number(pair, 1) * 60 + number(pair, 2))
        .when(t.rlike(minutes), number(minutes, 1) * 60)
    )


def slug(text: str | Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_col(text))), "[^a-z0-9-]", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit("swarm")).otherwise(s)


def generated_name(text: str | Column, limit: int, suffix: str | Column | None = None) -> Column:
    """A name of at most ``limit`` signs: the slug, as far as there is room, and ten signs that tell runs apart (random if not given)."""
    end = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10) if suffix is None else F.lower(F.left(_col(suffix), F.lit(10)))
    room = F.greatest(F.lit(1), F.lit(limit - 1) - F.length(end))
    return F.concat_ws("-", F.left(slug(text), room), end)


def clean_state(raw: str | Column) -> Column:
    """First word, cut at a plus sign, in capitals."""
    return F.upper(F.split_part(F.split_part(F.trim(_col(raw)), F.lit(" "), F.lit(1)), F.lit("+"), F.lit(1)))


#: Scheduler states by job status (fixed values); any other state is a failure.
PENDING = ("", "UNKNOWN", "PENDING", "CONFIGURING", "REQUEUED", "RESIZING")
RUNNING = ("RUNNING", "COMPLETING", "SUSPENDED")
CANCELLED = ("CANCELLED", "PREEMPTED", "STOPPED")
BAD = ("FAILED", "CANCELLED", "TIMEOUT", "BOOT_FAIL", "NODE_FAIL")
NO_CAPACITY = "Cannot provide a placement group"


def job_status(raw: str | Column) -> Column:
    s = clean_state(F.coalesce(_col(raw), F.lit("")))
    return F.when(s.isin(*PENDING), "PENDING").when(s.isin(*RUNNING), "RUNNING").when(s == "COMPLETED", "SUCCEEDED").when(s.isin(*CANCELLED), "CANCELLED").otherwise("FAILED")


def coerce_status(raw: str | Column, default: str | None = "PENDING") -> Column:
    """A job status in capitals; anything else is the ``default``, or an error where that is None."""
    s = F.upper(F.trim(_col(raw)))
    other = F.raise_error(F.concat(F.lit("no job status: "), F.coalesce(_col(raw).cast("string"), F.lit("null")))) if default is None else F.lit(default)
    return F.when(s.isin("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED"), s).otherwise(other)


def serving_phase(state: Column, http_ok: Column, model_ok: Column) -> Column:
    s = clean_state(F.coalesce(state, F.lit("UNKNOWN")))
    return F.when(s.isin(*BAD), "FAILED").when(s.isin("PENDING", "CONFIGURING", "UNKNOWN"), "PENDING").when(http_ok & model_ok, "RUNNING").otherwise("INITIALIZING")


def hosted_phase(state: Column, http_ok: Column) -> Column:
    """Phase of a hosted deployment: what is ready and answers runs, what is ready and does not is starting up."""
    return F.when(state.isNull(), "UNKNOWN").when(state.isin("Stopped", "Error"), "FAILED").when(state != "Ready", "PENDING").when(F.coalesce(http_ok, F.lit(False)), "RUNNING").otherwise("INITIALIZING")


def step_of(job: str | Column) -> tuple[Column, Column]:
    """Job and step of ``job.step``; without a dot the step is null."""
    c = _col(job)
    return F.substring_index(c, ".", 1), F.when(F.instr(c, ".") > 0, F.regexp_extract(c, r"^[^.]*\.(.*)$", 1))


def replica_url(node: str | Column, port: str | Column) -> Column:
    return F.concat(F.lit("http://"), _col(node), F.lit(":"), _col(port).cast("string"))


def fail_reason(exit_code: Column, signal: Column, attempt: Column, most: Column, tail: Column, longest: int = 2048) -> tuple[Column, Column]:
    """(text, retryable). ``signal`` is a name; ``tail`` the last log lines. Unknown parts are left out."""
    no_room = F.coalesce(F.contains(tail, F.lit(NO_CAPACITY)), F.lit(False))
    text = F.concat_ws(
        " | ",
        F.when(no_room, F.lit("ray_pg_insufficient_capacity")),
        F.concat(F.lit("exit_code="), exit_code.cast("string")),
        F.when(exit_code == 137, F.lit("(likely OOM / SIGKILL)")),
        F.concat(F.lit("signal="), signal.cast("string")),
        F.concat(F.lit("restart_attempt="), attempt.cast("string"), F.lit("/"), most.cast("string")),
        F.concat(F.lit("log_tail:\n"), tail),
    )
    short = F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest - 3)), F.lit("..."))).otherwise(text)
    return F.when(text == "", F.lit("unknown failure")).otherwise(short), ~no_room


def should_restart(policy: Column, exit_code: Column, count: Column, most: Column) -> Column:
    no = (exit_code == 190) | (policy == "never") | ((policy == "on-failure") & (exit_code == 0)) | (count >= most)
    return ~F.coalesce(no, F.lit(False))


def like_prefix(column: str | Column, base: str) -> Column:
    """Names that begin with ``base-``; signs special to LIKE have no meaning."""
    return _col(column).startswith(f"{base}-")
