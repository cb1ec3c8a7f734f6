"""Roll-ups of the activity log: the last lines, the state of each job, device changes and change detection.

Events carry an ordinal `ord`; the last one of a job is the one of the greatest ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import fill_template
from speechframe.functions.typed import as_str, leaf, render_param


def tail(lines: DataFrame, limit: int = S.TAIL_LINES) -> DataFrame:
    """The last lines (ord, value) that hold a JSON object, as (ord, entry variant). The limit counts before broken lines drop out."""
    last = lines.orderBy(F.desc("ord")).limit(limit)
    return last.select("ord", F.try_parse_json("value").alias("entry")).where(F.schema_of_variant("entry").startswith("OBJECT"))


def keep_last(lines: DataFrame, keep: int = S.KEEP_LINES) -> DataFrame:
    """What stays of a log after trimming."""
    return lines.orderBy(F.desc("ord")).limit(keep)


def gpu_jobs(events: DataFrame) -> DataFrame:
    """job, code, busy: each job's last code among those that take or release the card."""
    codes = [*S.GPU_CODES, *S.RELEASE_CODES]
    last = events.where(F.col("code").isin(*codes) & F.col("job").isNotNull()).groupBy("job").agg(F.max_by("code", "ord").alias("code"))
    return last.withColumn("busy", F.col("code").isin(*S.GPU_CODES))


def gpu_is_busy(events: DataFrame, worker_running: bool = True) -> DataFrame:
    """One row, busy: whether any job holds the card while the worker runs."""
    return gpu_jobs(events).agg(F.coalesce(F.bool_or("busy"), F.lit(False)).alias("busy")).withColumn("busy", F.col("busy") & F.lit(worker_running))


def job_stages(events: DataFrame) -> DataFrame:
    """job, stage, failed: the stage of the last code that has one (0 without any), and whether the job ever failed."""
    stage = F.try_element_at(F.create_map(*[F.lit(x) for pair in S.STAGES.items() for x in pair]), F.col("code"))
    e = events.where("job IS NOT NULL").withColumn("__s", stage)
    last = F.max_by("__s", F.when(F.col("__s").isNotNull(), F.col("ord")))
    return e.groupBy("job").agg(F.coalesce(last, F.lit(0)).alias("stage"), F.coalesce(F.bool_or(F.col("code") == "job_failed"), F.lit(False)).alias("failed"))


def log_lines(events: DataFrame, limit: int = 60) -> DataFrame:
    """ord, clock, text: the last events, with the time of day out of their ISO stamp."""
    return events.orderBy(F.desc("ord")).limit(limit).select("ord", F.substring("ts", 12, 8).alias("clock"), "text")


def render_messages(events: DataFrame, messages: DataFrame, lang: str = "th", default: str = "th") -> DataFrame:
    """events (code, params map<string,string>) with text: the code's template in lang, else in the default language, else the code."""
    own = messages.where(F.col("lang") == lang).select("code", F.col("template").alias("__own"))
    fallback = messages.where(F.col("lang") == default).select("code", F.col("template").alias("__fallback"))
    d = events.join(own, "code", "left").join(fallback, "code", "left")
    return d.withColumn("text", fill_template(F.coalesce("__own", "__fallback", "code"), F.coalesce("params", F.create_map().cast("map<string,string>")))).drop("__own", "__fallback")


def public_activity(entries: DataFrame, messages: DataFrame, lang: str = "th") -> DataFrame:
    """ord, ts, job, code, level, path, text of log entries (ord, entry variant): typed leaves, of the params the path alone, and the rendered text."""
    raw = F.coalesce(F.try_variant_get("entry", "$.params", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    params = F.map_filter(F.transform_values(raw, lambda k, v: render_param(v)), lambda k, v: v.isNotNull())
    field = lambda n: as_str(leaf(F.col("entry"), "$." + n))
    e = entries.select("ord", *[field(n).alias(n) for n in ("ts", "job", "level")], F.coalesce(field("code"), F.lit("")).alias("code"), F.left(field("params.path"), F.lit(S.PARAM_CHARS)).alias("path"), params.alias("params"))
    return render_messages(e, messages, lang).select("ord", "ts", "job", "code", "level", "path", "text")


def device_changes(polls: DataFrame) -> DataFrame:
    """stream, ts, old, new where a stream's polled name differs from the one before; polls that failed (null) are ignored."""
    w = W.partitionBy("stream").orderBy("ts")
    return polls.where("name IS NOT NULL").withColumn("old", F.lag("name").over(w)).where("old IS NOT NULL AND old <> name").select("stream", "ts", "old", F.col("name").alias("new"))


def signature(columns: list[str]) -> Column:
    """One digest of all that a view shows; it changes where the view does."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def redraws(states: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The states that differ from the one before."""
    w = W.partitionBy(key).orderBy(order)
    s = states.withColumn("signature", signature(columns))
    return s.withColumn("__before", F.lag("signature").over(w)).where(~F.col("__before").eqNullSafe(F.col("signature"))).drop("__before")


def companion_snapshot(busy: DataFrame, configured: bool, running: bool) -> DataFrame:
    """state, can_start, blocked_by: what a client may do with the companion process; busy is gpu_is_busy's row."""
    blocked = F.when(F.lit(not configured), "not_configured").when(F.col("busy"), "gpu_busy")
    return busy.select(F.lit("running" if running else "off").alias("state"), (blocked.isNull() & F.lit(not running)).alias("can_start"), blocked.alias("blocked_by"))


def worst_status(checks: DataFrame) -> DataFrame:
    """status, n, report of checks (ord, status, text): the worst of fail, warn and ok, and one line for each check."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    g = checks.agg(F.max_by("status", rank).alias("status"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("["), "status", F.lit("] "), "text").alias("t")))).alias("l"))
    return g.select("status", "n", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("report"))


def recorder_state(events: DataFrame) -> DataFrame:
    """session, status, since, elapsed: each session's last status, with the seconds since its start while it records. events: session, ts, status, ord."""
    g = events.groupBy("session").agg(F.max_by("status", "ord").alias("status"), F.min(F.when(F.col("status") == "recording", F.col("ts"))).alias("since"), F.max("ts").alias("__now"))
    seconds = F.unix_micros(F.col("__now").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return g.withColumn("elapsed", F.when(F.col("status") != "idle", F.call_function("div", seconds, F.lit(1_000_000)))).drop("__now")


def providers_known(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """requests (model_id) with status and detail: no summary or a known model is ok, an unknown one a warning that lists the known.

    The list is one text, the same for all warnings.
    """
    names = providers.where("model_id IS NOT NULL").select("model_id").distinct()
    listed = names.agg(F.array_join(F.array_sort(F.collect_list("model_id")), ", ")).first()[0]
    d = requests.join(names.withColumn("__known", F.lit(True)), "model_id", "left").select(*requests.columns, "__known")
    ok = F.coalesce(F.col("__known"), F.lit(False)) | F.coalesce(F.col("model_id") == S.NO_SUMMARY_MODEL, F.lit(False))
    return d.withColumn("status", F.when(ok, "ok").otherwise("warn")).withColumn("detail", F.when(~ok, F.lit(listed))).drop("__known")
