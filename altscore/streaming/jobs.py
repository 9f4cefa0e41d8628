"""Structured Streaming twins of the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as RU
from ..functions.expr import rnd, to_ntz
from ..operators import nested as N
from ..operators import portfolio as PF
from ..operators import quality as Q
from ..operators import requests as R
from ..sources import views as V
from ..sources.schemas import NESTED_APPLICATION
from ..session import stored
from ..sources.io import write
from ..sources.tables import normalise_timestamps, table_path
from .common import read_stream, run_dir, run_foreach_batch, run_to_files, run_upserts, state_on_disk, table_stream


# ---------------------------------------------------------------- T1
def nested_records(spark: SparkSession, sf_dir: str, limit: int = N.NESTED_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Self-contained application records (attributes + transaction list), and
    the ids of the applicants whose lists are over the API's limit."""
    nested, rest = N.nest_ledger(V.ledger(spark, sf_dir), limit)
    over = rest.select("applicant_id").distinct()
    a = V.applicants(spark, sf_dir).join(over, "applicant_id", "left_anti")
    empty = F.array().cast(NESTED_APPLICATION["sms_transactions"].dataType)
    rec = a.join(nested, "applicant_id", "left").withColumn(
        "sms_transactions", F.coalesce("sms_transactions", empty))
    return rec.select(*NESTED_APPLICATION.fieldNames()), over


def stream_score(spark: SparkSession, sf_dir: str, limit: int = N.NESTED_LIMIT, fmt: str = "parquet") -> DataFrame:
    """Record -> 45 features -> rule score -> decision + confidence, per
    record and stateless (the transactions travel inside the record).

    Applicants over the record limit can't be sent as one record; they are
    scored in full by the flat plan, over their own ledger rows."""
    from ..plans.q_scoring import score_of
    base = run_dir(spark, "score")
    records, over = nested_records(spark, sf_dir, limit)
    write(records, base + "/in", fmt)
    scored = N.score_records(read_stream(spark, base + "/in", NESTED_APPLICATION, fmt=fmt))
    run_to_files(scored, base + "/out", base + "/chk")
    flat = score_of(V.ledger(spark, sf_dir).join(over, "applicant_id", "left_semi"),
                    V.applicants(spark, sf_dir).join(over, "applicant_id", "left_semi"))
    return spark.read.schema(scored.schema).parquet(base + "/out").unionByName(flat)


# ---------------------------------------------------------------- T2
def stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid applications to the main sink, invalid ones (with their
    violation list) to quarantine; each micro-batch writes both sinks under
    its batch id, so a replayed batch overwrites instead of duplicating."""
    base = run_dir(spark, "validate")
    stream = V.loan_applications(spark, sf_dir, table_stream(spark, sf_dir, "orders"))

    def route(batch: DataFrame, batch_id: int):
        v = Q.with_violations(batch, RU.ALL_APPLICATION_RULES).persist()
        v.filter(F.size("violations") == 0).drop("violations").write.mode("overwrite").parquet(
            f"{base}/main/batch={batch_id}")
        v.filter(F.size("violations") > 0).write.mode("overwrite").parquet(f"{base}/quarantine/batch={batch_id}")
        v.unpersist()

    run_foreach_batch(stream, route, base + "/chk")
    return spark.read.parquet(base + "/main").select("application_id", "user_id")


# ---------------------------------------------------------------- T3 / T4
def stream_tumbling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly prediction metrics with a 1 h watermark, which lets state of
    closed hours go; updates are upserted, so the last hours are there too."""
    base = run_dir(spark, "tumbling")
    p = V.predictions(spark, sf_dir, table_stream(spark, sf_dir, "events"))
    s = p.withWatermark("prediction_timestamp", "1 hour")
    agg = s.groupBy(F.window("prediction_timestamp", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("decision") == "approve").alias("total_approvals"),
        F.avg("score").alias("avg_profitability_score"), F.avg("latency_ms").alias("avg_latency_ms"))
    out = agg.select(to_ntz("w.start").alias("period_start"), to_ntz("w.end").alias("period_end"),
                     F.lit("hourly").alias("period_type"), "total_predictions", "total_approvals",
                     rnd(F.col("avg_profitability_score"), 6).alias("avg_profitability_score"),
                     rnd(F.col("avg_latency_ms"), 6).alias("avg_latency_ms"))
    return run_upserts(out, ["period_start"], base)


WINDOW_MIN = 15            # minutes of a window, which slides by one


def stream_sliding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: requests per client in 15-minute windows sliding by 1 minute.

    The state holds one count a client and minute, not one for each of the 15 windows
    that a request is in, and lies on disk; a window is the sum of its minutes.  The watermark
    waits 14 minutes more, for a minute counts until its last window has closed."""
    base = run_dir(spark, "sliding")
    r = V.request_log(spark, sf_dir, table_stream(spark, sf_dir, "events")).select("request_id", "client", "ts")
    s = r.withWatermark("ts", f"{2 * WINDOW_MIN - 1} minutes")
    agg = s.groupBy("client", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out = agg.select("client", F.col("w.start").alias("minute"), "n")
    with state_on_disk(spark):
        minutes = run_upserts(out, ["client", "minute"], base)
    return windows_of(minutes)


def windows_of(minutes: DataFrame) -> DataFrame:
    """Windows from counts of client and minute.  Rows are dealt by client, at most one a
    minute each, before they multiply: what is shuffled grows with the minutes, not the windows."""
    parts = int(minutes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = F.sequence(F.lit(0), F.lit(WINDOW_MIN - 1))
    rows = minutes.repartition(parts, "client").select("client", "minute", "n", F.explode(ends).alias("k"))
    rows = rows.select("client", (F.col("minute") - F.make_dt_interval(mins=F.col("k"))).alias("start"), "n")
    agg = rows.groupBy("client", "start").agg(F.sum("n").alias("n_requests"))
    return agg.select("client", to_ntz("start").alias("window_start"),
                      to_ntz(F.col("start") + F.expr(f"INTERVAL {WINDOW_MIN} MINUTES")).alias("window_end"), "n_requests")


# ---------------------------------------------------------------- T5
TIMES, REQUESTS = "client string, ts_us long", "request_id long, client string, ts_us long"
LIMIT_OUT = R.RATE_LIMIT_SCHEMA + ", late boolean"


def limit_stream(stream: DataFrame, base: str, limit: int, window_us: int, delay_us: int) -> None:
    """Judges a stream of request_id, client, ts_us; ``limit_results`` reads what came of it.

    Requests arrive in any order, up to ``delay_us`` late.  A request waits until
    the watermark (the newest time seen less the delay) has passed it; then all that it has passed
    are judged in the order of time, by the batch form, which spreads a busy client
    over many tasks.  A request that the watermark had passed before its micro-batch came is
    late: others after it were judged already, so it is rejected and marked, and takes
    no quota; so is one without a time.  (Spark's own stateful operators drop late rows unseen
    and hold a client in one task.)

    The state is three tables: requests that wait, accepted times inside the
    window before the watermark, and the watermark.  Output and state lie under the batch id, and a
    micro-batch reads only the state of the one before, so a replayed micro-batch overwrites itself.
    """
    spark = stream.sparkSession
    # so that both are there if no micro-batch ever comes
    spark.createDataFrame([], LIMIT_OUT).write.mode("ignore").parquet(base + "/out/batch=-1")
    spark.createDataFrame([], "watermark long").write.mode("ignore").parquet(base + "/watermark/batch=-1")

    def run(batch: DataFrame, batch_id: int):
        out = f"{base}/out/batch={batch_id}"
        rows = batch.select("request_id", "client", "ts_us")
        waiting, carried, clock = _limit_state(spark, base, batch_id - 1)
        late = rows.where(F.col("ts_us").isNull() | (F.col("ts_us") <= F.lit(clock).cast("long")))
        rows = rows.where(F.coalesce(F.col("ts_us") > F.lit(clock).cast("long"), F.col("ts_us").isNotNull()))
        rows = stored(rows.unionByName(waiting), "limit-pool")
        newest = rows.agg(F.max("ts_us")).first()[0]
        known = [t for t in (clock, newest - delay_us if newest is not None else None) if t is not None]
        mark = F.lit(max(known, default=None)).cast("long")
        judged = R.limited(rows.where(F.col("ts_us") <= mark), limit, window_us, carried).withColumn("late", F.lit(False))
        none = F.lit(0).cast("long")
        judged = judged.unionByName(late.select("*", F.lit(False).alias("accepted"), none.alias("remaining"), none.alias("retry_after"),
                                                F.lit(True).alias("late")))
        judged.write.mode("overwrite").parquet(out)
        times = spark.read.schema(LIMIT_OUT).parquet(out).where("accepted").select("client", "ts_us").unionByName(carried)
        times.where(F.col("ts_us") > mark - window_us).write.mode("overwrite").parquet(f"{base}/accepted/batch={batch_id}")
        rows.where(F.col("ts_us") > mark).write.mode("overwrite").parquet(f"{base}/waiting/batch={batch_id}")
        spark.range(1).select(mark.alias("watermark")).write.mode("overwrite").parquet(f"{base}/watermark/batch={batch_id}")

    run_foreach_batch(stream, run, base + "/chk")


def _limit_state(spark: SparkSession, base: str, batch_id: int) -> tuple[DataFrame, DataFrame, int | None]:
    """Requests that wait, accepted times, and watermark after a micro-batch."""
    if batch_id < 0:
        return spark.createDataFrame([], REQUESTS), spark.createDataFrame([], TIMES), None
    mark = spark.read.schema("watermark long").parquet(f"{base}/watermark/batch={batch_id}").first()[0]
    return (spark.read.schema(REQUESTS).parquet(f"{base}/waiting/batch={batch_id}"),
            spark.read.schema(TIMES).parquet(f"{base}/accepted/batch={batch_id}"), mark)


def limit_results(spark: SparkSession, base: str, limit: int, window_us: int) -> DataFrame:
    """LIMIT_OUT of all requests so far: those judged, and those that still wait, as
    they would be judged if nothing else came."""
    out = spark.read.schema(LIMIT_OUT + ", batch long").parquet(base + "/out").drop("batch")
    last = spark.read.schema("watermark long, batch long").parquet(base + "/watermark").agg(F.max("batch")).first()[0]
    waiting, carried, _ = _limit_state(spark, base, -1 if last is None else last)
    return out.unionByName(R.limited(waiting, limit, window_us, carried).withColumn("late", F.lit(False)))


LIMIT_PARTS = 4            # deliveries of the log
LIMIT_DELAY_S = 24 * 3600  # by which a request arrives late, at most


def stream_rate_limit(spark: SparkSession, sf_dir: str, limit: int, window_s: int) -> DataFrame:
    """T5: the W1 limiter over the request log as it arrives, up to a day late: four
    deliveries that overlap in time, each at least one micro-batch, the stream
    stopped and resumed in between."""
    base, window_us = run_dir(spark, "ratelimit"), window_s * 1_000_000
    events = spark.read.parquet(table_path(sf_dir, "events"))
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LIMIT_DELAY_S)) * 1_000_000
    low, high = events.agg(F.min(arrival), F.max(arrival)).first()
    if low is not None:
        part = F.floor((arrival - low) * LIMIT_PARTS / (high - low + 1))
        events = events.withColumn("_part", F.coalesce(part, F.lit(0).cast("long")))
    for k in range(LIMIT_PARTS):
        (events.where(F.col("_part") == k).drop("_part") if low is not None else events).write.parquet(f"{base}/in/{k}")
        stream = normalise_timestamps(read_stream(spark, f"{base}/in/*", spark.read.parquet(table_path(sf_dir, "events")).schema))
        r = V.request_log(spark, sf_dir, stream).select("request_id", "client", F.unix_micros("ts").alias("ts_us"))
        limit_stream(r, base, limit, window_us, LIMIT_DELAY_S * 1_000_000)
        if low is None:
            break
    return limit_results(spark, base, limit, window_us).select("request_id", "client", to_ntz(F.timestamp_micros("ts_us")).alias("ts"),
                                                               "accepted", "remaining", "retry_after")


# ---------------------------------------------------------------- T6
def dedup_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Unique predictions from a source that delivers every row twice, both
    copies within the watermark; also the duplicates that the operator dropped,
    and the rows that it dropped as late."""
    base = run_dir(spark, "dedup")
    twice = table_stream(spark, sf_dir, "events").unionAll(table_stream(spark, sf_dir, "events"))
    s = V.predictions(spark, sf_dir, twice).withWatermark("prediction_timestamp", "1 hour")
    out = s.dropDuplicatesWithinWatermark(["prediction_id"])
    progress = run_to_files(out, base + "/out", base + "/chk")
    ops = [o for p in progress for o in p.get("stateOperators", [])]
    dropped = sum(o.get("customMetrics", {}).get("numDroppedDuplicateRows", 0) for o in ops)
    late = sum(o.get("numRowsDroppedByWatermark", 0) for o in ops)
    rows = spark.read.schema(out.schema).parquet(base + "/out")
    return rows.select("prediction_id", "application_id", "score", "decision"), dropped, late


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique prediction ids from a source that delivers every row twice."""
    return dedup_run(spark, sf_dir)[0]


# ---------------------------------------------------------------- T7
STATUS_OF_EVENT = """CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected'
  WHEN 'signup' THEN 'submitted' ELSE 'processing' END"""


def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes applied in order, whatever order they arrive in.

    The state store holds one row per application that had a change: its
    latest status and latest processing time.  A micro-batch writes only the
    rows it changed; they are laid over the applications at the end."""
    base = run_dir(spark, "status")
    aud = V.audit_logs(spark, sf_dir, table_stream(spark, sf_dir, "events"))
    order = F.struct(F.col("created_at"), F.col("audit_id"))
    done = F.when(F.col("event_type").isin("purchase", "error"), order)
    last = aud.groupBy("application_id").agg(
        F.max(order).alias("at"), F.max_by(F.expr(STATUS_OF_EVENT), order).alias("status"), F.max(done).alias("done"))
    changes = run_upserts(last, ["application_id"], base).select(
        "application_id", F.col("at.created_at").alias("updated_at"), F.col("at.audit_id").alias("seq"), "status",
        F.col("done.created_at").alias("processed_at"))
    apps = V.applications(spark, sf_dir).select(
        "application_id", F.col("submitted_at").alias("updated_at"), "status",
        F.lit(None).cast("timestamp").alias("processed_at"))
    out = PF.apply_updates(apps, changes, "application_id", "updated_at", "seq", ["status", "processed_at"])
    return out.select("application_id", to_ntz("updated_at").alias("updated_at"), "status",
                      to_ntz("processed_at").alias("processed_at"))
