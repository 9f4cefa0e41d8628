"""Request-log analytics: rate limiting, sliding counts,
client keys, latency percentiles, counters and histograms.
"""

from __future__ import annotations

import itertools
import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.expr import rnd, to_ntz
from ..session import scratch_path, stored

# FIXED VALUES: default latency histogram bucket bounds (seconds).
LATENCY_BUCKETS_S = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

RATE_LIMIT_SCHEMA = ("request_id long, client string, ts_us long, accepted boolean, "
                     "remaining long, retry_after long")


# What a range of the log gives: the accepted times it was handed (kind 0), its requests
# judged (1), and the accepted times that it hands on (2), for the client it ends with.
_RANGE_SCHEMA = "_pid int, kind int, " + RATE_LIMIT_SCHEMA
_CARRIED, _REQUEST, _STATE = range(3)
EAGER_ROUNDS = 3           # rounds in which all ranges with a new state run again, and not only the first of a row of them


def _limiter(limit: int, window_us: int):
    """State machine over rows sorted by (_pid, client, ts, carried first, id).

    The state is the deque of accepted request times still inside the window
    (at most ``limit`` entries), so memory is O(limit) whatever the volume; the
    partition is consumed as a stream of Arrow batches.  Carried rows were
    accepted earlier: they fill the deque and are not judged.
    """
    def run(batches):
        pid, client, acc = None, None, deque()

        def handed_on():
            n = len(acc) if pid is not None else 0
            return pd.DataFrame({"_pid": [pid] * n, "kind": _STATE, "request_id": pd.array([None] * n, dtype="Int64"),
                                 "client": pd.array([client] * n, dtype="object"), "ts_us": list(acc) if n else [],
                                 "accepted": True, "remaining": 0, "retry_after": 0})

        for pdf in batches:
            n = len(pdf)
            accepted = [False] * n
            remaining = [0] * n
            retry = [0] * n
            pids, clients = pdf["_pid"].tolist(), pdf["client"].tolist()
            times, kinds = pdf["ts_us"].tolist(), pdf["kind"].tolist()
            for i in range(n):
                t = times[i]
                if pids[i] != pid:
                    if acc:
                        yield handed_on()
                    pid, client, acc = pids[i], clients[i], deque()
                elif clients[i] != client:
                    client, acc = clients[i], deque()
                cutoff = t - window_us
                while acc and acc[0] <= cutoff:      # strictly newer than the cutoff survive
                    acc.popleft()
                if kinds[i] == _CARRIED:
                    acc.append(t)
                    accepted[i] = True
                elif len(acc) >= limit:
                    retry[i] = max(0, (acc[0] + window_us - t) // 1_000_000)
                    remaining[i] = max(0, limit - len(acc))
                else:
                    acc.append(t)
                    accepted[i] = True
                    remaining[i] = max(0, limit - len(acc))
            yield pdf[["_pid", "kind", "request_id", "client", "ts_us"]].assign(accepted=accepted, remaining=remaining, retry_after=retry)
        if acc:
            yield handed_on()
    return run


_SORT = ["_pid", "client", "ts_us", "kind", "request_id"]


def limited(requests: DataFrame, limit: int, window_us: int, carried: DataFrame | None = None) -> DataFrame:
    """RATE_LIMIT_SCHEMA of request_id, client, ts_us; ``carried`` (client, ts_us)
    are times that were accepted earlier.

    The log is sorted into ranges of (client, time), each one task, so a client that never
    pauses is many tasks.  Every range first runs from an empty state and hands on the
    accepted times of the last window for the client it ends with.  A range that begins with
    that client and was given another state than this one runs again; so until nothing
    changes, which is exactly the answer of one pass.  A range forgets what is a window old: where clients
    stay below the limit or pause, the second round settles all.  A client beyond the limit for a long
    time may need a round for each of its ranges; after a few rounds only the first of
    neighbouring changed ranges runs, so all rows are judged a few times at most.
    """
    spark = requests.sparkSession
    base = scratch_path(spark, f"limited-{uuid.uuid4().hex}")
    rows = requests.select("request_id", "client", "ts_us", F.lit(_REQUEST).alias("kind"))
    if carried is not None:
        rows = rows.unionByName(carried.select(F.lit(None).cast("long").alias("request_id"), "client", "ts_us", F.lit(_CARRIED).alias("kind")))
    run = _limiter(limit, window_us)
    ranges = rows.repartitionByRange("client", "ts_us", "kind", "request_id").withColumn("_pid", F.spark_partition_id())
    columns = ["_pid", "kind", "request_id", "client", "ts_us"]
    ranges = ranges.select(*columns).sortWithinPartitions(*_SORT)
    # a folder for each range: later rounds read those they run
    ranges.mapInPandas(run, _RANGE_SCHEMA).write.partitionBy("_pid").parquet(f"{base}/round=0")

    def judged(n: int) -> DataFrame:
        return spark.read.schema(_RANGE_SCHEMA).parquet(f"{base}/round={n}")

    first = judged(0)
    ends = first.where(F.col("kind") != _STATE).groupBy("_pid").agg(
        F.min(F.struct("client", "ts_us")).alias("first"), F.max(F.struct("client")).alias("last"))
    order = Window.orderBy("_pid")                             # one row per range
    ends = ends.select("_pid", F.col("last.client").alias("_last"), F.lead("_pid").over(order).alias("_next"), F.lead("first").over(order).alias("_then"))
    # client that goes on in the next range, and from when its times matter there
    ends = stored(ends.where(F.col("_last").eqNullSafe(F.col("_then.client")) & F.col("_next").isNotNull())
                  .select("_pid", "_next", F.col("_then.ts_us").alias("_from")), "limited-ends")
    latest: dict[int, int] = {}                                # range -> its last round, where it is not 0
    used = None                                                # states that ranges were given, by range

    def newest() -> DataFrame:
        out = first.where(~F.col("_pid").isin(list(latest))) if latest else first
        for n in sorted(set(latest.values())):
            out = out.unionByName(judged(n).where(F.col("_pid").isin([p for p, m in latest.items() if m == n])))
        return out

    for n in itertools.count(1):
        state = newest().where(F.col("kind") == _STATE).select("_pid", "client", "ts_us").join(ends, "_pid")
        state = stored(state.where(F.col("ts_us") > F.col("_from") - window_us).select(F.col("_next").alias("_pid"), "client", "ts_us"), "limited-states")

        def times(d):
            return d.groupBy("_pid").agg(F.array_sort(F.collect_list("ts_us")).alias("t"))       # ``limit`` times at most
        if used is None:
            changed = [r._pid for r in state.select("_pid").distinct().collect()]
        else:
            both = times(state).join(times(used).withColumnRenamed("t", "u"), "_pid", "full")
            changed = [r._pid for r in both.where(~F.col("t").eqNullSafe(F.col("u"))).select("_pid").collect()]
        if not changed:
            break
        follows = {r._next: r._pid for r in ends.collect()}
        again = set(changed)
        if n > EAGER_ROUNDS:
            again = {p for p in changed if follows[p] not in again}
        again = sorted(again)
        given = state.where(F.col("_pid").isin(again))
        rows = first.where(F.col("_pid").isin(again) & (F.col("kind") != _STATE)).select(*columns)
        rows = rows.unionByName(given.select("_pid", F.lit(_CARRIED).alias("kind"), F.lit(None).cast("long").alias("request_id"), "client", "ts_us"))
        rows = rows.repartition("_pid").sortWithinPartitions(*_SORT)
        rows.mapInPandas(run, _RANGE_SCHEMA).write.partitionBy("_pid").parquet(f"{base}/round={n}")
        used = given if used is None else used.where(~F.col("_pid").isin(again)).unionByName(given)
        latest |= dict.fromkeys(again, n)
    return newest().where(F.col("kind") == _REQUEST).select("request_id", "client", "ts_us", "accepted", "remaining", "retry_after")


def rate_limit(requests: DataFrame, limit: int = K.RATE_LIMIT_REQUESTS,
               window_s: int = K.RATE_LIMIT_WINDOW_S) -> DataFrame:
    """W1 + W2: accept a request iff fewer than ``limit`` *accepted* requests
    of the same client lie in the last ``window_s`` seconds (rejected ones are
    not recorded); remaining quota and retry-after per request.

    Work is dealt out by ranges of (client, time), so a busy client is many tasks."""
    out = limited(requests.select("request_id", "client", F.unix_micros("ts").alias("ts_us")), limit, window_s * 1_000_000)
    return out.select("request_id", "client", to_ntz(F.timestamp_micros("ts_us")).alias("ts"),
                      "accepted", "remaining", "retry_after")


def sliding_request_count(requests: DataFrame, window_s: int = K.RATE_LIMIT_WINDOW_S) -> DataFrame:
    """Raw requests of the client in the trailing window before this one
    (cutoff exclusive; requests at the same instant count, as in a RANGE frame).

    n_recent = C(<= t) - C(<= t - W) - 1, with C the client's running count of
    requests.  Both counts come from one keyed running sum over the client's
    distinct instants plus one probe row per request at t - W (ordered after
    a real instant at the same time), so a hot client is spread over many
    tasks instead of one window partition.
    """
    from .ordered import keyed_cumsum
    w_us = window_s * 1_000_000
    t = F.unix_micros("ts")
    base = requests.select("request_id", "client", t.alias("t"))
    inst = base.groupBy("client", "t").agg(F.count(F.lit(1)).alias("c")).withColumn("probe", F.lit(0))
    probes = base.select("client", (F.col("t") - w_us).alias("t"), F.lit(0).cast("long").alias("c"),
                         F.lit(1).alias("probe"), "request_id")
    u = inst.withColumn("request_id", F.lit(None).cast("long")).unionByName(probes)
    cum = keyed_cumsum(u, "client", ["t", "probe", "request_id"], "c", "cum")
    upto_t = cum.filter(F.col("probe") == 0).select("client", "t", F.col("cum").alias("c_t"))
    before = cum.filter(F.col("probe") == 1).select("request_id", F.col("cum").alias("c_before"))
    out = (base.join(upto_t, ["client", "t"]).join(before, "request_id")
           .select("request_id", "client", (F.col("c_t") - F.col("c_before") - 1).alias("n_recent")))
    return out


def client_key() -> F.Column:
    """First X-Forwarded-For entry, else X-Real-IP, else host, else 'unknown'."""
    xff, real, host = F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("client_host")
    return (F.when(F.coalesce(F.length(xff), F.lit(0)) > 0, F.trim(F.split_part(xff, F.lit(","), F.lit(1))))
            .when(F.coalesce(F.length(real), F.lit(0)) > 0, real)
            .otherwise(F.coalesce(host, F.lit("unknown"))))


def latency_metrics(requests: DataFrame, keep_last: int = K.LATENCY_KEEP_LAST) -> DataFrame:
    """Totals over all requests; mean and nearest-rank percentiles (index
    floor(n x p) of the ascending list) over the newest ``keep_last``."""
    tot = requests.agg(F.count(F.lit(1)).alias("total_requests"),
                       F.count_if(F.col("status") >= 500).alias("total_errors"))
    last = requests.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(keep_last)
    # At most keep_last rows by construction (the cap is the feature).
    ranked = last.select("latency_ms", F.row_number().over(
        Window.orderBy("latency_ms", "request_id")).alias("rk"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))

    def at(p):
        idx = F.floor(F.col("n") * p) if p != 0.5 else F.floor(F.col("n") / 2)
        return F.max(F.when(F.col("rk") == idx + 1, F.col("latency_ms")))

    pct = ranked.agg(F.avg("latency_ms").alias("avg"), at(0.5).alias("p50"), at(0.95).alias("p95"),
                     at(0.99).alias("p99"))
    j = tot.withColumn("_k", F.lit(1)).join(pct.withColumn("_k", F.lit(1)), "_k")
    return j.select("total_requests", "total_errors",
                    rnd(F.col("total_errors") / F.greatest(F.col("total_requests"), F.lit(1)), 9).alias("error_rate"),
                    *[F.coalesce(rnd(F.col(c), 2), F.lit(0.0)).alias(f"{c}_latency_ms")
                      for c in ("avg", "p50", "p95", "p99")])


def endpoint_status_counts(requests: DataFrame) -> DataFrame:
    """Requests per 'METHOD path' and per status."""
    ep = requests.groupBy(F.concat_ws(" ", "method", "endpoint").alias("key")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("endpoint").alias("kind"), "key", "n")
    st = requests.groupBy(F.col("status").cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "key", "n")
    return ep.unionByName(st)


def score_buckets(df: DataFrame, score_col: str, bounds=K.SCORE_BUCKET_BOUNDS) -> DataFrame:
    """Cumulative histogram (count of scores <= bound), plus +Inf."""
    s = F.col(score_col)
    cols = [F.count_if(s <= b).alias(f"le_{b}") for b in bounds] + [F.count(s).alias("le_inf")]
    names = [f"le_{b}" for b in bounds] + ["le_inf"]
    agg = df.agg(*cols).unpivot([], names, "bucket", "count")
    return agg.select(F.when(F.col("bucket") == "le_inf", F.lit("+Inf"))
                      .otherwise(F.regexp_replace("bucket", "le_", "")).alias("le"), "count")


def labelled_counters(requests: DataFrame, labels=("method", "endpoint", "status")) -> DataFrame:
    """Request counter and latency histogram by the given labels."""
    sec = F.col("latency_ms") / 1000.0
    aggs = [F.count(F.lit(1)).alias("requests"), rnd(F.sum(sec), 9).alias("latency_sum_s")]
    aggs += [F.count_if(sec <= b).alias("le_" + str(b).replace(".", "_")) for b in LATENCY_BUCKETS_S]
    return requests.groupBy(*labels).agg(*aggs)


def uptime_window(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """The API metrics row, with approval rate, last-hour volume and
    cache hit rate computed from the data."""
    lm = latency_metrics(requests)
    # one row, joined on a constant key
    now = requests.agg(F.max("ts").alias("now")).withColumn("_k", F.lit(1))
    rq = requests.withColumn("_k", F.lit(1)).join(F.broadcast(now), "_k").agg(
        F.count_if(F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("predictions_last_hour"),
        rnd(F.count_if("cache_hit") / F.count(F.lit(1)), 9).alias("cache_hit_rate"))
    pr = predictions.agg(rnd(F.count_if(F.col("decision") == "approve") / F.count(F.lit(1)), 9)
                         .alias("approval_rate"))
    j = (lm.withColumn("_k", F.lit(1)).join(rq.withColumn("_k", F.lit(1)), "_k")
         .join(pr.withColumn("_k", F.lit(1)), "_k"))
    return j.select(F.col("total_requests").alias("total_predictions"), "predictions_last_hour",
                    "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate", "approval_rate",
                    "cache_hit_rate")
