"""Event streams over the table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.registry import query, table
from weftgraph.streaming import events as E


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beyond a cursor, through a checkpointed stream."""
    stream = E.tail(E.source(spark, f"{sf_dir}/events.parquet"), 5000).select("event_id", "user_id", "event_type")
    return E.drained(stream, "tail")


@query("SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def event_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers that fire once a minute and kind, with state behind a watermark."""
    stream = E.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.fired_once(stream, "ts", ["event_type"]), "minutes")


@query("SELECT user_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, strftime(min(ts), '%H:%M:%S') AS first FROM events GROUP BY 1, 2")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.fired_daily(rows, "ts", ["user_id"], "Asia/Shanghai").withColumn("first", F.date_format("first", "HH:mm:ss"))


@query("SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def overdue_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = E.overdue(events.where("event_type = 'signup'"), events.where("event_type = 'purchase' and value > 95"), "user_id", "ts", F.lit("2024-01-20").cast("timestamp"))
    return found.select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' ELSE 'completed' END AS status, ts FROM events)
WHERE status = 'queued' OR (status = 'running' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 120 SECOND)""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("case event_type when 'click' then 'queued' when 'view' then 'running' else 'completed' end").alias("status"), F.col("ts").cast("timestamp").alias("heartbeat"))
    return E.stale(rows, F.lit("2024-01-15").cast("timestamp")).select("event_id")


GAP = "g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events)"


@query(f"WITH {GAP} SELECT user_id, event_id, (d // 1000000)::BIGINT AS seconds FROM g WHERE d >= 43200 * 1000000::BIGINT")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of users of twelve hours or more."""
    return E.gaps(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 43200, "event_id")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 43200000 THEN 0 ELSE 1 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m),
s AS (SELECT user_id, k, count(*) AS n, min(t) AS opened, max(t) AS closed FROM g GROUP BY ALL), x AS (SELECT *, max(k) OVER (PARTITION BY user_id) AS last_k, max(closed) OVER () AS top FROM s)
SELECT user_id, n, opened, closed FROM x WHERE k < last_k OR closed + 43200000 < top - 3600000""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that twelve hours of silence end, by custom state; those still open are not given."""
    stream = E.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.sessions(stream, "user_id", "ts", 43200), "sessions")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN -2 WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 END AS step FROM events WHERE event_type IN ('signup', 'error', 'click', 'purchase')),
k AS (SELECT *, sum((step = 2)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e),
r AS (SELECT *, sum(CASE WHEN abs(step) = 1 THEN step ELSE 0 END) OVER (PARTITION BY user_id, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS flying FROM k),
s AS (SELECT user_id, session, min(t) FILTER (WHERE step = 2) AS opened, min(t) FILTER (WHERE step = -2) AS down FROM r GROUP BY ALL),
n AS (SELECT *, lead(opened) OVER (PARTITION BY user_id ORDER BY session) AS nxt, (SELECT max(t) - 3600000 FROM e) AS mark FROM s),
aged AS (SELECT n.user_id, n.opened, n.nxt, n.mark, CASE WHEN arg_max(r.flying, (r.t, r.event_id)) FILTER (WHERE r.t < n.opened + 86400000) <= 0 THEN n.opened + 86400000 ELSE min(r.t) FILTER (WHERE r.t >= n.opened + 86400000 AND r.flying <= 0) END AS due
  FROM n JOIN r ON r.user_id = n.user_id AND r.session = n.session WHERE n.opened IS NOT NULL GROUP BY n.user_id, n.opened, n.nxt, n.mark)
SELECT user_id, 'disconnected' AS reason, coalesce(opened, -1) AS opened, down + 21600000 AS due FROM n WHERE down IS NOT NULL AND down + 21600000 < coalesce(nxt, mark) AND down + 21600000 <= mark
UNION ALL SELECT user_id, 'aged', opened, due FROM aged WHERE due < coalesce(nxt, mark + 1) AND due <= mark""")
def event_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as connections: signups bring them up, errors take them down, clicks begin and purchases end an answer; six hours of grace, a day at most, by timers."""
    stream = E.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.expr(f"case event_type when 'signup' then {E.UP} when 'error' then {E.DOWN} when 'click' then 1 when 'purchase' then -1 end")
    return E.drained_with_timers(E.watchdog(stream, "user_id", "ts", step, "event_id", 6 * 3600, 24 * 3600), "watchdog")
