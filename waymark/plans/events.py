"""Queries over request events: admission limits, visits, sessions; batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators import admission, reports, visits
from waymark.plans.registry import query, table
from waymark.session import work_folder
from waymark.streaming import admission as stream_admission
from waymark.streaming import visits as stream_visits


def _admit_sql(per_window: int, per_day: int, window: int) -> str:
    return f"""WITH RECURSIVE ev AS (SELECT event_type AS key, event_id, epoch_us(ts) AS us, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS recent, CAST(NULL AS DATE) AS day, 0 AS used, false AS ok, CAST(NULL AS BIGINT) AS event_id FROM ev
UNION ALL SELECT key, rn, CASE WHEN len(kept) < {per_window} AND used0 < {per_day} THEN list_append(kept, us) ELSE kept END, day,
 used0 + CASE WHEN len(kept) < {per_window} AND used0 < {per_day} THEN 1 ELSE 0 END, len(kept) < {per_window} AND used0 < {per_day}, event_id
 FROM (SELECT ev.key, ev.rn, ev.us, ev.day, ev.event_id, list_filter(w.recent, lambda x: x >= ev.us - {window * 1000000}) AS kept,
  CASE WHEN w.day = ev.day THEN w.used ELSE 0 END AS used0 FROM w JOIN ev ON ev.key = w.key AND ev.rn = w.rn + 1))
SELECT key, event_id FROM w WHERE ok"""


def _admit(spark, d, per_window, per_day, window) -> DataFrame:
    rows = admission.admit(table(spark, d, "events"), "event_type", "ts", "event_id", per_window, per_day, window)
    return rows.select("key", "event_id")


@query("E1", _admit_sql(2, 40, 3600))
def admission_hourly(spark, d) -> DataFrame:
    return _admit(spark, d, 2, 40, 3600)


@query("E1", _admit_sql(2, 10, 60))
def admission_report_profile(spark, d) -> DataFrame:
    return _admit(spark, d, *fixed.ADMISSION_PROFILES["report"], fixed.WINDOW_SECONDS)


@query("E1", _admit_sql(10, 200, 60))
def admission_chat_profile(spark, d) -> DataFrame:
    return _admit(spark, d, *fixed.ADMISSION_PROFILES["chat"], fixed.WINDOW_SECONDS)


@query("E1", _admit_sql(5, 30, 60))
def admission_login_profile(spark, d) -> DataFrame:
    return _admit(spark, d, *fixed.ADMISSION_PROFILES["login"], fixed.WINDOW_SECONDS)


_DAILY = "SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS count FROM events GROUP BY 1"


def _day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


@query("E2", _DAILY)
def daily_visits(spark, d) -> DataFrame:
    return _day_text(visits.daily_visits(table(spark, d, "events")))


@query("E2", _DAILY)
def daily_visits_added(spark, d) -> DataFrame:
    """Counts of two halves of the events, added day by day."""
    events = table(spark, d, "events")
    halves = [visits.daily_visits(events.filter(F.col("event_id") % 2 == i)) for i in (0, 1)]
    return _day_text(visits.add_visits(*halves))


@query("A22", """SELECT count(*) FILTER (CAST(ts + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-15') AS today, count(*) AS total FROM events""")
def visit_totals(spark, d) -> DataFrame:
    return reports.visit_totals(visits.daily_visits(table(spark, d, "events")), F.lit("2024-01-15").cast("date"))


@query("E3", """SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NULL OR ts - prev > INTERVAL 30 MINUTE""")
def session_first(spark, d) -> DataFrame:
    return visits.first_of_session(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


# ---- streams -----------------------------------------------------------------------------
def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("E2", _DAILY)
def stream_daily_visits(spark, d) -> DataFrame:
    root = work_folder(spark, "visits")
    stream_visits.keep_daily_counts(_stream(spark, d), f"{root}/days", f"{root}/checkpoint", once=True).awaitTermination()
    return _day_text(stream_visits.read_daily_counts(spark, f"{root}/days"))


@query("E3", "SELECT user_id || '/' || CAST(ts AS DATE) AS session, 1 AS visits FROM events GROUP BY 1")
def stream_first_visits(spark, d) -> DataFrame:
    """One visit per session id; a user's events of one day share an id."""
    root = work_folder(spark, "sessions")
    tagged = _stream(spark, d).withColumn("session", F.concat_ws("/", "user_id", F.to_date("ts").cast("string")))
    firsts = stream_visits.first_visits(tagged.select("session", "ts"))
    run = firsts.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet")
    run.start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("session").agg(F.count(F.lit(1)).alias("visits"))


@query("E3", """SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NULL OR ts - prev > INTERVAL 30 MINUTE""")
def stream_session_first(spark, d) -> DataFrame:
    """Session starts from a stream; a last event far behind all others closes what is open."""
    root = work_folder(spark, "session-starts")
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    events.write.parquet(f"{root}/in/part=0")
    events.agg(F.lit(-1).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).write.parquet(f"{root}/in/part=1")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    starts = stream_visits.session_starts(stream, "user_id", "ts", "event_id").select("user_id", "event_id")
    run = starts.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet")
    run.start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("E1", _admit_sql(2, 40, 3600))
def stream_admission_hourly(spark, d) -> DataFrame:
    root = work_folder(spark, "admission")
    with stream_admission.state_store(spark):
        decided = stream_admission.admissions(_stream(spark, d), "event_type", "ts", "event_id", 2, 40, 3600)
        run = decided.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet")
        run.start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").filter("admitted").select("key", "event_id")
