"""Queries that run as streams."""

import uuid

from pyspark.sql import functions as F

from correspond.operators.tables import shared_dir
from correspond.plans.base import query, read
from correspond.streaming import jobs


def _events(spark, d):
    return jobs.files(spark, f"{d}/events.parquet", read(spark, d, "events").schema)


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS checksum FROM events GROUP BY 1")
def stream_append(spark, d):
    """Events in several files, a third of them sent twice, taken in by two runs of a stream, a file a batch; each counts once, as in a rebuild."""
    e = read(spark, d, "events")
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    stream = lambda: jobs.files(spark, folder, e.schema)
    e.where("event_id % 3 <> 0").repartition(3, "event_id").write.mode("append").parquet(folder)
    jobs.append_once(spark, stream(), ["event_id"], f"{folder}-stored")
    e.where("event_id % 3 <> 1").repartition(2, "event_id").write.mode("append").parquet(folder)
    rows = jobs.append_once(spark, stream(), ["event_id"], f"{folder}-stored")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("checksum"))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return jobs.daily_counts(spark, _events(spark, d), "ts", ["event_type"])


#: Uploads of an archive, each from a day that was stored before to a time in the middle of another. Fixed values.
UPLOADS = (("2024-01-01 00:00:00", "2024-01-10 13:00:00"), ("2024-01-09 00:00:00", "2024-01-20 13:00:00"), ("2024-01-18 00:00:00", "2100-01-01 00:00:00"))


def _merged(out: str, old: str, new: str) -> str:
    return f"""{out}_last AS (SELECT room, max(left(block_id, 10)) AS l FROM {old} GROUP BY 1), {out}_in AS (SELECT n.* FROM {new} n LEFT JOIN {out}_last x ON x.room = n.room WHERE left(n.block_id, 10) = x.l OR (n.room, n.block_id) NOT IN (SELECT (room, block_id) FROM {old})),
{out} AS (SELECT * FROM {out}_in UNION ALL SELECT * FROM {old} WHERE (room, block_id) NOT IN (SELECT (room, block_id) FROM {out}_in))"""


_UPLOADS = ", ".join(f"u{k} AS (SELECT event_type AS room, strftime(ts, '%Y-%m-%d') || '_' || lpad((hour(ts) // 12 + 1)::VARCHAR, 2, '0') AS block_id, count(*) AS n, {k} AS version FROM events WHERE ts >= TIMESTAMP '{low}' AND ts < TIMESTAMP '{high}' GROUP BY 1, 2)" for k, (low, high) in enumerate(UPLOADS))


@query(f"WITH {_UPLOADS}, {_merged('s1', 'u0', 'u1')}, {_merged('s2', 's1', 'u2')} SELECT * FROM s2")
def stream_replace_latest_day(spark, d):
    """Half-day blocks in three uploads that overlap, each taken in by a run of the stream: the last stored day is renewed, earlier ones stay."""
    half = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.when(F.hour("ts") < 12, "_01").otherwise("_02"))
    e = read(spark, d, "events").select(F.col("event_type").alias("room"), half.alias("block_id"), "ts")
    folder = f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    for k, (low, high) in enumerate(UPLOADS):
        upload = e.where(f"ts >= timestamp_ntz '{low}' and ts < timestamp_ntz '{high}'").groupBy("room", "block_id").agg(F.count("*").alias("n")).withColumn("version", F.lit(k))
        upload.write.mode("append").parquet(folder)
        jobs.sync_blocks(spark, jobs.files(spark, folder, upload.schema, files_a_batch=100_000), "room", f"{folder}-stored")
    return jobs.stored_blocks(spark, upload.schema, "room", f"{folder}-stored")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(spark, d):
    """Each user's sessions that are closed at the end of the stream."""
    stream = jobs.files(spark, f"{d}/events.parquet", read(spark, d, "events").schema, files_a_batch=100_000)
    s = jobs.closed_sessions(spark, stream, "ts", ["user_id"], "4 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", text("started"), text("ended"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n, max(ts) + INTERVAL 4 HOUR > (SELECT max(ts) FROM events) AS is_open FROM s GROUP BY user_id, k""")
def stream_all_sessions(spark, d):
    """Each user's sessions, open ones marked, from batches whose times overlap throughout: later ones lengthen and join sessions of earlier ones."""
    e = read(spark, d, "events")
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    e.repartition(3, "event_id").write.parquet(folder)
    s = jobs.all_sessions(spark, jobs.files(spark, folder, e.schema), "ts", ["user_id"], "4 hours", parts=4)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", text("started"), text("ended"), "n", "is_open")
