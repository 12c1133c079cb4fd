"""Append jobs as Structured Streaming."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from correspond.operators.tables import shared_dir
from correspond.sources.snapshots import Snapshots


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there, batch by batch."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def files(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files under a folder, or of one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def _parts(spark: SparkSession, at: str, schema, number: int | None = None) -> DataFrame:
    """The parts that batches left in a folder (those before a batch), by one path: only columns that are asked for are read."""
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(at)
    return (rows if number is None else rows.where(F.col("batch") < number)).select([f.name for f in schema])


def append_once(spark: SparkSession, stream: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Rows of a stream whose key was not seen before, over all batches and, at the same folder `at`, over all runs: a run goes on where the last one ended.

    Each batch adds a part with its new rows; the ledger is the key columns of earlier
    parts. A batch that is run again after a failure replaces its own part, so each row
    counts once, and state doesn't grow in memory.
    """
    at = at or f"{shared_dir(spark)}/append-{uuid.uuid4().hex}"
    _started(spark, at, stream.schema)

    def each(batch, number):
        known = _parts(spark, at, [batch.schema[k] for k in keys], number)
        batch.dropDuplicates(keys).join(known, keys, "left_anti").write.mode("overwrite").parquet(f"{at}/batch={number}")

    run_batches(stream, each, f"{at}-checkpoint")
    return _parts(spark, at, stream.schema)


def append_or_rebuild(spark: SparkSession, stream: DataFrame, keys: list[str], at: str, mode: str = "append") -> DataFrame:
    """append_once at a folder; in mode `rewrite`, or where an append finds nothing new, the rows are taken in anew from the start, in a folder of their own that replaces nothing until it is complete."""
    if mode == "append":
        before = _parts(spark, at, stream.schema).count() if _exists(spark, at) else 0
        rows = append_once(spark, stream, keys, at)
        if rows.count() > before:
            return rows
    return append_once(spark, stream, keys, f"{at}-rebuilt-{uuid.uuid4().hex}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def daily_counts(spark: SparkSession, stream: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """Messages of each key and day by event time, however late a row comes: each batch adds a part of its own counts, a batch that is run again replaces it, and the parts are summed."""
    out = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    count = lambda rows: rows.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    schema = count(spark.createDataFrame([], stream.schema)).schema
    _started(spark, out, schema)
    run_batches(stream, lambda batch, number: count(batch).write.mode("overwrite").parquet(f"{out}/batch={number}"), f"{out}-checkpoint")
    return spark.read.schema(schema).parquet(f"{out}/*").groupBy(*keys, "day").agg(F.sum("n").alias("n"))


def _started(spark: SparkSession, at: str, schema) -> None:
    """An empty first part, so that a stream without rows has a result too."""
    if not _exists(spark, f"{at}/batch=-1"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{at}/batch=-1")


def sync_blocks(spark: SparkSession, stream: DataFrame, owner: str, at: str) -> None:
    """Takes in new blocks (owner, block_id, ...): unknown ids, and new versions of blocks of the owner's last stored day, as that day was still growing.

    Each batch adds a part with the rows that it accepted and no part is written
    anew, so that a run costs what arrives and the ids of what is stored; a batch
    that is run again replaces its own part. A batch holds a block once. Called
    again with the same folder, it goes on where it ended.
    """
    schema, day = stream.schema, F.substring("block_id", 1, 10)
    _started(spark, at, schema)

    def each(batch, number):
        old = _parts(spark, at, [schema[owner], schema["block_id"]], number)
        last = old.groupBy(owner).agg(F.max(day).alias("_last"))
        known = old.distinct().withColumn("_known", F.lit(True))
        rows = batch.join(last, owner, "left").join(known, [owner, "block_id"], "left")
        rows.where(F.col("_known").isNull() | (day == F.col("_last"))).select(schema.names).write.mode("overwrite").parquet(f"{at}/batch={number}")

    run_batches(stream, each, f"{at}-checkpoint")


def stored_blocks(spark: SparkSession, schema, owner: str, at: str) -> DataFrame:
    """What sync_blocks keeps at a folder: of each block the version that came last."""
    parts = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(at)
    rest = [n for n in schema.names if n not in (owner, "block_id")]
    return parts.groupBy(owner, "block_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(owner, "block_id", "r.*")


def closed_sessions(spark: SparkSession, stream: DataFrame, at: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """(keys, started, ended, n): runs of messages with at most `gap` between them, each given once, when no message can join it any more; ended is a gap after the last."""
    out = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    s = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).groupBy(*keys, F.session_window("_at", gap).alias("w")).agg(F.count("*").alias("n"))
    rows = s.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")
    _started(spark, out, rows.schema)
    run_batches(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), f"{out}-checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{out}/*")


def joined_sessions(spans: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """spans(keys, started, ended, n), single messages or sessions, in any order -> sessions: spans with at most `gap` between them are one."""
    order = Window.partitionBy(*keys).orderBy("started", "ended")
    before = F.max("ended").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("started") > before + F.expr(f"interval {gap}"), F.lit(True))
    numbered = spans.withColumn("_fresh", fresh.cast("int")).withColumn("_s", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_s").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n")).drop("_s")


def all_sessions(spark: SparkSession, stream: DataFrame, at: str, keys: list[str], gap: str, folder: str | None = None, late: str = "0 seconds", parts: int = 16) -> DataFrame:
    """(keys, started, ended, n, is_open): all sessions of what a stream has brought so far, those that may still grow among them; ended is the last message.

    Sessions are kept as snapshots by key. A batch is first joined into sessions by itself; with the stored ones of its keys they become new sessions, so a late
    message lengthens a session or makes two of them one, and a replayed batch has no effect. A session is open as long as its end, the gap and `late` reach beyond the newest
    message. Without a watermark nothing is dropped; a key's sessions, not its messages, meet in one task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "started timestamp_ntz", "ended timestamp_ntz", "n bigint"])
    store = Snapshots(spark, folder or f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}", schema, keys, parts)

    def each(batch, number):
        time = F.col(at).cast("timestamp_ntz")
        # Many messages of one minute are one span before they meet those of other minutes.
        spans = batch.where(F.col(at).isNotNull()).groupBy(*keys, F.date_trunc("minute", time).alias("_m")).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("_m") if gap_is_long else batch.where(F.col(at).isNotNull()).select(*keys, time.alias("started"), time.alias("ended"), F.lit(1).cast("long").alias("n"))
        store.change(spans, lambda old, new: joined_sessions(old.unionByName(new), keys, gap), number)

    gap_is_long = spark.range(1).select(F.expr(f"interval {gap} >= interval 1 minute")).first()[0]
    run_batches(stream, each, f"{store.at}-checkpoint")
    now = store.current()
    newest = F.lit(now.agg(F.max("ended")).first()[0]).cast("timestamp_ntz")
    open_ = F.col("ended") + F.expr(f"interval {gap}") + F.expr(f"interval {late}") > newest
    return now.select(*keys, "started", "ended", "n", open_.alias("is_open"))
