"""Counts of a stream whose files overlap in time."""

from pyspark.sql import functions as F

from correspond.streaming import jobs


def test_daily_counts_of_late_files(spark, tmp_path):
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).cast("timestamp_ntz")
    rows = spark.range(480).select(F.lit("k").alias("kind"), stamp.alias("ts"))
    for part in (rows.where("ts >= timestamp_ntz '2024-01-11'"), rows.where("ts < timestamp_ntz '2024-01-15'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.daily_counts(spark, jobs.files(spark, f"{tmp_path}/in", rows.schema), "ts", ["kind"])
    want = rows.unionByName(rows.where("ts >= timestamp_ntz '2024-01-11' and ts < timestamp_ntz '2024-01-15'")).groupBy("kind", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
