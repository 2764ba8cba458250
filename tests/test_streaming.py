"""Streams against the batch operators, in several micro-batches."""

from pyspark.sql import functions as F

from folioscope.operators import observe
from folioscope.streaming import ledger


def parts(spark, smoke_dir, path):
    """Events cut in three files, the middle days last, so that rows come late."""
    events = spark.read.parquet(f"{smoke_dir}/events.parquet").withColumn("failed", F.col("event_type") == "error")
    third = F.ntile(3).over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts", "event_id"))
    held = events.withColumn("part", third)
    for part in (1, 3, 2):
        held.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return events


def stream_of(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_seen_ledger(spark, smoke_dir, tmp_path):
    events = parts(spark, smoke_dir, f"{tmp_path}/in")
    keys, where = ["user_id", "event_type"], f"{tmp_path}/ledger"
    for _ in range(2):  # the second run finds nothing new
        ledger.write_first_seen(stream_of(spark, events, f"{tmp_path}/in"), keys, "ts", where, f"{tmp_path}/marks").awaitTermination(120)
    got = {(r.user_id, r.event_type): r.first_seen for r in ledger.read_first_seen(spark, where, keys).collect()}
    want = {(r.user_id, r.event_type): r.first_seen for r in observe.first_seen(events, keys, "ts").collect()}
    assert got == want
    assert len(list((tmp_path / "ledger").glob("number=*"))) == 3


def test_failure_runs_in_keyed_state(spark, smoke_dir, tmp_path):
    events = spark.read.parquet(f"{smoke_dir}/events.parquet").withColumn("failed", F.col("event_type") == "error")
    events.where("ts < '2024-01-10'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events.where("ts >= '2024-01-10'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    runs = ledger.failure_runs(stream_of(spark, events, f"{tmp_path}/in"), "user_id", ["ts", "event_id"], "failed")
    query = runs.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = sorted((r.event_id, r.run_length) for r in spark.table("runs").collect())
    want = sorted((r.event_id, r.run_length) for r in observe.failure_runs(events, "user_id", ["ts", "event_id"], F.col("failed")).collect())
    assert got == want and max(n for _, n in got) > 1
