"""Job events: history, replay, status, budgets, time to live, admission; in batch and as streams.

Event columns: event_id, ts, job, kind, value. Order within a job is (ts, event_id). Running values
per job are built in two levels - sums per (job, day), then within the day - so that a job that
holds a large share of all events is worked off in parts.

Nulls: events without a job or time belong to no history; a null value counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMINAL = ("complete", "error")


def usable(events: DataFrame) -> DataFrame:
    return events.filter(F.col("job").isNotNull() & F.col("ts").isNotNull())


def running_sum(df: DataFrame, key: str, value: Column, name: str, order: tuple[str, ...] = ("ts", "event_id"), part: Column | None = None) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row in order within its key, in parts by day."""
    d = df.withColumns({"_v": F.coalesce(value, F.lit(0)), "_part": part if part is not None else F.to_date("ts")})
    sums = d.groupBy(key, "_part").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "_part", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_in", F.sum("_v").over(inside)).join(before, [key, "_part"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_v", "_part", "_in", "_before")


def latest_status(events: DataFrame) -> DataFrame:
    """(job, status, since, n_events): the last event of each job; map-side combined."""
    return usable(events).groupBy("job").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("since"), F.count(F.lit(1)).alias("n_events"))


def replay(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Each job's events up to its first terminal one, repeated events once."""
    e = usable(events).dropDuplicates(["job", "event_id"])
    stop = e.filter(F.col("kind").isin(*terminal)).groupBy("job").agg(F.min(F.struct("ts", "event_id")).alias("stop"))
    j = e.join(stop, "job", "left")
    return j.filter(F.col("stop").isNull() | (F.struct("ts", "event_id") <= F.col("stop"))).drop("stop")


def budget(events: DataFrame, cost: Column, limit: int) -> DataFrame:
    """(job, spent, refused): charges in order until the limit; a charge that would pass it is not made, nor is any later one."""
    r = running_sum(usable(events), "job", cost, "used").withColumn("_c", cost)
    return r.groupBy("job").agg(F.coalesce(F.sum(F.when(F.col("used") <= limit, F.col("_c"))), F.lit(0)).alias("spent"), F.count_if(F.col("used") > limit).alias("refused"))


def live(events: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Events whose job's history has not expired: each event renews it for ``ttl_seconds``."""
    last = usable(events).groupBy("job").agg(F.max("ts").alias("_last"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    return usable(events).join(last.filter((age >= 0) & (age < ttl_seconds * 1_000_000)), "job").drop("_last")


def admission(events: DataFrame, starts: str, ends: tuple[str, ...], cap: int) -> DataFrame:
    """Start events with the number of jobs then open and whether one more was admitted (open before < cap)."""
    step = F.when(F.col("kind") == starts, 1).when(F.col("kind").isin(*ends), -1).otherwise(0)
    e = running_sum(usable(events), "job", step, "open")
    return e.filter(F.col("kind") == starts).select("job", "event_id", F.greatest(F.col("open") - 1, F.lit(0)).alias("open_before"), (F.col("open") - 1 < cap).alias("admitted"))


def cached(requests: DataFrame, cache: DataFrame, columns: list[str], now: Column, ttl_seconds: int) -> DataFrame:
    """Requests with their key, the answer if a cached one is still valid, and whether they must be asked."""
    r = requests.withColumn("key", F.sha2(F.to_json(F.struct(*columns)), 256))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp"))
    return r.join(cache.filter((age >= 0) & (age < ttl_seconds * 1_000_000)).select("key", "answer"), "key", "left").withColumn("ask", F.col("answer").isNull())


def describe(events: DataFrame) -> DataFrame:
    """Events with a line for people."""
    label = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    return events.withColumn("line", F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" "), label, F.when(F.col("value").isNotNull(), F.concat(F.lit(": "), F.format_number("value", 2))).otherwise("")))


def windows(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Tumbling windows per kind: number and sum of values; the same code for batch and stream."""
    return events.groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows per job."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "job").agg(F.count(F.lit(1)).alias("n")).select("job", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Events that arrive as parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windows of a stream; events later than ``late`` behind the newest are left out."""
    return windows(events.withWatermark("ts", late), length)


def stream_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's events once each, however often they are delivered within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "event_id"])


def process_jobs(jobs: DataFrame, handle, checkpoint_dir: str, trigger: str | None = None):
    """Run ``handle(batch, id)`` for each micro-batch of a job stream: at least once, in arrival order."""
    w = jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()
