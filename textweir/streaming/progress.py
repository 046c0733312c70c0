"""Streams of job events: counters, the latest snapshot, sessions, progress folded per job, and cache flushes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import first_write_wins

#: A file begins, segments are done, a file is done.
BEGINS = re.compile(r"^Processing:\s+(.+?)\s+\((\d+)/(\d+)\)$")
SEGMENT = re.compile(r"^\[TR\]\s+(\d+)/(\d+)\s+")
DONE = re.compile(r"^Done:\s+(.+?)\s+->")
OUT = "job_id long, files long, segments_done long, segments_total long"


def counters(events: DataFrame) -> DataFrame:
    """Calls, mean value and failures by type; complete mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("calls"), F.avg("value").alias("mean_value"), F.count_if(F.col("value") < 10).alias("failures"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job, one overwritten value; update or complete mode."""
    return events.groupBy(F.col("user_id").alias("job_id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("job_id", F.col("m.event_type").alias("stage"), F.col("m.ts").alias("ts"))


def sessions(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Voice segments of a media stream: events closer than ``gap``; late data up to ``late``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def warnings_once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of equal warnings of a job while the watermark holds it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "message"])


def fold_progress(state: tuple[int, int, int, int, int], message: str) -> tuple[int, int, int, int, int]:
    """(files done, base, segments done, segments total, in this file) after a line; segments of earlier files are the base."""
    files, base, done, total, own = state
    if m := BEGINS.match(message):
        return int(m[2]) - 1, done, done, total, 0
    if m := SEGMENT.match(message):
        return files, base, base + int(m[1]), base + int(m[2]), int(m[2])
    if DONE.match(message):
        return files + 1, base, base + own if own else done, total, own
    return state


def progress(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """job_id with its counters from log lines (job_id, seq, message); update mode.

    Lines are folded by seq within a micro-batch, and batches as they come: a log
    is one ordered stream, so a line that comes later than its successors' batch
    is folded where it comes.

    With ``ttl_ms`` a job's state is dropped after so long without lines. Spark
    then runs batches even when idle, so such a query ends by ``stop()`` alone.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for m in rows["message"]:
            now = fold_progress(now, m or "")
        state.update(tuple(int(x) for x in now))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], now[0], now[2], now[3])], columns=[c.split()[0] for c in OUT.split(", ")])

    return lines.groupBy("job_id").applyInPandasWithState(run, OUT, "files long, base long, done long, total long, own long", "update", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def replies(tokens: DataFrame) -> DataFrame:
    """call_id, text of token streams (call_id, seq, token, done): tokens in order up to the first that says it is the last; complete mode or a batch."""
    got = tokens.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("token", F.lit("")).alias("token")))).alias("t"), F.min(F.when(F.col("done"), F.col("seq"))).alias("end"))
    kept = F.filter("t", lambda x: F.col("end").isNull() | (x["seq"] <= F.col("end")))
    return got.select("call_id", F.btrim(F.array_join(F.transform(kept, lambda x: x["token"]), "")).alias("text"), F.col("end").isNotNull().alias("done"))


def run_until(query, stopped, poll: float = 0.2) -> bool:
    """Let a streaming query work until it ends or ``stopped()``; it is then ended between units, what it wrote stays. Whether it was stopped."""
    while query.isActive:
        if stopped():
            query.stop()
            return True
        query.awaitTermination(poll)
    return False


def flush_to_cache(path: str, *order: str):
    """A ``foreachBatch`` function that appends what the cache at ``path`` doesn't hold yet; a repeated batch adds nothing.

    The cache is partitioned by the first two digits of its keys, and a batch
    reads only the partitions of its own keys.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        keyed = batch.withColumn("shard", F.left("key_hash", F.lit(2)))
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            shards = [r.shard for r in keyed.select("shard").distinct().collect()]  # 256 at most
            have = spark.read.schema(keyed.schema).parquet(path).where(F.col("shard").isin(shards)).select("key_hash")
        else:
            have = spark.createDataFrame([], "key_hash string")
        first_write_wins(keyed, have, *order).write.mode("append").partitionBy("shard").parquet(path)

    return write
