"""The servers' status from a stream of calls: a snapshot that is replaced at each trigger, and the changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenscope.sources import sinks

STATUS = "server string, status string, requests long, errors long, error_rate double, last_activity timestamp"


def server_status(calls: DataFrame) -> DataFrame:
    """STATUS of each server from its calls (server, ts, failed): error if the last call failed (of calls at one time any), else running; the share of errors in percent."""
    last = F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), F.coalesce("failed", F.lit(False)).alias("failed")))
    out = calls.groupBy("server").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), last.alias("last"))
    status = F.when(F.col("last.failed"), "error").otherwise("running")
    return out.select("server", status.alias("status"), "requests", "errors", (F.col("errors") * 100.0 / F.col("requests")).alias("error_rate"), F.col("last.ts").alias("last_activity"))


def _events(before: DataFrame, now: DataFrame) -> DataFrame:
    """server, event and status now, of servers that are new, gone or of another status."""
    both = before.select("server", F.col("status").alias("was"), F.lit(None).cast("string").alias("status")).unionByName(now.select("server", "status"), allowMissingColumns=True)
    each = both.groupBy("server").agg(F.max("was").alias("was"), F.max("status").alias("status"))
    event = F.when(F.col("was").isNull(), "added").when(F.col("status").isNull(), "removed").when(F.col("was") != F.col("status"), "changed")
    return each.select("server", event.alias("event"), "status").where("event is not null")


def status_sink(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the status of all servers as a JSON snapshot at path, and the changes of status of each batch under path-changes.

    The changes are written first and, once they are whole, not again, so a batch that runs again neither loses nor doubles any.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").options(**sinks.EXACT_TIMES).json(f"{path}.staged")
        now = spark.read.schema(STATUS).json(f"{path}.staged")
        files, where = sinks._files(spark, path)
        events = f"{path}-changes/batch={number}"
        if not files.exists(where(f"{events}/_SUCCESS")):
            before = sinks.load_snapshot(spark, path, STATUS)
            _events(before, now).write.mode("overwrite").json(events)
        sinks.replace_snapshot(now, path)

    return server_status(calls).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_changes(spark, path: str) -> DataFrame:
    """batch, server, event (added, changed, removed) and the status now, of a sink's path."""
    return spark.read.schema("server string, event string, status string, batch long").json(f"{path}-changes")
