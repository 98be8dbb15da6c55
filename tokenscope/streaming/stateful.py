"""Structured Streaming forms: spend per window, keyed decisions, redaction, micro-batch sinks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenscope.functions import text as fn


def windowed_spend(log: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Tokens per server and event-time window; rows later than the watermark are dropped."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "server").agg(F.sum("tokens").alias("tokens"))
    return out.select("server", F.col("w.start").alias("start"), "tokens")


def decide(stream: DataFrame, key: str, order: list[str], make: Callable[[object], object], args: list[str], out: list[str], kinds: str) -> DataFrame:
    """The decisions of operators.state.replay on a stream: a key's state is kept between micro-batches, rows of a batch go in order."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else make(k[0])
        rows = pd.concat(parts).sort_values(order, kind="stable")
        decisions = [machine.step(*values) for values in zip(*(rows[a] for a in args))]
        state.update((pickle.dumps(machine),))
        yield rows[out].assign(decision=decisions)

    return stream.groupBy(key).applyInPandasWithState(run, f"{kinds}, decision string", "machine binary", "append", GroupStateTimeout.NoTimeout)


def redact(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whole values are redacted, so no secret is cut by a chunk's end."""
    return lines.withColumn(column, fn.redact_leftmost(F.col(column)))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def quarantine_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch, writes quarantined rows under path; a failed write fails the batch, so nothing passes unseen."""

    def write(batch: DataFrame, number: int) -> None:
        from tokenscope.operators.text import quarantine

        quarantine(batch.withColumn("risk", fn.risk_score(F.col("text"))).withColumn("action", fn.action_of(F.col("risk"))), path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_change(last: list, hook: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for snapshots of a feed: it calls hook when a batch's digest differs from that of the last one, kept in last."""
    from tokenscope.sources.feeds import feed_digest

    def run(batch: DataFrame, number: int) -> None:
        now = tuple(feed_digest(batch).first())
        if last and last[-1] == now:
            return
        last[:] = [now]
        hook(number)

    return run
