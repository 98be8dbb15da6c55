"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Prefix of every internal column, so that extra columns of the input can have any ordinary name.
OWN = "_ts_"

#: Rows per Arrow batch handed to Python; bounds a worker's memory when texts are long.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The cluster's folder, spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make sure that checkpoint() has a folder, see shared_folder."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "ts_checkpoint_"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of finished phases: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn for every Arrow batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def portions(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """Runs of texts of up to most characters together; a longer text is alone."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > most:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def spread_hash(words: list[bytes], cache: dict[bytes, int], limit: int = 400_000) -> np.ndarray:
    """Stable 64-bit hashes of words. The cache is emptied at limit entries, which bounds memory and changes no result."""
    import xxhash

    if len(cache) > limit:
        cache.clear()
    get, digest = cache.get, xxhash.xxh3_64_intdigest
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = cache[w] = digest(w)
        out[i] = h
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalizer of 64-bit words: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of width words: sum of mixed word hashes times powers of an odd base, mod 2**64."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = (0xD6E8FEB86659FD93 + 2 * 0x5851F42D4C957F2D * seed) & 0xFFFFFFFFFFFFFFFF | 1
    out = np.zeros(n, dtype=np.uint64)
    mixed, power, b = mix(words, seed), np.uint64(1), np.uint64(base)
    if width <= 8:
        for k in range(width):
            out = out * b + mixed[k : k + n]
        return mix(out, seed)
    powers = np.multiply.accumulate(np.concatenate([[power], np.full(len(words), b, dtype=np.uint64)]))
    inverse = pow(base, -1, 1 << 64)
    back = np.multiply.accumulate(np.concatenate([[power], np.full(len(words), np.uint64(inverse), dtype=np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[: len(words)], dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * back[:n], seed)
