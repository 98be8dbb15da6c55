"""The tools of many servers, asked at once: a partitioned data source for a list of servers, and a map over a table of servers.

Servers are dealt to partitions, those of a partition are asked side by side, each within a time limit. A server that fails
or does not answer in time gives one row with its error and no tool, so that the others' answers stand.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TOOLS = "server string, tool string, description string, input_schema string, error string"
#: Partitions at most, and servers of one partition that are asked at the same time.
MAX_PARTITIONS, AT_ONCE = 256, 16
#: Rows of an Arrow batch that goes back.
BATCH = 2000


class Servers(InputPartition):
    def __init__(self, servers: list[tuple[str, str]]) -> None:
        self.servers = servers


def manifest_folder(address: str) -> list[dict]:
    """The tools of a manifest, {"tools": [...]}, in the text files of a folder that all executors see."""
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(Path(address.removeprefix("file:")).iterdir()) if not p.name.startswith((".", "_")))
    tools = json.loads(text)["tools"]
    if not isinstance(tools, list):
        raise ValueError("tools is no list")
    return tools


def _rows(server: str, tools: list[dict]) -> list[tuple]:
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    return [(server, text(t["name"]), text(t.get("description", "")), text(t.get("inputSchema")), None) for t in tools]


def _ask(servers: list[tuple[str, str]], connect: Callable[[str], list[dict]], seconds: float) -> Iterator[tuple]:
    """Rows of TOOLS; AT_ONCE servers are asked at the same time."""
    pool = ThreadPoolExecutor(AT_ONCE)
    for i in range(0, len(servers), AT_ONCE):
        some = servers[i : i + AT_ONCE]
        asked = [(server, pool.submit(lambda s=server, a=address: _rows(s, connect(a)))) for server, address in some]
        for server, answer in asked:
            try:
                yield from answer.result(seconds)
            except TimeoutError:
                yield (server, None, None, None, f"no answer in {seconds:g} seconds")
            except Exception as e:
                yield (server, None, None, None, f"{type(e).__name__}")
        if not all(answer.done() for _, answer in asked):
            pool.shutdown(wait=False)
            pool = ThreadPoolExecutor(AT_ONCE)
    pool.shutdown(wait=False)


class ToolListReader(DataSourceReader):
    def __init__(self, servers: list[tuple[str, str]], connect: Callable[[str], list[dict]], seconds: float) -> None:
        self.servers, self.connect, self.seconds = servers, connect, seconds

    def partitions(self) -> list[Servers]:
        n = max(1, min(MAX_PARTITIONS, len(self.servers)))
        return [Servers(self.servers[i::n]) for i in range(n)]

    def read(self, partition: Servers) -> Iterator[tuple]:
        return _ask(partition.servers, self.connect, self.seconds)

    def __getstate__(self) -> dict:
        # a task gets its own servers, not all
        return self.__dict__ | {"servers": []}


def tool_lists(spark: SparkSession, servers: list[tuple[str, str]], connect: Callable[[str], list[dict]] = manifest_folder, seconds: float = 10.0) -> DataFrame:
    """TOOLS of servers (name, address). connect gives the tools of an address and runs on the executors; the list of servers is the registry's and small."""

    class ToolLists(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tool_lists"

        def schema(self) -> str:
            return TOOLS

        def reader(self, schema) -> ToolListReader:
            return ToolListReader(list(servers), connect, seconds)

    spark.dataSource.register(ToolLists)
    return spark.read.format("tool_lists").load()


def ask_servers(servers: DataFrame, connect: Callable[[str], list[dict]] = manifest_folder, seconds: float = 10.0) -> DataFrame:
    """TOOLS of a table of servers (server, address), of any size: none of it goes through the driver."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, pa.string()) for name in ("server", "tool", "description", "input_schema", "error")])
        for batch in batches:
            rows = _ask(list(zip(*(c.to_pylist() for c in batch.columns))), connect, seconds)
            while some := list(islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], schema=schema)

    n = min(MAX_PARTITIONS, 4 * servers.sparkSession.sparkContext.defaultParallelism)
    return servers.select(F.col("server").cast("string"), F.col("address").cast("string")).repartition(n, "server").mapInArrow(ask, TOOLS)


def write_manifests(manifests: DataFrame, folder: str) -> None:
    """A folder for each server of (server, text) with its manifest, written by the tasks, so that no file waits for the driver's commit."""
    root = folder.removeprefix("file:")

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            own = Path(root, f"server={row.server}")
            own.mkdir(parents=True, exist_ok=True)
            part = own / f".{uuid.uuid4().hex}"
            part.write_text(row.text + "\n", encoding="utf-8")
            # whole or not there, also when a task runs twice
            os.replace(part, own / "manifest.txt")

    manifests.select("server", "text").foreachPartition(write)
