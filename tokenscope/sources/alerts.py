"""Alerts as a streaming sink: those of a micro-batch are published together and once, also when the batch runs again.

Tasks write their rows to files of their own and report them; on commit the files go to one folder, which is renamed to the
batch's number. A batch whose folder is there already adds nothing. A hook is told each folder, and told again only if it failed
or the driver was lost before it returned.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class AlertWriter(DataSourceStreamWriter):
    def __init__(self, path: str, hook: Callable[[str], None] | None) -> None:
        self.path, self.hook = path, hook

    def _folder(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{root}/_new")
        return files, root

    def write(self, iterator: Iterator[Row]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None)
        files, root = self._folder()
        name = f"part-{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{root}/_new/{name}") as out:
            row: Row | None = first
            while row is not None:
                out.write((json.dumps(row.asDict(True), ensure_ascii=False, default=str) + "\n").encode())
                row = next(iterator, None)
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        names = [m.name for m in messages if m is not None and m.name]
        files, root = self._folder()
        folder = f"{root}/batch-{batchId:09d}"
        there = lambda path: files.get_file_info(path).type != fs.FileType.NotFound
        if there(folder):
            self._drop(names)
        elif names:
            new = f"{root}/_new/{uuid.uuid4().hex}"
            files.create_dir(new)
            for n in names:
                files.move(f"{root}/_new/{n}", f"{new}/{n}")
            files.move(new, folder)
        else:
            return
        if self.hook and not there(f"{folder}/_told"):
            self.hook(folder)
            files.open_output_stream(f"{folder}/_told").close()

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop([m.name for m in messages if m is not None and m.name])

    def _drop(self, names: list[str]) -> None:
        files, root = self._folder()
        for n in names:
            files.delete_file(f"{root}/_new/{n}")


def alert_sink(stream: DataFrame, path: str, checkpoint: str, hook: Callable[[str], None] | None = None, number: str = "alerts") -> StreamingQuery:
    """Write the alerts of stream below path, a folder that driver and executors share, as JSON lines in a folder for each batch that has any."""

    class Alerts(DataSource):
        @classmethod
        def name(cls) -> str:
            return number

        def streamWriter(self, schema, overwrite) -> AlertWriter:
            return AlertWriter(path, hook)

    stream.sparkSession.dataSource.register(Alerts)
    return stream.writeStream.format(number).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
