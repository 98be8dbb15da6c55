"""A feed that is replaced now and then, as a stream: each changed state of it is one batch, an unchanged one is none.

The feed is a folder of NDJSON files. When it looks different it is copied line by line to a version of its own in a folder that
driver and executors share, and its entries are digested on the way, in any order. Only if the digest is new does the version
stay and the offset move. Batches read versions and never the feed, so that a batch which runs again after a failure reads what
it read before; a version goes when a later one has been committed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tokenscope.sources.feeds import FEED, parsed_feed

#: Bytes of a part of a version: one task reads one.
PART_BYTES = 64 << 20
_WRAP = (1 << 128) - 1


class Part(InputPartition):
    def __init__(self, version: int, uri: str) -> None:
        self.version, self.uri = version, uri


def _lines(files: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Lines that aren't blank; of a line only what ends it is held besides."""
    with files.open_input_stream(path) as f:
        rest = b""
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.strip() for x in whole if x.strip())
        if rest.strip():
            yield rest.strip()


class FeedRefreshReader(DataSourceStreamReader):
    def __init__(self, feed: str, kept: str) -> None:
        self.feed, self.kept, self.seen = feed, kept, None

    def initialOffset(self) -> dict:
        return {"version": 0, "digest": ""}

    def _versions(self, files: fs.FileSystem, root: str) -> list[tuple[int, str, str]]:
        """(number, digest, path) of the versions held, the last one last."""
        names = [(x.base_name, x.path) for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and not x.base_name.startswith("_")]
        return sorted((int(n.split("-")[0]), n.split("-")[1], p) for n, p in names)

    def latestOffset(self) -> dict:
        files, root = fs.FileSystem.from_uri(self.kept)
        files.create_dir(root)
        held = self._versions(files, root)
        last = {"version": held[-1][0], "digest": held[-1][1]} if held else self.initialOffset()
        source, where = fs.FileSystem.from_uri(self.feed)
        found = [x for x in source.get_file_info(fs.FileSelector(where, allow_not_found=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        looks = sorted((x.path, x.size, x.mtime_ns) for x in found)
        # a feed that is away for a moment is no change
        if not found or looks == self.seen:
            return last
        new = f"{root}/_{uuid.uuid4().hex}"
        files.create_dir(new)
        entries = total = size = part = 0
        out = None
        for path, _, _ in looks:
            for line in _lines(source, path):
                if out is None or size > PART_BYTES:
                    if out is not None:
                        out.close()
                    out, size, part = files.open_output_stream(f"{new}/{part:06d}"), 0, part + 1
                out.write(line + b"\n")
                size += len(line) + 1
                entries += 1
                total = total + int.from_bytes(hashlib.blake2b(line, digest_size=16).digest(), "big") & _WRAP
        if out is not None:
            out.close()
        digest, self.seen = f"{entries}.{total:032x}", looks
        if digest == last["digest"]:
            files.delete_dir(new)
            return last
        number = last["version"] + 1
        files.move(new, f"{root}/{number:09d}-{digest}")
        return {"version": number, "digest": digest}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """Of several versions since the last batch only the last one is read: it is the feed's state."""
        if end["version"] == 0:
            return []
        files, root = fs.FileSystem.from_uri(self.kept)
        path = f"{root}/{end['version']:09d}-{end['digest']}"
        return [Part(end["version"], x.path) for x in sorted(files.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.kept)
        for line in _lines(files, partition.uri):
            yield (partition.version, line.decode("utf-8", "replace"))

    def commit(self, end: dict) -> None:
        files, root = fs.FileSystem.from_uri(self.kept)
        for number, _, path in self._versions(files, root):
            if number < end["version"]:
                files.delete_dir(path)


class FeedRefresh(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_refresh"

    def schema(self) -> str:
        return "version long, value string"

    def streamReader(self, schema) -> FeedRefreshReader:
        return FeedRefreshReader(self.options["path"], self.options["kept"])


def refreshes(spark: SparkSession, path: str, kept: str, schema: str = FEED) -> DataFrame:
    """A stream of the states of the NDJSON feed in folder path: version and the entries, malformed lines dropped.

    kept is a folder of this stream alone which driver and executors share. A feed of no entries is a state without rows; the first batch is made even where there is no feed yet.
    """
    spark.dataSource.register(FeedRefresh)
    lines = spark.readStream.format("feed_refresh").option("path", path).option("kept", kept).load()
    return parsed_feed(lines, schema)
