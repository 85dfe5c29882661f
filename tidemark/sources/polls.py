"""A folder that is polled, as a streaming source: what each poll sees of its files, ready for `streaming.watch`.

spark.readStream.format("folder_polls").option("folder", ...).load() gives (path, poll, mtime, size, digest); a file that has left gives one row with a null mtime. An offset holds the
number of the poll and where its listing lies in the log folder (option `log`, shared by driver and executors), so a stream that starts again from its checkpoint reads the same rows
for a batch that was not finished, whatever has changed since. Listings are cut into parts of `part` files each; contents are hashed where the parts are read. A listing older
than the last finished batch is deleted. The folder must be a path that driver and executors all see; names go through the driver, contents do not.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..streaming.watch import POLLS
from .files import SKIPPED_FOLDERS

Seen = tuple[str, int, int]  # path, time of change in nanoseconds, size


def listing(folder: str) -> Iterator[Seen]:
    """All files below a folder in the order of their paths, without those of the skipped folders; a file that goes while it is looked at is not there."""
    for base, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if f not in SKIPPED_FOLDERS)
        for name in sorted(names):
            full = os.path.join(base, name)
            try:
                stat = os.stat(full)
            except OSError:
                continue
            yield os.path.relpath(full, folder).replace(os.sep, "/"), stat.st_mtime_ns, stat.st_size


def digest(path: str) -> str | None:
    """SHA-1 of a file, read in pieces; None where it has gone."""
    sha = hashlib.sha1()
    try:
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                sha.update(piece)
    except OSError:
        return None
    return sha.hexdigest()


class Part(InputPartition):
    """Rows `first` to `last` of a listing."""

    def __init__(self, poll: int, file: str, first: int, last: int):
        super().__init__((poll, file, first))
        self.poll, self.file, self.first, self.last = poll, file, first, last


class PollReader(DataSourceStreamReader):
    def __init__(self, folder: str, log: str, part: int, beyond: int | None):
        self.folder, self.log, self.part, self.beyond = folder, log, part, beyond
        self.now: dict | None = None
        os.makedirs(log, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"poll": 0, "file": "", "rows": 0}

    def latestOffset(self) -> dict:
        """Polls once: writes what is there, and what has left since the poll before, under a new name, and renames it when it is whole."""
        last = self.now or self._last()
        if self.beyond is not None and last["poll"] >= self.beyond:
            return last
        poll, name = last["poll"] + 1, f"{last['poll'] + 1:09d}-{uuid.uuid4().hex}"
        before = {row[0] for row in self._rows(last["file"]) if row[1] is not None} if last["file"] else set()
        rows = 0
        with open(os.path.join(self.log, f".{name}"), "w", encoding="utf-8") as out:
            for row in listing(self.folder):
                before.discard(row[0])
                out.write(json.dumps(row) + "\n")
                rows += 1
            for path in sorted(before):
                out.write(json.dumps((path, None, None)) + "\n")
                rows += 1
        os.replace(os.path.join(self.log, f".{name}"), os.path.join(self.log, name))
        self.now = {"poll": poll, "file": name, "rows": rows}
        return self.now

    def _last(self) -> dict:
        names = sorted(n for n in os.listdir(self.log) if not n.startswith("."))
        if not names:
            return self.initialOffset()
        return {"poll": int(names[-1].split("-")[0]), "file": names[-1], "rows": sum(1 for _ in self._rows(names[-1]))}

    def _rows(self, name: str) -> Iterator[list]:
        with open(os.path.join(self.log, name), encoding="utf-8") as lines:
            for line in lines:
                yield json.loads(line)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """Parts of the polls after `start` up to `end`: the newest listing of each."""
        out = []
        for name in sorted(n for n in os.listdir(self.log) if not n.startswith(".")):
            poll = int(name.split("-")[0])
            if start["poll"] < poll <= end["poll"]:
                rows = end["rows"] if name == end["file"] else sum(1 for _ in self._rows(name))
                out += [Part(poll, name, k, min(k + self.part, rows)) for k in range(0, rows, self.part)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        for k, (path, mtime, size) in enumerate(self._rows(partition.file)):
            if k >= partition.last:
                break
            if k >= partition.first:
                yield path, partition.poll, mtime, size, None if mtime is None else digest(os.path.join(self.folder, path))

    def commit(self, end: dict) -> None:
        """Listings before that of the last finished batch are needed no more; that one tells the next poll what has left."""
        for name in os.listdir(self.log):
            if not name.startswith(".") and int(name.split("-")[0]) < end["poll"]:
                os.remove(os.path.join(self.log, name))


class FolderPolls(DataSource):
    """Options: folder, log, part (files in a task, 1000), polls (stop at this number of polls; for a run to the end)."""

    @classmethod
    def name(cls) -> str:
        return "folder_polls"

    def schema(self) -> str:
        return POLLS

    def streamReader(self, schema) -> PollReader:
        polls = self.options.get("polls")
        return PollReader(self.options["folder"], self.options["log"], int(self.options.get("part", 1000)), int(polls) if polls else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderPolls)
