"""Log files that are still being written: a stream source that follows them.

``growing_lines`` hands on every finished line of the files of a pattern once.  A file is known
by its inode and its first line, so a file that is renamed by rotation is read on under its new
name, and one that is emptied and written anew is read from its start.  What follows the last
line feed waits until its line is finished.  Offsets are positions after line feeds; a batch that
is run again after a failure reads the same bytes.

The files must be reachable at the same place from the driver and the executors, as by a
mounted share, or on one machine.  Files of object stores don't grow; Spark's own sources read
those.  The driver looks at names, sizes and the last unfinished line only; the lines are read by
tasks, a large piece of a file by several.
"""

from __future__ import annotations

import glob
import json
import os
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FEED = b"\n"
PACKED = (".gz", ".bz2", ".xz", ".zst", ".zip")
#: Bytes looked at to find the last line feed, bytes of a first line that count, bytes a task reads.
LOOK, FIRST, PIECE = 1 << 16, 1024, 16 << 20
#: Seconds after which a file that is gone is forgotten.
FORGET = 86_400
_SCHEMA = "value string, path string, file string, at long"


def local_path(path: str) -> str:
    """The path of a ``file`` address, or the path itself."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else path
    raise ValueError(f"growing files are followed on mounted paths only, not {parts.scheme}:")


def _first_line(file) -> int | None:
    """A mark of the first line; None while it isn't finished."""
    file.seek(0)
    head = file.read(FIRST)
    end = head.find(FEED)
    return zlib.crc32(head[:end]) if end >= 0 else zlib.crc32(head) if len(head) == FIRST else None


def end_of_lines(file, start: int, until: int) -> int:
    """The place after the last line feed between ``start`` and ``until``; ``start`` if there is none."""
    at = until
    while at > start:
        low = max(at - LOOK, start)
        file.seek(low)
        found = file.read(at - low).rfind(FEED)
        if found >= 0:
            return low + found + 1
        at = low
    return start


def end_of_line(file, start: int, size: int) -> int:
    """The place after the first line feed from ``start`` on; ``start`` if there is none."""
    at = start
    while at < size:
        file.seek(at)
        block = file.read(min(LOOK, size - at))
        found = block.find(FEED)
        if found >= 0:
            return at + found + 1
        if not block:
            break
        at += len(block)
    return start


@dataclass
class Piece(InputPartition):
    """Bytes of one file whose lines a task reads: those that start in them."""

    path: str
    file: str
    start: int
    until: int
    first: bool

    def __init__(self, path: str, file: str, start: int, until: int, first: bool):
        super().__init__(None)
        self.path, self.file, self.start, self.until, self.first = path, file, start, until, first


class GrowingReader(DataSourceStreamReader):
    """Offsets: ``{"files": {file: [path, position, gone since]}}``; ``{}`` and the tail mark at the start."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("growing_lines needs a path")
        self.patterns = [local_path(p) for p in json.loads(options["path"])] if options["path"].startswith("[") else [
            local_path(options["path"])]
        self.position = options.get("position", "head")
        if self.position not in ("head", "tail"):
            raise ValueError("position must be 'head' or 'tail'")
        self.most = int(options.get("maxbytespertrigger", 0) or 0)
        self.piece = int(options.get("piecebytes", PIECE))
        self.strict = str(options.get("failondataloss", "true")).lower() == "true"
        self.remembered = local_path(options["positions"]) if options.get("positions") else None
        self.at: dict | None = None  # what has been planned last, as far as this reader knows
        if self.remembered:
            self.at = self.initialOffset()
            if os.path.exists(self.remembered):
                with open(self.remembered) as file:
                    self.at = json.load(file)

    def initialOffset(self) -> dict:
        return {"tail": True} if self.position == "tail" else {}

    def _remember(self, end: dict) -> None:
        """Spark has logged ``end`` by now and will plan this batch again if it can't finish it."""
        self.at = end
        if self.remembered:
            os.makedirs(os.path.dirname(self.remembered) or ".", exist_ok=True)
            with open(f"{self.remembered}.new", "w") as file:
                json.dump(end, file)
            os.replace(f"{self.remembered}.new", self.remembered)

    def _present(self) -> Iterator[tuple[str, os.stat_result]]:
        seen = set()
        for pattern in self.patterns:
            pattern = os.path.join(pattern, "*") if os.path.isdir(pattern) else pattern
            for path in sorted(glob.glob(pattern)):
                name = os.path.basename(path)
                if path in seen or name.startswith(("_", ".")) or name.endswith(PACKED) or not os.path.isfile(path):
                    continue
                seen.add(path)
                try:
                    yield path, os.stat(path)
                except FileNotFoundError:
                    continue  # renamed meanwhile: found under its new name next time

    def latestOffset(self) -> dict:
        known = (self.at or {}).get("files", {})
        left = self.most if self.most and self.at is not None and "tail" not in self.at else None
        files: dict[str, list] = {}
        for path, stat in sorted(self._present(), key=lambda x: (x[1].st_mtime, x[0])):  # oldest first
            try:
                with open(path, "rb") as file:
                    mark = _first_line(file)
                    if mark is None:
                        continue
                    key = f"{stat.st_dev}:{stat.st_ino}:{mark}"
                    size = os.fstat(file.fileno()).st_size
                    start = known.get(key, [path, 0, 0])[1]
                    start = 0 if start > size else start
                    until = size if left is None else min(size, start + left)
                    end = end_of_lines(file, start, until)
                    if end == start and until < size and left:  # a line longer than a batch
                        end = end_of_line(file, until, size)
                        end = start if end == until else end
            except FileNotFoundError:
                continue
            if key in files:  # a second name of the same file
                continue
            files[key] = [path, end, 0]
            if left is not None:
                left = max(left - (end - start), 0)
        now = int(time.time())
        for key, (path, end, gone) in known.items():
            if key not in files and not (gone and now - gone > FORGET):
                files[key] = [path, end, gone or now]
        return {"files": dict(sorted(files.items()))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._remember(end)
        if "tail" in start:
            return []  # what is there when the stream first looks counts as handled
        before, out = start.get("files", {}), []
        for key, (path, until, _) in end.get("files", {}).items():
            at = before.get(key, [path, 0, 0])[1]
            first = 0 if until < at else at  # shorter than it was: emptied and written anew
            for low in range(first, until, self.piece):
                out.append(Piece(path, key, low, min(low + self.piece, until), low == first))
        return out

    def commit(self, end: dict) -> None:
        pass

    def _open(self, piece: Piece):
        inode = int(piece.file.split(":")[1])
        names = [piece.path, *(p for p, s in self._present() if s.st_ino == inode)]
        for name in names:
            try:
                file = open(name, "rb")
            except FileNotFoundError:
                continue
            stat = os.fstat(file.fileno())
            if f"{stat.st_dev}:{stat.st_ino}:{_first_line(file)}" == piece.file and stat.st_size >= piece.until:
                return file
            file.close()
        if self.strict:
            raise FileNotFoundError(f"{piece.path} lost bytes {piece.start} to {piece.until} before they were read")
        return None

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        file = self._open(piece)
        if file is None:
            return
        with file:
            size = os.fstat(file.fileno()).st_size
            start = piece.start
            if not piece.first:  # the line before began in the piece before
                start = end_of_line(file, start - 1, size)
            if start >= piece.until:
                return
            end = piece.until
            file.seek(end - 1)
            if file.read(1) != FEED:
                end = end_of_line(file, end, size)
            file.seek(start)
            text = file.read(end - start)
        lines = text.split(FEED)[:-1]
        places = start + np.cumsum([0] + [len(x) + 1 for x in lines])[:-1]
        for at in range(0, len(lines), 10_000):
            some = pa.array(lines[at : at + 10_000], pa.binary())
            try:
                some = some.cast(pa.string())
            except pa.ArrowInvalid:
                some = pa.array([x.decode("utf-8", "replace") for x in lines[at : at + 10_000]], pa.string())
            yield pa.RecordBatch.from_arrays([
                pc.utf8_rtrim(some, "\r"), pa.array([piece.path] * len(some), pa.string()),
                pa.array([piece.file] * len(some), pa.string()),
                pa.array(places[at : at + len(some)], pa.int64()),
            ], names=["value", "path", "file", "at"])


class GrowingLines(DataSource):
    """``value, path, file, at``: a line, where it was found, which file that is, where it starts in it.

    Options: ``path`` (a file, folder, pattern or JSON list of these), ``position`` (``head``, or
    ``tail`` to take what is written from now on), ``maxBytesPerTrigger`` (0: all), ``positions``,
    ``pieceBytes`` a task, ``failOnDataLoss``.  Spark doesn't tell such a source where it stopped
    before it asks for the newest offset; ``positions`` names a file, one for each checkpoint, in
    which the source remembers that.  Without it the first batch of each run isn't bounded.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader({k.lower(): v for k, v in dict(self.options).items()})


def follow_lines(
    spark: SparkSession, paths: str | Sequence[str], *, position: str = "head", max_bytes: int = 0,
    positions: str | None = None, **options
) -> DataFrame:
    """A stream of the finished lines of files that grow."""
    spark.dataSource.register(GrowingLines)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if positions:
        options["positions"] = positions
    reader = spark.readStream.format("growing_lines").options(
        path=json.dumps(paths), position=position, maxBytesPerTrigger=max_bytes, **options)
    return reader.load()
