"""A stream source that follows text files as they grow.

Spark's own file source takes a file once, as it was when it was listed. Here an offset is a
byte position per file, behind its last line end: lines that are appended later are read
later, and a last line without its end is held back until that arrives. The bytes just before
a position are remembered by a digest. Where they have changed, or the file has become
shorter, the path holds another file and is read from its start; where a new path holds them,
the old file was renamed and is read on from there, under its old name.

The driver lists the folder and looks at the ends of files that changed. Lines are read by
tasks, a block of at most ``block_bytes`` each, so a large backlog of one file is spread.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 32 << 20
FORMAT = "growing_lines"
SCHEMA = "run string, path string, position bigint, line string"


def plain_path(path: str) -> str:
    """A path without ``file:``, absolute if it is local; other schemes stay."""
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    return local if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", local) else os.path.abspath(local)


def _source() -> type:
    """The data source class. It is local so that it travels by value, as in ``early_stop``."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    name, schema, checked, chunk, lines_at_once = FORMAT, SCHEMA, 256, 1 << 20, 10_000

    class Block(InputPartition):
        """Lines that start in ``[start, stop)``; the file is read up to ``end`` at most."""

        def __init__(self, path: str, run_path: str, first: int, start: int, stop: int, end: int):
            self.path, self.run_path, self.first, self.start, self.stop, self.end = path, run_path, first, start, stop, end

    class Reader(DataSourceStreamReader):
        def __init__(self, path: str, block_bytes: int):
            self.path, self.block_bytes = path, block_bytes
            #: What was found out about a file, as long as its size and time stay.
            self.known: dict[str, tuple[tuple, list]] = {}

        def _open(self):
            return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

        def _read(self, store, path: str, start: int, length: int) -> bytes:
            with store.open_input_file(path) as file:
                return file.read_at(length, start)

        def _digest(self, store, path: str, position: int) -> str:
            """Of the bytes before a position."""
            start = max(0, position - checked)
            return hashlib.md5(self._read(store, path, start, position - start)).hexdigest()

        def _last_line_end(self, store, path: str, size: int) -> int:
            end = size
            while end > 0:
                start = max(0, end - chunk)
                found = self._read(store, path, start, end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
            return 0

        def _files(self, store, root: str) -> dict:
            info = store.get_file_info(root)
            if info.type == fs.FileType.File:
                return {info.path: info}
            found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            inside = {i.path: i for i in found if i.type == fs.FileType.File}
            return {p: i for p, i in inside.items() if not any(part[:1] in "._" for part in p[len(root):].split("/") if part)}

        def initialOffset(self) -> dict:
            return {"files": {}}

        def latestOffset(self) -> dict:
            store, root = self._open()
            out = {}
            for path, info in sorted(self._files(store, root).items()):
                state = info.size, info.mtime_ns
                if self.known.get(path, (None,))[0] != state:
                    position = self._last_line_end(store, path, info.size)
                    self.known[path] = state, [position, self._digest(store, path, position)]
                out[path] = self.known[path][1]
            return {"files": out}

        def _same(self, store, path: str, size: int, entry: list) -> bool:
            return size >= entry[0] and self._digest(store, path, entry[0]) == entry[1]

        def partitions(self, start: dict, end: dict) -> list:
            store, _ = self._open()
            before, now = start["files"], end["files"]
            # Old positions whose path no longer holds their file.
            lost = {p: e for p, e in before.items() if e[0] and (p not in now or not self._same(store, p, now[p][0], e))}
            blocks = []
            for path, (stop, _) in now.items():
                run_path, begin = path, 0
                if path in before and path not in lost:
                    begin = before[path][0]
                elif path not in before:
                    for old, entry in lost.items():
                        if self._same(store, path, stop, entry):
                            run_path, begin = old, entry[0]
                            break
                for at in range(begin, stop, self.block_bytes):
                    blocks.append(Block(path, run_path, begin, at, min(at + self.block_bytes, stop), stop))
            return blocks

        def read(self, partition):
            store, root = self._open()
            under = partition.run_path.startswith(root.rstrip("/") + "/")
            relative = partition.run_path[len(root.rstrip("/")) + 1:] if under else partition.run_path.rsplit("/", 1)[-1]
            folder, _, base = relative.rpartition("/")
            run = (folder + "/" if folder else "") + (base.rpartition(".")[0] if "." in base else base)

            def batch(found: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([run] * len(found)), pa.array([partition.path] * len(found)),
                     pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())],
                    ["run", "path", "position", "line"])

            with store.open_input_file(partition.path) as file:
                at = partition.start
                file.seek(at)
                rest, skip = b"", False
                if at > partition.first:
                    # The line under way belongs to the block before, unless it ended just here.
                    file.seek(at - 1)
                    skip = file.read(1) != b"\n"
                found: list = []
                where = at
                while where < partition.stop or skip:
                    data = file.read(min(chunk, partition.end - file.tell()))
                    if not data and not rest:
                        break
                    lines = (rest + data).split(b"\n")
                    rest = lines.pop()
                    for line in lines:
                        if skip:
                            skip = False
                        elif where < partition.stop:
                            found.append((where, line.removesuffix(b"\r").decode(errors="replace")))
                        where += len(line) + 1
                        if len(found) == lines_at_once:
                            yield batch(found)
                            found = []
                    if not data:
                        break
                if found:
                    yield batch(found)

        def commit(self, end: dict) -> None:
            pass

    class GrowingLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema):
            return Reader(self.options["path"], int(self.options["block_bytes"]))

    return GrowingLines


def stream_lines(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines ``(run, path, position, line)`` of all text files below a folder, as they are appended.

    ``run`` is the file's path below the folder without its extension, ``position`` the byte where the
    line starts, which orders the lines of a file. Bytes that are no UTF-8 become replacement characters.
    The path is a local or shared folder, or a URI that Arrow's file systems know.
    """
    spark.dataSource.register(_source())
    return (spark.readStream.format(FORMAT).option("path", plain_path(path))
            .option("block_bytes", str(block_bytes)).load())
