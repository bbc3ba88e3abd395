"""Following a store of log files as it grows: a streaming source of lines, and their times.

    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("path", "file:///logs").load()
    events = timed(lines)

The source's offset is how many bytes of every day file have been read, always up to a line's end.  A micro-batch is
what lies between two offsets, cut into ranges that are read at once; short ones that follow one another are one task.  Lines
carry the numbers that the batch reader gives them within a range, so they order alike.  Relative times need what came before: the time at the end
of a part is a state of that part, so a day's lines keep their times however they fall into batches.

A day file is ``2024/9.log`` under path, on any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.eventlog import EVENT, fields

DAY_FILE = re.compile(r"(?:^|/)(\d{4,})/(\d{1,3})\.log$")
#: Bytes of a range, of ranges that follow one another in a task, and of what is read at once to look for a line's end.
RANGE, TASK, LOOK = 1 << 24, 1 << 24, 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Range(InputPartition):
    """The lines of a file that begin in [low, high): one or several ranges."""

    def __init__(self, part: str, file: str, low: int, high: int):
        self.part, self.file, self.low, self.high = part, file, low, high


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _logs(self) -> dict[str, pafs.FileInfo]:
        fs, root = opened(self.path)
        found = {}
        for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
            if x.type == pafs.FileType.File and (m := DAY_FILE.search(x.path)):
                found[f"{m[1]}/{m[2].zfill(3)}"] = x
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.path)
        out = {}
        for part, x in sorted(self._logs().items()):
            with fs.open_input_file(x.path) as f:
                end = x.size
                while end:  # back to the end of the last whole line
                    low = max(0, end - LOOK)
                    if (at := f.read_at(end - low, low).rfind(b"\n")) >= 0:
                        end = low + at + 1
                        break
                    end = low
                out[part] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        logs, out = self._logs(), []
        for part, high in end.items():
            low = start.get(part, 0)
            step = max(1, TASK // self.size) * self.size
            out += [Range(part, logs[part].path, at, min(at + step, high)) for at in range(low, high, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.file) as f:
            at = partition.low
            if at and f.read_at(1, at - 1) != b"\n":  # the line that is under way belongs to the range before
                at = self._next(f, at)
            for low in range(partition.low, partition.high, self.size):
                high = min(low + self.size, partition.high)
                if high > at:
                    end = self._next(f, high - 1)
                    yield self._lines(partition.part, at, f.read_at(end - at, at))
                    at = end

    def _lines(self, part: str, at: int, data: bytes) -> pa.RecordBatch:
        lines = data.split(b"\n")
        sizes = np.array([len(x) + 1 for x in lines], np.int64)
        start = at + np.cumsum(sizes) - sizes
        keep = [i for i, x in enumerate(lines) if x]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(keep), pa.string()), pa.array(start[keep] * 2 + 1), pa.array([lines[i].decode(errors="replace") for i in keep], pa.string())], names=["part", "line_no", "line"])

    def _next(self, f: pa.NativeFile, at: int) -> int:
        """Where the line after the one at ``at`` begins."""
        while block := f.read_at(LOOK, at):
            if (n := block.find(b"\n")) >= 0:
                return at + n + 1
            at += len(block)
        return at

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "part string, line_no long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("range", RANGE)))


#: Of an event, what comes before its attributes.
PLAIN = EVENT.rsplit(",", 2)[0]


def timed(lines: DataFrame) -> DataFrame:
    """A stream of lines as events (eventlog.EVENT): the time at the end of each part is kept from batch to batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values("seq")
        mark, whole = rows["mark"].fillna(0).to_numpy(np.int64), (rows["op"] == "T").to_numpy()
        run = np.cumsum(np.where(whole, 0, mark))
        # since the last absolute time, or since the time kept
        base = np.where(whole, mark - run, np.iinfo(np.int64).min)
        last = np.maximum.accumulate(np.where(whole, np.arange(len(rows)), -1))
        rows["ts"] = run + np.where(last >= 0, base[np.maximum(last, 0)], now)
        state.update((int(rows["ts"].iloc[-1]),))
        yield rows[["part", "seq", "ts", "op", "key", "name", "value", "attrs"]]

    # attributes pass through Python as the text that they are in the log
    rows = fields(lines, parsed=False).groupBy("part").applyInPandasWithState(step, f"{PLAIN}, attrs string", "now long", "append", GroupStateTimeout.NoTimeout)
    return rows.withColumn("attrs", F.from_json("attrs", "map<string,string>"))


def write_files(lines: DataFrame, root: str) -> DataFrame:
    """lines(part, seq, line) as one file a part, ``2024/9.log`` for part 2024/009: (part, lines) of what was written.

    Each file is written aside and moved to its place, so a task that runs again leaves the same; a reader of the
    store sees a file grow if it is written again with more lines.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = opened(root)
        now, out, n, aside, done = None, None, 0, "", []

        def close() -> None:
            year, day = now.split("/")
            out.close()
            fs.move(aside, f"{base}/{year}/{int(day)}.log")
            done.append((now, n))

        for batch in batches:
            lines = batch.column("line").to_pylist()
            runs = batch.column("part").dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(lines)] if lines else [0]
            for low, high in zip(cuts, cuts[1:]):
                if (part := batch.column("part")[low].as_py()) != now:
                    if out:
                        close()
                    now, n, aside = part, 0, f"{base}/{part.split('/')[0]}/.{part.split('/')[1]}-{TaskContext.get().taskAttemptId()}"
                    fs.create_dir(aside.rsplit("/", 1)[0])
                    out = fs.open_output_stream(aside)
                out.write("".join(f"{line}\n" for line in lines[low:high]).encode())
                n += high - low
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["part", "lines"])

    return lines.repartition("part").sortWithinPartitions("part", "seq", F.lower(F.substring("line", 1, 2)).eqNullSafe("t ").desc()).select("part", "line").mapInArrow(write, "part string, lines long")
