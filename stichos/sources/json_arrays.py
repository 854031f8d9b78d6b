"""JSON arrays as tables: files of any size are cut into byte ranges that many tasks read.

Whether a byte stands inside a string cannot be told from a range alone. So each range is first summed up for both cases (the parity of its
quotes, and by how much brackets open or close in it if it begins outside or inside a string); running sums over the ranges of a file give
the true state at each start; then every range yields the elements whose separator it holds, reading on to the end of its last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

RANGE_BYTES = 8 << 20


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        path = rest if colon else uri
        return pafs.LocalFileSystem(), ("/" + path.lstrip("/") if colon or path.startswith("/") else path)
    return pafs.FileSystem.from_uri(uri)


def _files(path: str) -> list[tuple[str, int]]:
    """Data files of a path and their sizes, on the driver (names with a leading dot or underscore are no data)."""
    store, place = _store(path)
    found = store.get_file_info(place)
    if found.type == pafs.FileType.Directory:
        found = store.get_file_info(pafs.FileSelector(place, recursive=True))
    else:
        found = [found]
    head = path[:len(path) - len(place)] if path.endswith(place) else ""
    return [(head + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and not f.base_name.startswith((".", "_"))]


class _Bytes:
    """Reads of one file, and whether the byte at a place is escaped."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)

    def read(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(start)
        return np.frombuffer(self.file.read(stop - start), np.uint8)

    def escaped(self, place: int) -> bool:
        """An odd run of backslashes stands before it (they occur in strings only)."""
        run, step = 0, 64
        while place > run:
            part = self.read(max(0, place - run - step), place - run)
            other = np.flatnonzero(part != 92)
            if len(other):
                return (run + len(part) - 1 - int(other[-1])) % 2 == 1
            run, step = run + len(part), step * 2
        return run % 2 == 1


def _structure(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Quotes that open or close a string before each byte, by how much each byte opens as a bracket, the quotes in all, and
    whether the byte behind is escaped."""
    at, slash = np.arange(len(data)), data == 92
    # the last place without a backslash up to each byte: the run behind it has the escapes
    last = np.maximum.accumulate(np.where(slash, -1, at))
    before = np.concatenate([[-1], last[:-1]])
    run = at - 1 - before + np.where(before < 0, int(escaped), 0)
    quote = (data == 34) & (run % 2 == 0)
    quotes = np.cumsum(quote)
    opens = ((data == 91) | (data == 123)).astype(np.int64) - ((data == 93) | (data == 125))
    tail = len(data) - 1 - int(last[-1]) + (int(escaped) if last[-1] < 0 else 0)
    return quotes - quote, opens, int(quotes[-1]), tail % 2 == 1


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    files = spark.createDataFrame(_files(path), "file string, size long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    return files.select("file", starts, "size").select("file", "start", F.least(F.col("start") + range_bytes, "size").alias("stop")).repartition(tasks, "file", "start")


SUMMARY = "file string, start long, stop long, parity long, outside long, inside long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            source = _Bytes(r["file"])
            quotes, opens, total, _ = _structure(source.read(r["start"], r["stop"]), source.escaped(r["start"]))
            odd = quotes % 2 == 1
            rows.append((r["file"], r["start"], r["stop"], total % 2, int(opens[~odd].sum()), int(opens[odd].sum())))
        if rows:
            names = [f.split(" ")[0] for f in SUMMARY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


class _Reader:
    """Cuts a file at the separators of its arrays, from a known state on."""

    def __init__(self, source: _Bytes, at: int, in_string: int, depth: int):
        self.source, self.at, self.in_string, self.depth, self.escaped = source, at, in_string, depth, source.escaped(at)

    def separators(self, stop: int) -> tuple[bytes, list[int], list[bool]]:
        """The bytes up to `stop`, the places in them that bound elements, and whether one begins there."""
        data = self.source.read(self.at, stop)
        self.at += len(data)
        if not len(data):
            return b"", [], []
        quotes, opens, total, escaped = _structure(data, self.escaped)
        outside = (quotes + self.in_string) % 2 == 0
        change = np.where(outside, opens, 0)
        after = self.depth + np.cumsum(change)
        before = after - change
        begins = outside & (((data == 44) & (before == 1)) | ((data == 91) & (before == 0)))
        marks = np.flatnonzero(begins | (outside & (data == 93) & (before == 1)))
        self.in_string, self.depth, self.escaped = (self.in_string + total) % 2, int(after[-1]), escaped
        return data.tobytes(), marks.tolist(), begins[marks].tolist()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the elements whose separator (the opening bracket or a comma of the array) lies in the range."""
    for batch in batches:
        for r in batch.to_pylist():
            reader, stop = _Reader(_Bytes(r["file"]), r["start"], r["in_string"], r["depth"]), r["stop"]
            found, open_, own = [], None, True
            while own or open_ is not None:
                data, marks, begins = reader.separators(stop)
                start = 0
                for mark, begin in zip(marks, begins):
                    if open_ is not None:
                        found.append(b"".join([*open_, data[start:mark]]).strip())
                        open_ = None
                    if not own:
                        break
                    if begin:
                        open_, start = [], mark + 1
                if open_ is not None:
                    open_.append(data[start:])
                if not data:                                           # the file ends within an element, which is none then
                    break
                own, stop = False, reader.at + max(1 << 16, r["stop"] - r["start"])
            texts = [f.decode("utf-8", "replace") for f in found if f]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


def json_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements of the arrays in a file, or in all files below a folder, as texts (value). Empty arrays and files have none."""
    if not _files(path):
        return spark.createDataFrame([], "value string")
    ranges = _ranges(spark, path, range_bytes)
    summed = ranges.mapInArrow(_summaries, SUMMARY)
    # one row per range
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = summed.withColumn("in_string", F.coalesce(F.sum("parity").over(before) % 2, F.lit(0)))
    known = known.withColumn("_change", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    known = known.withColumn("depth", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = known.select("file", "start", "stop", "in_string", "depth").repartition(tasks, "file", "start")
    return spread.mapInArrow(_elements, "value string")


def write_json_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON array per task, an object per row and line."""
    write_elements(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, mode)


def write_elements(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON array per task of elements that are JSON texts already (value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            rows = batch.column("value").to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([("," if opened or k else "[") + v for k, v in enumerate(rows)], pa.string())], ["value"])
                opened = True
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"], pa.string())], ["value"])

    texts.select("value").mapInArrow(run, "value string").write.mode(mode).text(path)
