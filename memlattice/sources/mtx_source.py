"""Matrix Market files by Spark's own front door: spark.read.format("mtx").load(path), df.write.format("mtx").save(path).

Reading. The header is read once, on the driver, and gives the schema; then each range of bytes is a partition, which begins after the
first line break in it and ends with the line that its last byte is in. A gzipped file is one partition, read as a stream. Each
entry comes with the byte its line begins at (of the plain text), which orders the entries as the file does; `numbered` turns it into places.
Whole ranges are parsed by numpy; a line of too few or too many values stops the task that meets it.

Writing. Each task writes its own part beside the file, in the order of its rows; the commit puts the header in front, streams the parts behind
it by partition, and moves the file into place. Sorted rows (orderBy) are written in order. A failed or repeated task leaves only parts that the
commit doesn't name, and an aborted job nothing.

Paths are those of pyarrow's file systems: local and shared folders, hdfs, s3, gs. What only Spark's readers can open goes through
sources.mtx. Options: field, symmetry, rows, columns (writing), comment, split_bytes (reading; the
least bytes of a range: a file that would fall into more than RANGES of them is cut into larger ones, of up to SPLIT_BYTES).
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import MatrixError
from ..operators.matrix import INT_MAX, SparseMatrix
from ..operators.position import positioned
from ..session import ship
from .mtx import FIELDS, IDENTIFIER, Header, parse_header, parse_size

SPLIT_BYTES = 32 << 20
#: Ranges smaller than SPLIT_BYTES are at most so many: a task takes longer to begin than to read some KB.
RANGES = 1024
#: Bytes that are parsed or copied at once.
CHUNK = 4 << 20
#: Bytes that are read at once to find the line break at a range's border.
BEYOND = 1 << 10

COLUMNS = {"real": "at long, i int, j int, a double", "integer": "at long, i int, j int, a int", "complex": "at long, i int, j int, a double, im double", "pattern": "at long, i int, j int"}
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_KINDS = {"real": (float,), "integer": (int,), "complex": (float, float), "pattern": ()}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _opened(path: str):
    where, at = located(path)
    f = where.open_input_stream(at, compression=None)
    return gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f


def header_of(path: str) -> tuple[Header, int]:
    """A file's header and the byte of its plain text at which the entries begin."""
    with _opened(path) as f:
        text, lines, ended = b"", [], False
        while not ended:
            more = f.read(1 << 16)
            text, ended = text + more, not more
            lines = text.split(b"\n")
            for n, line in enumerate(lines if ended else lines[:-1]):
                if n and line.strip() and not line.startswith(b"%"):
                    header = parse_header(lines[0].decode())
                    comments = tuple(x.decode().rstrip("\r") for x in lines[1:n] if x.startswith(b"%"))
                    return parse_size(line.decode(), header, comments), sum(len(x) + 1 for x in lines[: n + 1])
    if not text:
        raise MatrixError(f"{path}: the file is empty")
    parse_header(lines[0].decode())
    raise MatrixError(f"{path}: the file has no size line")


def parsed(text: bytes, at: int, field: str) -> pa.RecordBatch:
    """The entries of whole lines; at: the byte the first one begins at. Empty lines are passed over."""
    width = FIELDS[field]
    data = np.frombuffer(text, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    inside = ~_SPACE[data]
    first = inside & np.concatenate(([True], ~inside[:-1]))
    before = np.concatenate(([0], np.cumsum(first)))
    there = before[ends] - before[starts]
    full = there > 0
    if (wrong := np.flatnonzero(full & (there != width))).size:
        raise MatrixError(f"the entry at byte {at + starts[wrong[0]]} has {there[wrong[0]]} values, not {width}")
    values = text.split()
    try:
        columns = [np.array(values[k::width], dtype="S").astype(np.int32) for k in range(2)]
        columns += [np.array(values[2 + k :: width], dtype="S").astype(np.float64 if kind is float else np.int32) for k, kind in enumerate(_KINDS[field])]
    except ValueError as e:
        raise MatrixError(f"an entry near byte {at}: {e}") from None
    arrays = [pa.array(at + starts[full], pa.int64()), *(pa.array(c) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, ["at", "i", "j", "a", "im"][: len(arrays)])


@dataclass
class Bytes(InputPartition):
    start: int
    stop: int


class MtxReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, columns: list[str]):
        self.path, self.split_bytes, self.columns = path, split_bytes, columns
        self.header, self.begin = header_of(path)

    def partitions(self) -> list[Bytes]:
        if self.path.endswith(".gz"):
            return [Bytes(self.begin, -1)]
        where, at = located(self.path)
        size = where.get_file_info(at).size
        step = max(self.split_bytes, min(SPLIT_BYTES, -(-(size - self.begin) // RANGES)))
        return [Bytes(k, min(k + step, size)) for k in range(self.begin, size, step)] or [Bytes(size, size)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        for text, at in self._lines(partition):
            if text.strip():
                yield parsed(text, at, self.header.field).select(self.columns)

    def _lines(self, part: Bytes) -> Iterator[tuple[bytes, int]]:
        """Whole lines that begin in the range, some MB at once, and the byte they begin at."""
        if part.stop < 0:
            f, start, stop = _opened(self.path), part.start, None
            f.read(start)
            at = start
        else:
            where, path = located(self.path)
            f = where.open_input_file(path)
            start, stop = part.start, part.stop
            f.seek(start)
            at = start
            if start > self.begin:  # the line that the range begins in belongs to the one before
                f.seek(start - 1)
                at, skipped = start - 1, b""
                while b"\n" not in skipped:
                    more = f.read(BEYOND)
                    if not more:
                        return
                    skipped = more
                    at += len(more)
                at -= len(skipped) - skipped.index(b"\n") - 1
                f.seek(at)
        with f:
            rest = b""
            while stop is None or at < stop:
                # of a short range no more than what it lacks, and a little for the line that it ends in
                more = f.read(CHUNK if stop is None else min(CHUNK, max(stop - at - len(rest), 0) + BEYOND))
                text = rest + more
                if not text:
                    return
                if stop is not None and at + len(text) >= stop:  # up to the end of the line that holds the last byte
                    end = text.find(b"\n", stop - 1 - at)
                    if end >= 0:
                        yield text[: end + 1], at
                        return
                end = text.rfind(b"\n") + 1
                if not more:
                    yield text, at
                    return
                if end:
                    yield text[:end], at
                    at += end
                rest = text[end:]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class MtxWriter(DataSourceArrowWriter):
    """Tasks write parts side by side, the commit joins them."""

    def __init__(self, path: str, header: Header, columns: list[str]):
        self.path, self.header, self.columns, self.job = path, header, columns, uuid.uuid4().hex

    def _wanted(self) -> list[str]:
        return ["i", "j", *{"pattern": [], "complex": ["a", "im"]}.get(self.header.field, ["a"])]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, at = located(self.path)
        part, rows = f"{at}.{self.job}.part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with where.open_output_stream(part, compression="gzip" if self.path.endswith(".gz") else None) as out:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in self._wanted()]
                if any(x is None for c in columns for x in c):
                    raise MatrixError("an entry has no value")
                out.write("".join([" ".join(map(str, row)) + "\n" for row in zip(*columns)]).encode())
                rows += batch.num_rows
        return Written(task.partitionId(), part, rows)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        h = self.header
        head = [f"{IDENTIFIER} matrix coordinate {h.field} {h.symmetry}", *h.comments, f"{h.rows} {h.columns} {sum(m.rows for m in parts)}"]
        text = "".join(x + "\n" for x in head).encode()
        where, at = located(self.path)
        joined = f"{at}.{self.job}.joined"
        with where.open_output_stream(joined, compression=None) as out:
            out.write(gzip.compress(text) if self.path.endswith(".gz") else text)  # members of gzip files may follow one another
            for m in parts:
                with where.open_input_stream(m.path, compression=None) as part:
                    while more := part.read(CHUNK):
                        out.write(more)
        where.move(joined, at)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, at = located(self.path)
        folder, _, name = at.rpartition("/")
        for info in where.get_file_info(pafs.FileSelector(folder or ".")):
            if info.base_name.startswith(f"{name}.{self.job}."):
                where.delete_file(info.path)


class MtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return COLUMNS[header_of(self.options["path"])[0].field]

    def reader(self, schema) -> MtxReader:
        return MtxReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> MtxWriter:
        o, names = self.options, [f.name for f in schema.fields]
        path = o["path"]
        where, at = located(path)
        if not overwrite and where.get_file_info(at).type != pafs.FileType.NotFound:
            raise MatrixError(f"{path}: the file exists")
        where.create_dir(at.rpartition("/")[0] or ".", recursive=True)
        field = o.get("field", "real" if "a" in names else "pattern")
        header = parse_header(f"{IDENTIFIER} matrix coordinate {field} {o.get('symmetry', 'general')}")
        rows, columns = int(o["rows"]), int(o["columns"])
        if not (0 <= rows <= INT_MAX and 0 <= columns <= INT_MAX):
            raise MatrixError("the shape is larger than the format's 32-bit sizes")
        comments = tuple(f"% {x}" for x in o["comment"].split("\n")) if "comment" in o else ()
        return MtxWriter(path, Header(field=header.field, symmetry=header.symmetry, rows=rows, columns=columns, comments=comments), names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and this package to its executors."""
    ship(spark)
    spark.dataSource.register(MtxSource)


def numbered(entries: DataFrame, header: Header) -> SparseMatrix:
    """A file's entries as a matrix, its places from the order of the lines; as many as the header says, further ones are left out."""
    k = positioned(entries, ["at"], "k").where(F.col("k") < header.num_entries)
    value = F.lit(1.0) if header.field == "pattern" else F.col("a").cast("double")
    return SparseMatrix(k.select("k", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), value.alias("a")), header.rows, header.columns, header.field, header.symmetry)


def load(spark: SparkSession, path: str) -> SparseMatrix:
    """A file as a matrix, read by ranges of bytes."""
    register(spark)
    return numbered(spark.read.format("mtx").load(path), header_of(path)[0])


def save(m: SparseMatrix, path: str) -> None:
    """A matrix as a file in the order of its places: sorted by ranges, each written by its own task."""
    register(m.spark)
    e = m.entries.select("k", (F.col("i") + 1).cast("int").alias("i"), (F.col("j") + 1).cast("int").alias("j"), F.col("a").cast("double").alias("a")).orderBy("k")
    writer = e.write.format("mtx").option("rows", m.rows).option("columns", m.columns).option("symmetry", m.symmetry)
    writer.mode("overwrite").save(path)
