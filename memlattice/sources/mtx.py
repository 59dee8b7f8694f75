"""Matrix Market files: plain, .gz, .tar, .tar.gz and .tgz, through any path that Spark reads.

Plain files are scanned in splits; a line's place follows from its split's offset and its place in the split.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MatrixError
from ..functions.scalars import member_name, reorder_suffix
from ..operators import reorder
from ..operators.matrix import INT_MAX, SparseMatrix
from ..operators.position import positioned
from ..session import materialize, ship

#: Tokens of a header line; fixed values of the format.
IDENTIFIER = "%%MatrixMarket"
OBJECTS, FORMATS = ("matrix", "vector"), ("coordinate", "array")
FIELDS = {"real": 3, "double": 3, "complex": 4, "integer": 3, "pattern": 2}
#: Bytes of a part that are copied at once.
COPIED = 4 << 20
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Header:
    object: str = "matrix"
    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"
    rows: int = 0
    columns: int = 0
    num_entries: int = 0
    comments: tuple[str, ...] = ()


@dataclass(frozen=True)
class MatrixMarket:
    """entries: (k, i, j, a[, im]) with one-based indices, as in the file; a is null for pattern matrices."""

    header: Header
    entries: DataFrame

    def matrix(self) -> SparseMatrix:
        """Zero-based, real values (the real part of complex ones, 1 for pattern); symmetry is not expanded."""
        if self.header.format != "coordinate":
            raise MatrixError("Expected matrix in coordinate format")
        a = F.lit(1.0) if self.header.field == "pattern" else F.col("a").cast("double")
        return SparseMatrix(self.entries.select("k", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), a.alias("a")), self.header.rows, self.header.columns, self.header.field, self.header.symmetry)

    def same_as(self, other: MatrixMarket) -> bool:
        """Equal headers, comments too, and equal entries, place by place."""
        columns = self.entries.columns
        if self.header != other.header or sorted(columns) != sorted(other.entries.columns):
            return False
        theirs = other.entries.select(*columns)
        return self.entries.exceptAll(theirs).isEmpty() and theirs.exceptAll(self.entries).isEmpty()


def parse_header(line: str) -> Header:
    tokens = line.split()
    if not tokens or tokens[0] != IDENTIFIER:
        raise MatrixError(f"Expected identifier {IDENTIFIER}")
    low = [t.lower() for t in tokens[1:5]] + [""] * 4
    for what, token, known in (("object", low[0], OBJECTS), ("format", low[1], FORMATS), ("field", low[2], FIELDS), ("symmetry", low[3], SYMMETRIES)):
        if token not in known:
            raise MatrixError(f"Expected a known {what}, got '{token}'")
    return Header(low[0], low[1], "real" if low[2] == "double" else low[2], low[3])


def parse_size(line: str, header: Header, comments: tuple[str, ...]) -> Header:
    wanted = 3 if header.format == "coordinate" else 2
    try:
        n = [int(t) for t in line.split()[:wanted]]
    except ValueError:
        n = []
    if len(n) < wanted or min(n) < 0 or max(n) > INT_MAX:
        raise MatrixError("Failed to parse the size line")
    return Header(header.object, header.format, header.field, header.symmetry, n[0], n[1], n[2] if wanted == 3 else 0, comments)


def _untar(member: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:*") as tar:
                    found = False
                    for m in tar:
                        if m.name == member or m.name.startswith(member) or not member:
                            found, lines, at = True, [], 0
                            for line in io.TextIOWrapper(tar.extractfile(m), "utf-8"):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 50_000:
                                    yield pa.RecordBatch.from_arrays([pa.array([0] * len(lines)), pa.array(range(at, at + len(lines))), pa.array(lines)], ["block", "row", "value"])
                                    at, lines = at + len(lines), []
                            yield pa.RecordBatch.from_arrays([pa.array([0] * len(lines), pa.int64()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["block", "row", "value"])
                            break
                    if not found:
                        raise ValueError(f"no member {member}")

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, row, value), in order by block and row."""
    if path.endswith((".tar.gz", ".tgz", ".tar")):
        ship(spark)
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_untar(member_name(path)), "block long, row long, value string")
    return spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def read(spark: SparkSession, path: str) -> MatrixMarket:
    """The header is read on the driver; entries are as many as it says, further lines are ignored."""
    lines = materialize(_lines(spark, path))
    n = 64
    while True:  # comments may be many
        head = [r["value"] for r in lines.where("block = 0").orderBy("row").limit(n).collect()]
        if not head:
            raise MatrixError(f"{path}: the file is empty")
        header = parse_header(head[0])
        at = 1
        while at < len(head) and head[at].startswith("%"):
            at += 1
        while at < len(head) and not head[at].strip():
            at += 1
        if at < len(head) or len(head) < n:
            break
        n *= 8
    comments = tuple(c for c in head[1:at] if c.startswith("%"))
    header = parse_size(head[at] if at < len(head) else "", header, comments)
    size_row = lines.where("block = 0").orderBy("row").limit(at + 1).agg(F.max("row")).first()[0]
    body = lines.where((F.col("block") > 0) | (F.col("row") > size_row)).where(F.trim("value") != "")
    if header.format == "array":
        return MatrixMarket(header, spark.createDataFrame([], "k long, i int, j int, a double"))
    return MatrixMarket(header, _entries(body, header, path))


def _entries(body: DataFrame, header: Header, path: str) -> DataFrame:
    k = positioned(body, ["block", "row"], "k").where(F.col("k") < header.num_entries)
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    width = FIELDS[header.field]
    number = "int" if header.field == "integer" else "double"

    def token(n: int, kind: str) -> Column:
        return F.get(t, F.lit(n)).try_cast(kind)

    cols = [token(0, "int").alias("i"), token(1, "int").alias("j"), (token(2, number) if width > 2 else F.lit(None).cast(number)).alias("a")]
    if header.field == "complex":
        cols.append(token(3, "double").alias("im"))
    out = materialize(k.select("k", *cols))
    need = [c for c in out.columns if not (c == "a" and header.field == "pattern")]
    bad = F.sum(F.when(sum((F.col(c).isNull().cast("int") for c in need), F.lit(0)) > 0, 1).otherwise(0))
    n, wrong = out.agg(F.count("*"), F.coalesce(bad, F.lit(0))).first()
    if n < header.num_entries or wrong:
        raise MatrixError(f"{path}: expected {header.num_entries} entries, got {n - wrong}")
    return out


def load(spark: SparkSession, path: str, order: str | None = None, parts: DataFrame | None = None) -> SparseMatrix:
    """A matrix by path; __RCM and __GP<n> suffixes, or order="rcm", "gp", ask for a reordering (rcm first). parts: a partition of
    the rows for gp; without one, and without n, gp leaves the order as it is."""
    path, asked, n = reorder_suffix(path)
    m = read(spark, path).matrix()
    wanted = {*(asked or "").split("+"), *(order or "").split("+")}
    if "rcm" in wanted:
        m = m.permuted(reorder.reverse_cuthill_mckee(m))
    if "gp" in wanted:
        m = m.permuted(reorder.graph_partition(m, parts, n))
    return m


def lines_of(mm: MatrixMarket, write_entries: bool = True) -> DataFrame:
    """(k, value): the file's lines; header lines have negative k. Values are written in full precision."""
    h = mm.header
    size = f"{h.rows} {h.columns}" + (f" {h.num_entries}" if h.format == "coordinate" else "")
    head = [f"{IDENTIFIER} {h.object} {h.format} {h.field} {h.symmetry}", *h.comments, size]
    spark = mm.entries.sparkSession
    out = spark.createDataFrame([(k - len(head), v) for k, v in enumerate(head)], "k long, value string")
    if not write_entries:
        return out
    cols = ["i", "j"] + ([] if h.field == "pattern" else ["a", "im"] if h.field == "complex" else ["a"])
    return out.unionByName(mm.entries.select("k", F.concat_ws(" ", *(F.col(c).cast("string") for c in cols)).alias("value")))


def write(mm: MatrixMarket, path: str, write_entries: bool = True) -> None:
    """One file, gzipped if its name ends in .gz. Lines are sorted and written in parts side by side, as many as the sort has; the parts are
    then put behind one another, some MB at a time (members of gzip files may follow one another)."""
    spark = mm.entries.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    out = lines_of(mm, write_entries).orderBy("k").select("value")
    out.write.option("compression", "gzip" if path.endswith(".gz") else "none").text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    # parts are named by their number, which is their order
    parts = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    target = jvm.org.apache.hadoop.fs.Path(path)
    joined = parts[0]
    if len(parts) > 1:
        joined = jvm.org.apache.hadoop.fs.Path(at, "joined")
        to = fs.create(joined)
        try:
            for part in parts:
                source = fs.open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, to, COPIED, False)
                source.close()
        finally:
            to.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(joined, target)
    fs.delete(at, True)


def of(m: SparseMatrix, comments: tuple[str, ...] = ()) -> MatrixMarket:
    """A matrix as a file of real values, of the symmetry it has."""
    entries = m.entries.select("k", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "a")
    return MatrixMarket(Header(symmetry=m.symmetry, rows=m.rows, columns=m.columns, num_entries=m.num_entries(), comments=comments), entries)
