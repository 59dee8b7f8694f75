"""Line deduplication over levelled sorted runs of line hashes.

The documents come in batches, those with the largest ids first. A run is a table of (128-bit line hash, documents that
hold it, largest document id), dealt into buckets and sorted by hash. Each batch's hashes are counted and merge-joined with
the runs: those that no run holds (the anti-join's) have their first, and thus largest, holder here; of the others only the
count is news. Both go into a run of level 0. Whenever a level holds `fanout` runs, they are compacted into one of the next
level. Runs are never dealt out or sorted again: every join and compaction reads them as they lie. After the last batch the
runs say which lines go: those held often enough, from all documents but the holder they name. Only DataFrame functions run.

Null or empty texts are one empty line. Repeated rows of a document count once and are cleaned alike; rows of one id with
different texts are one document, each cleaned by its own lines. Rows with a null id are never counted and lose no line. Of
equal lines in one document all go or all stay. A text's lines are worked through once, however many go and however long
they are. Columns with clashing names keep them, the added ones take free names. Of an empty table the result is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, in_order, materialize, materialize_sorted
from .common import free

#: The white space that is stripped at both ends of a line; fixed values.
STRIPPED = " \t\n\x0b\f\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased (lower() does it alone where all is ASCII)."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def keyed_lines(df: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(id, t, p, a, b): each keyed line's document, a hash of the text it stands in, its place there and its own two hashes."""
    x = df.where(F.col(id_col).isNotNull() & (F.length(text) >= min_chars))
    x = x.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(lines_of(F.col(text))).alias("p", "line"))
    # stripping only shortens a line, so a shorter line needs no key
    x = x.where(F.length("line") >= min_chars).select("id", "t", "p", line_key(F.col("line")).alias("key"))
    return x.where(F.length("key") >= min_chars).select("id", "t", "p", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def id_bounds(df: DataFrame, id_col: str, batches: int) -> list:
    """Ids that part the rows into about equal batches, the largest first; of any type that has an order."""
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).repartitionByRange(8 * batches, "id")
    parts = sorted(((r["top"], r["n"]) for r in ids.groupBy(F.spark_partition_id()).agg(F.max("id").alias("top"), F.count("*").alias("n")).collect()), reverse=True)
    whole, held, out = sum(n for _, n in parts), 0, []
    for (_, n), (below, _) in zip(parts, parts[1:]):
        held += n
        if held * batches >= whole * (len(out) + 1):
            out.append(below)
    return out[: batches - 1]


class LineRuns:
    """The runs by level. Old runs are deleted once a compacted one stands for them."""

    def __init__(self, buckets: int, fanout: int = 4):
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def probed(self, hashes: DataFrame) -> DataFrame:
        """hashes: (a, b, ...), one row each. Adds `known`: whether a run holds the line. Those that none does are the anti-join."""
        marks = [f"in_{k}" for k in range(len(self.runs))]
        x = hashes
        for mark, run in zip(marks, self.runs):
            x = x.join(run.select("a", "b", F.lit(True).alias(mark)).hint("merge"), ["a", "b"], "left")
        known = reduce(Column.__or__, (F.col(m).isNotNull() for m in marks), F.lit(False))
        return x.withColumn("known", known).drop(*marks)

    def added(self, batch: DataFrame) -> DataFrame:
        """The plan of add()."""
        new = self.probed(batch.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("top")))
        return new.select("a", "b", "n", F.when(~F.col("known"), F.col("top")).alias("top"))

    def add(self, batch: DataFrame) -> None:
        """batch: distinct (id, a, b) of documents, whose ids are all smaller than those of earlier batches."""
        with in_order(batch.sparkSession):
            self._put(materialize_sorted(self.added(batch), self.buckets, "a", "b"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(self.levels[level], level + 1)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs in one, for use under in_order(): counts are added up, the one id that a line has is kept."""
        # all rows pass the filter, but it makes rows of the column batches: of those Spark 4.1 lays the union's buckets side by
        # side, yet plans the sum as if it had joined them
        return reduce(DataFrame.unionByName, [x.where(F.col("n") > 0) for x in runs]).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _compact(self, old: list[DataFrame], level: int) -> None:
        run = materialize_sorted(self.merged(old), self.buckets, "a", "b")
        self.levels = [[x for x in xs if not any(x is y for y in old)] for xs in self.levels]
        self._put(run, level)
        for x in old:
            discard(x)

    def common(self, min_docs: int) -> DataFrame:
        """(a, b, top) of the lines that min_docs documents or more hold, from one run into which all are compacted."""
        with in_order(self.runs[0].sparkSession):
            if len(self.runs) > 1:
                self._compact(self.runs, len(self.levels))
        # written first: the join then reads two plain sides, and a line that very many documents hold can be split
        return materialize(self.runs[0].where(F.col("n") >= min_docs).select("a", "b", "top"))

    def clear(self) -> None:
        for run in self.runs:
            discard(run)
        self.levels = []


def dropped_places(df: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(id, t, gone): the places of the lines that go, in order, for each text that loses any."""
    spark = df.sparkSession
    bounds = id_bounds(df, id_col, batches)
    batch = sum(((F.col("id") <= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    lined = materialize(keyed_lines(df, id_col, text, min_chars).withColumn("batch", batch), "batch")
    runs = LineRuns(int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for k in range(len(bounds) + 1):
        runs.add(lined.where(F.col("batch") == k).select("id", "a", "b").distinct())
    common = runs.common(min_docs)
    runs.clear()
    drops = lined.join(common, ["a", "b"]).where(F.col("id") < F.col("top"))
    out = materialize(drops.groupBy("id", "t").agg(F.sort_array(F.collect_set("p")).alias("gone")))
    discard(common)
    discard(lined)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4, kept: str = "kept_text") -> DataFrame:
    """df with three columns more: kept (the text without the lines that go), n_lines and n_dropped."""
    kept, n_lines, n_dropped, gone, key, mark, lines = free(df, kept, "n_lines", "n_dropped", "l_gone", "l_id", "l_text", "l_lines")
    drops = dropped_places(df, id_col, text, min_chars, min_docs, batches, fanout).toDF(key, mark, gone)
    # joined alike at every size: by sorting, however few lines go
    x = df.join(drops.hint("merge"), (df[id_col] == F.col(key)) & (F.xxhash64(df[text]) == F.col(mark)), "left").drop(key, mark)
    x = x.withColumn(lines, lines_of(F.col(text)))
    # what lies between one line that goes and the next: each line is copied once
    between = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda k: F.slice(F.col(lines), F.coalesce(F.get(gone, k - 1), F.lit(-1)) + 2, F.coalesce(F.get(gone, k), F.size(lines)) - F.coalesce(F.get(gone, k - 1), F.lit(-1)) - 1),
    )
    return x.select(
        *(x[c] for c in df.columns),
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(gone).isNotNull(), F.array_join(F.flatten(between), "\n")).otherwise(F.coalesce(F.col(text), F.lit(""))).alias(kept),
    )


def op8(df: DataFrame) -> DataFrame:
    """The digest of the contract."""
    x = dedup_lines(df.select("doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(df: DataFrame) -> DataFrame:
    """The documents with their cleaned text and its length."""
    kept, lines, dropped = free(df, "kept_text", "n_lines", "n_dropped")
    x = dedup_lines(df, kept=kept)
    return x.select(*(F.col(kept).alias("text") if c == "text" else F.length(kept).cast(df.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in df.columns))


ORACLE = r"""
with l as (
  select doc_id, i, ls[i] as line, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))
), k as (
  select key, max(doc_id) as top from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), f as (
  select l.*, (k.key is not null and l.doc_id < k.top) as gone from l left join k on k.key = l.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from f group by doc_id
"""
