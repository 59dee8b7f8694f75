"""Mixing sources to target weights.

Words are counted per source with map-side partial sums. Targets share the whole amount by weight; no target exceeds
`most` times its source's size, and what a capped source leaves is shared again by weight. A source's repetition rate is
target / size, and each document is emitted floor(rate) times, plus once more with probability equal to the fraction,
decided by a hash of the seed and the document's id: reruns agree and no random state is kept.

A null source is a source of its own, last in order. Null or empty texts have size 0; a text of any length is counted whole.
Rows with the same id, or with none, share their draw. A source of size 0 has rate 0. Of sources that are capped at the same
level (ties), the first by name counts first; the targets are the same either way. Columns with clashing names keep them, the
added ones take free names. Of an empty table the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free, words

#: Up to so many sources their rates are sent to every executor; beyond, they are joined.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes: (source, source_size). Adds weight, target and rate.

    Sharing again and again ends where every source has min(most * size, level * weight) for one level. Sources are
    ordered by the level at which they are capped; the level follows from the running sums. The windows see one row per
    source, not per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    x = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * most).withColumn("capped_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("capped_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    x = x.withColumn("level", left / rest)
    # the first source that isn't capped at its own level sets the level of all that follow
    x = x.withColumn("level", F.min(F.when(F.col("level") < F.col("capped_at"), F.struct("capped_at", F.col("source").isNull().alias("z"), "source", "level"))).over(everything)["level"])
    target = F.when((F.col("level").isNull()) | (F.col("capped_at") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return x.select("source", "source_size", "weight", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def draw(id_col: Column, seed: int) -> Column:
    """Uniform in [0, 1) from 52 bits of a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, payload: bool = True) -> DataFrame:
    """df with size, source_size, target, rate and copies (how often the mix takes the row). payload: keep df's columns."""
    size, source_size, target, rate, copies, key = free(df, "size", "source_size", "target", "rate", "copies", "m_source")
    sized = df.withColumn(size, size_of(F.col(text)))
    if not payload:  # the words of each text are counted once
        sized = materialize(sized.select(id_col, source, size))
    per_source = targets(sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), weights, most)
    rates = materialize(per_source.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate)).coalesce(1))
    n = rates.count()
    out = sized.join(F.broadcast(rates) if n <= BROADCAST_SOURCES else rates, sized[source].eqNullSafe(F.col(key))).drop(key)
    extra = F.when(draw(F.col(id_col), seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    return out.withColumn(copies, (F.floor(rate) + extra).cast("int"))


def op6(df: DataFrame) -> DataFrame:
    """The digest of the contract."""
    x = mix(df.select("doc_id", "source", "text"), payload=False)
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def stage(df: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    size, source_size, target, rate, copies = free(df, "size", "source_size", "target", "rate", "copies")
    x = mix(df)
    return x.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*df.columns)


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight from d group by source
), c as (
  select *, source_size * 3 as cap, (source_size * 3)::double / weight as capped_at from s
), v as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as lv
  from c window o as (order by capped_at, source nulls last rows between unbounded preceding and 1 preceding)
), w as (
  select *, (select lv from v where lv < capped_at order by capped_at, source nulls last limit 1) as level from v
), t as (
  select source, source_size, case when level is null or capped_at <= level then cap::double else level * weight end as target from w
), r as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
  from d join t on d.source is not distinct from t.source
), k as (
  select *, (floor(rate) + case when ('0x' || substr(md5('17:' || doc_id), 1, 13))::bigint / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end)::integer as copies from r
)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies from k
"""
