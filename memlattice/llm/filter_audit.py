"""How filters interact: direct relational replay of every order in which they can be applied.

Each document's failures are found once and kept as bits. They are crossed with the table of orders (120 of five filters),
which is broadcast; a document's first failure in an order follows from its bits and the order's, and the order's steps are
exploded with it. Counts are conditional sums by part, order and step, combined on the map side, so what is shuffled is one
row for each part and step of a task, and a part that holds most documents is as quick as any other. Rows before that grow with
documents times orders times steps, in a pipelined stage that stores none of them. Orders grow as the factorial of
the filters: at most six filters are taken (720 orders), which bounds what is broadcast.

A copy is a document whose text some smaller id has. Least ids are found by the text's SHA-256, with partial minima; a document is
looked up by id and text, so a text that a third of all documents share is no hot key.

Null texts are empty ones, null parts are the empty string, which is one part with it. Texts of any length are measured whole. Rows
that repeat an id (and text) are judged one by one, and none of them is a copy of another; null ids are smaller than nothing and
larger than nothing, so such rows are never copies. Labels of one id are merged: a document is good or toxic if any of them says so;
labels of null ids belong to nobody. Only the columns named are read, so others can't clash. Without documents there are no
parts, and the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import words

#: Six filters have 720 orders.
MOST_FILTERS = 6


@dataclass(frozen=True)
class Filter:
    """A letter, and the SQL condition under which a document fails; {t} is the text, {w} its words, {copy} whether it is a copy."""

    name: str
    fails: str


FILTERS = (
    Filter("A", "size({w}) < 200"),
    Filter("B", "100 * size(array_distinct({w})) < 50 * size({w})"),
    Filter("C", "100 * length(regexp_replace({t}, '[^A-Z]+', '')) > 3 * length({t})"),
    Filter("D", "{t} rlike '[#$%&*|]'"),
    Filter("E", "{copy}"),
)


def _any(bits: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0))


def flags(df: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, fails): each document's failures, filter k's as bit k."""
    t = F.coalesce(F.col(text), F.lit("")).alias("t")
    measured = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), t).withColumn("w", words(F.col("t")))
    own = [F.when(F.expr(f.fails.format(t="t", w="w", copy="false")), 1 << k).otherwise(0) for k, f in enumerate(filters) if "{copy}" not in f.fails]
    # written: the texts are read once, for the failures and for what identifies them
    measured = materialize(measured.select("id", "part", _any(own).alias("own"), F.unhex(F.sha2(F.col("t"), 256)).alias("digest")))
    first = measured.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    found = measured.join(first, ["digest", "id"], "left").withColumn("is_copy", F.col("id").isNotNull() & F.col("is_first").isNull())
    copied = [F.when(F.expr(f.fails.format(t="''", w="array()", copy="is_copy")), 1 << k).otherwise(0) for k, f in enumerate(filters) if "{copy}" in f.fails]
    return found.select("id", "part", F.col("own").bitwiseOR(_any(copied)).alias("fails"))


def orders(df: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """(filter_order, steps): each order of the filters, and its filters' bits from the first step to the last."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters can be replayed in all orders")
    rows = [("".join(filters[k].name for k in p), [1 << k for k in p]) for p in permutations(range(len(filters)))]
    return df.sparkSession.createDataFrame(rows, "filter_order string, steps array<int>").coalesce(1)


def replay(flagged: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """flagged: (part, fails, good, toxic). (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): what each step of each order does to the part's documents."""
    n = len(filters)
    crossed = flagged.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders(flagged, filters)))
    # the least step at which the document fails, n if at none
    first = F.least(*(F.when(F.col("fails").bitwiseAND(F.col("steps")[k]) != 0, k).otherwise(n) for k in range(n)))
    stepped = crossed.withColumn("first", first).select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("steps").alias("at", "bit"))
    here = F.col("first") == F.col("at")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    counted = stepped.groupBy("part", "filter_order", "at", "bit").agg(
        count(F.col("first") > F.col("at")).alias("kept"),
        count(here).alias("removed"),
        count((F.col("first") < F.col("at")) & (F.col("fails").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
    )
    # over orders times steps of each part, whatever the documents
    share = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return counted.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", share.alias("shapley"))


def audit(df: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The replay of df's documents; labels: (id_col, quality, toxic) of some of them."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    said = said.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = flags(df, filters, id_col, text, part).join(said, "id", "left")
    return replay(known.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), filters)


def op12(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the contract."""
    return audit(df, labels)


ORACLE = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), c as (
  select *, min(doc_id) over (partition by t) as least from w
), f as (
  select doc_id, part, len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > least, false) as e
  from c
), l as (
  select doc_id, max(quality) filter (where quality = 1) as quality, max(toxic) filter (where toxic = 1) as toxic from labels group by doc_id
), g as (
  select part, (case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end) as fails,
         coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
  from f left join l on l.doc_id = f.doc_id
), n as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), o as (
  select n1.x || n2.x || n3.x || n4.x || n5.x as filter_order from n n1, n n2, n n3, n n4, n n5
  where n2.x <> n1.x and n3.x not in (n1.x, n2.x) and n4.x not in (n1.x, n2.x, n3.x) and n5.x not in (n1.x, n2.x, n3.x, n4.x)
), r as (
  select g.*, filter_order, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: contains(fails, substr(filter_order, k, 1)))), 6) as gone from g, o
), s as (
  select part, filter_order, step, substr(filter_order, step, 1) as x, count(*) filter (where gone > step) as kept, count(*) filter (where gone = step) as removed,
         count(*) filter (where gone < step and contains(fails, substr(filter_order, step, 1))) as redundant,
         count(*) filter (where fails = substr(filter_order, step, 1)) as unique_fails,
         count(*) filter (where gone = step and good) as good_lost, count(*) filter (where gone = step and toxic) as toxic_lost
  from r, (select unnest([1, 2, 3, 4, 5]) as step) group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from s
"""
