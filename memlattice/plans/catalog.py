"""The queries over matrices, layouts and samples, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json_tree, stats
from ..operators import formats, matrix, references, reorder, tiles
from ..session import own_dir
from ..sources import mtx
from . import tables
from .registry import query

#: CTEs that the SQL shares: entries in file order, shape, row-major positions, row starts.
BASE = """
with dims as (select (select max(o_orderkey) + 1 from orders)::bigint as nr, (select max(p_partkey) + 1 from part)::bigint as nc, (select count(*) from lineitem)::bigint as nnz),
e as (select row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate) - 1 as k, l_orderkey::bigint as i, l_partkey::bigint as j, l_quantity::double as a from lineitem),
s as (select row_number() over (order by i, j, k) - 1 as k, i, j, a from e),
rws as (select unnest(range(0, (select nr from dims))) as i),
len as (select rws.i, count(e.i)::bigint as len from rws left join e on e.i = rws.i group by rws.i),
ends as (select i, len, (sum(len) over (order by i rows between unbounded preceding and current row))::bigint as stop from len)
"""
SQUARE = """
with n as (select (select max(p_partkey) + 1 from part)::bigint as n),
e as (select l_suppkey::bigint as i, l_partkey::bigint as j, sum(l_quantity)::double as a from lineitem group by 1, 2)
"""


def _spmv_sql(term: str, join: str = "") -> str:
    return BASE + f"select rws.i, coalesce(y, 0.0)::double as y from rws left join (select e.i, sum({term})::double as y from e {join} group by e.i) z on z.i = rws.i"


_GATHER = "join part on p_partkey = e.j"
_PRODUCT = _spmv_sql("e.a * p_size", _GATHER)


@query("spmv_coo", _PRODUCT)
@query("spmv_coo_atomic", _PRODUCT)
def _coo(spark, d):
    return matrix.spmv(tables.lineitem_matrix(spark, d, False), tables.part_sizes(spark, d))


@query("spmv_csr", _PRODUCT)
@query("spmv_csr_unrolled", _PRODUCT)
def _csr(spark, d):
    return references.Csr(tables.lineitem_matrix(spark, d)).run(tables.part_sizes(spark, d))


@query("spmv_csr_row_aligned", _PRODUCT)
def _csr_aligned(spark, d):
    m = tables.lineitem_matrix(spark, d)
    return references.Csr(m, layout=formats.csr(m, 4)).run(tables.part_sizes(spark, d))


@query("spmv_ell", _PRODUCT)
def _ell(spark, d):
    return references.Ell(tables.lineitem_matrix(spark, d)).run(tables.part_sizes(spark, d))


@query("spmv_ell_skip_padding", _PRODUCT)
def _ell_skip(spark, d):
    return references.Ell(tables.lineitem_matrix(spark, d), skip_padding=True).run(tables.part_sizes(spark, d))


@query("spmv_hybrid", _PRODUCT)
def _hybrid(spark, d):
    return references.Hybrid(tables.lineitem_matrix(spark, d)).run(tables.part_sizes(spark, d))


@query("spmv_twice", SQUARE + """, x as (select p_partkey::bigint as j, p_size::double as v from part),
y as (select e.i, sum(e.a * v) as y from e join x on x.j = e.j group by e.i)
select r.i, coalesce(z, 0.0)::double as y from (select unnest(range(0, (select n from n))) as i) r left join (select e.i, sum(e.a * y) as z from e join y on y.i = e.j group by e.i) z on z.i = r.i""")
def _twice(spark, d):
    """A (A x) over tiles that are dealt out once."""
    t = tiles.Tiles(tables.square_matrix(spark, d))
    y = t.power(tables.part_sizes(spark, d), 2)
    t.discard()
    return y


@query("spmv_accumulate", BASE + "select rws.i, (1.0 + coalesce(y, 0.0))::double as y from rws left join (select e.i, sum(e.a * p_size)::double as y from e join part on p_partkey = e.j group by e.i) z on z.i = rws.i")
def _accumulate(spark, d):
    m = tables.lineitem_matrix(spark, d, False)
    return matrix.spmv(m, tables.part_sizes(spark, d), matrix.ones(spark, m.rows))


@query("spmv_mkl_csr", SQUARE + "select r.i, coalesce(y, 0.0)::double as y from (select unnest(range(0, (select n from n))) as i) r left join (select e.i, sum(e.a * p_size)::double as y from e join part on p_partkey = e.j group by e.i) z on z.i = r.i")
def _mkl(spark, d):
    return references.VendorCsr(tables.square_matrix(spark, d)).run(tables.part_sizes(spark, d))


@query("spmv_regular_traffic", _spmv_sql("e.a"))
def _regular(spark, d):
    return matrix.spmv_regular_traffic(tables.lineitem_matrix(spark, d, False))


@query("spmv_irregular_traffic", _spmv_sql("p_size", _GATHER))
def _irregular(spark, d):
    return matrix.spmv_irregular_traffic(tables.lineitem_matrix(spark, d, False), tables.part_sizes(spark, d))


@query("triad", "select unnest(range(0, (select count(*) from lineitem)))::bigint as idx, (1.0 + 3.1 * 2.0)::double as a")
def _triad(spark, d):
    return matrix.triad(spark, tables.table(spark, d, "lineitem").count(), 1.0, 2.0)


@query("vector_norm", "select sqrt(sum(p_size * p_size)::double) as l2norm from part")
def _norm(spark, d):
    return matrix.l2norm(tables.part_sizes(spark, d))


@query("vector_inner", "select sum(p_size * p_size)::double as inner_product from part")
def _inner(spark, d):
    x = tables.part_sizes(spark, d)
    return matrix.inner(x, x).withColumnRenamed("inner", "inner_product")


@query("coo_entries", BASE + "select k, i, j, a from e")
def _coo_entries(spark, d):
    return tables.lineitem_matrix(spark, d).entries


@query("row_lengths", BASE + "select i, len from len")
def _row_lengths(spark, d):
    return tables.lineitem_matrix(spark, d, False).row_lengths()


@query("max_row_length", BASE + "select max(len)::bigint as max_row_length from len")
def _max_row_length(spark, d):
    return tables.lineitem_matrix(spark, d, False).max_row_length()


@query("row_length_histogram", BASE + 'select len, count(*)::bigint as "rows" from len group by len')
def _histogram(spark, d):
    return tables.lineitem_matrix(spark, d, False).row_length_histogram()


_WIDTH = "(select coalesce(min(len), 0) from (select len, sum(count(*)) over (order by len) as upto from len group by len) where upto >= (2 * (select nr from dims)) // 3)"


@query("hybrid_ell_width", BASE + f"select {_WIDTH}::bigint as ell_row_length")
def _width(spark, d):
    return formats.hybrid_width(tables.lineitem_matrix(spark, d, False))


@query("csr_row_ptr", BASE + "select 0::bigint as r, 0::bigint as ptr union all select i + 1, stop from ends")
def _row_ptr(spark, d):
    return formats.csr(tables.lineitem_matrix(spark, d)).ptr


@query("csr_entries", BASE + "select k, i, j, a from s")
def _csr_entries(spark, d):
    return formats.csr(tables.lineitem_matrix(spark, d)).entries.drop("is_pad")


_ALIGNED = BASE + ", al as (select i, len, ((len + 3) // 4 * 4)::bigint as w from len), ae as (select *, (sum(w) over (order by i rows between unbounded preceding and current row))::bigint as stop from al) "


@query("csr_row_aligned_ptr", _ALIGNED + "select 0::bigint as r, 0::bigint as ptr union all select i + 1, stop from ae")
def _aligned_ptr(spark, d):
    return formats.csr(tables.lineitem_matrix(spark, d), 4).ptr


_ALIGNED_ENTRIES = """
select (ae.stop - w + ae.l)::bigint as k, ae.i, coalesce(x.j, 0)::bigint as j, coalesce(x.a, 0.0) as a, x.j is null as is_pad
from (select *, unnest(range(0, w)) as l from ae) ae left join (select *, row_number() over (partition by i order by k) - 1 as l from s) x on x.i = ae.i and x.l = ae.l
"""


@query("csr_row_aligned_entries", _ALIGNED + _ALIGNED_ENTRIES)
def _aligned_entries(spark, d):
    return formats.csr(tables.lineitem_matrix(spark, d), 4).entries


def _slots_sql(width: str, pad: str) -> str:
    return f"""
select g.i, g.l, coalesce(x.j, {pad})::bigint as j, coalesce(x.a, 0.0) as a, x.j is null as is_pad
from (select i, stop, unnest(range(0, {width})) as l from ends) g
left join (select *, row_number() over (partition by i order by k) - 1 as l from s) x on x.i = g.i and x.l = g.l
left join s p on p.k = g.stop - 1
"""


_LONGEST = "(select max(len) from len)"


@query("ell_slots", BASE + _slots_sql(_LONGEST, "coalesce(p.j, 0)"))
def _ell_slots(spark, d):
    return formats.ell(tables.lineitem_matrix(spark, d))[0]


@query("ell_slots_skip_padding", BASE + _slots_sql(_LONGEST, "2147483647"))
def _ell_slots_skip(spark, d):
    return formats.ell(tables.lineitem_matrix(spark, d), True)[0]


@query("hybrid_ell_slots", BASE + _slots_sql(_WIDTH, "coalesce(p.j, 0)"))
def _hybrid_slots(spark, d):
    return formats.hybrid(tables.lineitem_matrix(spark, d))[0]


_OVER = f", over0 as (select row_number() over (order by k) - 1 as k, i, j, a from (select *, row_number() over (partition by i order by k) - 1 as l from s) where l >= {_WIDTH}) "


@query("hybrid_overflow", BASE + _OVER + "select * from over0")
def _hybrid_overflow(spark, d):
    return formats.hybrid(tables.lineitem_matrix(spark, d))[1]


@query("matrix_sizes", BASE + f""", c as (select nnz, nr, nr * {_LONGEST} as es, nr * {_WIDTH} as hs, (select sum(greatest(len - {_WIDTH}, 0)) from len) as co from dims),
f as (
  select 'coo' as format, nnz as entries, 0 as padding, nnz * 8 as index_size from c
  union all select 'csr', nnz, 0, (nr + 1) * 4 + nnz * 4 from c
  union all select 'ell', es, es - nnz, es * 4 from c
  union all select 'hybrid', hs + co, hs + co - nnz, (hs + co) * 4 from c
)
select format, entries::bigint as entries, padding::bigint as padding, (entries * 8)::bigint as value_size, index_size::bigint as index_size,
       (entries * 8 + index_size)::bigint as size, (padding * 8)::bigint as value_padding_size, (padding * 4)::bigint as index_padding_size from f""")
def _sizes(spark, d):
    return formats.storage(tables.lineitem_matrix(spark, d, False))


@query("rows_per_thread", BASE + "select t::integer as thread, (least(nr, (t + 1) * ((nr + 3) // 4)) - least(nr, t * ((nr + 3) // 4)))::bigint as \"rows\" from dims, range(0, 4) r(t)")
def _rows_per_thread(spark, d):
    return formats.rows_per_thread(tables.lineitem_matrix(spark, d, False), 4)


@query("nonzeros_per_thread", BASE + f"""
select t::integer as thread, (select coalesce(sum(len), 0) from len, dims where i // ((nr + 3) // 4) = t)::bigint as csr,
       ((least(nr, (t + 1) * ((nr + 3) // 4)) - least(nr, t * ((nr + 3) // 4))) * {_LONGEST})::bigint as ell,
       ((least(nr, (t + 1) * ((nr + 3) // 4)) - least(nr, t * ((nr + 3) // 4))) * {_WIDTH})::bigint as hybrid
from dims, range(0, 4) r(t)""")
def _nonzeros_per_thread(spark, d):
    return formats.nonzeros_per_thread(tables.lineitem_matrix(spark, d, False), 4)


@query("sort_row_major", BASE + "select row_number() over (order by i, j, k) - 1 as k, k as file_k, i, j, a from e")
def _row_major(spark, d):
    return tables.lineitem_matrix(spark, d).sorted_row_major()


@query("sort_column_major", BASE + "select row_number() over (order by j, i, k) - 1 as k, k as file_k, i, j, a from e")
def _column_major(spark, d):
    return tables.lineitem_matrix(spark, d).sorted_column_major()


@query("permute", SQUARE + "select row_number() over (order by i, j) - 1 as k, n - 1 - i as i, n - 1 - j as j, a from e, n")
def _permute(spark, d):
    m = tables.square_matrix(spark, d)
    return m.permuted(m.row_domain().select(F.col("i").alias("old"), (F.lit(m.rows - 1) - F.col("i")).alias("new"))).entries


@query("bandwidth", SQUARE + "select coalesce(max(abs(i - j)), 0)::bigint as bandwidth from e")
def _bandwidth(spark, d):
    return tables.square_matrix(spark, d).bandwidth()


@query("degrees", SQUARE + "select r.i, count(e.i)::bigint as degree from (select unnest(range(0, (select n from n))) as i) r left join e on e.i = r.i and e.i <> e.j group by r.i")
def _degrees(spark, d):
    return tables.square_matrix(spark, d).degrees()


@query("adjacency", SQUARE + "select i as src, j as dst, k from (select *, row_number() over (order by i, j) - 1 as k from e) where i <> j")
def _adjacency(spark, d):
    return reorder.adjacency(tables.square_matrix(spark, d))


@query("partition_to_permutation", 'select p_partkey::bigint as old, row_number() over (order by p_size, p_partkey) - 1 as "new" from part')
def _partition(spark, d):
    return reorder.from_partition(tables.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("i"), F.col("p_size").alias("part")))


@query("graph_partition_identity", 'select unnest(range(0, (select max(p_partkey) + 1 from part)))::bigint as old, old as "new"')
def _gp(spark, d):
    return reorder.graph_partition(tables.square_matrix(spark, d))


@query("rcm_order")
def _rcm(spark, d):
    return reorder.reverse_cuthill_mckee(tables.square_matrix(spark, d))


@query("symmetric_expanded", SQUARE + ", b as (select i, j, a from e union all select j, i, a from e where i <> j) select row_number() over (order by i, j, a) - 1 as k, i, j, a from b")
def _expanded(spark, d):
    return tables.square_matrix(spark, d).expanded().entries


_MOMENTS = """
with m as (select *, avg(value::double) over (partition by event_type) as mu from events),
c as (
  select event_type, count(value) as n, min(value) as lo, max(value) as hi, any_value(mu) as mean, list_sort(list(value))[count(value) // 2 + 1] as med,
         sum((value - mu) ** 2) as s2, sum((value - mu) ** 3) as s3, sum((value - mu) ** 4) as s4
  from m group by event_type
)
select event_type, n::bigint as samples, lo as "min", hi as "max", round(mean, 6) as mean, med as median, round(s2 / (n - 1), 4) as variance, round(sqrt(s2 / (n - 1)), 6) as standard_deviation,
       round((s3 / n) / sqrt((s2 / (n - 1)) ** 3), 6) as skewness, round((s4 / n) / ((s2 / n) ** 2), 6) as kurtosis
from c"""


@query("sample_stats", _MOMENTS)
def _sample_stats(spark, d):
    x = stats.summary(tables.table(spark, d, "events"), ["event_type"], "value")
    places = {"mean": 6, "variance": 4, "standard_deviation": 6, "skewness": 6, "kurtosis": 6}
    return x.select(*(F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in x.columns))


@query("event_samples", "select user_id::integer as thread, event_type as event, list(value order by event_id) as counts, count(*)::bigint as samples from events group by 1, 2")
def _event_samples(spark, d):
    # a sample is as long as the runs of one event on one thread
    x = tables.table(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("thread"), F.col("event_type").alias("event"))
    x = x.agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return x.select("thread", "event", F.col("s.value").alias("counts"), F.size("s").cast("long").alias("samples"))


@query("extrapolate_counts", "select event_id, case when event_id % 7 = 0 then 0 else floor(event_id * (100.0::double / (event_id % 7)))::bigint end as count from events")
def _extrapolate(spark, d):
    running = F.col("event_id") % 7
    return tables.table(spark, d, "events").select("event_id", stats.extrapolated(F.col("event_id"), F.lit(100.0), running).alias("count"))


@query("profiling_events", "select user_id::integer as thread, event_type as event, count(*)::bigint as runs, min(value) as \"min\", max(value) as \"max\" from events group by 1, 2")
def _profiling(spark, d):
    x = tables.table(spark, d, "events")
    return x.groupBy(F.col("user_id").cast("int").alias("thread"), F.col("event_type").alias("event")).agg(F.count("*").alias("runs"), F.min("value").alias("min"), F.max("value").alias("max"))


@query("mtx_round_trip", SQUARE + "select row_number() over (order by i, j) - 1 as k, i, j, a from e")
def _mtx(spark, d):
    path = f"{own_dir(spark)}/mtx-{uuid.uuid4().hex}.mtx"
    mtx.write(mtx.of(tables.square_matrix(spark, d)), path)
    m = mtx.read(spark, path).matrix()
    return m.entries.select("k", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "a")


@query("mtx_lines", SQUARE + """
select -2::bigint as k, '%%MatrixMarket matrix coordinate real general' as value
union all select -1, n || ' ' || n || ' ' || (select count(*) from e) from n
union all select row_number() over (order by i, j) - 1, (i + 1) || ' ' || (j + 1) || ' ' || a from e""")
def _mtx_lines(spark, d):
    return mtx.lines_of(mtx.of(tables.square_matrix(spark, d)))


@query("json_fields", """
select event_id, case when json_type(props) = 'OBJECT' then 'object' else 'other' end as kind, len(json_keys(props))::bigint as members, list_sort(json_keys(props)) as keys,
       json_extract(props, '$.k')::bigint as k
from events""")
def _json_fields(spark, d):
    v = F.col("v")
    x = tables.table(spark, d, "events").select("event_id", json_tree.parsed(F.col("props")).alias("v"))
    return x.select("event_id", json_tree.kind(v).alias("kind"), json_tree.object_size(v).alias("members"), json_tree.keys(v).alias("keys"), json_tree.whole(json_tree.member(v, "k")).alias("k"))


@query("event_counts", "select user_id::integer as thread, count(*) filter (where event_type = 'click')::bigint as click, 0::bigint as unknown from events group by 1")
def _event_counts(spark, d):
    x = tables.table(spark, d, "events").select(F.col("user_id").cast("int").alias("thread"), F.col("event_type").alias("event"), F.lit(1).cast("long").alias("count"))
    m = stats.event_counts(x, ["thread"])
    return m.select("thread", *(stats.event_count(F.col("counts"), e).cast("long").alias(e) for e in ("click", "unknown")))
