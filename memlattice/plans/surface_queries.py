"""The queries over files, configurations, JSON trees, counters, vectors and scalars, with their DuckDB SQL."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import json_tree, moments, render, scalars, stats
from ..operators import formats, matrix, partition, references, reorder
from ..operators.layout import align_down, align_up
from ..session import materialize, own_dir
from ..sources import config, events, mtx, mtx_source, report
from . import tables
from .catalog import _ALIGNED, _ALIGNED_ENTRIES, _LONGEST, _MOMENTS, _WIDTH, BASE, SQUARE
from .registry import query


@query("row_indices", BASE + "select k, i from e")
def _rows(spark, d):
    return tables.lineitem_matrix(spark, d).row_indices()


@query("column_indices", BASE + "select k, j from e")
def _columns(spark, d):
    return tables.lineitem_matrix(spark, d).column_indices()


@query("values_real", BASE + "select k, a from e")
def _values(spark, d):
    return tables.lineitem_matrix(spark, d).values_real()


@query("vector_plus", "select p_partkey::bigint as idx, (p_size + p_retailprice)::double as v from part")
def _plus(spark, d):
    return matrix.combined(tables.part_sizes(spark, d), _prices(spark, d))


@query("vector_minus", "select p_partkey::bigint as idx, (p_size - p_retailprice)::double as v from part")
def _minus(spark, d):
    return matrix.combined(tables.part_sizes(spark, d), _prices(spark, d), -1.0)


@query("vector_scaled", "select p_partkey::bigint as idx, (2.5::double * p_size)::double as v from part")
def _scaled(spark, d):
    return matrix.scaled(tables.part_sizes(spark, d), 2.5)


def _prices(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("idx"), F.col("p_retailprice").cast("double").alias("v"))


@query("vector_checked", """
with n as (select (max(p_partkey) + 1)::bigint as n from part), p as (select p_partkey::bigint as idx from part),
v as (
  select 'fits' as x, idx from p union all select 'too short', idx from p where idx % 7 <> 3 union all select 'twice', idx from p union all select 'twice', idx from p where idx % 11 = 4
  union all select 'too long', idx from p union all select 'too long', idx + n from p, n where idx % 13 = 5 union all select 'shifted', idx + 1 from p
), c as (select x, idx, count(*)::bigint as "values" from v group by x, idx)
select x, idx, "values" from c, n where "values" > 1 or idx not between 0 and n - 1
union all select k.x, r.idx, 0 from (select distinct x from v) k, (select unnest(range(0, n)) as idx from n) r where not exists (select 1 from c where c.x = k.x and c.idx = r.idx)""")
def _checked(spark, d):
    """Where vectors don't fit: gaps, repeated places, places beyond the columns. The one that fits has no row; a product refuses the others."""
    m, x = tables.lineitem_matrix(spark, d, False), tables.part_sizes(spark, d)
    i = F.col("idx")
    cases = {
        "fits": x, "too short": x.where(i % 7 != 3), "twice": x.unionByName(x.where(i % 11 == 4)), "too long": x.unionByName(x.where(i % 13 == 5).withColumn("idx", i + m.columns)), "shifted": x.withColumn("idx", i + 1),
    }
    found = [matrix.vector_faults(m, v).select(F.lit(name).alias("x"), "idx", "values") for name, v in cases.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("layout_equality", _ALIGNED + f""", p as (select 0::bigint as r, 0::bigint as ptr union all select i + 1, stop from ends),
ce as (select k, i, j, a, false as is_pad from s), al4 as ({_ALIGNED_ENTRIES}), sl as (select i, unnest(range(0, {_LONGEST})) as l from ends)
select not exists(select * from p except select * from p) as ptr, not exists(select * from ce except select * from ce) as entries,
       not exists((select * from ce except select * from al4) union all (select * from al4 except select * from ce)) as aligned, not exists(select * from sl except select * from sl) as slots""")
def _layout_equality(spark, d):
    """Layouts made twice, and one of aligned rows."""
    m = tables.lineitem_matrix(spark, d)
    a, b, c = formats.csr(m), formats.csr(m), formats.csr(m, _ALIGN)
    same = formats.same_layout
    return spark.createDataFrame([(same(a.ptr, b.ptr), same(a.entries, b.entries), same(a.entries, c.entries), same(formats.ell(m)[0], formats.ell(m)[0]))], "ptr boolean, entries boolean, aligned boolean, slots boolean")


@query("matrix_equality", SQUARE + """, f as (select row_number() over (order by i, j) - 1 as k, i, j, a from e)
select not exists(select * from f except select * from f) as same, not exists(select * from f except select k, i, j, a + (k = 0)::integer from f) as changed,
       not exists(select * from f except select k, j, i, a from f) as reordered""")
def _equality(spark, d):
    m = tables.square_matrix(spark, d)
    changed = matrix.SparseMatrix(m.entries.withColumn("a", F.col("a") + (F.col("k") == 0).cast("double")), m.rows, m.columns)
    reordered = matrix.SparseMatrix(m.entries.select("k", F.col("j").alias("i"), F.col("i").alias("j"), "a"), m.rows, m.columns)
    return spark.createDataFrame([(m.same_as(m), m.same_as(changed), m.same_as(reordered))], "same boolean, changed boolean, reordered boolean")


_ALIGN = 8
_AL = f"((len + {_ALIGN - 1}) // {_ALIGN} * {_ALIGN})"


@query("matrix_sizes_aligned", BASE + f"""
select 'csr' as format, sum({_AL})::bigint as entries, 0::bigint as padding, (sum({_AL}) * 8)::bigint as value_size, (((select nr from dims) + 1) * 4 + sum({_AL}) * 4)::bigint as index_size,
       (sum({_AL}) * 12 + ((select nr from dims) + 1) * 4)::bigint as size, 0::bigint as value_padding_size, 0::bigint as index_padding_size from len""")
def _sizes_aligned(spark, d):
    return formats.storage(tables.lineitem_matrix(spark, d, False), _ALIGN).where("format = 'csr'")


@query("nonzeros_per_thread_aligned", BASE + f"select t::integer as thread, (select coalesce(sum({_AL}), 0) from len, dims where i // ((nr + 3) // 4) = t)::bigint as csr from range(0, 4) r(t)")
def _per_thread_aligned(spark, d):
    return formats.nonzeros_per_thread(tables.lineitem_matrix(spark, d, False), 4, _ALIGN).select("thread", "csr")


@query("padding_share", BASE + f"select round(1 - sum(len)::double / (count(*) * {_LONGEST}), 9) as ell, round(1 - sum(least(len, {_WIDTH}))::double / (count(*) * {_WIDTH}), 9) as hybrid_ell from len")
def _padding_share(spark, d):
    """Of the slots of both ELLPACK layouts, those that are padding, counted in the layouts themselves."""
    m = tables.lineitem_matrix(spark, d)
    share = F.round(F.avg(F.col("is_pad").cast("int")), 9)
    ell, hybrid = formats.ell(m)[0], formats.hybrid(m)[0]
    return ell.agg(share.alias("ell")).crossJoin(hybrid.agg(share.alias("hybrid_ell")))  # one row each


def _round_trip(spark, d, suffix, field="real", symmetry="general"):
    """The square matrix as a file of a kind, written and read."""
    m = tables.square_matrix(spark, d)
    whole = mtx.of(m)
    a = {"real": F.col("a"), "complex": F.col("a"), "integer": F.col("a").cast("int"), "pattern": F.lit(None).cast("double")}[field]
    entries = whole.entries.select("k", "i", "j", a.alias("a"), *([(-F.col("a")).alias("im")] if field == "complex" else []))
    header = mtx.Header(field=field, symmetry=symmetry, rows=m.rows, columns=m.columns, num_entries=whole.header.num_entries, comments=("% made of orders", "%"))
    path = f"{own_dir(spark)}/mtx-{uuid.uuid4().hex}{suffix}"
    mtx.write(mtx.MatrixMarket(header, entries), path)
    back = mtx.read(spark, path)
    if back.header != header:
        raise ValueError(f"{back.header} is not {header}")
    return back


_FILE = SQUARE + "select row_number() over (order by i, j) - 1 as k, (i + 1)::integer as i, (j + 1)::integer as j"


@query("mtx_gzip", _FILE + ", a from e")
def _gzip(spark, d):
    return _round_trip(spark, d, ".mtx.gz").entries


@query("mtx_integer", _FILE + ", a::integer as a from e")
def _integer(spark, d):
    return _round_trip(spark, d, ".mtx", "integer").entries


@query("mtx_pattern", _FILE + " from e")
def _pattern(spark, d):
    return _round_trip(spark, d, ".mtx", "pattern").entries.drop("a")


@query("mtx_complex", _FILE + ", a, -a as im from e")
def _complex(spark, d):
    return _round_trip(spark, d, ".mtx", "complex").entries


@query("mtx_skew_expanded", SQUARE + ", b as (select i, j, a from e union all select j, i, -a from e where i <> j) select row_number() over (order by i, j, a) - 1 as k, i, j, a from b")
def _skew(spark, d):
    m = _round_trip(spark, d, ".mtx", symmetry="skew-symmetric").matrix().expanded()
    return m.entries.select("k", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "a")


@query("matrix_text", """
with e as (select row_number() over (order by n_regionkey, n_nationkey) - 1 as k, n_regionkey as i, n_nationkey as j from nation)
select '[' || string_agg(i::varchar, ' ' order by k) || '] [' || string_agg(j::varchar, ' ' order by k) || '] [' || string_agg('1', ' ') || ']' as text from e""")
def _text(spark, d):
    return spark.createDataFrame([(render.coo(tables.nation_matrix(spark, d).entries),)], "text string")


_GRAPH = """
with recursive n as (select (max(c_custkey) + 1)::bigint as n from customer),
far as (select c_custkey::bigint as src, ((7 * c_custkey + c_nationkey + 400 * m * m) % n)::bigint as dst from customer, n, range(0, 4) r(m)),
adj as (select src, dst, row_number() over (order by src, dst) - 1 as k from far),
deg as (select v, count(src) as degree from (select unnest(range(0, n)) as v from n) left join adj on src = v and src <> dst group by v),
nb as (select src, list(dst order by degree, k) as ds from (select src, dst, min(k) as k from adj where src <> dst group by all) join deg on v = dst group by src),
vs as (select list(v order by degree, v) as vs from deg),
w as (
  select []::bigint[] as walked, 0::bigint as q
  union all
  select case when q < len(walked) then list_concat(walked, list_filter(coalesce(ds, []), lambda x: not list_contains(walked, x))) else list_append(walked, list_filter(vs, lambda x: not list_contains(walked, x))[1]) end,
         case when q < len(walked) then q + 1 else q end
  from w left join nb on src = walked[q + 1] cross join vs cross join n where q < n
)
"""


@query("rcm_order_small", _GRAPH + "select unnest(walked) as old, n - 1 - unnest(range(0, n)) as \"new\" from w, n where q = n")
def _rcm_small(spark, d):
    return reorder.reverse_cuthill_mckee(tables.customer_graph(spark, d))


@query("rcm_order_by_levels", _GRAPH + "select unnest(walked) as old, n - 1 - unnest(range(0, n)) as \"new\" from w, n where q = n")
def _rcm_levels(spark, d):
    """The same, with large components taken to be those of over 500 edges and vertices."""
    return reorder.reverse_cuthill_mckee(tables.customer_graph(spark, d), 500)


@query("balanced_part_sizes", "with n as (select (max(p_partkey) + 1)::bigint as n from part) select (v * 7 // n)::integer as part, count(*)::bigint as \"rows\" from (select unnest(range(0, n)) as v, n from n) group by 1")
def _balanced(spark, d):
    return reorder.balanced_parts(tables.square_matrix(spark, d), 7).groupBy("part").agg(F.count("*").alias("rows"))


@query("stats_from_states", _MOMENTS.replace("med as median, ", ""))
def _from_states(spark, d):
    """The states of seven parts of each sample, stored, merged, and read by the SQL functions."""
    x = tables.table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 7).alias("part")).agg(moments.state(F.col("value")).alias("state"))
    moments.register(spark)
    moments.merged(materialize(x), ["event_type"]).createOrReplaceTempView("memlattice_states")
    return spark.sql("""select event_type, sample_count(state) as samples, sample_min(state) as `min`, sample_max(state) as `max`, round(sample_mean(state), 6) as mean,
        round(sample_variance(state), 4) as variance, round(sample_deviation(state), 6) as standard_deviation, round(sample_skewness(state), 6) as skewness, round(sample_kurtosis(state), 6) as kurtosis
        from memlattice_states""")


@query("multilevel_parts", """
with n as (select (max(p_partkey) + 1)::bigint as n from part), l as (select l_orderkey as o, l_partkey::bigint as v from lineitem),
e as (select distinct a.v as i, b.v as j from l a join l b on a.o = b.o and a.v < b.v where a.v % 8 = b.v % 8 or a.o % 50 = 0),
c as (select v, count(*) as cut from (select i as v, j as w from e union all select j, i from e) where v % 8 <> w % 8 group by v)
select r.v, r.v % 8 as label, coalesce(cut, 0)::bigint as cut, (select count(*) from (select unnest(range(0, (select n from n))) as u) where u % 8 = r.v % 8)::bigint as "rows"
from (select unnest(range(0, n)) as v from n) r left join c on c.v = r.v""")
def _multilevel(spark, d):
    """Eight parts of the graph of parts bought together: each row's part by its least row, its edges that are cut, and the part's size."""
    m = tables.bought_together(spark, d)
    parts = partition.multilevel_parts(m, 8, coarsest=256)
    named = parts.join(parts.groupBy("part").agg(F.min("i").alias("label"), F.count("*").alias("rows")), "part")
    e = m.entries.select(F.col("i").alias("v"), F.col("j").alias("w")).unionByName(m.entries.select(F.col("j").alias("v"), F.col("i").alias("w")))
    ends = e.join(parts.select(F.col("i").alias("v"), F.col("part").alias("p")), "v").join(parts.select(F.col("i").alias("w"), F.col("part").alias("q")), "w")
    cut = ends.where("p <> q").groupBy(F.col("v").alias("i")).agg(F.count("*").alias("cut"))
    return named.join(cut, "i", "left").select(F.col("i").alias("v"), "label", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), "rows")


@query("mtx_source", SQUARE + "select row_number() over (order by i, j) - 1 as k, i, j, a from e")
def _mtx_source(spark, d):
    """Through spark.write.format("mtx") and spark.read.format("mtx"), in ranges of a few KB."""
    path = f"{own_dir(spark)}/source-{uuid.uuid4().hex}.mtx"
    mtx_source.save(tables.square_matrix(spark, d), path)
    back = mtx_source.numbered(spark.read.format("mtx").option("split_bytes", 64 << 10).load(path), mtx_source.header_of(path)[0])
    return back.entries.select("k", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "a")


@query("json_built", """
select event_id, '{"event":' || to_json(event_type) || ',"flags":[true,null,' || (event_id % 2 = 0)::varchar || '],"id":' || event_id || ',"nested":{"empty":[]}}' as json from events""")
def _built(spark, d):
    t = json_tree
    made = t.object_(id=t.from_number(F.col("event_id")), event=t.from_string(F.col("event_type")), flags=t.array(t.boolean(F.lit(True)), t.null(), t.boolean(F.col("event_id") % 2 == 0)), nested=t.object_(empty=t.array()))
    return tables.table(spark, d, "events").select("event_id", F.to_json(made).alias("json"))


@query("json_iterated", """
with m as (select event_id, list_sort(json_keys(props)) as ks, props from events where json_type(props) = 'OBJECT'),
x as (select event_id, unnest(range(0, len(ks))) as place, ks, props from m)
select event_id, place::integer as place, ks[place + 1] as key, json_extract(props, '$."' || ks[place + 1] || '"')::varchar as value, ks[len(ks) - place] as backwards from x""")
def _iterated(spark, d):
    x = tables.table(spark, d, "events").select("event_id", json_tree.parsed(F.col("props")).alias("v"))
    x = x.select("event_id", F.posexplode(json_tree.members(F.col("v"))).alias("place", "m"), json_tree.members(F.col("v"), True).alias("b"))
    return x.select("event_id", "place", F.col("m.key").alias("key"), F.to_json("m.value").alias("value"), F.get("b", F.col("place"))["key"].alias("backwards"))


@query("json_elements", "select event_id, place::integer as place, [event_id, event_id % 7, 5][place + 1]::varchar as value, [5, event_id % 7, event_id][place + 1]::varchar as backwards, 3::bigint as size, null::varchar as past from events, range(0, 3) r(place)")
def _elements(spark, d):
    t = json_tree
    v = F.parse_json(F.concat(F.lit("["), F.concat_ws(",", F.col("event_id"), F.col("event_id") % 7, F.lit(5)), F.lit("]")))
    x = tables.table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v", F.posexplode(t.elements(F.col("v"))).alias("place", "e"))
    return x.select("event_id", "place", F.to_json("e").alias("value"), F.to_json(F.get(t.elements(F.col("v"), True), F.col("place"))).alias("backwards"), t.array_size(F.col("v")).alias("size"), F.to_json(t.element(F.col("v"), 3)).alias("past"))


@query("json_problems", "select event_id, case event_id % 3 when 0 then '1:2' when 1 then '2:3' end as problem from events")
def _problems(spark, d):
    bad = F.when(F.col("event_id") % 3 == 0, F.lit("{,}")).when(F.col("event_id") % 3 == 1, F.lit("[1,\n 2;3]")).otherwise(F.col("props"))
    return tables.table(spark, d, "events").select("event_id", F.substring_index(json_tree.problem(bad), ":", 2).alias("problem"))


@query("event_catalogue", """
select 'events' as pmu, event_type as event, 'events::' || event_type as name, 'counts ' || event_type as description, list_sort(list_distinct(list((user_id % 5)::varchar))) as attributes from events group by event_type""")
def _catalogue(spark, d):
    x = tables.table(spark, d, "events").select(F.lit("events").alias("pmu"), F.col("event_type").alias("event"), F.concat(F.lit("counts "), "event_type").alias("description"), (F.col("user_id") % 5).cast("string").alias("attribute"), F.lit(None).cast("string").alias("attribute_description"))
    return events.catalogue(x).withColumn("attributes", F.col("attributes.attribute"))


def _groups() -> str:
    rows = [(n, k, e) for n, t in enumerate(tables.config().threads) for k, g in enumerate(t.event_groups) for e in g.events]
    return ", ".join(f"({n}, {k}, '{e}')" for n, k, e in rows)


@query("event_groups", f"""
select event_id as run, thread::integer as thread, event_group::integer as event_group, event, case when event_id % 7 = 0 then 0 else floor(event_id * (100.0::double / (event_id % 7)))::bigint end as count
from events join (values {_groups()}) as g(thread, event_group, event) on event = event_type and thread = user_id % 4""")
def _event_groups(spark, d):
    counters = tables.table(spark, d, "events").select(F.col("event_id").alias("run"), (F.col("user_id") % 4).cast("int").alias("thread"), F.col("event_type").alias("event"), F.col("event_id").alias("count"), F.lit(100.0).alias("time_enabled"), (F.col("event_id") % 7).alias("time_running"))
    return stats.grouped_events(tables.config().threads_frame(spark), counters)


@query("event_counts_extrapolated", """
with x as (select user_id::integer as thread, event_type, case when event_id % 7 = 0 then 0 else floor(event_id * (100.0::double / (event_id % 7)))::bigint end as n from events)
select thread, coalesce(sum(n) filter (where event_type = 'click'), 0)::bigint as click, coalesce(sum(n) filter (where event_type = 'view'), 0)::bigint as "view" from x group by 1""")
def _counts_extrapolated(spark, d):
    x = tables.table(spark, d, "events").select(F.col("user_id").cast("int").alias("thread"), F.col("event_type").alias("event"), F.col("event_id").alias("count"), F.lit(100.0).alias("time_enabled"), (F.col("event_id") % 7).alias("time_running"))
    m = stats.event_counts(x, ["thread"])
    return m.select("thread", *(stats.event_count(F.col("counts"), e).cast("long").alias(e) for e in ("click", "view")))


@query("central_moments", _MOMENTS[: _MOMENTS.rindex("select")] + 'select event_type, round(s2 / n, 4) as second, round(s3 / n, 2) as third, round(s4 / n, 0) as fourth from c')
def _moments(spark, d):
    x, v = tables.table(spark, d, "events"), F.col("value")
    return x.groupBy("event_type").agg(F.round(stats.central_moment(v, 2), 4).alias("second"), F.round(stats.central_moment(v, 3), 2).alias("third"), F.round(stats.central_moment(v, 4), 0).alias("fourth"))


@query("empty_sample", "select 1.7976931348623157e308::double as \"min\", 2.2250738585072014e-308::double as \"max\", 9223372036854775807::bigint as min_long, (-9223372036854775808)::bigint as max_long")
def _empty(spark, d):
    x = tables.table(spark, d, "events").where("event_type = 'none such'")
    return x.agg(stats.sample_min(F.col("value")).alias("min"), stats.sample_max(F.col("value")).alias("max"), stats.sample_min(F.col("event_id"), "long").alias("min_long"), stats.sample_max(F.col("event_id"), "long").alias("max_long"))


@query("octal_fields", "select event_id, event_id as number from events")
def _octal(spark, d):
    field = F.concat(F.lit(" "), F.conv(F.col("event_id").cast("string"), 10, 8), F.lit("\0"))
    return tables.table(spark, d, "events").select("event_id", scalars.octal(field).alias("number"))


@query("longer_suffixes", "select page_id, coalesce(ends_with(url, '.html') and length(url) > 5, false) as html, coalesce(ends_with(url, url) and length(url) > length(url), false) as whole from pages")
def _suffixes(spark, d):
    url = F.col("url")
    return tables.table(spark, d, "pages").select("page_id", F.coalesce(scalars.longer_suffix(url, F.lit(".html")), F.lit(False)).alias("html"), F.coalesce(scalars.longer_suffix(url, url), F.lit(False)).alias("whole"))


@query("aligned_addresses", "select p_partkey, (p_partkey * 8 + 4095) // 4096 * 4096 as up, p_partkey * 8 // 4096 * 4096 as down from part")
def _aligned_addresses(spark, d):
    at = F.col("p_partkey").cast("long") * 8
    return tables.table(spark, d, "part").select("p_partkey", align_up(at, 4096).alias("up"), align_down(at, 4096).alias("down"))


@query("mtx_tar", "select row_number() over (order by n_regionkey, n_nationkey) - 1 as k, (n_regionkey + 1)::integer as i, (n_nationkey + 1)::integer as j, 1.0::double as a from nation")
def _tar(spark, d):
    """A gzipped tar whose member stands where its name says."""
    name = f"nations-{uuid.uuid4().hex}"
    text = "\n".join(r["value"] for r in mtx.lines_of(mtx.of(tables.nation_matrix(spark, d))).orderBy("k").collect()).encode()  # one line for each nation
    made = io.BytesIO()
    with tarfile.open(fileobj=made, mode="w:gz") as tar:
        for member, content in ((f"{name}/readme.txt", b"not the matrix"), (scalars.member_name(f"{name}.tar.gz"), text)):
            info = tarfile.TarInfo(member)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    path = f"{own_dir(spark)}/{name}.tar.gz"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(made.getvalue()))
    out.close()
    return mtx.read(spark, path).entries


@query("mtx_header", SQUARE + "select 'matrix' as object, 'coordinate' as format, 'integer' as field, 'general' as symmetry, n::integer as \"rows\", n::integer as columns, (select count(*) from e)::integer as num_entries, ['% made of orders', '%'] as comments from n")
def _header(spark, d):
    h = _round_trip(spark, d, ".mtx", "integer").header
    return spark.createDataFrame([(h.object, h.format, h.field, h.symmetry, h.rows, h.columns, h.num_entries, list(h.comments))], "object string, format string, field string, symmetry string, rows int, columns int, num_entries int, comments array<string>")


def _refused(spark, cases):
    """(what, refused) of some (what, function)."""
    rows = []
    for what, f in cases:
        try:
            f()
            rows.append((what, False))
        except ValueError:
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, refused boolean")


def _constants(rows: list[tuple]) -> str:
    return "select * from (values " + ", ".join(f"('{a}', {str(b).lower()})" for a, b in rows) + ") as c(what, refused)"


@query("config_checks", _constants([("whole", False), ("size", True), ("parent", True), ("circle", True), ("cache", True), ("domain", True), ("no caches", True)]))
def _config_checks(spark, d):
    def broken(*way, value):
        c = at = json.loads(tables.config_text())
        for step in way[:-1]:
            at = at[step]
        at[way[-1]] = value
        return lambda: config.parse(json.dumps(c), strict=True)

    return _refused(spark, [
        ("whole", broken("name", value="x")), ("size", broken("caches", "all", "size", value=100)), ("parent", broken("caches", "all", "parent", value="none")), ("circle", broken("caches", "all", "parent", value="a0")),
        ("cache", broken("thread_affinities", 0, "cache", value="none")), ("domain", broken("thread_affinities", 0, "numa_domain", value=2)), ("no caches", broken("caches", value=None)),
    ])


@query("kernel_refusals", _constants([("references of the vendor kernel", True), ("vendor product of a matrix that is not square", True), ("reordering of a matrix that is not square", True), ("reordering of whole numbers", True), ("reordering of real values", False)]))
def _refusals(spark, d):
    wide, square = tables.nation_matrix(spark, d), tables.square_matrix(spark, d)
    whole = matrix.SparseMatrix(square.entries, square.rows, square.columns, "integer")
    return _refused(spark, [
        ("references of the vendor kernel", lambda: references.VendorCsr(square).references(references.Threads((0, 1)))), ("vendor product of a matrix that is not square", lambda: references.VendorCsr(wide).run()),
        ("reordering of a matrix that is not square", lambda: reorder.reverse_cuthill_mckee(wide)), ("reordering of whole numbers", lambda: reorder.adjacency(whole)), ("reordering of real values", lambda: reorder.adjacency(square)),
    ])


@query("path_names", """
select n_nationkey, '/data/' || n_name || '.mtx' as path, case n_nationkey % 3 when 0 then 'rcm' when 1 then 'gp' end as asked, case when n_nationkey % 3 = 1 then n_nationkey else 0 end::integer as parts,
       n_name || '/' || n_name || '.mtx' as member from nation""")
def _names(spark, d):
    rows = []
    for r in tables.table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # as many as there are nations
        key, name = r["n_nationkey"], r["n_name"]
        path, asked, parts = scalars.reorder_suffix(f"/data/{name}.mtx" + ["__RCM", f"__GP{key}", ""][key % 3])
        rows.append((key, path, asked, parts, scalars.member_name(f"/data/{name}.tar.gz")))
    kind = tables.table(spark, d, "nation").schema["n_nationkey"].dataType.simpleString()
    return spark.createDataFrame(rows, f"n_nationkey {kind}, path string, asked string, parts int, member string")


@query("profile_events", f"""
with x as (
  select thread, event_group, event, case when event_id % 7 = 0 then 0 else floor(event_id * (100.0::double / (event_id % 7)))::bigint end as n
  from events join (values {_groups()}) as g(thread, event_group, event) on event = event_type and thread = user_id % 4
)
select thread::integer as thread, event as name, count(*)::bigint as samples, min(n) as "min", max(n) as "max", list_sort(list(n))[count(*) // 2 + 1] as median from x group by thread, event_group, event""")
def _profile_events(spark, d):
    """What a profile reports of counters."""
    counters = tables.table(spark, d, "events").select(F.col("event_id").alias("run"), (F.col("user_id") % 4).cast("int").alias("thread"), F.col("event_type").alias("event"), F.col("event_id").alias("count"), F.lit(100.0).alias("time_enabled"), (F.col("event_id") % 7).alias("time_running"))
    times = spark.createDataFrame([(0, 5), (1, 7)], "run int, ns long")
    found = report.profile(tables.config(), {}, times, counters)["profiling_events"]
    rows = [(e["thread"], e["name"], *(e["counts"][k] for k in ("samples", "min", "max", "median"))) for e in found]
    return spark.createDataFrame(rows, "thread int, name string, samples long, min long, max long, median long")
