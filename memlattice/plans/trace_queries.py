"""The queries over reference streams and caches, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import caches, references
from ..operators.layout import VALUE_SIZE, div, owner
from ..sources import report
from ..sources.config import TraceConfig
from . import tables, trace
from .catalog import _LONGEST, _OVER, _WIDTH, BASE, _slots_sql
from .registry import ORACLES, query

THREADS = references.Threads((0, 1))
T = THREADS.n
#: The configurations that the queries trace under: a usual one, and one of caches with a few lines.
CONFIG, SMALL = tables.config(), tables.config(tables.SMALL_SIZES)


def _owner_sql(idx: str, n: str, t: int = T) -> str:
    n = f"greatest({n}, 1)"
    return f"least((least(({idx}) * 8 // 4096, ({n} * 8 + 4095) // 4096 - 1) * 4096 // 8) // (({n} + {t - 1}) // {t}), {t - 1})"


@query("owner_thread", BASE + f"select j::bigint as j, {_owner_sql('j', 'nc')}::integer as thread from (select unnest(range(0, nc)) as j, nc from dims)")
def _owners(spark, d):
    n = tables.table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    return spark.range(n).select(F.col("id").alias("j"), owner(F.col("id"), n, VALUE_SIZE, T).alias("thread"))


def _page(n: str, size: int) -> str:
    return f"((greatest({n}, 1) * {size} + 4095) // 4096 * 4096)"


def _refs_sql(arrays: list[tuple[str, str, int]], parts: list[str], ctes: str = "", t: int = T, tables: str = BASE) -> str:
    """parts select (thread, o1..o5, array, idx, domain); t is the rank by o1..o5 in the thread."""
    base, at = [], "0"
    for name, n, size in arrays:
        base.append(f"select '{name}' as array_name, {at} as base, {size} as size from c")
        at += f" + {_page(n, size)}"
    return tables + ctes + f"""
, c as (select nr, nc, nnz, (nr + {t - 1}) // {t} as rc, (nnz + {t - 1}) // {t} as ec from dims),
b as ({' union all '.join(base)}),
p as ({' union all '.join(parts)})
select thread::integer as thread, row_number() over (partition by thread order by o1, o2, o3, o4) - 1 as t, array_name as "array", idx::bigint as idx, (base + idx * size)::bigint as addr, domain::integer as domain
from p join b using (array_name)"""


_XY = [("x", "nc", 8), ("y", "nr", 8)]
def _coo_walk(src: str, ec: str, prefix: str, o1: int, t: int = T) -> list[str]:
    own = f"k // {ec}"
    return [
        *(f"select {own} as thread, {o1} as o1, k as o2, {n} as o3, 0 as o4, '{prefix}{a}' as array_name, k as idx, {own} as domain from {src}, c" for n, a in enumerate(("row_index", "column_index", "value"))),
        f"select {own}, {o1}, k, 3, 0, 'x', j, {_owner_sql('j', 'nc', t)} from {src}, c",
    ]


def _reduce(o1: int, t: int = T) -> list[str]:
    length = f"{t} * (least(nr, (i // rc + 1) * rc) - i // rc * rc)"
    return [
        f"select i // rc, {o1}, i, q, 0, 'workspace', q * nr + i, {_owner_sql('q * nr + i', length, t)} from rws, c, range(0, {t}) r(q)",
        f"select i // rc, {o1}, i, q, 1, 'y', i, i // rc from rws, c, range(0, {t}) r(q)",
    ]


@query("ref_triad", f"""
with n as (select count(*)::bigint as n from lineitem), c as (select n, (n + {T - 1}) // {T} as ec, {_page('n', 8)} as w from n)
select (k // ec)::integer as thread, 3 * (k - k // ec * ec) + q as t, ['b', 'c', 'a'][q + 1] as "array", k as idx, ([w, 2 * w, 0][q + 1] + 8 * k)::bigint as addr, (k // ec)::integer as domain
from (select unnest(range(0, n)) as k, ec, w from c), range(0, 3) r(q)""")
def _ref_triad(spark, d):
    return references.Triad(spark, tables.table(spark, d, "lineitem").count()).references(THREADS)


_ENTRY = [("row_index", "nnz", 4), ("column_index", "nnz", 4), ("value", "nnz", 8)]


def _coo_refs(t: int = T) -> str:
    parts = [*_coo_walk("e", "ec", "", 0, t), "select k // ec, 0, k, 4, 0, 'workspace', k // ec * nr + i, k // ec from e, c", *_reduce(1, t)]
    return _refs_sql([*_ENTRY, *_XY, ("workspace", f"nr * {t}", 8)], parts, t=t)


@query("ref_coo", _coo_refs())
def _ref_coo(spark, d):
    return references.Coo(tables.lineitem_matrix(spark, d)).references(THREADS)


@query("ref_coo_atomic", _refs_sql([*_ENTRY, *_XY], [*_coo_walk("e", "ec", "", 0), f"select k // ec, 0, k, 4, 0, 'y', i, {_owner_sql('i', 'nr')} from e, c"]))
def _ref_coo_atomic(spark, d):
    return references.CooAtomic(tables.lineitem_matrix(spark, d)).references(THREADS)


def _csr_refs(t: int = T, tables: str = BASE) -> str:
    return _refs_sql([("row_ptr", "nr + 1", 4), ("column_index", "nnz", 4), ("value", "nnz", 8), *_XY], [
        f"select q as thread, -1 as o1, 0 as o2, 0 as o3, 0 as o4, 'row_ptr' as array_name, least(nr, q * rc) as idx, q as domain from c, range(0, {t}) r(q)",
        "select i // rc, i, 0, 0, 0, 'row_ptr', i + 1, i // rc from rws, c",
        "select i // rc, i, 1, k, 0, 'column_index', k, i // rc from s, c",
        "select i // rc, i, 1, k, 1, 'value', k, i // rc from s, c",
        f"select i // rc, i, 1, k, 2, 'x', j, {_owner_sql('j', 'nc', t)} from s, c",
        "select i // rc, i, 2, 0, 0, 'y', i, i // rc from rws, c",
    ], t=t, tables=tables)


@query("ref_csr", _csr_refs())
def _ref_csr(spark, d):
    return references.Csr(tables.lineitem_matrix(spark, d)).references(THREADS)


def _ell_walk(width: str, prefix: str, o1: int) -> list[str]:
    return [
        f"select i // rc as thread, {o1} as o1, i as o2, l as o3, 0 as o4, '{prefix}column_index' as array_name, i * w + l as idx, i // rc as domain from g, c",
        f"select i // rc, {o1}, i, l, 1, '{prefix}value', i * w + l, i // rc from g, c",
        f"select i // rc, {o1}, i, l, 2, 'x', j, {_owner_sql('j', 'nc')} from g, c",
        f"select i // rc, {o1}, i, {width}, 0, 'y', i, i // rc from rws, c",
    ]


@query("ref_ell", _refs_sql([("column_index", f"nr * {_LONGEST}", 4), ("value", f"nr * {_LONGEST}", 8), *_XY], _ell_walk(_LONGEST, "", 0), f", g as (select i, l, j, {_LONGEST} as w from ({_slots_sql(_LONGEST, 'coalesce(p.j, 0)')}))"))
def _ref_ell(spark, d):
    return references.Ell(tables.lineitem_matrix(spark, d)).references(THREADS)


@query("ref_hybrid", _refs_sql(
    [("ell_column_index", f"nr * {_WIDTH}", 4), ("ell_value", f"nr * {_WIDTH}", 8), *((f"coo_{n}", "(select count(*) from over0)", z) for n, _, z in _ENTRY), *_XY, ("workspace", f"nr * {T}", 8)],
    [*_ell_walk(_WIDTH, "ell_", 0), *_coo_walk("over1", "oc", "coo_", 1), "select k // oc, 1, k, 4, 0, 'workspace', k // oc * nr + i, k // oc from over1, c", *_reduce(2)],
    f", g as (select i, l, j, {_WIDTH} as w from ({_slots_sql(_WIDTH, 'coalesce(p.j, 0)')})) {_OVER}, over1 as (select *, greatest(1, (count(*) over () + {T - 1}) // {T}) as oc from over0)",
))
def _ref_hybrid(spark, d):
    return references.Hybrid(tables.lineitem_matrix(spark, d)).references(THREADS)


def _csr_kernel(spark, d):
    return references.Csr(tables.lineitem_matrix(spark, d))


@query("interleave", f"with refs as ({ORACLES['ref_csr']}) select row_number() over (order by t, thread) - 1 as pos, thread, addr // 64 as line, domain from refs")
def _interleaved(spark, d):
    refs = _csr_kernel(spark, d).references(THREADS).select("thread", "t", "addr", "domain")
    active = spark.createDataFrame([("all", t, 64) for t in range(T)], "group string, thread int, line_size long")
    return caches.interleave(refs, active).select("pos", "thread", "line", "domain")


def _stream_sql(refs: str, config: TraceConfig, warmup: bool = False) -> str:
    """CTEs: rp, what each group of caches sees (grp, thread, domain, line, pos, counted); caches (cache, grp, lines)."""
    active, kept = trace.groups(config)
    again = "union all select grp, thread, domain, line, pos, false from st" if warmup else ""
    return f"""
with refs as ({refs}),
act(grp, thread, line_size) as (values {', '.join(f"('{g}', {t}, {z})" for g, t, z in active)}),
caches(cache, grp, lines) as (values {', '.join(f"('{c}', '{g}', {n})" for c, g, n in kept)}),
st as (
  select grp, thread, {list(config.domains)}[domain + 1]::integer as domain, addr // line_size as line,
         row_number() over (partition by grp order by t, thread) - 1 as pos, count(*) over (partition by grp) as n
  from refs join act using (thread)
),
rp as (select grp, thread, domain, line, pos + {int(warmup)} * n as pos, true as counted from st {again})"""


#: A reference's distance is its gap less the references in between whose line came again in between: pairs out of order in (pos,
#: prev), counted bit by bit of pos among those whose higher bits are equal.
_DISTANCES = """,
pv as (select *, lag(pos) over (partition by grp, line order by pos) as prev from rp),
lv as (select grp, pos, prev, l, (pos >> l) & 1 as bit, pos >> (l + 1) as block from pv, range(0, 23) r(l) where prev is not null),
dm as (
  select grp, pos, sum(n) as n
  from (select grp, pos, bit, sum(1 - bit) over (partition by grp, l, block order by prev desc rows between unbounded preceding and 1 preceding) as n from lv)
  where bit = 1 group by grp, pos
),
sd as (select pv.*, (pv.pos - pv.prev - 1 - coalesce(dm.n, 0))::bigint as distance from pv left join dm using (grp, pos))"""


def _grid_sql(found: str, config: TraceConfig) -> str:
    """found: (cache, thread, domain, misses). A row for each cache, thread and domain."""
    return f"""
select c.cache, th.thread::integer as thread, dom.domain::integer as numa_domain, coalesce(m.misses, 0)::bigint as misses
from caches c cross join range(0, {len(config.threads)}) th(thread) cross join range(0, {config.num_numa_domains}) dom(domain)
left join ({found}) m on m.cache = c.cache and m.thread = th.thread and m.domain = dom.domain"""


def _lru_sql(refs: str, warmup: bool = False) -> str:
    found = "select cache, thread, domain, count(*) as misses from sd join caches using (grp) where counted and (prev is null or distance >= lines) group by all"
    return _stream_sql(refs, CONFIG, warmup) + _DISTANCES + _grid_sql(found, CONFIG)


@query("lru_misses", _lru_sql(_csr_refs(len(CONFIG.threads))))
def _lru(spark, d):
    return trace.cache_misses(CONFIG, _csr_kernel(spark, d))


@query("lru_misses_warmup", _lru_sql(_csr_refs(len(CONFIG.threads)), True))
def _lru_warm(spark, d):
    return trace.cache_misses(CONFIG, _csr_kernel(spark, d), warmup=True)


@query("lru_misses_coo", _lru_sql(_coo_refs(len(CONFIG.threads))))
def _lru_coo(spark, d):
    return trace.cache_misses(CONFIG, references.Coo(tables.lineitem_matrix(spark, d)))


_ALL = "0,1,2,3/128"


@query("lru_stack_distances", _stream_sql(_csr_refs(len(CONFIG.threads)), CONFIG) + _DISTANCES + f" select distance, count(*)::bigint as refs from sd where grp = '{_ALL}' group by distance")
def _distances(spark, d):
    refs = _csr_kernel(spark, d).references(references.Threads(CONFIG.domains))
    its = [(t, z) for g, t, z in trace.groups(CONFIG)[0] if g == _ALL]
    return caches.distance_counts(refs.select("thread", "t", "addr", "domain"), [t for t, _ in its], its[0][1])


@query("fifo_misses")
def _fifo(spark, d):
    return trace.cache_misses(CONFIG, _csr_kernel(spark, d), policy="fifo")


@query("rand_misses")
def _rand(spark, d):
    return trace.cache_misses(CONFIG, _csr_kernel(spark, d), policy="rand")


#: Regions x nations: more threads than blocks of rows, so that one is idle.
_NATIONS = """
with dims as (select (select max(r_regionkey) + 1 from region)::bigint as nr, (select max(n_nationkey) + 1 from nation)::bigint as nc, (select count(*) from nation)::bigint as nnz),
e as (select row_number() over (order by n_regionkey, n_nationkey) - 1 as k, n_regionkey::bigint as i, n_nationkey::bigint as j, 1.0::double as a from nation),
s as (select k, i, j, a from e),
rws as (select unnest(range(0, (select nr from dims))) as i)
"""


#: Lines that caches hold from the start, the oldest first.
INITIAL = (64, 0, 1)


def _replay_sql(hit: str, warmup: bool, initial: tuple[int, ...] = ()) -> str:
    """A cache's lines in the order in which they go, reference by reference. hit: what a hit makes of them."""
    found = "select cache, thread, domain, sum(miss) as misses from run where counted group by all"
    sql = _stream_sql(_csr_refs(len(SMALL.threads), _NATIONS), SMALL, warmup).replace("with refs as", "with recursive refs as", 1)
    return sql + f""",
run as (
  select cache, grp, lines, -1::bigint as pos, list_slice({list(initial)}::bigint[], -lines, -1) as held, 0 as miss, 0 as thread, 0 as domain, false as counted from caches
  union all
  select run.cache, run.grp, run.lines, rp.pos,
         case when list_contains(held, rp.line) then {hit} when len(held) < run.lines then list_append(held, rp.line) else list_append(held[2:], rp.line) end,
         case when list_contains(held, rp.line) then 0 else 1 end, rp.thread, rp.domain, rp.counted
  from run join rp on rp.grp = run.grp and rp.pos = run.pos + 1
)""" + _grid_sql(found, SMALL)


def _nation_kernel(spark, d):
    return references.Csr(tables.nation_matrix(spark, d))


@query("fifo_misses_small", _replay_sql("held", False))
def _fifo_small(spark, d):
    return trace.cache_misses(SMALL, _nation_kernel(spark, d), policy="fifo")


@query("fifo_misses_small_warmup", _replay_sql("held", True))
def _fifo_small_warm(spark, d):
    return trace.cache_misses(SMALL, _nation_kernel(spark, d), warmup=True, policy="fifo")


_TO_END = "list_append(list_filter(held, lambda x: x <> rp.line), rp.line)"


@query("lru_misses_small", _replay_sql(_TO_END, False))
def _lru_small(spark, d):
    return trace.cache_misses(SMALL, _nation_kernel(spark, d))


@query("lru_replayed_small", _replay_sql(_TO_END, True))
def _lru_replayed(spark, d):
    """The replacement policy run as a state machine, warmed up."""
    refs, kept = trace.stream(SMALL, _nation_kernel(spark, d), True)
    return caches.full_grid(caches.simulate(refs, kept, "lru"), kept, len(SMALL.threads), SMALL.num_numa_domains)


def _initial(spark):
    rows = [(g, age, line) for g in sorted({g for _, g, _ in trace.groups(SMALL)[1]}) for age, line in enumerate(INITIAL)]
    return spark.createDataFrame(rows, "group string, age long, line long")


@query("lru_misses_initial", _replay_sql(_TO_END, False, INITIAL))
def _lru_initial(spark, d):
    return trace.cache_misses(SMALL, _nation_kernel(spark, d), initial=_initial(spark))


@query("fifo_misses_initial", _replay_sql("held", False, INITIAL))
def _fifo_initial(spark, d):
    return trace.cache_misses(SMALL, _nation_kernel(spark, d), policy="fifo", initial=_initial(spark))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_CACHES = f"(values {_values([(c.name, c.parent) for c in CONFIG.caches.values()])}) as caches(cache, parent)"
_FIRST = f"(values {_values([(n, t.cache) for n, t in enumerate(CONFIG.threads)])}) as t(thread, first)"
_CLOSURE = f"with recursive up(cache, ancestor) as (select cache, cache from {_CACHES} union all select up.cache, parent from up join {_CACHES} on caches.cache = up.ancestor where parent is not null) "


@query("cache_ancestors", _CLOSURE + "select cache, ancestor from up")
def _ancestors(spark, d):
    return spark.createDataFrame([(c, a) for c in CONFIG.caches for a in CONFIG.ancestors(c)], "cache string, ancestor string")


@query("active_threads", _CLOSURE + f"select ancestor as cache, thread::integer as thread from up join {_FIRST} on up.cache = t.first")
def _active(spark, d):
    return spark.createDataFrame([(c, t) for c in CONFIG.caches for t in CONFIG.active_threads(c)], "cache string, thread int")


@query("cache_lines", f"select cache, ((size + line_size - 1) // line_size)::bigint as lines, (max(size) over ())::bigint as max_cache_size from (values {_values([(c.name, c.size, c.line_size) for c in CONFIG.caches.values()])}) as c(cache, size, line_size)")
def _cache_lines(spark, d):
    return CONFIG.caches_frame(spark).select("cache", div(F.col("size") + F.col("line_size") - 1, F.col("line_size")).alias("lines"), F.lit(CONFIG.max_cache_size()).cast("long").alias("max_cache_size"))


@query("config_caches", f"select cache, size::bigint as size, line_size::bigint as line_size, parent from (values {_values([(c.name, c.size, c.line_size, c.parent) for c in CONFIG.caches.values()])}) as c(cache, size, line_size, parent)")
def _config_caches(spark, d):
    return tables.config_file(spark).caches_frame(spark).select("cache", "size", "line_size", "parent")


@query("config_threads", f"select thread::integer as thread, cpu::integer as cpu, cache, numa_domain::integer as numa_domain from (values {_values([(n, t.cpu, t.cache, t.numa_domain) for n, t in enumerate(CONFIG.threads)])}) as t(thread, cpu, cache, numa_domain)")
def _config_threads(spark, d):
    return tables.config_file(spark).threads_frame(spark).select("thread", "cpu", "cache", "numa_domain")


def _report_sql() -> str:
    """The report's lines: those of the configuration and the kernel's names are fixed, its numbers and the misses are counted."""
    config = json.dumps(CONFIG.as_json(), separators=(",", ":")).replace("'", "''")
    reached = [c for c in sorted(CONFIG.caches) if CONFIG.active_threads(c)]
    empty = ", ".join(f"('{c}', '[]')" for c in sorted(CONFIG.caches) if c not in reached)
    return f"""
with m as ({ORACLES['lru_misses']}),
r as (select cache, thread, '[' || string_agg(misses::varchar, ',' order by numa_domain) || ']' as r from m group by cache, thread),
c as (select cache, '[' || string_agg(r, ',' order by thread) || ']' as v from r group by cache union all select * from (values {empty}) as e(cache, v)),
z as ({ORACLES['matrix_sizes']}),
d as (select (select max(o_orderkey) + 1 from orders) as nr, (select max(p_partkey) + 1 from part) as nc, (select count(*) from lineitem) as nnz)
select '{{"trace_config":{config},"kernel":{{"name":"csr-spmv","matrix_path":"","matrix_format":"csr","rows":' || nr || ',"columns":' || nc || ',"nonzeros":' || nnz || ',"matrix_size":' || size
       || ',"x_size":' || nc * 8 || ',"y_size":' || nr * 8 || '}},"warmup":false,"cache_misses":{{' || (select string_agg('"' || cache || '":' || v, ',' order by cache) from c) || '}}}}' as json
from d, z where z.format = 'csr'"""


@query("trace_report", _report_sql())
def _trace_report(spark, d):
    kernel = _csr_kernel(spark, d)
    found = report.trace(CONFIG, kernel.info(), False, trace.cache_misses(CONFIG, kernel))
    return spark.createDataFrame([(json.dumps(json.loads(report.pretty(found)), separators=(",", ":")),)], "json string")
