"""Trace configurations: caches, threads and event groups from JSON, checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import TraceConfigError


@dataclass(frozen=True)
class Cache:
    name: str
    size: int
    line_size: int
    bandwidth: float | None = None
    bandwidth_per_numa_domain: tuple[float, ...] = ()
    cache_miss_event: str | None = None
    parent: str | None = None

    @property
    def lines(self) -> int:
        return -(-self.size // self.line_size)


@dataclass(frozen=True)
class EventGroup:
    pid: int = -1
    cpu: int = -1
    events: tuple[str, ...] = ()


@dataclass(frozen=True)
class Thread:
    cpu: int
    cache: str
    numa_domain: int
    event_groups: tuple[EventGroup, ...] = ()


@dataclass(frozen=True)
class TraceConfig:
    name: str
    description: str
    num_numa_domains: int
    bandwidth_per_numa_domain: tuple[float, ...] = ()
    caches: dict[str, Cache] = field(default_factory=dict)
    threads: tuple[Thread, ...] = ()

    def __post_init__(self) -> None:
        for c in self.caches.values():
            if c.line_size < 1 or c.size < 1 or c.size % c.line_size:
                raise TraceConfigError(f"cache {c.name}: the size {c.size} is not a multiple of the line size {c.line_size}")
            if c.parent is not None and c.parent not in self.caches:
                raise TraceConfigError(f"cache {c.name}: unknown parent {c.parent}")
        for name in self.caches:
            self.ancestors(name)
        for n, t in enumerate(self.threads):
            if t.cache not in self.caches:
                raise TraceConfigError(f"thread {n}: unknown cache {t.cache}")
            if not 0 <= t.numa_domain < self.num_numa_domains:
                raise TraceConfigError(f"thread {n}: NUMA domain {t.numa_domain} is not one of {self.num_numa_domains}")

    def ancestors(self, cache: str) -> list[str]:
        """The cache itself, its parent and so on."""
        out: list[str] = []
        at: str | None = cache
        while at is not None:
            if at in out:
                raise TraceConfigError(f"cache {cache}: its parents go in a circle")
            out.append(at)
            at = self.caches[at].parent
        return out

    def active_threads(self, cache: str) -> list[int]:
        """Threads whose references reach the cache."""
        return [n for n, t in enumerate(self.threads) if cache in self.ancestors(t.cache)]

    def max_cache_size(self) -> int:
        return max((c.size for c in self.caches.values()), default=0)

    @property
    def domains(self) -> tuple[int, ...]:
        return tuple(t.numa_domain for t in self.threads)

    def caches_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.size, c.line_size, c.bandwidth, list(c.bandwidth_per_numa_domain), c.cache_miss_event, c.parent) for c in self.caches.values()]
        return spark.createDataFrame(rows, "cache string, size long, line_size long, bandwidth double, bandwidth_per_numa_domain array<double>, cache_miss_event string, parent string")

    def threads_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, t.cpu, t.cache, t.numa_domain, [(g.pid, g.cpu, list(g.events)) for g in t.event_groups]) for n, t in enumerate(self.threads)]
        return spark.createDataFrame(rows, "thread int, cpu int, cache string, numa_domain int, event_groups array<struct<pid:int,cpu:int,events:array<string>>>")

    def as_json(self) -> dict:
        return {
            "name": self.name,
            "description": self.description,
            "num_numa_domains": self.num_numa_domains,
            "bandwidth_per_numa_domain": list(self.bandwidth_per_numa_domain) or None,
            "caches": {n: {"size": c.size, "line_size": c.line_size, "bandwidth": c.bandwidth, "bandwidth_per_numa_domain": list(c.bandwidth_per_numa_domain) or None, "cache_miss_event": c.cache_miss_event, "parent": c.parent} for n, c in sorted(self.caches.items())},
            "thread_affinities": [{"cpu": t.cpu, "cache": t.cache, "numa_domain": t.numa_domain, "event_groups": [{"pid": g.pid, "cpu": g.cpu, "events": list(g.events)} for g in t.event_groups]} for t in self.threads],
        }


def _need(where: str, obj: dict, key: str, kind):
    if key not in obj:
        raise TraceConfigError(f"{where}: {key} is missing")
    value = obj[key]
    if isinstance(value, bool) or not isinstance(value, kind):
        raise TraceConfigError(f"{where}: {key} is not of the right type")
    return value


def _may(where: str, obj: dict, key: str, kind):
    return None if obj.get(key) is None else _need(where, obj, key, kind)


#: Keys that may be null; fixed values of the format.
NULLABLE = ("bandwidth", "bandwidth_per_numa_domain", "cache_miss_event", "parent")


def parse(text: str, strict: bool = False) -> TraceConfig:
    """Nullable keys of a cache may be left out, unless strict: then each has to be there. Event groups may be objects or plain
    lists of events."""
    try:
        top, _ = json.JSONDecoder().raw_decode(text.lstrip())  # what follows the first element is ignored
    except json.JSONDecodeError as e:
        raise TraceConfigError(f"{e.lineno}:{e.colno}: {e.msg}") from e
    if not isinstance(top, dict):
        raise TraceConfigError("the configuration is not an object")
    number = (int, float)
    caches = {}
    for name, c in _need("configuration", top, "caches", dict).items():
        at = f"cache {name}"
        if not isinstance(c, dict):
            raise TraceConfigError(f"{at} is not an object")
        if strict and (missing := [k for k in NULLABLE if k not in c]):
            raise TraceConfigError(f"{at}: {missing[0]} is missing")
        per = _may(at, c, "bandwidth_per_numa_domain", list) or []
        caches[name] = Cache(name, int(_need(at, c, "size", number)), int(_need(at, c, "line_size", number)), _may(at, c, "bandwidth", number), tuple(map(float, per)), _may(at, c, "cache_miss_event", str), _may(at, c, "parent", str))
    threads = []
    for n, t in enumerate(_need("configuration", top, "thread_affinities", list)):
        at = f"thread {n}"
        if not isinstance(t, dict):
            raise TraceConfigError(f"{at} is not an object")
        groups = []
        for g in _may(at, t, "event_groups", list) or []:
            groups.append(EventGroup(events=tuple(g)) if isinstance(g, list) else EventGroup(int(_need(at, g, "pid", number)), int(_need(at, g, "cpu", number)), tuple(_need(at, g, "events", list))))
        threads.append(Thread(int(_need(at, t, "cpu", number)), _need(at, t, "cache", str), int(_need(at, t, "numa_domain", number)), tuple(groups)))
    per = _may("configuration", top, "bandwidth_per_numa_domain", list) or []
    named = [v if isinstance(v := top.get(k), str) else "" for k in ("name", "description")]
    return TraceConfig(*named, int(_may("configuration", top, "num_numa_domains", number) or 0), tuple(map(float, per)), caches, tuple(threads))


def read(spark: SparkSession, path: str, strict: bool = False) -> TraceConfig:
    """From any path that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise TraceConfigError(f"{path}: expected one file")
    try:
        return parse(rows[0][0], strict)
    except TraceConfigError as e:
        raise TraceConfigError(f"{path}: {e}") from e
