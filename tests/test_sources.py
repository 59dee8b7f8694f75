import gzip
import io
import json
import tarfile

import pytest

from memlattice.errors import MatrixError, TraceConfigError
from memlattice.functions.scalars import member_name, reorder_suffix, tar_number, wrap_text
from memlattice.operators import references, reorder
from memlattice.plans import tables, trace
from memlattice.sources import config, mtx, report

from .matrices import M7, M8, make

HEAD = "%%MatrixMarket matrix coordinate {} general\n% Test matrix\n1 1 1\n"


def put(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("kind, line, value", [("real", "1 1 0.5", 0.5), ("complex", "1 1 0.5 -0.5", 0.5), ("integer", "1 1 5", 5.0), ("pattern", "1 1", 1.0), ("Double", "1 1 2", 2.0)])
def test_fields(spark, tmp_path, kind, line, value):
    mm = mtx.read(spark, put(tmp_path / "test.mtx", HEAD.format(kind) + line + "\n"))
    assert mm.header.comments == ("% Test matrix",) and (mm.header.rows, mm.header.columns, mm.header.num_entries) == (1, 1, 1)
    assert [tuple(r) for r in mm.matrix().entries.collect()] == [(0, 0, 0, value)]
    if kind == "complex":
        assert mm.entries.first()["im"] == -0.5


def test_compressed(spark, tmp_path):
    text = (HEAD.format("real") + "1 1 0.5\n").encode()
    (tmp_path / "a.mtx.gz").write_bytes(gzip.compress(text))
    for name, mode in (("test.tar", "w"), ("test.tar.gz", "w:gz"), ("test.tgz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            info = tarfile.TarInfo("test/test.mtx")
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    for name in ("a.mtx.gz", "test.tar", "test.tar.gz", "test.tgz"):
        assert mtx.read(spark, str(tmp_path / name)).matrix().entries.first()["a"] == 0.5


@pytest.mark.parametrize("text", ["", "%%matrixmarket matrix coordinate real general\n1 1 0\n", "%%MatrixMarket matrix coordinate real odd\n1 1 0\n", HEAD.format("real"), HEAD.format("real") + "1 x 1\n", "%%MatrixMarket matrix coordinate real general\n1 1\n", "%%MatrixMarket matrix coordinate real general\n1 3000000000 1\n1 1 1\n"])
def test_malformed(spark, tmp_path, text):
    with pytest.raises(MatrixError):
        mtx.read(spark, put(tmp_path / "bad.mtx", text))


def test_dense_files_have_no_entries(spark, tmp_path):
    mm = mtx.read(spark, put(tmp_path / "d.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n"))
    assert mm.entries.count() == 0
    with pytest.raises(MatrixError):
        mm.matrix()


def test_further_lines_are_ignored(spark, tmp_path):
    assert mtx.read(spark, put(tmp_path / "t.mtx", HEAD.format("real") + "1 1 1\n1 1 7\n")).entries.count() == 1


@pytest.mark.parametrize("name", ["m.mtx", "m.mtx.gz"])
def test_round_trip(spark, tmp_path, name):
    m = make(spark, M7)
    mtx.write(mtx.of(m, ("% made here",)), str(tmp_path / name))
    back = mtx.read(spark, str(tmp_path / name))
    assert back.header.comments == ("% made here",) and back.matrix().same_as(m)


def test_header_only(spark):
    assert mtx.lines_of(mtx.of(make(spark, M8)), write_entries=False).count() == 2


def test_reordering_on_load(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate real general\n4 4 6\n1 4 1\n4 1 1\n4 2 1\n2 4 1\n2 3 1\n3 2 1\n"
    path = put(tmp_path / "p.mtx", text)
    m = mtx.load(spark, path + "__RCM")
    assert m.bandwidth().first()[0] == 1 and mtx.load(spark, path).bandwidth().first()[0] == 3
    assert mtx.load(spark, path + "__GP").same_as(mtx.load(spark, path))
    parted = mtx.load(spark, path + "__GP4")
    plain = mtx.load(spark, path)
    assert parted.same_as(plain.permuted(reorder.graph_partition(plain, n=4))) and not parted.same_as(plain)


def test_names():
    assert reorder_suffix("a/b.mtx__GP8__RCM") == ("a/b.mtx", "rcm+gp", 8)
    assert reorder_suffix("a/b.mtx") == ("a/b.mtx", None, 0)
    assert member_name("x/abc.tar.gz") == "abc/abc.mtx"
    assert tar_number(b"0000644\0") == 0o644 and tar_number(b"\x80\0\0\0\0\0\1\0") == 256
    assert wrap_text("a bc def", 4) == "a bc\ndef"


def broken(**change):
    c = json.loads(tables.config_text())
    for k, v in change.items():
        at = c
        *way, last = k.split("__")
        for w in way:
            at = at[int(w)] if w.isdigit() else at[w]
        if v is None and last in at:
            del at[last]
        else:
            at[last] = v
    return json.dumps(c)


@pytest.mark.parametrize("text", ["[", "[]", "{}", broken(caches__all__size=100), broken(caches__all__parent="none"), broken(caches__all__parent="a0"), broken(thread_affinities__0__cache="L9"), broken(thread_affinities__0__numa_domain=2), broken(thread_affinities__0__numa_domain=-1), broken(caches__all__size=None), broken(thread_affinities__0__cpu="x")])
def test_bad_configurations(text):
    with pytest.raises(TraceConfigError):
        config.parse(text)


def test_configuration(spark, tmp_path):
    c = config.read(spark, put(tmp_path / "c.json", tables.config_text() + " trailing"))
    assert config.parse(json.dumps(c.as_json())) == c
    assert c.active_threads("all") == [0, 1, 2, 3] and c.active_threads("right") == [2, 3] and c.active_threads("spare") == [] and c.max_cache_size() == 1048576
    assert c.ancestors("a0") == ["a0", "left", "all"]
    assert c.caches_frame(spark).count() == 8 and c.threads_frame(spark).count() == 4
    plain = config.parse(broken(thread_affinities__0__event_groups=[["cycles", "misses"], {"pid": 1, "cpu": 2, "events": ["x"]}]))
    assert plain.threads[0].event_groups[0].events == ("cycles", "misses")


def test_nullable_keys_have_to_be_there_if_asked():
    whole, cut = tables.config_text(), broken(caches__all__cache_miss_event=None)
    assert "cache_miss_event" not in json.loads(cut)["caches"]["all"]
    assert config.parse(whole, strict=True) == config.parse(whole) and config.parse(cut).caches["all"].cache_miss_event is None
    with pytest.raises(TraceConfigError, match="cache_miss_event"):
        config.parse(cut, strict=True)


def test_files_are_equal_with_their_headers(spark):
    a = mtx.of(make(spark, M8), ("% one",))
    assert a.same_as(mtx.of(make(spark, M8), ("% one",))) and not a.same_as(mtx.of(make(spark, M8))) and not a.same_as(mtx.of(make(spark, M7), ("% one",)))


def test_reports(spark):
    c, k = tables.config(), references.Csr(make(spark, M7), "m7.mtx")
    r = json.loads(report.pretty(report.trace(c, k.info(), True, trace.cache_misses(c, k, warmup=True))))
    assert r["warmup"] is True and r["kernel"]["matrix_size"] == 7 * 12 + 5 * 4 and list(r["cache_misses"]) == sorted(c.caches)
    assert r["cache_misses"]["a0"] == [[0, 0]] * 4 and r["cache_misses"]["spare"] == []
    cold = report.miss_matrices(trace.cache_misses(c, k), c)
    assert cold["all"][0][0] > 0 and cold["b2"][2][1] > 0
    times = trace.timed(spark, k, 3)
    rows = [(0, 0, "view", 1), (1, 0, "view", 3), (0, 0, "unlisted", 9), (0, 1, "click", 5)]
    p = report.profile(c, k.info(), times, spark.createDataFrame(rows, "run int, thread int, event string, count long"))
    found = [(e["thread"], e["name"], e["counts"]["samples"], e["counts"]["median"]) for e in p["profiling_events"]]
    assert p["execution_time"]["samples"] == 3 and found == [(0, "view", 2, 3), (0, "view", 2, 3), (1, "click", 1, 5)]  # two groups of thread 0 list it
    assert '"nan"' in report.pretty({"a": [float("nan")]})
    assert references.Hybrid(make(spark, M8)).info()["ell_row_length"] == 2 and references.Triad(spark, 4).info() == {"name": "triad", "num_entries": "4"}


@pytest.mark.parametrize("name", ["many.mtx", "many.mtx.gz"])
def test_lines_are_written_side_by_side(spark, tmp_path, monkeypatch, name):
    """No task gets all lines, and the parts stand behind one another in their order."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    def refused(*_):
        raise AssertionError("one task writes all lines")

    monkeypatch.setattr(Frame, "coalesce", refused)
    m = make(spark, (50, 40, [(n % 50, n * 7 % 40, n) for n in range(2000)]))
    path = tmp_path / name
    mtx.write(mtx.of(m), str(path))
    mtx.write(mtx.of(m), str(path))  # in place of the file that is there
    lines = (gzip.open if name.endswith(".gz") else open)(path, "rt").read().splitlines()
    assert lines[:2] == ["%%MatrixMarket matrix coordinate real general", "50 40 2000"]
    assert lines[2:] == [f"{n % 50 + 1} {n * 7 % 40 + 1} {float(n)}" for n in range(2000)]
    assert mtx.read(spark, str(path)).matrix().same_as(m)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [name]
