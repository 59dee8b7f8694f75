import json

import pytest
from pyspark.sql import functions as F

from memlattice.__main__ import main
from memlattice.functions import json_tree as J
from memlattice.operators.caches import Lru
from memlattice.plans import tables
from memlattice.sources import events


def test_json_kinds(spark):
    docs = ["null", "true", "false", "1.5e1", '"a\\tb"', "[1, 2, {}]", '{"b": 1, "a": [true]}', "{]", None, "[]", "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "n long, t string").withColumn("v", J.parsed(F.col("t")))
    v = F.col("v")
    rows = df.select("n", J.kind(v), J.array_size(v), J.object_size(v), J.keys(v), J.number(v), J.whole(v), J.string(v), J.kind(J.member(v, "a")), J.whole(J.element(v, 1)), J.kind(J.element(v, 9))).orderBy("n").collect()
    got = [tuple(r)[1:] for r in rows]
    assert [g[0] for g in got] == ["null", "true", "false", "number", "string", "array", "object", None, None, "array", "object"]
    assert [g[1] for g in got] == [None] * 5 + [3] + [None] * 3 + [0, None] and [g[2] for g in got][6] == 2 and got[10][2] == 0
    assert got[6][3] == ["a", "b"] and got[3][4] == 15.0 and got[3][5] == 15 and got[4][6] == "a\tb"
    assert got[6][7] == "array" and got[5][8] == 2 and got[5][9] is None


@pytest.fixture
def files(tmp_path):
    (tmp_path / "c.json").write_text(tables.config_text())
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 4\n1 1 1\n2 3 2\n3 1 1\n3 3 1\n")
    return str(tmp_path / "c.json"), str(tmp_path / "m.mtx")


@pytest.mark.parametrize("kind", ["csr", "hybrid"])
def test_command_line_traces(spark, files, capsys, kind):
    config, matrix = files
    assert main(["-c", config, "-m", matrix, "--spmv-format", kind]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["kernel"]["matrix_format"] == kind and out["kernel"]["nonzeros"] == 4 and out["cache_misses"]["all"][0][0] > 0


def test_command_line_triad_and_errors(spark, files, capsys):
    config, matrix = files
    assert main(["-c", config, "--triad", "100"]) == 0
    misses = json.loads(capsys.readouterr().out)["cache_misses"]
    assert sum(map(sum, misses["a0"])) == 3 * 4  # three arrays of 25 elements, 200 bytes, on 64-byte lines
    assert main(["-c", matrix]) == 1 and "memlattice:" in capsys.readouterr().err
    assert main(["-c", config, "-m", config, "--spmv-format", "csr"]) == 1
    assert main(["-c", config, "-m", matrix, "--spmv-format", "mkl-csr"]) == 1


def test_command_line_errors_of_files_and_arguments(spark, files, capsys):
    config, matrix = files
    assert main(["-c", config + ".none"]) == 1 and main(["-c", config, "-m", matrix + ".none", "--spmv-format", "csr"]) == 1
    assert capsys.readouterr().err.count("memlattice:") == 2
    with pytest.raises(SystemExit):
        main(["--triad", "4"])


def test_command_line_lists_events_and_profiles(spark, files, tmp_path, capsys):
    rows = [("cpu", "cycles", "Counts cycles. " * 9, None, None), ("cpu", "loads", "Loads", "hit", "those that hit"), ("cpu", "loads", "Loads", "all", None), ("mem", "reads", None, "a-very-long-attribute-name", "words " * 20)]
    spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events")
    assert main(["--list-perf-events", f"{tmp_path}/events"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert [x for x in out if x.startswith("#")] == ["## cpu", "## mem"] and max(map(len, out)) <= events.WIDTH
    assert out[2].startswith("- `cycles`: Counts cycles.") and out[3].startswith("  cycles. Counts")
    at = out.index("- `loads`: Loads")
    assert out[at : at + 3] == ["- `loads`: Loads", "  - `all`", "  - `hit`: those that hit"] and "- `reads`" in out
    spark.createDataFrame([(0, 0, "view", 10, 4, 2), (1, 0, "view", 10, 4, 4)], "run int, thread int, event string, count long, time_enabled long, time_running long").write.parquet(f"{tmp_path}/counters")
    config, matrix = files
    assert main(["-c", config, "-m", matrix, "--spmv-format", "coo", "-p", "2", "--events", f"{tmp_path}/counters"]) == 0
    p = json.loads(capsys.readouterr().out)
    assert p["execution_time"]["samples"] == 2 and [e["counts"]["max"] for e in p["profiling_events"]] == [20, 20]


def test_json_constructors_and_problems(spark):
    made = J.object_(a=J.array(J.null(), J.boolean(F.lit(False)), J.from_number(F.lit(1.5))), b=J.from_string(F.lit('q"\n')), c=J.object_())
    x = spark.range(1).select(F.to_json(made).alias("j"), J.keys(made).alias("k"), J.array_size(J.member(made, "a")).alias("n")).first()
    assert json.loads(x["j"]) == {"a": [None, False, 1.5], "b": 'q"\n', "c": {}} and x["k"] == ["a", "b", "c"] and x["n"] == 3
    docs = ['{"a":1} tail', None, "", "[1,\n2\n,]", "nul"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(docs)), "n long, t string").orderBy("n").select(J.problem(F.col("t"))).collect()]
    assert got[:2] == [None, None] and got[2].startswith("1:1:") and got[3].startswith("3:") and got[4].startswith("1:1:")


def test_live_caches(spark, tmp_path):
    from memlattice.streaming.live_caches import live_misses

    stream = [(c, n, (n * n + len(c)) % 7) for c in ("a", "bb") for n in range(60)]
    for b in range(3):
        spark.createDataFrame([s for s in stream if s[1] // 20 == b], "cache string, pos long, line long").coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
    refs = spark.readStream.schema("cache string, pos long, line long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live_misses(refs, {"a": 3, "bb": 4}).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["cache"], r["references"]): r["misses"] for r in spark.table("live").collect()}
    for name, lines in (("a", 3), ("bb", 4)):
        cache, want = Lru(lines), 0
        for c, n, line in stream:
            if c == name:
                want += cache.allocate(line)
                if n % 20 == 19:
                    assert got[name, n + 1] == want


def test_rendering(spark):
    from memlattice.functions import render
    from memlattice.operators import formats, references

    from .matrices import M7, M8, M9, make

    assert render.coo(make(spark, M7).entries) == "[0 0 1 2 3 3 3] [0 1 1 2 0 3 4] [1 2 1 3 -1 2 1]"
    c = formats.csr(make(spark, M7))
    assert render.csr(c.ptr, c.entries) == "[0 2 3 4 7] [0 1 1 2 0 3 4] [1 2 1 3 -1 2 1]"
    assert render.ell(formats.ell(make(spark, M8))[0]).startswith("[0 1 3 0 1 1 2 2 2 3 4 4]")
    assert render.hybrid(*formats.hybrid(make(spark, M9))[:2]).endswith("[0 0] [3 4] [3 5]")
    assert render.references(references.Triad(spark, 1).references(references.Threads((0,)))) == "((4096, 0), (8192, 0), (0, 0))"
    assert render.indented("a\n\nb") == "  a\n\n  b"
