"""Readers, sinks and streams: round trips on small files."""

import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from circuitlake.sources import readers, sinks
from circuitlake.streaming import events as ev


def test_chat_files(spark, tmp_path):
    row = {"id": "a", "task_id": "t", "messages": [{"role": "user", "content": "hi"}], "score": 1.0, "success": True}
    (tmp_path / "one.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps({"id": "b"}) + "\n")
    (tmp_path / "train_x.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "skip.jsonl").write_text(json.dumps(row) + "\n")
    got = readers.chats(spark, str(tmp_path), ("skip.jsonl",)).collect()
    assert [(r.id, r["_source"]) for r in got] == [("a", "one.jsonl")]


def test_numbered_lines_survive_broken_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"messages": [{"role": "user", "content": "a"}]}\n\n{broken\n{"conversations": [{"from": "human", "value": "b"}]}\n')
    got = [(r.line, r.ok) for r in readers.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(1, True), (3, False), (4, True)]
    turns = {r.line: r.messages for r in readers.chat_lines(spark, str(tmp_path)).collect()}
    assert turns[4][0].role == "human" and turns[4][0].content == "b"


def test_task_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "analog").mkdir()
    (tmp_path / "analog" / "a.yaml").write_text("id: a\ncategory: analog\nsupply: 1.8\nspecs:\n  gain: {min: 60, unit: dB}\ncorners: [tt, ss]\ntemp_range: [-40, 125]\n")
    (tmp_path / "analog" / "b.yaml").write_text("- not a task\n")
    got = readers.tasks(spark, str(tmp_path), "analog").collect()
    assert len(got) == 1 and got[0].specs["gain"]["min"] == 60.0 and got[0].specs["gain"]["weight"] == 1.0 and got[0]["_file"] == "a.yaml"


def raw(points, complex_=False, cut=0):
    names = ["time", "v(out)"]
    head = f"Title: x\nFlags: {'complex' if complex_ else 'real'}\nNo. Variables: 2\nNo. Points: {len(points)}\nVariables:\n" + "".join(f"\t{i}\t{n}\tvoltage\n" for i, n in enumerate(names)) + "Binary:\n"
    body = b"".join(struct.pack("<dd", v.real, v.imag) if complex_ else struct.pack("<d", v) for p in points for v in p)
    return head.encode() + body[: len(body) - cut]


def test_raw_files(spark, tmp_path):
    (tmp_path / "r1.raw").write_bytes(raw([(0.0, 1.0), (1.0, 2.0), (2.0, float("inf"))]))
    (tmp_path / "bad.raw").write_bytes(b"nothing here")
    rows = readers.raw_results(spark, str(tmp_path))
    assert rows.count() == 6
    cut = readers.parse_raw(raw([(0.0, 1.0), (1.0, 2.0)], cut=4))
    assert cut[["variable", "i", "re"]].values.tolist() == [["time", 0, 0.0], ["v(out)", 0, 1.0], ["time", 1, 1.0]] and cut["im"].isna().all()
    assert readers.parse_raw(raw([(0j, 1 + 2j)], True)).values.tolist()[1] == ["v(out)", 0, 1.0, 2.0]
    # a vector that lost a sample is not as long as its axis
    assert readers.results(rows).count() == 0
    (tmp_path / "r2.raw").write_bytes(raw([(0.0, 1.0), (1.0, 2.0)]))
    got = readers.results(readers.raw_results(spark, str(tmp_path))).collect()
    assert [(r.run, r.variable, r.kind, [(s.x, s.y) for s in r.samples]) for r in got] == [("r2", "v(out)", "sweep", [(0.0, 1.0), (1.0, 2.0)])]


def test_tables_logs_reports_listing(spark, tmp_path):
    for d in ("csv", "log", "rep"):
        (tmp_path / d).mkdir()
    (tmp_path / "csv" / "t.csv").write_text("x,y\n1,2\n3,oops\n")
    got = {(r["name"], r.value) for r in readers.columns_csv(spark, str(tmp_path / "csv")).collect()}
    assert got == {("x", 1.0), ("y", 2.0), ("x", 3.0), ("y", None)}
    (tmp_path / "log" / "a.log").write_text("Warning: x\nError: y\nno convergence\n")
    r = readers.logs(spark, str(tmp_path / "log")).collect()[0]
    assert (r.converged, r.warnings, r.errors, r.failed) == (False, 1, 1, False)
    (tmp_path / "rep" / "r.json").write_text(json.dumps({"model": "m", "results": [{"task_id": "t", "passed": True, "final_score": 0.5, "steps": 3}]}, indent=1))
    assert readers.run_report(spark, str(tmp_path / "rep")).collect()[0].final_score == 0.5
    got = {r.suffix: r.files for r in readers.listing(spark, str(tmp_path), (".csv", ".log", ".xyz")).collect()}
    assert got == {".csv": 1, ".log": 1}


def test_mock_simulator(spark):
    spark.dataSource.register(readers.MockSimulator)
    tt = spark.read.format("mocksim").options(runs=2, points=11).load()
    ss = spark.read.format("mocksim").options(runs=2, points=11, corner="ss").load()
    j = tt.alias("a").join(ss.alias("b"), ["run", "i"]).select((F.col("b.y") - 0.8 * F.col("a.y")).alias("d"))
    assert tt.count() == 22 and j.agg(F.max(F.abs("d"))).collect()[0][0] < 1e-9


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "x", "s"), (2, "val", None, "s")], "id long, split string, text string, _private string")
    sinks.write_jsonl(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    sinks.write_splits(df, str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b"))
    assert set(back.columns) == {"id", "split", "text"} and back.filter("split = 'val'").count() == 1
    assert json.loads(sinks.manifest(df.select("id")))[1]["id"] == 2
    odd = spark.createDataFrame([(1.23456789, [float("nan"), 2.0], {"k": float("inf")}, (3.0,))], "a double, b array<double>, c map<string,double>, d struct<e:double>")
    r = sinks.json_safe(odd).collect()[0]
    assert r.a == 1.23457 and r.b == [None, 2.0] and r.c == {"k": None} and r.d.e == 3.0
    assert sinks.count_non_finite(odd, "b").collect()[0][0] == 1


def test_stream_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, value double"
    src = tmp_path / "in"
    src.mkdir()

    def put(name, rows):
        pd.DataFrame([(pd.Timestamp(t), u, e, v) for t, u, e, v in rows], columns=["ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(src / name)

    query = ev.tumbling(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    for name, rows in (("1.parquet", [("2024-01-01 00:05", 1, "a", 1.0)]), ("2.parquet", [("2024-01-01 03:00", 1, "a", 5.0)]), ("3.parquet", [("2024-01-01 00:10", 1, "a", 7.0), ("2024-01-01 06:00", 1, "a", 1.0)])):
        put(name, rows)
        query.processAllAvailable()
    query.stop()
    got = {(str(r.start), r.n, r.total) for r in spark.table("w").collect()}
    assert got == {("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 03:00:00", 1, 5.0)}


def test_stream_episodes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    query = ev.episodes(spark.readStream.schema("run_id long, step int, tool string, reward double").parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("ep").option("checkpointLocation", str(tmp_path / "cp")).start()
    for k in range(2):
        pd.DataFrame({"run_id": [1, 1, 2], "step": [2 * k, 2 * k + 1, k], "tool": ["sim.dc", "sim.dc", None], "reward": [0.5, 0.25, None]}).astype({"step": "int32"}).to_parquet(src / f"{k}.parquet")
        query.processAllAvailable()
    query.stop()
    last = {r.run_id: r for r in spark.sql("select * from ep order by steps").collect()}
    assert last[1].steps == 4 and last[1].total == 1.5 and last[1].stuck and last[2].best is None and not last[2].stuck


def test_trainer_logs_and_first_chats(spark, tmp_path):
    (tmp_path / "run" / "cp").mkdir(parents=True)
    (tmp_path / "run" / "cp" / "trainer_state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2}, {"step": 3, "loss": 1.0}]}, indent=1))
    assert sorted((r.step, r.loss) for r in readers.trainer_logs(spark, str(tmp_path)).collect()) == [(1, 2.0), (3, 1.0)]
    rows = [{"id": i, "messages": []} for i in ("b", "a", "c")]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    assert [r.id for r in readers.first_chats(spark, str(tmp_path / "x.jsonl"), 2).collect()] == ["a", "b"]
