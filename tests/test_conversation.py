"""Tool calls and chats on literals; every registered query on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from circuitlake.operators import conversation as conv

SMALL = "/root/testdata/sf0.001"


def test_tool_calls(spark):
    texts = [
        (1, 'think <tool_call>{"name": "sim.dc", "arguments": {"netlist": "x"}}</tool_call> and <tool_call>{"name": "a", "arguments": {},}</tool_call>'),
        (2, "<tool_call>{'name': 'b', 'arguments': {}}</tool_call>"), (3, "<tool_call>[1]</tool_call>"), (4, "<tool_call>{oops</tool_call>"),
        (5, '<function=sim.ac>{"netlist": 1}</function>'), (6, '<tool_call>{"name": "c", "arguments": 3}</tool_call>'), (7, None), (8, ""),
        (9, '<tool_call>{"arguments": {}}</tool_call>'),
    ]
    got = {(r.id, r.call): (r.method, r["name"], r.error) for r in conv.parse_calls(spark.createDataFrame(texts, "id int, content string"), ["id"]).collect()}
    assert got[(1, 0)] == ("chatml", "sim.dc", None) and got[(1, 1)] == ("chatml", "a", None) and got[(2, 0)] == ("chatml", "b", None)
    assert got[(3, 0)][2] == "not_object" and got[(4, 0)][2] == "not_json" and got[(5, 0)] == ("xml", "sim.ac", None) and got[(6, 0)][2] == "bad_arguments" and got[(9, 0)][2] == "no_name"
    assert not {7, 8} & {k for k, _ in got}


def test_normalizing_chats(spark):
    schema = "id int, messages array<struct<role: string, content: string>>"
    rows = [(1, None), (2, []), (3, [("user", "x")]), (4, [("system", conv.SYSTEM_PROMPT)]), (5, [("system", "old"), ("user", None)])]
    got = {r.id: (r.a, None if r.m is None else [tuple(x) for x in r.m]) for r in spark.createDataFrame(rows, schema).select("id", conv.normalize_action().alias("a"), conv.normalized().alias("m")).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["no_messages", "no_messages", "inserted", "already_canonical", "rewritten"]
    assert got[3][1][0] == ("system", conv.SYSTEM_PROMPT) and got[5][1] == [("system", conv.SYSTEM_PROMPT), ("user", None)]


def test_step_errors(spark):
    schema = "run_id int, step int, role string, action struct<name: string, arguments: struct<q: string>>, observation string"
    rows = [(1, 0, "tool", None, None), (1, 1, "assistant", ("x", None), None), (1, 2, "user", ("x", ("q",)), None), (1, 3, "alien", None, None)]
    got = {(r.step, r.error) for r in conv.step_errors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, "tool_without_result"), (0, "early_tool"), (1, "bad_call"), (2, "call_by_other"), (3, "bad_role")}


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0


CORE = [n for n in entry.queries() if not n.startswith("p") or n.startswith("p4")]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(SMALL + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    norm = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    want = sorted(tuple(norm(v) for _, v in sorted(zip(names, row, strict=True))) for row in rel.fetchall())
    df = entry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", [n for n in CORE if n not in entry.oracle_sql()])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() >= 0


def test_lenient_json(spark):
    rows = spark.createDataFrame([('{"a": 1,}',), ("{'a': 1}",), ("nope",), (None,)], "t string").select(conv.lenient_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in rows] == ['{"a": 1}', '{"a": 1}', None, None]
