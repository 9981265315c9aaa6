"""Run collapsing against brute force."""

import random

import pytest

from circuitlake.llm import repeats

EVENT = "seq long, ord long, key string, ts timestamp, arrived timestamp"


def brute(rows):
    best = {}
    for seq, order, key, _, _ in rows:
        if seq is not None and order is not None:
            best.setdefault((seq, order), key)
    out, prev = [], None
    for (seq, order), key in sorted(best.items()):
        if key is None:
            prev = None
        elif prev and prev[0] == seq and prev[1] == key:
            prev[3], prev[4] = order, prev[4] + 1
        else:
            prev = [seq, key, order, order, 1]
            out.append(prev)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_runs_across_blocks(spark, block):
    import datetime as dt

    random.seed(block)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, o, random.choice(["a", "a", "b", None]), t0 + dt.timedelta(seconds=o), t0) for s in range(6) for o in range(40) if random.random() < 0.8]
    rows += random.sample(rows, 20) + [(None, 1, "a", None, None), (1, None, "a", None, None)]
    random.shuffle(rows)
    got = repeats.collapse(spark.createDataFrame(rows, EVENT), block).collect()
    assert sorted((r.seq, r.key, r.first_ord, r.last_ord, r.n_events) for r in got) == brute(rows)
    assert all(r.duration_s == r.last_ord - r.first_ord for r in got)


def test_null_times_and_empty(spark):
    got = repeats.collapse(spark.createDataFrame([(1, 1, "a", None, None), (1, 2, "a", None, None)], EVENT)).collect()
    assert len(got) == 1 and got[0].n_events == 2 and got[0].duration_s is None
    assert repeats.collapse(spark.createDataFrame([], EVENT)).count() == 0


def test_actions(spark):
    schema = "run_id long, task_id string, step int, role string, content string, action struct<name: string, arguments: struct<netlist: string, changes: string, query: string>>, observation string, reward double, done boolean, ts timestamp, received_at timestamp, seq string, key string"
    deck = "title\nR1 a b 1k\n.end"
    same = "other\nr1 A B 1000 ; x\n"
    acts = [("sim.dc", (deck, None, None)), ("sim.dc", (same, "changed", None)), None, ("sim.dc", (same, None, None)), ("sim.ac", (same, None, None)),
            ("sim.ac", ("/a/x.cir", None, None)), ("sim.ac", ("C:\\b\\X.CIR", None, None)), ("q", (None, None, "w")), ("q", (" ", None, "w")), ("q", None), (None, (deck, None, None))]
    rows = [(5, "t", i * 2, None, None, a, None, None, None, None, None, "clash", "clash") for i, a in enumerate(acts)]
    got = sorted((r.first_step, r.last_step, r.n_events) for r in repeats.repeated_actions(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 2, 2), (6, 6, 1), (8, 8, 1), (10, 12, 2), (14, 16, 2), (18, 18, 1)]
